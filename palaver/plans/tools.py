"""The query tools over a log (B15-B22, J4, X4): each returns a DataFrame; ``handle`` answers in JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.enrichment import Embedder
from palaver.functions.text import clip
from palaver.operators import graph as gr
from palaver.operators import retrieval as rt
from palaver.operators import state as st
from palaver.operators import timeline as tl
from palaver.operators.lineage import LineageTable, chains_of

#: Rows that one JSON answer carries at most, as a guard of the driver; DataFrames are not limited.
ANSWER_ROWS = 1000


#: What each tool does and takes: name -> (description, argument -> (JSON type, description)).
TOOLS = {
    "context_search": ("Search past events by meaning.", {"query": ("string", "what to look for"), "k": ("integer", "hits at most"), "segment": ("string", "a segment id, or all"), "session": ("string", "current, all or a session id")}),
    "fetch_event": ("Read one event.", {"event_id": ("string", "the event"), "full": ("boolean", "without clipping")}),
    "expand_context": ("Events around one: over the dependency graph or of a segment.", {"event_id": ("string", "the event"), "mode": ("string", "graph or segment"), "depth": ("integer", "steps, 5 at most"), "segment_id": ("string", "a segment")}),
    "list_segments": ("The latest segments of the session.", {"limit": ("integer", "segments at most")}),
    "get_goal_history": ("The latest goals of the session.", {"limit": ("integer", "snapshots at most")}),
    "recall_recent": ("The last turns word by word.", {"turns": ("integer", "1 to 50")}),
    "get_execution_state": ("The session's state and statistics.", {}),
}
REQUIRED = {"context_search": ["query"], "fetch_event": ["event_id"]}


def tool_schemas() -> list[dict]:
    """The tools as JSON schemas for a model's function calls."""
    return [
        {"name": name, "description": text, "parameters": {"type": "object", "properties": {a: {"type": t, "description": d} for a, (t, d) in args.items()}, "required": REQUIRED.get(name, [])}}
        for name, (text, args) in TOOLS.items()
    ]


@dataclass
class MemoryTools:
    """events, vectors, history, lineage and edges in the engine's data model; one bound session."""

    events: DataFrame
    vectors: DataFrame
    history: DataFrame
    lineage: DataFrame
    session_id: object
    embedder: Embedder
    edges: DataFrame | None = None
    #: saved states: session_id, goal, perhaps topic_tags
    states: DataFrame | None = None
    #: stored links; with them a chain is walked from the session alone
    links: LineageTable | None = None

    def chain(self) -> DataFrame:
        own = self.events.sparkSession.createDataFrame([(self.session_id,)], self.events.select("session_id").schema)
        found = gr.lineage_chain(own, self.lineage) if self.links is None else chains_of(self.links, own)
        return found.select(F.col("member").alias("session_id"))

    def context_search(self, query: str, k: int = 5, segment: str = "all", session="current") -> DataFrame:
        """The best hits; session is 'current' (with its lineage), 'all', an id or a list of ids."""
        if not (query or "").strip():
            raise ValueError("query is empty; arguments: query, k, segment, session")
        vector = self.embedder.embed([query])[0]
        spark = self.events.sparkSession
        if vector is None:
            return self.events.limit(0).select("event_id", F.lit(0.0).alias("score"), "type", F.col("content").alias("snippet"), "ts", F.col("session_id").alias("source_session_id"))
        pool = self.vectors
        if session == "current":
            pool = pool.join(self.chain(), "session_id", "left_semi")
        elif isinstance(session, (list, tuple)):
            pool = pool.filter(F.col("session_id").isin(*session)) if session else pool.limit(0)
        elif session != "all":
            pool = pool.filter(F.col("session_id") == F.lit(session))
        detail = self.events.select("event_id", "type", "content", "ts", "segment_id")
        if segment not in ("all", "current", None):
            pool = pool.join(detail.filter(F.col("segment_id") == segment).select("event_id"), "event_id", "left_semi")
        asked = spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, query array<float>")
        hits = rt.search(asked, pool.select("event_id", "session_id", "embedding"), "all", k)
        return hits.join(detail, "event_id").select(
            "event_id", F.col("similarity").alias("score"), "type", F.left("content", F.lit(300)).alias("snippet"), "ts", F.col("session_id").alias("source_session_id")
        )

    def fetch_event(self, event_id, full: bool = False) -> DataFrame:
        """B16, S4."""
        row, n = self.events.filter(F.col("event_id") == event_id), F.length("content")
        return row if full else row.withColumns({"truncated": n > 4000, "original_chars": n, "content": F.left("content", F.lit(4000))})

    def expand_context(self, event_id=None, mode: str = "graph", depth: int = 2, segment_id: str | None = None) -> DataFrame:
        """Graph neighbours with snippets, or the skeleton of a segment, given or that of the event."""
        if mode == "segment":
            if segment_id is None:
                its = self.events.filter(F.col("event_id") == event_id).select("session_id", "segment_id")
                return tl.segment_skeleton(self.events.join(F.broadcast(its), ["session_id", "segment_id"], "left_semi"))  # of one event
            return tl.segment_skeleton(self.events.filter((F.col("session_id") == self.session_id) & (F.col("segment_id") == segment_id)))
        edges = self.edges if self.edges is not None else gr.derive_edges(self.events)
        seeds = self.events.filter(F.col("event_id") == event_id).select(F.col("event_id").alias("seed"), F.col("event_id").alias("node"))
        near = gr.with_hops(gr.neighbors(seeds, edges, depth), edges)
        return near.join(self.events, near["node"] == self.events["event_id"]).select("event_id", "depth", "edge_type", "ts", "type", clip(F.col("content"), 200).alias("snippet"))

    def list_segments(self, limit: int = 10) -> DataFrame:
        """B18; with the session's topic tags where its saved state has some."""
        mine = F.col("session_id") == self.session_id
        tags = self.states.filter(mine).select("session_id", "topic_tags") if self.states is not None and "topic_tags" in self.states.columns else None
        return tl.segment_manifest(self.events.filter(mine), self.history.filter(mine), limit, tags)

    def get_goal_history(self, limit: int = 20) -> DataFrame:
        """B19."""
        return tl.goal_history(self.history.filter(F.col("session_id") == self.session_id), limit)

    def recall_recent(self, turns: int = 5) -> DataFrame:
        """The last turns, 1 to 50."""
        return tl.recent_turns(self.events.filter(F.col("session_id") == self.session_id), max(1, min(50, turns)))

    def get_execution_state(self) -> DataFrame:
        """B21, ST5: the saved state, else the nearest ancestor's, else the live one, with statistics."""
        mine = self.events.filter(F.col("session_id") == self.session_id)
        live = st.live_state(mine).join(tl.session_stats(mine, self.lineage), "session_id")
        if self.states is None:
            return live.withColumn("source", F.lit("live"))
        own = self.events.sparkSession.createDataFrame([(self.session_id,)], self.events.select("session_id").schema)
        held = gr.inherited_state(own, self.states, self.lineage).withColumnRenamed("goal", "saved_goal")
        joined = own.join(live, "session_id", "left").join(held, "session_id", "left")
        origin = F.when(F.col("source_session").isNull(), "live").when(F.col("source_session") == F.col("session_id"), "saved").otherwise("ancestor")
        return joined.withColumn("goal", F.coalesce("saved_goal", "goal")).withColumn("source", origin).drop("saved_goal")

    def handle(self, name: str, args: dict | None = None) -> str:
        """A tool by name; single rows gain an estimate of their tokens, lists stay lists."""
        if name not in TOOLS:
            return json.dumps({"error": f"unknown tool: {name}"})
        try:
            frame = getattr(self, name)(**(args or {}))
        except (TypeError, ValueError) as problem:
            return json.dumps({"error": str(problem), "received": sorted(args or {})})
        rows = [json.loads(r[0]) for r in frame.select(F.to_json(F.struct("*"))).limit(ANSWER_ROWS + 1).collect()]
        if name not in ("fetch_event", "get_execution_state"):
            if len(rows) > ANSWER_ROWS:
                return json.dumps({"rows": rows[:ANSWER_ROWS], "truncated": True, "hint": "narrow the request, or read the DataFrame of this tool"}, ensure_ascii=False)
            return json.dumps(rows, ensure_ascii=False)
        answer = rows[0] if rows else {"error": "not found"}
        answer["_estimated_tokens"] = max(1, len(json.dumps(answer, ensure_ascii=False)) // 4)
        return json.dumps(answer, ensure_ascii=False)
