"""Per-turn context assembly over many sessions in one job (R4-R9, U1-U3, B1-B13): from messages to prompts.

Each session's turn is its last user message.  A session's query meets only its own events, by an equi-join on
the session, so the work is the sum of the sessions' sizes and no pair of sessions is formed; searches beyond the first are
run for the sessions alone that need them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.config import Settings
from palaver.functions import text as tx
from palaver.functions import vector as vc
from palaver.functions.enrichment import Embedder, Reranker, embed_column, embed_events, rerank_groups
from palaver.operators import budget as bd
from palaver.operators import cascade as cs
from palaver.operators import centroids as cn
from palaver.operators import graph as gr
from palaver.operators import knn
from palaver.operators import retrieval as rt
from palaver.operators import state as st
from palaver.operators import timeline as tl
from palaver.sources import messages as ms

#: Places of the blocks of the system message, in order; further ones come after them.
HINT, TRAIL, STATE, CHECKPOINT, ELSEWHERE, FURTHER = range(6)


def current_messages(messages: DataFrame) -> DataFrame:
    """(session_id, msg_index, message) of each session's last user message that says something."""
    clean = tx.clean_message(F.col("content"))
    said = messages.filter((F.col("role") == "user") & (clean != ""))
    return said.groupBy("session_id").agg(F.max_by(F.struct("msg_index", clean.alias("message")), "msg_index").alias("c")).select("session_id", "c.*")


def turns(messages: DataFrame, states: DataFrame, drifts: DataFrame | None = None, threshold: float = S.DRIFT_THRESHOLD) -> DataFrame:
    """Per session the current message with its signals, intent, mode and query text.  drifts: session_id, drift."""
    replies = messages.filter("role = 'assistant'").groupBy("session_id").agg(F.max_by("content", "msg_index").alias("reply"))
    rows = current_messages(messages).join(replies, "session_id", "left").join(states, "session_id", "left")
    rows = rows.withColumn("drift", F.lit(0.0)) if drifts is None else rows.join(drifts.select("session_id", "drift"), "session_id", "left")
    rows = rows.withColumns({"names": tx.entities(F.col("reply")), "drift": F.coalesce("drift", F.lit(0.0))})
    against = tx.contradicts(F.col("message"), F.col("names"))
    rows = rows.withColumn("signals", tx.signals(tx.is_switch(F.col("message")), against, F.col("drift"), tx.asks_about(F.col("message"), F.col("names")), threshold))
    rows = rows.withColumn("intent", F.col("signals.intent"))
    mode = F.when(F.col("intent") == "CLARIFICATION", "clarification").otherwise(tx.mode(F.col("message"), F.col("last_tool")))
    text = lambda c: F.coalesce(c, F.lit(""))
    query = tx.query_text(
        text(F.col("goal")), text(F.col("current_step")), text(F.col("last_tool_output_summary")), F.col("names"), F.col("message"), F.col("intent"), F.col("message")
    )
    return rows.select("session_id", "msg_index", "message", "signals", "intent", "drift", mode.alias("mode"), query.alias("query_text"), "goal", "current_step")


def message_drifts(current: DataFrame, events: DataFrame, vectors: DataFrame, window: int = S.CENTROID_WINDOW, least: int = S.COLD_START) -> DataFrame:
    """V6: (session_id, drift) of each current message (session_id, msg_index, vector) from the last *window* vectors (0: all) before it in its session's current segment."""
    now = tl.latest_segment(events)
    rows = events.join(now, ["session_id", "segment_id"], "left_semi").select("event_id", "session_id", "ts", F.col("msg_index").alias("at"))
    rows = rows.join(current.select("session_id", "msg_index"), "session_id").filter("at < msg_index").join(vectors.select("event_id", "embedding"), "event_id")
    back = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    last = rows.withColumn("back", back).filter(F.col("back") <= window) if window else rows
    means = cn.means(cn.partials(last.select("event_id", "session_id", "embedding"), "session_id"), "session_id", least)
    return current.join(means, "session_id", "left").select("session_id", vc.drift(F.col("vector"), F.col("centroid")).alias("drift"))


def system_blocks(states: DataFrame, events: DataFrame, settings: Settings, lineage: DataFrame | None = None, history: DataFrame | None = None, elsewhere: DataFrame | None = None) -> DataFrame:
    """(session_id, pos, block) of the system messages: hint, goal trail, state, checkpoint, hits of other sessions.

    history: snapshots (session_id, id, ts, goal), for the trail and the checkpoint's goals; elsewhere: hits (session_id,
    rank, from_session, event_id, content) of :func:`cascade.probe`.  A checkpoint is due where the session's last calls were memory
    tools, as many in a row as the settings say.
    """
    spark = events.sparkSession
    if lineage is None:
        lineage = spark.createDataFrame([], "old_session_id string, new_session_id string")
    state = F.concat(F.lit("[EXECUTION STATE]\n"), F.to_json(F.struct(*[c for c in states.columns if c != "session_id"])))
    blocks = [st.compress_state(states, S.STATE_CAP_TOKENS).select("session_id", F.lit(STATE).alias("pos"), state.alias("block"))]
    if settings.memory_hint:
        hint = bd.memory_hint(tl.session_stats(events, lineage), settings.tail_floor)
        blocks.append(hint.select("session_id", F.lit(HINT).alias("pos"), F.col("hint").alias("block")))
    calls = tl.memory_streaks(events.filter("type = 'tool_call'"), F.coalesce(F.col("tool_name").isin(*settings.memory_tools), F.lit(False)), settings.checkpoint_calls)
    due = calls.groupBy("session_id").agg(F.max_by(F.struct("checkpoint", "streak"), F.struct("ts", "event_id")).alias("l")).filter("l.checkpoint")
    due = due.select("session_id", F.col("l.streak").alias("calls"))
    if history is not None:
        blocks.append(bd.goal_trail(tl.recent_unique_goals(history, settings.goal_trail)).select("session_id", F.lit(TRAIL).alias("pos"), "block"))
        goals = tl.recent_unique_goals(history, 2).groupBy("session_id").agg(F.max_by("goal", "id").alias("goal"), F.min_by("goal", "id").alias("prior"))
    else:
        goals = states.select("session_id", "goal", F.lit(None).cast("string").alias("prior"))
    blocks.append(due.join(goals, "session_id", "left").select("session_id", F.lit(CHECKPOINT).alias("pos"), bd.checkpoint_block(F.col("calls"), F.col("goal"), F.col("prior")).alias("block")))
    if elsewhere is not None:
        line = F.concat(F.lit("- session="), F.col("from_session").cast("string"), F.lit(" event="), F.col("event_id").cast("string"), F.lit(" :: "), F.left(F.coalesce("content", F.lit("")), F.lit(160)))
        lines = elsewhere.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
        listed = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
        blocks.append(lines.select("session_id", F.lit(ELSEWHERE).alias("pos"), F.concat(F.lit("[CROSS-SESSION CANDIDATES]\n"), listed).alias("block")))
    return reduce(DataFrame.unionByName, blocks).filter("block IS NOT NULL")


def assemble_turns(
    messages: DataFrame, embedder: Embedder, as_of: str, settings: Settings | None = None, reranker: Reranker | None = None, overhead: int = 0,
    extras: DataFrame | None = None, resumed: DataFrame | None = None, lineage: DataFrame | None = None, history: DataFrame | None = None,
    prompt_tokens: DataFrame | None = None, others: DataFrame | None = None,
) -> DataFrame:
    """(session_id, pos, role, content): the prompt of every session's current turn.

    messages: session_id, msg_index, ts, role, content.  Sessions within budget pass unchanged, but *resumed* ones
    (ST10: session_id), which are assembled once; *prompt_tokens* (session_id, current_tokens) is what the host has counted,
    where that is more than the messages (B3).  *extras*: further blocks of the system message, in order of pos.  *others*: vectors
    of other sessions (event_id, session_id, embedding, content), which new sessions are compared with (R9).
    """
    settings = settings or Settings()
    total = settings.budget
    parsed = ms.parse_messages(messages)
    stamped = parsed.join(messages.select("session_id", "msg_index", "ts"), ["session_id", "msg_index"])
    segment = tl.segment_ordinals(messages).select("session_id", "msg_index", F.concat_ws("_", F.lit("seg"), "session_id", "segment").alias("segment_id"))
    events = stamped.join(segment, ["session_id", "msg_index"])
    states = st.live_state(events)
    budgets = bd.token_budgets(messages, total, 0, overhead, prompt_tokens)
    long = budgets.filter(~F.col("pass_through")).select("session_id")
    if resumed is not None:
        long = long.unionByName(resumed.select("session_id").join(budgets, "session_id", "left_semi")).distinct()
    # written once: later steps read them several times; dealt anew, as a small file of long texts is one task to read and to embed
    long = gr.cut(long)
    work, states = gr.cut(events.join(long, "session_id", "left_semi").repartition("event_id")), gr.cut(states.join(long, "session_id", "left_semi"))
    talk = messages.join(long, "session_id", "left_semi")
    vectors = gr.cut(embed_events(work, embedder, "assembly", settings.summary_threshold, settings.summary_tokens))
    said = gr.cut(current_messages(talk).withColumn("vector", embed_column(embedder)(F.col("message"))))
    asked = gr.cut(turns(talk, states, message_drifts(said, work, vectors, settings.centroid_window), settings.drift_threshold))
    wanted = asked.join(said.select("session_id", F.col("vector").alias("clean")), "session_id").join(tl.latest_segment(work), "session_id")
    wanted = wanted.withColumn("query", embed_column(embedder)(F.col("query_text")))
    bonus = gr.dependency_bonus(tl.anchors(work, 20), gr.derive_edges(work), settings.decay, settings.max_depth).select("event_id", "bonus")
    pool = vectors.select("event_id", "embedding").join(work.select("event_id", "session_id", "segment_id", "msg_index", "ts", "type", "content"), "event_id")
    back = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("msg_index").desc()))
    tail_ids = talk.withColumn("back", back).filter(F.col("back") <= settings.tail_floor + 1).select("session_id", "msg_index")
    protected = work.join(tail_ids, ["session_id", "msg_index"], "left_semi").select("session_id", "event_id")
    pool = cs.staged_search(
        wanted, pool.drop("msg_index").join(bonus, "event_id", "left"), protected, int(total * settings.retrieved_ratio), as_of, settings.recency_lambda, settings.min_candidates, settings.top_k or None
    )
    pool = pool.join(asked.select("session_id", "query_text"), "session_id").withColumn("query_id", F.col("session_id"))
    if reranker is not None and settings.reranker_enabled:
        pool = rerank_groups(pool.select("query_id", "session_id", "query_text", "event_id", "type", "content", "score"), reranker, settings.reranker_top_k or None)
    if settings.top_k:
        pool = rt.top_k(pool, settings.top_k, by="score").drop("rank")
    packed = bd.pack_retrieved(pool, int(total * settings.retrieved_ratio))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "event_id"))
    chunks = gr.cut(packed.select(F.col("query_id").alias("session_id"), place.alias("pos"), "chunk", F.col("chunk_tokens").alias("cost")))
    elsewhere = None
    if others is not None:
        counts = work.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
        hits = cs.probe(wanted, counts, knn.build_index(others.select("event_id", "session_id", "embedding")), 3, max(1, settings.tail_floor))
        elsewhere = hits.join(others.select("event_id", "content"), "event_id")
    blocks_of = system_blocks(states, work, settings, lineage, history, elsewhere)
    if extras is not None:  # session_id, pos, block
        blocks_of = blocks_of.unionByName(extras.select("session_id", (F.col("pos") + FURTHER).cast("int").alias("pos"), "block"))
    system = gr.cut(blocks_of.filter("block IS NOT NULL").join(long, "session_id", "left_semi"))
    fixed = system.groupBy("session_id").agg(F.sum(ms.tokens(F.col("block"))).alias("cost")).unionByName(asked.select("session_id", bd.message_cost(F.col("message")).alias("cost")))
    used = fixed.select("session_id", "cost").unionByName(chunks.select("session_id", "cost")).groupBy("session_id").agg(F.sum("cost").alias("other"))
    tail = bd.pack_tail(talk.join(used, "session_id", "left"), int(total * settings.tail_ratio), total, settings.tail_floor, F.coalesce("other", F.lit(0)))
    tail = gr.cut(tail)
    age = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("msg_index").desc()))
    blocks = (
        fixed.select("session_id", F.lit("fixed").alias("kind"), F.lit(1).alias("place"), "cost")
        .unionByName(chunks.select("session_id", F.lit("retrieved").alias("kind"), F.col("pos").alias("place"), "cost"))
        .unionByName(tail.select("session_id", F.lit("tail").alias("kind"), age.alias("place"), "cost"))
    )
    kept = bd.resolve_collision(blocks, total)
    chunks = chunks.join(kept.filter("kind = 'retrieved'").select("session_id", F.col("place").alias("pos")), ["session_id", "pos"], "left_semi")
    tail = tail.withColumn("place", age).join(kept.filter("kind = 'tail'").select("session_id", "place"), ["session_id", "place"], "left_semi")
    built = bd.assemble(system, chunks, tail, asked.select("session_id", F.col("message").alias("content")))
    same = messages.join(long, "session_id", "left_anti").select("session_id", F.col("msg_index").cast("long").alias("pos"), "role", "content")
    return built.unionByName(same)


def due_enrichments(commits: DataFrame, every: int = S.ENRICH_EVERY, on_boundary: bool = True) -> DataFrame:
    """Commits (session_id, turn, segment, boundary, ok) at which enrichment runs.

    It runs every so many turns after its last success, or at a boundary in a new segment; only success moves
    the last run, so this is a fold over sorted partitions that holds one session's counters.
    """

    def fold(batches):
        session, last, seen = None, -1, None
        for pdf in batches:
            keep = []
            for r in pdf.itertuples(index=False):
                if r.session_id != session:
                    session, last, seen = r.session_id, -1, None
                run = r.turn >= 1 and (0 < every <= r.turn - max(last, 0) or (on_boundary and bool(r.boundary) and r.segment != seen))
                if run and bool(r.ok):
                    last, seen = r.turn, r.segment
                keep.append(run)
            yield pdf[keep]

    return commits.repartition("session_id").sortWithinPartitions("session_id", "turn").mapInPandas(fold, commits.schema)
