"""The dependency graph and session lineage.

Closures are bounded loops of joins from a frontier, with known nodes removed by an anti-join, or double their
reach; a loop's state is checkpointed between rounds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.operators.timeline import forward


def shared_folder(spark: SparkSession) -> None:
    """The cluster's checkpoint folder; where none is set, one of our own in local mode and an error elsewhere."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
    sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="palaver-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write a loop's state to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    shared_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def derive_edges(events: DataFrame) -> DataFrame:
    """tool_call -> tool_output, and tool_output -> assistant_message (decision), each consumed once.

    An output links to the row before it among calls and outputs, a reply to the row before it among
    outputs and replies; both are running maxima over one sort of the session.
    """
    place = F.struct("ts", "event_id", "type")
    before = forward().rowsBetween(W.unboundedPreceding, -1)
    last = lambda a, b: F.max(F.when(F.col("type").isin(a, b), place)).over(before)
    rows = events.withColumns({"call": last("tool_call", "tool_output"), "output": last("tool_output", "assistant_message")})
    answers = (F.col("type") == "tool_output") & (F.col("call.type") == "tool_call")
    decides = (F.col("type") == "assistant_message") & (F.col("output.type") == "tool_output")
    return rows.filter(answers | decides).select(
        "session_id", F.when(answers, F.col("call.event_id")).otherwise(F.col("output.event_id")).alias("from_event_id"),
        F.col("event_id").alias("to_event_id"), F.when(answers, "tool_output").otherwise("decision").alias("edge_type"),
    )


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """G1: legal types only; an edge that exists is ignored."""
    legal = more.filter(F.col("edge_type").isin(*S.EDGE_TYPES)).dropDuplicates(["from_event_id", "to_event_id"])
    return edges.unionByName(legal.join(edges, ["from_event_id", "to_event_id"], "left_anti").select(*edges.columns))


def undirected(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("from_event_id").alias("a"), F.col("to_event_id").alias("b"))
    return both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def bounded_closure(seeds: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth): what is reached from each seed (its own node at 0) over links (a, b), shortest first.

    Links and each round's new nodes are written, so a round computes only its own step.
    """
    known = cut(seeds.select("seed", F.col("node"), F.lit(0).alias("depth")))
    links = cut(links.select("a", "b")) if depth > 0 else links
    front = known
    for d in range(1, depth + 1):
        reached = front.join(links, front["node"] == links["a"]).select("seed", F.col("b").alias("node")).distinct()
        front = cut(reached.join(known, ["seed", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def neighbors(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Neighbours both ways, to a depth of at most 5, without the seed itself."""
    return bounded_closure(seeds, undirected(edges), min(depth, 5)).filter("depth > 0")


def with_hops(near: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours (seed, node, depth) with the type and session of the edge that they were reached over: the least of those from one step nearer."""
    both = edges.select(F.col("from_event_id").alias("before"), F.col("to_event_id").alias("node"), "edge_type", F.col("session_id").alias("edge_session"))
    both = both.unionByName(both.select(F.col("node").alias("before"), F.col("before").alias("node"), "edge_type", "edge_session"))
    seeds = near.select("seed").distinct().select("seed", F.col("seed").alias("before"), F.lit(0).alias("nearer"))
    known = near.select("seed", F.col("node").alias("before"), F.col("depth").alias("nearer")).unionByName(seeds)
    hops = near.join(both, "node").join(known, ["seed", "before"]).filter("nearer = depth - 1")
    return hops.groupBy("seed", "node", "depth").agg(F.min(F.struct("edge_type", "edge_session")).alias("hop")).select("seed", "node", "depth", "hop.*")


def dependency_bonus(anchors: DataFrame, edges: DataFrame, decay: float = S.DECAY, depth: int = S.MAX_DEPTH) -> DataFrame:
    """(session_id, event_id, bonus): decay ** distance from the session's nearest anchor; anchors 1."""
    seeds = anchors.select(F.col("session_id").alias("seed"), F.col("event_id").alias("node"))
    if depth <= 0 or decay <= 0:
        seeds, depth = seeds.limit(0), 0
    near = bounded_closure(seeds, undirected(edges), depth).groupBy("seed", "node").agg(F.min("depth").alias("d"))
    return near.select(F.col("seed").alias("session_id"), F.col("node").alias("event_id"), F.pow(F.lit(float(decay)), F.col("d")).alias("bonus"))


def pointer_closure(links: DataFrame) -> DataFrame:
    """(node, ancestor, depth): all nodes above each node over (child, parent) links, by doubling.

    Rounds grow with the logarithm of the longest chain; a cycle ends when no pair is new.
    """
    known = cut(links.filter("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    size = known.count()
    while size:
        far = known.alias("x").join(known.alias("y"), F.col("x.ancestor") == F.col("y.node")).select(
            F.col("x.node").alias("node"), F.col("y.ancestor").alias("ancestor"), (F.col("x.depth") + F.col("y.depth")).alias("depth")
        )
        known = cut(known.unionByName(far).filter("node <> ancestor").groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        now = known.count()
        if now == size:
            break
        size = now
    return known


def lineage_chain(sessions: DataFrame, lineage: DataFrame) -> DataFrame:
    """(session_id, member): ancestors, descendants and the session itself; not siblings."""
    up = pointer_closure(lineage.select(F.col("new_session_id").alias("child"), F.col("old_session_id").alias("parent")))
    ids = sessions.select("session_id").distinct()
    pairs = up.select(F.col("node").alias("session_id"), F.col("ancestor").alias("member"))
    pairs = pairs.unionByName(up.select(F.col("ancestor").alias("session_id"), F.col("node").alias("member")))
    return pairs.join(ids, "session_id", "left_semi").unionByName(ids.select("session_id", F.col("session_id").alias("member"))).distinct()


def newest(lineage: DataFrame, of: str, to: str) -> DataFrame:
    """(node, next): of several links of a session the latest by created_at, else by id."""
    time = F.col("created_at") if "created_at" in lineage.columns else F.lit(0)
    rows = lineage.filter((F.col(of) != F.col(to)) & F.col(of).isNotNull() & F.col(to).isNotNull())
    return rows.groupBy(F.col(of).alias("node")).agg(F.max_by(to, F.struct(time, F.col(to))).alias("next"))


def follow(links: DataFrame) -> DataFrame:
    """(node, end, steps): where each node's chain of (node, next) ends, by pointer jumping; one row per node throughout.

    A round doubles what a pointer spans, so rounds grow with the logarithm of the longest chain.  Nodes of a cycle, or
    before one, never end; once a pointer spans more steps than there are nodes they are left out.
    """
    at = cut(links.select("node", F.col("next").alias("end"), F.lit(1).cast("long").alias("steps")))
    n, span = at.count(), 1
    while n:
        there = at.select(F.col("node").alias("end"), F.col("end").alias("end_2"), F.col("steps").alias("steps_2"))
        jumped = at.join(there, "end", "left")
        moved = jumped.filter("end_2 IS NOT NULL")
        if moved.isEmpty():
            break
        if span > n:
            return at.join(there.select("end"), "end", "left_anti")
        at = cut(jumped.select("node", F.coalesce("end_2", "end").alias("end"), (F.col("steps") + F.coalesce("steps_2", F.lit(0))).alias("steps")))
        span *= 2
    return at


def resolve_sessions(lineage: DataFrame) -> DataFrame:
    """(old_session_id, current_id): where a session's events belong now; resolved on read, nothing is rewritten."""
    return follow(newest(lineage, "old_session_id", "new_session_id")).select(F.col("node").alias("old_session_id"), F.col("end").alias("current_id"))


def rollover(lineage: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lineage with new edges; equal, empty or directly reversed ones are refused."""
    new = wanted.filter((F.col("old_session_id") != F.col("new_session_id")) & F.col("old_session_id").isNotNull() & F.col("new_session_id").isNotNull())
    reverse = lineage.select(F.col("old_session_id").alias("new_session_id"), F.col("new_session_id").alias("old_session_id"))
    return lineage.unionByName(new.join(reverse, ["old_session_id", "new_session_id"], "left_anti").select(*lineage.columns)).distinct()


def rebase_segments(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """Events under their current session, segment ids rewritten with it."""
    joined = events.join(resolved, events["session_id"] == resolved["old_session_id"], "left")
    old, new = F.col("session_id").cast("string"), F.col("current_id").cast("string")
    return joined.withColumn(
        "segment_id", F.when(F.col("current_id").isNotNull(), F.replace("segment_id", old, new)).otherwise(F.col("segment_id"))
    ).withColumn("session_id", F.coalesce("current_id", "session_id")).drop("old_session_id", "current_id")


def inherited_state(sessions: DataFrame, states: DataFrame, lineage: DataFrame) -> DataFrame:
    """G6, ST5: the session's own state, else that of the nearest ancestor by newest parents.

    A chain of newest parents ends at the first session that holds a state, so pointers jump to it.
    """
    held = states.groupBy(F.col("session_id").alias("holder")).agg(F.min("goal").alias("goal"))
    up = newest(lineage, "new_session_id", "old_session_id").join(held.select(F.col("holder").alias("node")), "node", "left_anti")
    ends = follow(up).select(F.col("node").alias("session_id"), F.col("end").alias("source_session"))
    asked = sessions.select("session_id").distinct().join(ends, "session_id", "left")
    at = F.coalesce("source_session", "session_id").alias("source_session")
    return asked.select("session_id", at).join(held, F.col("source_session") == F.col("holder")).select("session_id", "source_session", "goal")
