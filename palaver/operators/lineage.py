"""The lineage of given sessions from a stored table (G5, G6): what is read grows with their chains, not with the table.

Links are stored in both directions as a :class:`BucketTable` by the session they start from, sorted within each bucket.  A
step of the walk knows its frontier, the sessions found last: it opens only the buckets of these, and where the frontier is
small its ids go into the filter, so the pages of a bucket that hold none of them are skipped by their statistics.  Only new
sessions enter the next frontier (a semi-naive closure), so cycles end and a link is followed once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators.graph import cut
from palaver.sources.buckets import BucketTable

#: Sessions of a frontier whose ids become part of the filter; beyond it the buckets are read and joined.
FILTER_IDS = 1000
UP, DOWN = True, False


class LineageTable(BucketTable):
    """(node, next, up): for each link a row from the newer session up to the older one, and one back."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path, "node", buckets)

    def build(self, lineage: DataFrame, version: int = 0) -> None:
        old, new = F.col("old_session_id"), F.col("new_session_id")
        rows = lineage.filter(old.isNotNull() & new.isNotNull() & (old != new)).select(old.alias("old"), new.alias("new")).distinct()
        both = rows.select(F.col("new").alias("node"), F.col("old").alias("next"), F.lit(UP).alias("up")).unionByName(
            rows.select(F.col("old").alias("node"), F.col("new").alias("next"), F.lit(DOWN).alias("up"))
        )
        placed = both.withColumns({"bucket": self.bucket(), "version": F.lit(version).cast("long")})
        sorted_rows = placed.repartition("bucket").sortWithinPartitions("bucket", "node")
        sorted_rows.write.mode("append").option("parquet.block.size", 1 << 20).option("parquet.page.row.count.limit", 1000).partitionBy("bucket", "version").parquet(self.path)

    def links(self, frontier: DataFrame, up: bool) -> DataFrame | None:
        """Links of one direction of the buckets of a frontier (node)."""
        known = self.newest()
        buckets = [r[0] for r in frontier.select(self.bucket().alias("b")).distinct().collect()]  # as many as the table has, at most
        rows = self.read({b: known[b] for b in buckets if b in known})
        if rows is None:
            return None
        few = [r[0] for r in frontier.select("node").distinct().limit(FILTER_IDS + 1).collect()]
        rows = rows.filter(F.col("up") == up)
        return rows.filter(F.col("node").isin(few)) if len(few) <= FILTER_IDS else rows


def walk(table: LineageTable, seeds: DataFrame, up: bool) -> DataFrame:
    """(seed, node, depth) of all sessions above (or below) each seed."""
    known = [cut(seeds.select(F.col("session_id").alias("seed"), F.col("session_id").alias("node"), F.lit(0).alias("depth")).distinct())]
    while True:
        front = known[-1]
        links = table.links(front, up)
        if links is None:
            break
        reached = front.join(links, "node").select("seed", F.col("next").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, known).select("seed", "node")
        front = cut(reached.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(len(known))))
        if front.isEmpty():
            break
        known.append(front)
    return reduce(DataFrame.unionByName, known)


def chains_of(table: LineageTable, sessions: DataFrame) -> DataFrame:
    """(session_id, member) of given sessions: themselves, all before them and all after them."""
    both = walk(table, sessions, UP).unionByName(walk(table, sessions, DOWN))
    return both.select(F.col("seed").alias("session_id"), F.col("node").alias("member")).distinct()


def nearest_state(table: LineageTable, sessions: DataFrame, states: DataFrame) -> DataFrame:
    """(session_id, source_session, goal): of the sessions above and the session itself the nearest that holds a state."""
    held = states.groupBy(F.col("session_id").alias("node")).agg(F.min("goal").alias("goal"))
    found = walk(table, sessions, UP).join(held, "node").groupBy("seed").agg(F.min(F.struct("depth", "node", "goal")).alias("s"))
    return found.select(F.col("seed").alias("session_id"), F.col("s.node").alias("source_session"), F.col("s.goal").alias("goal"))
