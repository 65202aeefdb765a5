"""Centroids that are kept up to date, and centroids of the last so many vectors (A5, J3, ST9, W7).

:class:`CentroidTable` stores mergeable partials per segment: the sum per dimension, the number of vectors, and the sum of the
hashes of their ids as a fingerprint.  A batch of new vectors is summed first and merged with the stored partials of the
buckets that it touches, and these alone are written.  A bucket remembers the last batch that it holds, so a batch that is
applied again after a failure changes only what it did not reach.

:func:`window_centroids` gives each event the mean of the last vectors of its segment before it.  Running sums per dimension
are columns of one window, and the sum of the last n is the difference of two of them.  A long segment is cut into blocks
that repeat the last n rows of the block before, so no task sorts a whole hot segment and sums stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.operators.graph import cut
from palaver.sources.buckets import BUCKETS, BucketTable

#: Rows of a block of a segment; more than a window.
BLOCK_ROWS = 5000


def partials(vectors: DataFrame, key: str) -> DataFrame:
    """(key, n, fingerprint, sums) of vectors (event_id, key, embedding); sums combine map-side, a dimension a row."""
    rows = vectors.filter("embedding IS NOT NULL")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("event_id").cast("decimal(38,0)")).alias("fingerprint"))
    return counts.join(gather(rows.select(key, F.posexplode("embedding").alias("pos", "x")), key), key)


def gather(dimensions: DataFrame, key: str) -> DataFrame:
    """(key, sums) of rows (key, pos, x)."""
    summed = dimensions.groupBy(key, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    listed = summed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("dims"))
    return listed.select(key, F.transform("dims", lambda d: d["x"]).alias("sums"))


def merge(parts: DataFrame, key: str) -> DataFrame:
    """Partials of the same key into one."""
    counts = parts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("fingerprint").cast("decimal(38,0)").alias("fingerprint"))
    return counts.join(gather(parts.select(key, F.posexplode("sums").alias("pos", "x")), key), key)


class CentroidTable(BucketTable):
    """Partials per *key* below *path*."""

    def __init__(self, spark: SparkSession, path: str, key: str = "segment_id", buckets: int = BUCKETS):
        super().__init__(spark, path, key, buckets)

    def apply(self, batch_id: int, vectors: DataFrame) -> list[int]:
        """Merge a batch (ids grow from batch to batch); returns the buckets that were written."""
        known = self.newest()
        new = cut(partials(vectors.select("event_id", self.key, "embedding"), self.key).withColumn("bucket", self.bucket()))
        touched = {r[0] for r in new.select("bucket").distinct().collect()}  # as many as there are buckets, at most
        due = sorted(b for b in touched if known.get(b, -1) < batch_id)
        if due:
            new = new.filter(F.col("bucket").isin(due)).drop("bucket")
            old = self.read({b: known[b] for b in due if b in known})
            self.write(merge(new if old is None else old.unionByName(new), self.key), batch_id)
        return due


def means(parts: DataFrame, key: str, least: int = S.COLD_START) -> DataFrame:
    """(key, n, centroid) of partials; null below the cold-start count."""
    return parts.select(key, "n", F.when(F.col("n") >= least, F.transform("sums", lambda x: x / F.col("n"))).alias("centroid"))


def window_centroids(vectors: DataFrame, key: str, order: list[str], window: int = S.CENTROID_WINDOW, least: int = S.COLD_START, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(event_id, key, embedding, n, centroid): the mean of the last *window* vectors of the segment before each event.

    Events are ordered by *order*, which has to tell them apart; n: how many vectors the mean is of, null mean below *least*.
    """
    rows = vectors.filter("embedding IS NOT NULL")
    width = rows.select(F.size("embedding")).first()
    if width is None:
        return rows.select("event_id", key, "embedding", F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<double>").alias("centroid"))
    block_rows = max(block_rows, window)
    # numbers of narrow rows first; the vectors are then dealt by block
    numbered = rows.select("event_id", key, *[c for c in order if c not in ("event_id", key)])
    numbered = numbered.withColumn("at", F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).select("event_id", "at")
    block = F.floor(F.col("at") / block_rows)
    # the last rows of a block are the beginning of the next one, too
    again = F.when(F.col("at") % block_rows >= block_rows - window, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = rows.select("event_id", key, "embedding").join(numbered, "event_id").withColumn("own", block).withColumn("block", F.explode(again))
    by = W.partitionBy(key, "block").orderBy("at")
    before, names = by.rowsBetween(W.unboundedPreceding, -1), [f"s{i}" for i in range(width[0])]
    sums = {c: F.coalesce(F.sum(F.col("embedding")[i].cast("double")).over(before), F.lit(0.0)) for i, c in enumerate(names)}
    running = dealt.select("event_id", key, "embedding", "at", "own", "block", *[c.alias(n) for n, c in sums.items()])
    last = F.array(*[F.col(c) - F.lag(c, window, 0.0).over(by) for c in names])
    seen = F.least(F.col("at"), F.lit(window)).cast("long")
    found = running.select("event_id", key, "embedding", "own", "block", seen.alias("n"), last.alias("total")).filter("own = block")
    return found.select("event_id", key, "embedding", "n", F.when(F.col("n") >= least, F.transform("total", lambda x: x / F.col("n"))).alias("centroid"))
