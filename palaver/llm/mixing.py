"""Mixing sources to target weights by Pareto order sampling.

The whole part of ``target / source size`` is allocated with certainty; what is left of the source's target is a sample of its
documents with unequal probabilities: a document's inclusion odds are proportional to its size, so a source's target in words
is met while its long documents are taken once more oftener than its short ones.  (On sf0.1 a source's quarters by size get
0.38, 0.57, 0.70 and 0.82 of a further copy where 0.76 of the words are due.)  Documents are ranked by ``(u / (1 - u)) / odds`` with a pseudo-random ``u`` from the row
itself, and the prefix of that order whose words come nearest the rest of the target is taken once more.  A common
factor of all odds of a source changes no order, so the cut sets their scale.

The running sum over the order is distributed: ranks fall into buckets of equal width on a logarithmic scale, bucket
totals are summed up per source, and only the bucket in which a source's target is reached is ordered row by row.  The
logarithm of random odds has a density of 1/4 at most, and sizes only spread it, so a bucket of width w holds at most
about w / 4 of a source's rows whatever their sizes.  What the sample takes is then one comparison per row with its
source's cut: documents are not moved.

Edge cases: null or blank texts have size 0, rank last and take 0; null sources form one source, last in order; a
source of size 0 has target 0; rows with equal ranks follow by id, null first; repeated rows (equal id and text)
are taken or left together; a very long text is counted whole and taken or left like any other; an empty table gives no rows; further columns are ignored by :func:`mix` and pass through
:func:`mix_documents`.  The windows over sources see one row per source, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.llm.common import fresh, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
SEED = 17
#: Sources up to which what is known of them is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000
ROWS_PER_BUCKET = 20_000


def word_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """(source, source_size, source_rows, target): shares by weight, each at most ``most`` source sizes.

    Handing the excess on by weight until no target is above its stop ends at the water level L with
    target = min(stop, L * weight).  Sources in order of stop / weight are capped one after another, so L
    follows from running sums.  One row per source is all that these windows see.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_stop = W.orderBy("level", "pos")
    per = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
        .withColumn("pos", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", w)
        .withColumn("stop", F.col("source_size") * most)
        .withColumn("level", F.col("stop") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * share)
        # what is left for this source and those after it, if all before it are capped
        .withColumn("left", F.col("budget") - F.sum("stop").over(by_stop) + F.col("stop"))
        .withColumn("shares", F.sum("weight").over(every) - F.sum("weight").over(by_stop) + F.col("weight"))
        .withColumn("capped", F.col("left") * F.col("weight") >= F.col("stop") * F.col("shares"))
        # the first source that is not capped sets the level for itself and all after it
        .withColumn("open_level", F.when(~F.col("capped"), F.struct("level", "pos", (F.col("left") / F.col("shares")).alias("unit"))))
        .withColumn("unit", F.min("open_level").over(every)["unit"])
    )
    target = F.when(F.col("capped") | F.col("unit").isNull(), F.col("stop")).otherwise(
        F.least(F.col("stop"), F.col("unit") * F.col("weight"))
    )
    return per.select("source", "source_size", "source_rows", target.cast("double").alias("target"))


def pareto_rank(u: Column, odds: Column) -> Column:
    """Random odds divided by inclusion odds; infinite where these are 0."""
    return F.when(odds > 0, u / (1 - u) / odds).otherwise(F.lit(float("inf")))


def uniform(seed: int, doc_id: Column, text: Column) -> Column:
    """In (0, 1), from the row's own values by SHA-256 (52 bits): the same on every run."""
    said = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.sha2(said, 256), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def sized(docs: DataFrame, seed: int, id_col: str = "doc_id") -> dict[str, Column]:
    """What the mix reads from a document."""
    text = F.col("text").cast("string")
    return {"doc_id": F.col(id_col), "source": F.col("source").cast("string"), "size": word_count(text), "u": uniform(seed, F.col(id_col), text)}


def per_source(table: DataFrame) -> DataFrame:
    """A written table of one row a source, to be joined: broadcast if it is small, so that no document moves."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def source_cuts(rows: DataFrame, weights: tuple, share: float, most: float, rows_per_bucket: int) -> DataFrame:
    """(source, source_size, target, whole, rest, width, edge, cut): how often documents of a source are taken.

    All are taken ``whole`` times, and once more where their bucket is before ``edge``, or is it and (order_rank, doc_id,
    size) is not after ``cut``; where the target is beyond all documents, edge is null and all are.
    """
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = source_targets(rows, weights, share, most).withColumn("whole", F.floor(expected + F.lit(1e-12)))
    targets = targets.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    targets = materialize(targets.withColumn("width", F.least(F.lit(1.0), F.lit(4.0 * rows_per_bucket) / F.col("source_rows"))))
    ranked = placed(rows.filter("size > 0").withColumnRenamed("source", "of").join(per_source(targets), F.col("of").eqNullSafe(F.col("source"))))
    totals = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reached = totals.withColumn("before", before).filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    edges = reached.select(F.col("source").alias("e_source"), F.col("bucket").alias("edge"), "before")
    inside = ranked.join(edges, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("edge")))
    # rows that are alike in all three are peers: the default frame ends after the last of them
    run = F.sum("size").over(W.partitionBy("source").orderBy("order_rank", "doc_id", "size")) + F.col("before")
    # nearest prefix: a document counts if at least half of it lies before the target
    taken = inside.withColumn("run", run).filter(F.col("run") - F.col("size") / 2 <= F.col("rest"))
    cuts = taken.groupBy(F.col("source").alias("c_source")).agg(F.max(F.struct("order_rank", "doc_id", "size")).alias("cut"))
    found = targets.join(edges, F.col("source").eqNullSafe(F.col("e_source")), "left").join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left")
    return materialize(found.select("source", "source_size", "target", "whole", "rest", "width", "edge", "cut"))


def placed(rows: DataFrame) -> DataFrame:
    """With order_rank and bucket; documents without words are in none."""
    rows = rows.withColumn("order_rank", pareto_rank(F.col("u"), F.col("size").cast("double")))
    return rows.withColumn("bucket", F.when(F.col("size") > 0, F.floor(F.log("order_rank") / F.col("width"))))


def with_copies(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows (with size, u, source and doc_id) joined with their source's cut, and copies, taken and order_rank."""
    held = per_source(cuts.withColumnRenamed("source", "c_source"))
    joined = placed(rows.join(held, F.col("source").eqNullSafe(F.col("c_source"))).drop("c_source"))
    key = F.struct("order_rank", "doc_id", "size")
    in_edge = (F.col("bucket") == F.col("edge")) & F.coalesce(key <= F.col("cut"), F.lit(False))
    more = F.when((F.col("rest") <= 0) | F.col("bucket").isNull(), False).when(F.col("edge").isNull(), True).otherwise((F.col("bucket") < F.col("edge")) | in_edge)
    copies = (F.col("whole") + more.cast("int")).cast("long")
    joined = joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return joined.drop("whole", "rest", "width", "edge", "cut", "bucket", "u")


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
    seed: int = SEED,
    id_col: str = "doc_id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, order_rank."""
    rows = materialize(docs.select(*[c.alias(n) for n, c in sized(docs, seed, id_col).items()]))
    out = with_copies(rows, source_cuts(rows, weights, share, most, rows_per_bucket))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "order_rank")


def mix_documents(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
    seed: int = SEED,
    id_col: str = "doc_id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """The documents that the mix takes, with all their columns, how often (``copies``) and the words taken (``taken``).

    Documents without words have nothing to take and stay out; the two columns get other names where taken.
    """
    parts = sized(docs, seed, id_col)
    rows = materialize(docs.select(*[c.alias(n) for n, c in parts.items()]))
    cuts = source_cuts(rows, weights, share, most, rows_per_bucket)
    chosen = with_copies(docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in parts.items()]), cuts).filter("taken > 0")
    return chosen.select("row.*", F.col("copies").alias(fresh("copies", docs)), F.col("taken").alias(fresh("taken", docs)))
