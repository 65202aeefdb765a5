"""Filter interaction audit: what each order of five quality filters removes, from one cube of failure flags.

Every document gets five failure flags once (:func:`failures`).  A document survives a set of filters if none of their
flags is set, and how many survive a set does not depend on the order in which its filters ran.  So documents are counted by
part and flags, ``CUBE(part, A, B, C, D, E)`` over these few rows gives a row for each subset of flags, and the rows whose
selected flags are all false are the survivors of the 32 subsets.  A step of an order is the pair of the subset before it
and the subset after it: an equi-join of survivors with the steps, and one with survivors again.

Scale: texts are read once; a narrow row of each goes to the shared folder.  The first of a group of equal texts is found
by a partial aggregation on the digest and met on (id, digest), so a text that makes up a third of all rows is spread over
all tasks, as is a hot part.  What the cube reads is at most 32 rows a part.

Edge cases: a null text counts as empty (it fails the first condition alone, and the last if it repeats); a null or empty
``lang`` is the part ''; a row without an id neither repeats another nor is repeated; rows that share id and text are not
repeats of each other; a document with several label rows counts once, as good or toxic if one of them says so; labels of
unknown documents count nowhere; a very long text is one row of constant size after the scan; an empty table gives no rows;
further columns, also those named as the flags here, are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import materialize, text_or_empty

FILTERS = "ABCDE"
EVERY = (1 << len(FILTERS)) - 1
#: Fixed values of the conditions.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT = 100, 80, 10
BLANKS, WORD_BREAK, SYMBOLS = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+", r"[#$%&*|]"
#: What is counted of a group of documents.
COUNTS = ("n", "good", "toxic")


def text_failures(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns *keep* and the conditions that a text fails by itself; its words are made once."""
    bare = F.btrim(text, F.lit(BLANKS))
    parted = rows.select(*keep, text, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK)).alias("__words"))
    sized = parted.select(*keep, text, F.size("__words").cast("long").alias("__n"), F.size(F.array_distinct("__words")).cast("long").alias("__distinct"))
    return sized.select(
        *keep,
        (F.col("__n") < LEAST_WORDS).alias("A"),
        (F.col("__distinct") * 100 < F.col("__n") * LEAST_DISTINCT_PERCENT).alias("B"),
        (F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * MOST_UPPER_PERCENT).alias("C"),
        F.col(text).rlike(SYMBOLS).alias("D"),
    )


def failures(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """One row a document: id, part, good, toxic and the flags A to E."""
    text = text_or_empty(text_col)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("__text"))
    rows = materialize(text_failures(read, "__text", ["id", "part", "digest"]))
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = rows.join(firsts, ["id", "digest"], "left")
    of = labels.groupBy(F.col("doc_id").alias("id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    known = marked.join(of, "id", "left")
    no = F.lit(False)
    return known.select(
        "id", "part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), *list("ABCD"), (F.col("first").isNull() & F.col("id").isNotNull()).alias("E")
    )


def subset_survivors(flagged: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): what survives each subset of filters, zeros included; bit k of mask is filter k."""
    few = flagged.groupBy("part", *FILTERS).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in COUNTS[1:]])
    cubed = few.cube("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"free_{f}") for f in FILTERS])
    passed = F.lit(True)
    mask = F.lit(0)
    for k, f in enumerate(FILTERS):
        passed = passed & ((F.col(f"free_{f}") == 1) | ~F.coalesce(F.col(f), F.lit(False)))
        mask = mask + F.when(F.col(f"free_{f}") == 0, 1 << k).otherwise(0)
    counted = materialize(cubed.filter((F.col("all_parts") == 0) & passed).select("part", mask.alias("mask"), *COUNTS))
    masks = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(EVERY))).alias("mask"))
    return masks.join(counted, ["part", "mask"], "left").na.fill(0, list(COUNTS))


def order_steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, filter, bit, before, after): all orders of the filters, 120 with five steps each."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        done = 0
        for step, k in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), step, FILTERS[k], 1 << k, done, done | 1 << k))
            done |= 1 << k
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, bit int, before int, after int")


def audit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """One row per part, order and step: part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    survivors = materialize(subset_survivors(failures(docs, labels, text_col, id_col, part_col)))
    at = lambda name: survivors.select(F.col("part"), F.col("mask").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in COUNTS])
    steps = F.broadcast(order_steps(docs.sparkSession))  # 600 rows
    pairs = at("before").join(steps, "before").join(at("after"), ["part", "after"])
    pairs = pairs.withColumns({"removed": F.col("before_n") - F.col("after_n"), "rest": F.lit(EVERY).bitwiseXOR(F.col("bit")).cast("int")})
    # of one filter: subsets without any, with it alone, with all others and with all
    ends = survivors.filter(F.col("mask").isin(0, EVERY)).groupBy("part").agg(F.max(F.when(F.col("mask") == 0, F.col("n"))).alias("total"), F.max(F.when(F.col("mask") == EVERY, F.col("n"))).alias("clean"))
    alone = survivors.select("part", F.col("mask").alias("bit"), F.col("n").alias("alone"))
    others = survivors.select("part", F.col("mask").alias("rest"), F.col("n").alias("others"))
    shares = pairs.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    out = pairs.join(ends, "part").join(alone, ["part", "bit"]).join(others, ["part", "rest"]).join(shares, ["part", "filter"])
    return out.select(
        "part", "filter_order", "step", "filter", F.col("after_n").alias("kept"), "removed",
        (F.col("total") - F.col("alone") - F.col("removed")).alias("redundant"), (F.col("others") - F.col("clean")).alias("unique_fails"),
        (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"), "shapley",
    )
