"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of documents; the
last one returns the mix.  Stage results are written as Parquet to the shared checkpoint folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from palaver.llm.common import fresh, load, materialize, remove_path, shared_path
from palaver.llm.queries import third

#: Near-duplicate stages look at five words.  Fingerprints that differ in 4 of 64 bits are linked, and all texts whose
#: sets of shingles are 0.8 alike or more.
SHINGLE, MAX_DISTANCE, SIMILARITY = 5, 4, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go.  Null texts score lowest and stay; an empty table stays empty."""
    return toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"), usable=lambda i: third(i) != 1)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines frequent within a source go; documents that lost all their words go, others stay.

    Copies count as one page.  Where all rows of a text that several rows hold would go, the one with the smallest
    id (then source) stays as it was, so that every group of copies keeps a member.
    """
    digest = fresh("__digest", docs)
    cleaned = line_dedup.drop_boilerplate(docs.withColumn(digest, F.unhex(F.md5("text"))))
    (dropped,) = [c for c in cleaned.columns if c not in [*docs.columns, digest]]
    emptied = F.coalesce((F.col(dropped) > 0) & (F.btrim("text", F.lit(line_dedup.BLANKS)) == ""), F.lit(False))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("source").alias("host"))
    lost = cleaned.filter(emptied).groupBy(F.col(digest).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("row"))
    lost = materialize(lost.filter("n > 1").select("d", "row.id", "row.host"))
    same = (F.unhex(F.md5("text")) == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("host"))
    stay = cleaned.filter(~emptied)
    out = with_length(stay.select(*docs.columns))
    if lost.isEmpty():
        return out
    lost = lost.join(stay.select(F.col(digest).alias("d")), "d", "left_anti")
    # one row of those that are alike in all three
    return out.unionByName(docs.join(lost, same, "left_semi").dropDuplicates(["doc_id", "text", "source"]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays, the one with the smallest id."""
    return simhash.drop_near_duplicates(docs, SHINGLE, MAX_DISTANCE, similarity=SIMILARITY)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that benchmark windows hit go, and documents of which nothing else is left."""
    cleaned = decontaminate.remove_contamination(docs, load(spark, sf_dir, "benchmark"))
    (hits,) = [c for c in cleaned.columns if c not in docs.columns]
    return with_length(cleaned.drop(hits))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the documents it takes, with their columns, how often (copies) and their words times that (taken)."""
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("mixing", mix_sources),
]

#: SQL can express neither compression distances nor the tree search.
ORACLE_SQL = None


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; a stage's table goes when the next one is written."""
    folder = shared_path(spark, "pipeline")
    docs, held = load(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if held:
            remove_path(spark, held)
        docs, held = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
