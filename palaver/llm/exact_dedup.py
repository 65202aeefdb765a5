"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary (``DataFrameStatFunctions.freqItems``: the Karp-Schenker-Papadimitriou
counters, merged over partitions) proposes every digest that may make up more than ``support`` of all
rows.  The candidates, at most ``1/support`` of them, are counted exactly; the verified ones are
broadcast and resolved without any shuffle of their rows, and only the rest is shuffled by digest.

Edge cases: a null text counts as empty; a null ``doc_id`` ranks below every other; of rows that
repeat a ``doc_id`` within a group exactly one is kept; a very long text is hashed whole and is a row like any other; an empty table gives no rows; further input
columns are ignored by :func:`resolve_duplicates` and pass through :func:`drop_duplicates_exact`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import fresh, materialize, text_or_empty

#: A digest in more than this share of all rows is heavy; the summary holds 1/SUPPORT counters.
SUPPORT = 1e-3


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One narrow row per document, written once: the text is read a single time."""
    return materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"),
        ).withColumn("row_id", F.monotonically_increasing_id())
    )


def heavy_candidates(digested: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Misra-Gries candidates, at most 1/support digests; no heavy digest is missing."""
    summary = digested.select(F.hex("digest").alias("d")).stat.freqItems(["d"], support)
    return summary.select(F.explode(F.col(summary.columns[0])).alias("d")).select(F.unhex("d").alias("digest"))


def winners(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays, by partial aggregation."""
    return rows.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row_id")).alias("win"), F.count(F.lit(1)).alias("group_size")
    )


def resolve_duplicates(
    docs: DataFrame, support: float = SUPPORT, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, text_col, id_col)
    total = rows.count()
    candidates = heavy_candidates(rows, support)
    # at most 1/support rows, each verified by its exact count: the bound of the broadcast
    heavy = materialize(
        winners(rows.join(F.broadcast(candidates), "digest", "left_semi")).filter(
            F.col("group_size") > F.lit(support * total)
        )
    )
    of_heavy = rows.join(F.broadcast(heavy), "digest")
    light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    # every light digest covers at most support of the rows
    of_light = light.join(winners(light), "digest")
    return of_heavy.unionByName(of_light).select(
        "doc_id",
        F.col("win.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("win.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates_exact(
    docs: DataFrame, support: float = SUPPORT, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows are matched by (id, digest); of rows repeating both, one stays.
    """
    kept = resolve_duplicates(docs, support, text_col, id_col).filter("kept")
    d, k = fresh("__digest", docs), fresh("__keep", docs)
    keyed = docs.withColumn(d, F.sha2(text_or_empty(text_col), 256))
    stay = kept.select(F.col("doc_id").alias(k), F.col("text_sha256").alias(d + "_k"))
    joined = keyed.join(stay, keyed[id_col].eqNullSafe(stay[k]) & (keyed[d] == stay[d + "_k"]), "left_semi")
    return joined.dropDuplicates([id_col, d]).drop(d)
