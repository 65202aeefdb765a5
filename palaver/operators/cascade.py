"""Staged search of a turn (R7, U1-U3, R9): each further search is run for the sessions alone whose pool is still thin.

1. The session's query against its current segment; where that yields few, against the whole session (U1).
2. Without what the protected tail holds, pools with too few events or too few tokens are joined by a search over all
   segments, scored alike (U2).
3. Pools that still hold little of the retrieved budget are joined by plain similarity to the message alone (U3).

A stage is an equi-join on the session of those that enter it, so its cost is the size of these sessions; who enters is an
aggregate of a row a session.  Every search keeps its best k.  :func:`probe` looks for the hits of new sessions in others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.functions.vector import cosine
from palaver.operators import knn
from palaver.operators import retrieval as rt
from palaver.operators.graph import cut
from palaver.sources.messages import tokens

FOUND = ["session_id", "event_id", "similarity", "score", "stage", "ts", "type", "content"]


def search(asked: DataFrame, pool: DataFrame, query: str, k: int | None) -> DataFrame:
    """The k best events of each session's pool for its *query* column."""
    mine = asked.select("session_id", F.col(query).alias("__query"), "mode")
    rows = pool.join(mine, "session_id").withColumn("similarity", cosine(F.col("__query"), F.col("embedding"))).filter("similarity IS NOT NULL")
    best = rt.top_k(rows.drop("__query", "embedding"), k, key="session_id")
    return best.drop("rank")


def scored(rows: DataFrame, as_of: str, rate: float) -> DataFrame:
    """R3 with the weights of each session's mode."""
    weight = lambda n: F.element_at(F.map_from_arrays(F.array(*map(F.lit, S.MODE_WEIGHTS)), F.array(*[F.lit(w[n]) for w in S.MODE_WEIGHTS.values()])), F.col("mode"))
    bonus = F.coalesce("bonus", F.lit(0.0)) if "bonus" in rows.columns else F.lit(0.0)
    score = weight(0) * F.col("similarity") + weight(1) * rt.recency(F.col("ts"), as_of, rate) + weight(2) * bonus + weight(3) * rt.type_weight(F.col("type"))
    return rows.withColumn("score", score)


def unseen(rows: DataFrame, *seen: DataFrame) -> DataFrame:
    for s in seen:
        rows = rows.join(s.select("session_id", "event_id"), ["session_id", "event_id"], "left_anti")
    return rows


def thin(asked: DataFrame, pool: DataFrame, floor: int, least: int = 0) -> DataFrame:
    """The asked sessions whose pool has fewer than *least* events or fewer than *floor* tokens."""
    size = pool.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(tokens(F.col("content"))).alias("held"))
    joined = asked.join(size, "session_id", "left")
    poor: Column = F.coalesce("held", F.lit(0)) < floor
    if least:
        poor = poor | (F.coalesce("n", F.lit(0)) < least)
    return joined.filter(poor).drop("n", "held")


def staged_search(asked: DataFrame, pool: DataFrame, protected: DataFrame, budget: int, as_of: str, rate: float = S.RECENCY_LAMBDA, least: int = S.MIN_CANDIDATES, k: int | None = None) -> DataFrame:
    """FOUND columns: the events of each session's turn and the stage that found them.

    asked: session_id, mode, segment_id (the current one), query, clean (vectors of the query text and of the message);
    pool: session_id, segment_id, event_id, embedding, ts, type, content, perhaps bonus; protected: session_id, event_id.
    """
    asked = cut(asked.select("session_id", "mode", "segment_id", "query", "clean"))
    near = search(asked, pool.join(asked.select("session_id", "segment_id"), ["session_id", "segment_id"], "left_semi"), "query", k)
    near = cut(near.withColumn("stage", F.lit("segment")))
    few = thin(asked, near, 0, least)
    wide = unseen(search(few, pool, "query", k), near).withColumn("stage", F.lit("session"))
    one = cut(scored(unseen(near.unionByName(wide), protected), as_of, rate).select(*FOUND))
    poor = thin(asked, one, int(budget * S.THIN_DEDUP), least)
    more = unseen(search(poor, pool, "query", k), one, protected).withColumn("stage", F.lit("segments"))
    two = cut(one.unionByName(scored(more, as_of, rate).select(*FOUND)))
    still = thin(asked, two, int(budget * S.THIN_CLEAN))
    plain = unseen(search(still, pool, "clean", k), two, protected)
    plain = plain.withColumns({"stage": F.lit("message"), "score": F.col("similarity")})
    return two.unionByName(plain.select(*FOUND))


def probe(asked: DataFrame, counts: DataFrame, index: knn.Index, k: int = 3, most: int = 20) -> DataFrame:
    """(session_id, event_id, from_session, similarity, rank) for sessions of 1 to *most* events (counts: session_id, n): the best hits of others."""
    new = asked.join(counts.filter(F.col("n").between(1, most)).select("session_id"), "session_id", "left_semi")
    queries = new.select(F.col("session_id").alias("query_id"), F.col("session_id").alias("q_session"), F.col("clean").alias("query"))
    hits = knn.search(queries, index, k, others_only=True)
    return hits.select(F.col("query_id").alias("session_id"), "event_id", F.col("session_id").alias("from_session"), "similarity", "rank")
