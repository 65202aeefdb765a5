"""Ranked retrieval.

Queries meet vectors in block products (:mod:`palaver.operators.blocks`); neither side is held whole.  A search within
sessions lets the vectors of a session meet its own queries, so no other pair is formed.  Details join the vectors before
these meet queries, not each pair.  The best k keep a bounded state per query and task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.operators import blocks

#: What a score adds to the similarity, in the order of the weights of a mode.
TERMS = ("recency", "bonus", "type_weight")


def sides(queries: DataFrame, vectors: DataFrame, wanted: str | None) -> tuple[DataFrame, DataFrame]:
    """Queries and vectors as :func:`blocks.met` takes them; *wanted*: the column of queries that names the session whose vectors they meet."""
    asked = F.struct(*[c for c in queries.columns if c != "query"]).alias("q")
    given = F.struct(*[c for c in vectors.columns if c != "embedding"]).alias("v")
    group = (F.lit(0), F.lit(0)) if wanted is None else (F.col(wanted), F.col("session_id"))
    return queries.select(group[0].alias("g"), asked, F.col("query").alias("vector")), vectors.select(group[1].alias("g"), given, F.col("embedding").alias("vector"))


def score_pairs(queries: DataFrame, vectors: DataFrame, metric: str = "cosine") -> DataFrame:
    """(query_id, query session, vector row, similarity) of a stated query set against all vectors, all pairs."""
    return blocks.met(*sides(queries, vectors, None), None, metric).drop("mode", "score")


def score_in_sessions(queries: DataFrame, vectors: DataFrame, wanted: str, metric: str = "cosine") -> DataFrame:
    """V3, V4: as :func:`score_pairs`, of each query with the vectors of its own sessions alone (*wanted*: a column of queries)."""
    return blocks.met(*sides(queries, vectors, wanted), None, metric).drop("mode", "score")


def top_k(scored: DataFrame, k: int | None, by: str = "similarity", key: str = "query_id") -> DataFrame:
    """Rank within a query; k of 0 or None keeps all."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col(by).desc(), "event_id"))
    ranked = scored.withColumn("rank", rank)
    return ranked.filter(F.col("rank") <= k) if k else ranked


def search(queries: DataFrame, vectors: DataFrame, scope: str, k: int, metric: str = "cosine") -> DataFrame:
    """Filter first, then the exact top k.

    scope: 'session' (queries carry q_session), 'sessions' (q_sessions, an array; empty finds nothing),
    'other' (not q_session) or 'all'.
    """
    others, wanted = None, {"session": "q_session", "sessions": "q_one"}.get(scope)
    if scope == "sessions":
        queries = queries.withColumn("q_one", F.explode(F.array_distinct("q_sessions")))
    elif scope == "other":
        queries, others = queries.filter("q_session IS NOT NULL"), ("q_session", "session_id")
    found = blocks.met(*sides(queries, vectors, wanted), k or None, metric, others)
    return top_k(found.drop("mode", "score", "q_one"), k)


def recency(ts: Column, as_of: str, rate: float = S.RECENCY_LAMBDA) -> Column:
    """Exponential decay by minutes; 0 for an unreadable time."""
    minutes = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 60e6
    return F.coalesce(F.exp(-rate * minutes), F.lit(0.0))


def type_weight(kind: Column) -> Column:
    """R2."""
    out = F.lit(S.TYPE_WEIGHT_DEFAULT)
    for name, weight in S.TYPE_WEIGHTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def with_terms(rows: DataFrame, as_of: str, rate: float = S.RECENCY_LAMBDA) -> DataFrame:
    """Rows with what does not depend on a query, unless they have it: recency, type_weight and bonus."""
    parts = {"recency": lambda: recency(F.col("ts"), as_of, rate), "type_weight": lambda: type_weight(F.col("type")), "bonus": lambda: F.lit(0.0)}
    return rows.withColumns({name: made() for name, made in parts.items() if name not in rows.columns})


def best_composite(queries: DataFrame, vectors: DataFrame, k: int, as_of: str, rate: float = S.RECENCY_LAMBDA, mode: str | None = "general") -> DataFrame:
    """The k best rows of each query (and mode) by :func:`composite`, without forming all pairs; ``rank`` says their order."""
    rows = with_terms(vectors, as_of, rate).withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
    modes = {mode: S.MODE_WEIGHTS[mode]} if mode else S.MODE_WEIGHTS
    found = blocks.met(*sides(queries, rows, None), k, terms=TERMS, modes=dict(modes))
    rank = F.row_number().over(W.partitionBy("query_id", "mode").orderBy(F.col("score").desc(), "event_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def composite(rows: DataFrame, as_of: str, rate: float = S.RECENCY_LAMBDA, mode: str | None = "general") -> DataFrame:
    """The weighted sum for one mode, or for all modes (mode None) as rows."""
    rows = with_terms(rows, as_of, rate)
    of = {mode: S.MODE_WEIGHTS[mode]} if mode else S.MODE_WEIGHTS
    weights = F.array(*[F.struct(F.lit(m).alias("mode"), *[F.lit(x).alias(n) for x, n in zip(w, "srdt", strict=True)]) for m, w in of.items()])
    rows = rows.withColumn("w", F.explode(weights))
    score = F.col("w.s") * F.col("similarity") + F.col("w.r") * F.col("recency") + F.col("w.d") * F.coalesce("bonus", F.lit(0.0)) + F.col("w.t") * F.col("type_weight")
    return rows.withColumns({"mode": F.col("w.mode"), "score": score}).drop("w")


def widen(narrow: DataFrame, wide: DataFrame, least: int = S.MIN_CANDIDATES, key: str = "query_id") -> DataFrame:
    """The wider pool joins only for queries whose own pool is thin; an event counts once, narrow first."""
    n = narrow.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    thin = wide.join(n, key, "left").filter(F.coalesce("n", F.lit(0)) < least).drop("n")
    extra = thin.join(narrow.select(key, "event_id"), [key, "event_id"], "left_anti")
    return narrow.withColumn("origin", F.lit("narrow")).unionByName(extra.withColumn("origin", F.lit("wide")))


def widen_if_thin(pool: DataFrame, more: DataFrame, budget: Column, share: float, least: int | None, source: str, key: str = "query_id") -> DataFrame:
    """Rows of *more* for queries whose pool has few events or few tokens against the budget."""
    size = pool.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("held"))
    poor = F.coalesce("held", F.lit(0)) < budget * share
    poor = poor | (F.coalesce("n", F.lit(0)) < least) if least else poor
    wanted = more.join(size, key, "left").filter(poor).drop("n", "held")
    extra = wanted.join(pool.select(key, "event_id"), [key, "event_id"], "left_anti")
    return pool.withColumn("score_source", F.lit("composite")).unionByName(extra.withColumn("score_source", F.lit(source)))


def without_tail(candidates: DataFrame, tail: DataFrame) -> DataFrame:
    """Candidates that the protected tail does not hold."""
    return candidates.join(tail.select("event_id"), "event_id", "left_anti")


def with_details(candidates: DataFrame, events: DataFrame, columns: list[str]) -> DataFrame:
    """One inner join in place of a lookup per candidate; missing events drop out."""
    return candidates.join(events.select("event_id", *columns), "event_id")


def merge_rerank(candidates: DataFrame, responses: DataFrame, k: int | None = None) -> DataFrame:
    """Scores from a reranker's JSON answer (results with index and score, or scores); unscored keep theirs."""
    shape = "struct<results:array<struct<index:int,relevance_score:double,score:double>>,scores:array<double>>"
    parsed = responses.select("query_id", F.from_json("body", shape).alias("r"))
    listed = parsed.select("query_id", F.explode("r.results").alias("x")).select("query_id", (F.col("x.index") + 1).alias("rank"), F.coalesce("x.relevance_score", "x.score").alias("new"))
    plain = parsed.filter("r.results IS NULL").select("query_id", F.posexplode("r.scores").alias("p", "new")).select("query_id", (F.col("p") + 1).alias("rank"), "new")
    joined = candidates.join(listed.unionByName(plain), ["query_id", "rank"], "left")
    scored = joined.withColumn("score", F.coalesce("new", "score")).drop("new", "rank")
    return top_k(scored, k, by="score")
