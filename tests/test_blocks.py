"""Block products against all pairs one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.operators import blocks
from palaver.operators import retrieval as rt
from palaver.plans import queries as engine
from tests.test_knn import ASKED, SCHEMA, clustered, plain


def tables(spark):
    vectors = clustered()
    vectors += [(9000 + i, i % 3, vectors[5][2]) for i in range(25)]  # repeated vectors are ties
    vectors += [(9900, 1, None), (9901, 1, [0.0] * 16), (9902, 1, [1.0]), (9903, None, vectors[7][2])]
    queries = [(e, s, v) for e, s, v in vectors if v is not None and e % 50 == 0 and len(v) == 16]
    return vectors, queries, spark.createDataFrame(vectors, SCHEMA), spark.createDataFrame(queries, ASKED)


@pytest.mark.parametrize(("scope", "metric"), [("all", "cosine"), ("all", "l2"), ("other", "cosine"), ("session", "cosine")])
@pytest.mark.parametrize("limits", [(20_000, 2048), (60, 64)])
def test_best_equal_all_distances(spark, monkeypatch, scope, metric, limits):
    monkeypatch.setattr(blocks, "ROWS", limits[0])
    monkeypatch.setattr(blocks, "BLOCK", limits[1])
    vectors, queries, given, asked = tables(spark)
    got = {(r.query_id, r.event_id, r["rank"]) for r in rt.search(asked, given, scope, 6, metric).collect()}
    if scope == "session":
        assert got == {row for q in queries for row in plain([v for v in vectors if v[1] == q[1]], [q], 6)}
    else:
        assert got == plain(vectors, queries, 6, metric, scope == "other")


def test_all_pairs_and_composite_scores(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS_OF_ALL", 100)
    vectors, queries, given, asked = tables(spark)
    pairs = {(r.query_id, r.event_id): r.similarity for r in rt.score_pairs(asked, given.withColumnRenamed("session_id", "of")).collect()}
    known = {e: np.array(v) for e, _, v in vectors if v is not None and len(v) == 16 and any(v)}
    want = {(q, e): a @ known[e] / np.linalg.norm(a) / np.linalg.norm(known[e]) for q, _, v in queries for a in [np.array(v)] for e in known}
    assert set(pairs) == set(want) and all(abs(pairs[p] - want[p]) < 1e-12 for p in want)
    detailed = given.select("event_id", "embedding", F.timestamp_seconds(1_706_000_000 + F.col("event_id") * 60).alias("ts"), F.lit("decision").alias("type"))
    every = rt.composite(rt.score_pairs(asked, detailed), "2024-01-31 00:00:00", 0.0001, None)
    best = rt.best_composite(asked, detailed, 4, "2024-01-31 00:00:00", 0.0001, None)
    kept = lambda rows: sorted((r.query_id, r.mode, r["rank"], round(r.score, 9)) for r in rows.select("query_id", "mode", "rank", "score").collect())
    rank = F.row_number().over(rt.W.partitionBy("query_id", "mode").orderBy(F.col("score").desc(), "event_id"))
    assert kept(best) == kept(every.withColumn("rank", rank).filter("rank <= 4"))


@pytest.mark.parametrize("name", ["rank_modes", "context_pack", "knn_l2", "knn_global", "bootstrap_probe", "widen_fallback", "clean_query_fallback", "dedup_fallback", "metrics", "graph_boost"])
def test_no_query_set_is_copied_to_every_vector(spark, name):
    plan = engine.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
