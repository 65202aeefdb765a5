"""The pruned search against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.operators import knn


def plain(vectors, queries, k, metric="cosine", others_only=False):
    out = set()
    for q, qs, query in queries:
        a, scored = np.array(query, dtype=float), []
        for e, s, v in vectors:
            if v is None or len(v) != len(a) or (others_only and (s is None or s == qs)):
                continue
            b = np.array(v, dtype=float)
            n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
            if metric == "l2":
                scored.append((-1 / (1 + np.sqrt(((a - b) ** 2).sum())), e))
            elif n > 0:
                scored.append((-(b * a).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum())), e))
        out |= {(q, e, r) for r, (_, e) in enumerate(sorted(scored)[:k], 1)}
    return out


def clustered(seed=5, centers=12, size=60, dim=16):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, dim)) * 5
    points = np.concatenate([m + rng.normal(size=(size, dim)) * 0.2 for m in middle])
    return [(i, i % 4, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]


SCHEMA = "event_id long, session_id long, embedding array<float>"
ASKED = "query_id long, q_session long, query array<float>"


@pytest.mark.parametrize(("metric", "others"), [("cosine", False), ("l2", False), ("cosine", True)])
@pytest.mark.parametrize("limits", [(50_000, 2048), (7, 2)])
def test_equals_all_distances(spark, monkeypatch, metric, others, limits):
    monkeypatch.setattr(knn, "CELL_ROWS", limits[0])
    monkeypatch.setattr(knn, "BLOCK", limits[1])
    vectors = clustered()
    vectors += [(9000 + i, i % 3, vectors[5][2]) for i in range(25)]  # repeated vectors are ties
    vectors += [(9900, 1, None), (9901, 1, [0.0] * 16), (9902, 1, [1.0]), (9903, None, vectors[7][2])]
    queries = [(e, s, v) for e, s, v in vectors if v is not None and e % 50 == 0 and len(v) == 16]
    index = knn.build_index(spark.createDataFrame(vectors, SCHEMA), metric)
    got = knn.search(spark.createDataFrame(queries, ASKED), index, 6, others).collect()
    assert {(r.query_id, r.event_id, r["rank"]) for r in got} == plain(vectors, queries, 6, metric, others)


def test_cells_are_skipped(spark):
    """A query reads its own cluster and little more."""
    vectors = clustered()
    queries = spark.createDataFrame([(e, s, v) for e, s, v in vectors if e % 20 == 0], ASKED)
    index = knn.build_index(spark.createDataFrame(vectors, SCHEMA))
    assert len(index.cells) > 12
    start = knn.deal(queries.withColumn("bound", F.lit(float("inf"))), index, knn.nearest_cells(index, 5))
    first = knn.top_k(knn.meet(start, index, 5, False), 5)
    rest = knn.deal(knn.with_bounds(queries, first, 5, "cosine"), index, knn.cells_left(index, 5))
    met = start.select("query_id", "cell").unionByName(rest.select("query_id", "cell"))
    assert met.count() == met.distinct().count()  # no cell twice
    assert met.count() < 0.4 * queries.count() * len(index.cells)


def test_runs_of_rows_are_passed_over():
    pivots = np.array([[1.0, 0.0]])
    part = knn.Part((0, 0, 0), pivots, "l2", 1, False)
    import pyarrow as pa

    def batch(dist, bound, query, event, vector):
        n = len(dist)
        return pa.RecordBatch.from_arrays(
            [pa.array([0] * n, pa.int32())] * 3 + [pa.array(dist), pa.array(bound), pa.array(query, pa.int64()), pa.array([None] * n, pa.int64()), pa.array(event, pa.int64()), pa.array([None] * n, pa.int64()), pa.array(vector, pa.list_(pa.float64()))],
            names=list("abcdefghij"),
        )

    part.take(batch([-1.0], [0.5], [1], [None], [[1.0, 0.1]]))
    part.take(batch([0.1, 0.2], [0.0] * 2, [None] * 2, [7, 8], [[1.0, 0.1], [1.0, 0.2]]))
    part.take(batch([3.0, 4.0], [0.0] * 2, [None] * 2, [9, 10], [[1.0, 3.0], [1.0, 4.0]]))
    assert part.passed_over == 2 and part.found[0][0][1] == 7


def test_nothing_to_search(spark):
    vectors, queries = spark.createDataFrame(clustered(size=1), SCHEMA), spark.createDataFrame([(1, 1, [0.5] * 16), (2, 1, None)], ASKED)
    assert knn.search(queries, knn.build_index(vectors.limit(0)), 3).count() == 0
    assert knn.search(queries.limit(0), knn.build_index(vectors), 3).count() == 0
    assert knn.search(queries, knn.build_index(vectors), 30).count() == 12  # fewer than asked for
