"""Stored and sliding centroids against plain sums."""

import os

import numpy as np
import pytest

from palaver.operators import centroids as cn

SCHEMA = "event_id long, segment_id string, embedding array<float>"


def vectors(n, segments, seed=1, dim=4):
    rng = np.random.default_rng(seed)
    return [(i, f"s{rng.integers(segments)}", [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in range(n)]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def same_as_plain(spark, table, rows):
    got = {r.segment_id: r for r in table.read().collect()}
    for s in {r[1] for r in rows}:
        mine = np.array([r[2] for r in rows if r[1] == s])
        assert got[s].n == len(mine) and np.allclose(got[s].sums, mine.sum(axis=0))
    whole = {r.segment_id: r.fingerprint for r in cn.partials(spark.createDataFrame(rows, SCHEMA), "segment_id").collect()}
    assert {s: r.fingerprint for s, r in got.items()} == whole


def test_batches_equal_recomputation(spark, tmp_path):
    rows = vectors(300, 9)
    table = cn.CentroidTable(spark, f"{tmp_path}/t", buckets=5)
    assert table.read() is None
    for b in range(3):
        table.apply(b, spark.createDataFrame(rows[b * 100 : b * 100 + 100], SCHEMA))
    same_as_plain(spark, table, rows)
    assert table.vacuum() > 0 and all(len(v) == 1 for v in table.versions().values())
    same_as_plain(spark, table, rows)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    rows = vectors(200, 20)
    table = cn.CentroidTable(spark, f"{tmp_path}/t", buckets=8)
    table.apply(0, spark.createDataFrame(rows, SCHEMA))
    before = files(tmp_path)
    more = [(1000, rows[0][1], rows[0][2])]
    (written,) = table.apply(1, spark.createDataFrame(more, SCHEMA))
    after = files(tmp_path)
    assert before.items() <= after.items()  # the old version stays for its readers
    assert {p for p in after if p not in before} and all(f"bucket={written}/version=1" in p for p in after if p not in before)
    same_as_plain(spark, table, rows + more)
    table.vacuum()
    assert {p: t for p, t in files(tmp_path).items() if f"bucket={written}/" not in p} == {p: t for p, t in before.items() if f"bucket={written}/" not in p}


def test_a_batch_cut_short_is_finished_by_its_repeat(spark, tmp_path):
    """The first run reached some buckets: the second writes the others and nothing counts twice."""
    rows, more = vectors(120, 12), [(i + 500, s, v) for i, s, v in vectors(120, 12, seed=2)]
    table = cn.CentroidTable(spark, f"{tmp_path}/t", buckets=6)
    table.apply(0, spark.createDataFrame(rows, SCHEMA))
    batch = spark.createDataFrame(more, SCHEMA)
    reached = table.apply(1, batch.filter(table.bucket() < 3))
    rest = table.apply(1, batch)
    assert reached and rest and not set(reached) & set(rest)
    assert table.apply(1, batch) == []
    same_as_plain(spark, table, rows + more)


@pytest.mark.parametrize("block_rows", [5000, 12])
def test_window_means(spark, block_rows):
    rows = vectors(150, 2) + [(900, "s0", None)]
    got = {r.event_id: r for r in cn.window_centroids(spark.createDataFrame(rows, SCHEMA), "segment_id", ["event_id"], 10, 3, block_rows).collect()}
    assert len(got) == 150
    for i, s, _ in rows[:150]:
        last = [v for j, t, v in rows if t == s and j < i and v is not None][-10:]
        assert got[i].n == len(last)
        assert got[i].centroid is None if len(last) < 3 else np.allclose(got[i].centroid, np.mean(last, axis=0))


def test_no_vectors(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert cn.window_centroids(empty, "segment_id", ["event_id"]).count() == 0
    assert cn.CentroidTable(spark, f"{tmp_path}/t").apply(0, empty) == []
