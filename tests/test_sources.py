"""The cursor source, the rotating sink, re-embedding and stored lineage."""

import json
import os

import pytest
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.functions.enrichment import HashedEmbedder
from palaver.operators import graph as gr
from palaver.operators import lineage as ln
from palaver.sources import cursor, reindex, trace_sink
from palaver.sources.buckets import BucketTable

# -- message buffers ------------------------------------------------------------------------------


def put(folder, session, messages, mode="a", end="\n"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{session}.jsonl", mode) as f:
        f.write("\n".join(json.dumps({"role": "user", "content": m}) for m in messages) + (end if messages else ""))


@pytest.fixture
def pull(spark, tmp_path):
    spark.dataSource.register(cursor.MessageBuffers)

    def run(width=cursor.RANGE):
        """New messages since the last run, in the stream's own log."""
        stream = spark.readStream.format("message_buffers").option("range", width).load(f"{tmp_path}/buffers")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/log").option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/log").collect()
        return sorted((r.session_id, r.content) for r in rows)

    return run


@pytest.mark.parametrize("width", [cursor.RANGE, 50])
def test_each_message_once(pull, tmp_path, width):
    folder = f"{tmp_path}/buffers"
    put(folder, "a", ["a0", "a1", "ä2"])
    put(folder, "b", ["b0"])
    want = [("a", "a0"), ("a", "a1"), ("a", "ä2"), ("b", "b0")]
    assert pull(width) == sorted(want)
    assert pull(width) == sorted(want)  # nothing new, also after a restart
    put(folder, "a", ["a3", "a4 is longer than what a task reads " * 5])
    put(folder, "c", ["c0"])
    want += [("a", "a3"), ("a", "a4 is longer than what a task reads " * 5), ("c", "c0")]
    assert pull(width) == sorted(want)


def test_a_line_that_is_not_whole_waits(pull, tmp_path):
    folder = f"{tmp_path}/buffers"
    put(folder, "a", ["a0", "a1"], end="")
    assert pull() == [("a", "a0")]
    with open(f"{folder}/a.jsonl", "a") as f:
        f.write("\nno message\n[1]\n")
    assert pull() == [("a", "a0"), ("a", "a1")]


def test_a_buffer_that_shrank_is_read_anew(pull, tmp_path):
    folder = f"{tmp_path}/buffers"
    put(folder, "a", ["a0", "a1", "a2"])
    put(folder, "b", ["b0", "b1"])
    assert len(pull()) == 5
    put(folder, "a", ["new"], mode="w")
    put(folder, "b", ["b2"])
    assert pull() == sorted([("a", "a0"), ("a", "a1"), ("a", "a2"), ("a", "new"), ("b", "b0"), ("b", "b1"), ("b", "b2")])


def test_ranges_share_no_line(tmp_path):
    folder = f"{tmp_path}/buffers"
    put(folder, "a", [f"message {i} " + "x" * (i % 17) for i in range(60)])
    for width in (1, 7, 40, 10_000):
        reader = cursor.BufferReader(folder, width)
        parts = reader.ranges({}, reader.cursors({}))
        got = [r[3] for p in parts for r in reader.rows(p)]
        assert got == [f"message {i} " + "x" * (i % 17) for i in range(60)]


def test_buffers_as_a_table(spark, tmp_path):
    spark.dataSource.register(cursor.MessageBuffers)
    put(f"{tmp_path}/buffers", "a", ["a0", "a1"])
    rows = spark.read.format("message_buffers").load(f"{tmp_path}/buffers").orderBy("at").collect()
    assert [(r.session_id, r.role, r.content) for r in rows] == [("a", "user", "a0"), ("a", "user", "a1")] and rows[0]["at"] == 0


# -- the trace ------------------------------------------------------------------------------------


def turns(spark, first, n, broken=False):
    ids = spark.range(first, first + n, 1, 2)
    name = F.concat(F.lit("t"), F.col("id").cast("string"))
    if broken:
        name = F.when(F.col("id") == first + n - 1, F.raise_error(F.lit("lost"))).otherwise(name)
    shape = spark.createDataFrame([], S.TRACE).schema
    return ids.select(*[name.alias("turn_id") if f.name == "turn_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in shape])


def generations(path):
    return {g: sum(os.path.getsize(os.path.join(path, g, f)) for f in os.listdir(os.path.join(path, g)) if f.endswith(".json")) for g in os.listdir(path) if g != trace_sink.JOBS}


def test_trace_rotates_by_size(spark, tmp_path):
    spark.dataSource.register(trace_sink.TraceSink)
    path = f"{tmp_path}/trace"
    for k in range(12):
        turns(spark, 100 * k, 20).write.format("turn_trace").option("max_bytes", 9000).mode("append").save(path)
        ids = {r.turn_id for r in trace_sink.read_rotated(spark, path).collect()}
        assert {f"t{100 * k + i}" for i in range(20)} <= ids
    sizes = generations(path)
    assert set(sizes) == {"current", "1", "2", "3"} and all(0 < s <= 9000 for s in sizes.values())
    assert not os.listdir(f"{path}/{trace_sink.JOBS}")
    assert len(ids) < 240 and "t0" not in ids  # the oldest generation went


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(trace_sink.TraceSink)
    path = f"{tmp_path}/trace"
    turns(spark, 0, 10).write.format("turn_trace").mode("append").save(path)
    before = generations(path)
    with pytest.raises(Exception, match="lost"):
        turns(spark, 100, 10, broken=True).write.format("turn_trace").mode("append").save(path)
    assert generations(path) == before and not os.listdir(f"{path}/{trace_sink.JOBS}")
    assert trace_sink.read_rotated(spark, f"{tmp_path}/none").count() == 0


# -- re-embedding ---------------------------------------------------------------------------------


class Failing(HashedEmbedder):
    """Gives out at an event."""

    def __init__(self, event):
        super().__init__()
        self.event = event

    def embed(self, texts):
        if any(f"event {self.event} with" in t for t in texts):
            raise RuntimeError("service is down")
        return super().embed(texts)


def log(spark, n=120):
    said = F.concat(F.lit("event "), F.col("id").cast("string"), F.lit(" with some text"))
    rows = spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 5).cast("string").alias("session_id"), F.lit("s").alias("segment_id"), F.lit("user_message").alias("type"), said.alias("content"), F.lit(4).cast("long").alias("token_estimate"))
    return rows.withColumn("content", F.when(F.col("event_id") == 3, F.lit("  ab ")).otherwise(F.col("content")))


def test_a_run_that_was_cut_short_is_finished(spark, tmp_path):
    from palaver.functions.enrichment import embed_events

    events = log(spark)
    table = BucketTable(spark, f"{tmp_path}/v", "event_id", 6)
    table.write(embed_events(events.filter("event_id < 90"), HashedEmbedder(8), "old").select(*reindex.VECTOR_COLUMNS), 0)
    middle = events.filter(table.bucket() == 3).agg(F.max("event_id")).first()[0]
    with pytest.raises(Exception, match="service is down"):
        reindex.reembed(table, events, Failing(middle), "new", 1, at_once=1)
    reached = {b for b, v in table.newest().items() if v == 1}
    assert 0 < len(reached) < 6
    half = {r.event_id: r.embedding_model_id for r in table.read().collect()}
    assert set(range(90)) - {3} <= set(half)  # no vector lost, each bucket of one model
    rest = reindex.reembed(table, events, HashedEmbedder(), "new", 1, at_once=1)
    assert set(rest) == set(range(6)) - reached
    rows = table.read().collect()
    assert sorted(r.event_id for r in rows) == [i for i in range(120) if i != 3]
    assert {r.embedding_model_id for r in rows} == {"new"} and {len(r.embedding) for r in rows} == {64}


class Counting(HashedEmbedder):
    """Counts the texts that it is given, in all tasks."""

    def __init__(self, given):
        super().__init__()
        self.given = given

    def embed(self, texts):
        self.given.add(len(texts))
        return super().embed(texts)


def test_a_run_embeds_each_text_once(spark, tmp_path):
    """Which buckets change is found from ids and models, not by embedding."""
    given, events = spark.sparkContext.accumulator(0), log(spark)
    table = BucketTable(spark, f"{tmp_path}/v", "event_id", 6)
    assert sorted(reindex.reembed(table, events, Counting(given), "new", 1, at_once=2)) == list(range(6))
    assert given.value == 119 and table.read().count() == 119
    assert reindex.reembed(table, events, Counting(given), "new", 2, at_once=2) == [] and given.value == 119
    assert sorted(reindex.reembed(table, events, Counting(given), "newer", 3, at_once=4)) == list(range(6)) and given.value == 238


def test_buckets_without_stale_vectors_are_left_alone(spark, tmp_path):
    events = log(spark)
    table = BucketTable(spark, f"{tmp_path}/v", "event_id", 6)
    assert sorted(reindex.reembed(table, events, HashedEmbedder(), "new", 1)) == list(range(6))
    assert reindex.reembed(table, events, HashedEmbedder(), "new", 2) == []
    more = events.unionByName(events.filter("event_id = 0").withColumn("event_id", F.lit(5000).cast("long")))
    assert len(reindex.reembed(table, more, HashedEmbedder(), "new", 3)) == 1
    assert table.vacuum() == 1 and table.read().count() == 120


# -- lineage of given sessions --------------------------------------------------------------------


def test_chains_of_seeds(spark, tmp_path):
    links = [(i, i + 1) for i in range(0, 12)] + [(i, i + 1) for i in range(100, 103)] + [(5, 50), (60, 5), (200, 201), (201, 200), (7, 7), (None, 3)]
    lineage = spark.createDataFrame(links, "old_session_id long, new_session_id long")
    table = ln.LineageTable(spark, f"{tmp_path}/l", 16)
    table.build(lineage)
    seeds = spark.createDataFrame([(5,), (101,), (200,), (999,)], "session_id long")
    got = {(r.session_id, r.member) for r in ln.chains_of(table, seeds).collect()}
    want = {(r.session_id, r.member) for r in gr.lineage_chain(seeds, lineage).collect()}
    assert got == want and (5, 60) in got and (5, 50) in got
    states = spark.createDataFrame([(2, "far"), (4, "near"), (101, "own")], "session_id long, goal string")
    found = {r.session_id: (r.source_session, r.goal) for r in ln.nearest_state(table, seeds, states).collect()}
    assert found == {5: (4, "near"), 101: (101, "own")}


def test_only_the_chains_buckets_are_opened(spark, tmp_path):
    lineage = spark.range(0, 40_000, 2).select(F.col("id").alias("old_session_id"), (F.col("id") + 1).alias("new_session_id"))
    table = ln.LineageTable(spark, f"{tmp_path}/l", 64)
    table.build(lineage)
    front = spark.createDataFrame([(1001,)], "node long")
    links = table.links(front, ln.UP)
    assert len(links.inputFiles()) == 1
    assert [(r.node, r.next) for r in links.collect()] == [(1001, 1000)]
    assert "PushedFilters: [IsNotNull(up), IsNotNull(node), EqualTo(up,true), EqualTo(node,1001)]" in links._jdf.queryExecution().toString()


def test_a_long_chain_is_walked(spark, tmp_path):
    lineage = spark.range(30).select(F.col("id").alias("old_session_id"), (F.col("id") + 1).alias("new_session_id"))
    table = ln.LineageTable(spark, f"{tmp_path}/l", 4)
    table.build(lineage)
    assert ln.chains_of(table, spark.createDataFrame([(15,)], "session_id long")).count() == 31


def test_buffers_of_many_sessions(spark, tmp_path):
    """Buffers, and so cursors and tasks, do not grow with the sessions; lines say whose they are."""
    lines = spark.range(600).selectExpr("id % 200 AS session_id", "id DIV 200 AS msg_index", "to_json(struct(cast(id % 200 AS string) AS session_id, 'user' AS role, cast(id AS string) AS content)) AS line")
    cursor.write_buffers(lines.repartition(3), str(tmp_path))
    assert 0 < len(cursor.buffers(str(tmp_path))) <= 4
    spark.dataSource.register(cursor.MessageBuffers)
    rows = spark.read.format("message_buffers").load(str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.session_id, r["at"])):
        got.setdefault(int(r.session_id), []).append(int(r.content))
    assert got == {s: [s, s + 200, s + 400] for s in range(200)}
