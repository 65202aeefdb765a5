"""Ordered stateful streams against their batch folds, for late rows in any micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palaver.operators import graph as gr
from palaver.operators import state as st
from palaver.streaming import ordered, pipelines

COMMITS = "session_id string, id long, ts timestamp, goal string, current_step string, intent_label string, activity_ts timestamp"
EVENTS = "session_id string, event_id long, ts timestamp, type string"
START = datetime(2024, 1, 1)


def shuffled(rows, seed, batches=5):
    """Micro-batches by time, each row up to two minutes late; the last one moves the watermark on."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(120)))
    size = -(-len(late) // batches)
    for b in range(0, len(late), size):
        part = late[b : b + size]
        rng.shuffle(part)
        yield part


def stream_of(spark, folder, schema, batches, last):
    for part in [*batches, [last]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return pipelines.read_events(spark, folder, spark.createDataFrame([], schema).schema, files=1)


def commits(seed):
    rng, at, rows = random.Random(seed), START, []
    for i in range(120):
        at += timedelta(seconds=rng.randrange(60))
        rows.append((f"s{rng.randrange(4)}", i, at, rng.choice(["a", "a", "a", "b"]), rng.choice(["x", "x", None]), None, at - timedelta(seconds=rng.randrange(400)) if rng.random() < 0.3 else None))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_snapshots_equal_the_batch_fold(spark, tmp_path, seed):
    rows = commits(seed)
    want = {(r.session_id, r.id) for r in st.snapshot_log(spark.createDataFrame(rows, COMMITS)).collect()}
    last = ("end", 10_000, START + timedelta(days=2), "a", None, None, None)
    stream = stream_of(spark, f"{tmp_path}/in", COMMITS, shuffled(rows, seed), last)
    ordered.start(ordered.live_snapshots(stream, "3 minutes"), f"{tmp_path}/log", f"{tmp_path}/offsets").awaitTermination()
    got = [(r.session_id, r.id) for r in spark.read.parquet(f"{tmp_path}/log").filter("session_id <> 'end'").collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < len(rows)


def test_keepalive_after_120_seconds_without_change(spark, tmp_path):
    rows = [("s", i, START + timedelta(seconds=s), "a", "x", "l", None) for i, s in enumerate((0, 60, 119, 120, 200, 239, 241))]
    stream = stream_of(spark, f"{tmp_path}/in", COMMITS, [rows[::-1]], ("end", 99, START + timedelta(days=1), "a", None, None, None))
    ordered.start(ordered.live_snapshots(stream, "10 minutes"), f"{tmp_path}/log", f"{tmp_path}/offsets").awaitTermination()
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/log").filter("session_id = 's'").orderBy("id").collect()] == [0, 3, 6]


def test_edges_equal_the_batch_rule_and_survive_a_restart(spark, tmp_path):
    rng, at, rows = random.Random(4), START, []
    for i in range(400):
        at += timedelta(seconds=rng.randrange(20))
        rows.append((f"s{rng.randrange(3)}", i, at, rng.choice(["tool_call", "tool_output", "assistant_message", "user_message"])))
    want = {(r.from_event_id, r.to_event_id, r.edge_type) for r in gr.derive_edges(spark.createDataFrame(rows, EVENTS)).collect()}
    parts, folder = list(shuffled(rows, 4, 6)), f"{tmp_path}/in"

    def run(batches):
        for part in batches:
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        stream = pipelines.read_events(spark, folder, spark.createDataFrame([], EVENTS).schema, files=1)
        ordered.start(ordered.live_edges(stream, "3 minutes"), f"{tmp_path}/edges", f"{tmp_path}/offsets").awaitTermination()
        return [(int(r.from_event_id), int(r.to_event_id), r.edge_type) for r in spark.read.parquet(f"{tmp_path}/edges").collect()]

    first = run(parts[:3])  # what the watermark has not passed is still open
    assert set(first) < want
    got = run([*parts[3:], [("end", 9999, START + timedelta(days=2), "tool_call")]])
    assert len(got) == len(set(got)) and set(got) == want
    assert spark.conf.get(ordered.PROVIDER) != ordered.ROCKS
    assert spark.read.parquet(f"{tmp_path}/edges").filter(F.col("from_event_id").isNull()).count() == 0


def test_a_key_waits_under_one_timer_a_batch():
    """Timers do not grow with the rows that wait; the one that fires sets the next."""
    import pandas as pd

    class Held:
        def __init__(self):
            self.rows = None

        def exists(self):
            return self.rows is not None

        def get(self):
            return self.rows

        def appendList(self, new):
            self.rows = (self.rows or []) + list(new)

        def put(self, new):
            self.rows = list(new)

        update = put

        def clear(self):
            self.rows = None

    class Clock:
        now = 0

        def registerTimer(self, at):
            timers.append(at)

        def getCurrentWatermarkInMs(self):
            return self.now

    timers, rule, clock = [], ordered.EdgeRule(), Clock()
    rule.handle, rule.waiting, rule.state = clock, Held(), Held()
    rows = pd.DataFrame({"at": [i * 1000 for i in range(1, 51)], "id": range(1, 51), "event_id": [str(i) for i in range(1, 51)], "type": ["tool_call", "tool_output"] * 25})
    assert list(rule.handleInputRows(("s",), iter([rows]), clock)) == [] and timers == [1]
    clock.now = 30
    assert sum(len(f) for f in rule.handleExpiredTimer(("s",), clock, None)) == 15 and timers == [1, 31]
    clock.now = 99
    assert sum(len(f) for f in rule.handleExpiredTimer(("s",), clock, None)) == 10 and timers == [1, 31] and not rule.waiting.exists()
