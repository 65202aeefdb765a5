"""Stateful streams that need their rows in order: the live snapshot log and the live edges (ST3, W3, G2).

Both rules look at the row before, so a late row would change what was said about later ones.  Rows therefore wait in the
state of their session, under an event-time timer for the earliest of them, until the watermark has passed them: no earlier row can come any more,
and they are folded in order of time and id.  What is kept besides is one row a session, so the state is bounded by what
arrives within the delay.  Output is appended and never revised, whatever the micro-batches were.

The state lives in RocksDB, which ``transformWithState`` asks for; :func:`start` sets it for the query it starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from palaver import schemas as S

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class InOrder(StatefulProcessor):
    """Folds the rows (at: microseconds, id, *fields*: strings) of a key in order, once the watermark has passed them.

    A subclass names *fields* and *kept* (the schema of what is kept between rows) and says in ``step`` what a row yields.
    """

    fields: tuple[str, ...] = ()
    kept = ""
    out: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(["at long", "id long", *(f"{f} string" for f in self.fields)]))
        self.state = handle.getValueState("state", self.kept)

    def step(self, key: tuple, kept: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        """(what is kept from now on, the row to append or None)."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.astype(object).where(batch.notna(), None)
            new = [tuple(None if v is None else int(v) if i < 2 else str(v) for i, v in enumerate(r)) for r in batch[["at", "id", *self.fields]].itertuples(index=False)]
            if new:
                self.waiting.appendList(new)
                self.wake(new)
        return iter(())

    def wake(self, rows: list[tuple]) -> None:
        """One timer for the earliest of *rows*; when it fires, it sees to all that are due and to the next timer."""
        self.handle.registerTimer(-(-min(r[0] for r in rows) // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(r for r in rows if r[0] <= passed)
        if not due:  # another timer of this watermark has seen to them
            return
        rest = [r for r in rows if r[0] > passed]
        if rest:
            self.waiting.put(rest)
            self.wake(rest)
        else:
            self.waiting.clear()
        kept, out = tuple(self.state.get()) if self.state.exists() else None, []
        for row in due:
            kept, said = self.step(key, kept, row)
            if said is not None:
                out.append(said)
        if kept is not None:
            self.state.update(kept)
        if out:
            yield pd.DataFrame(out, columns=list(self.out))

    def close(self) -> None:
        pass


class SnapshotRule(InOrder):
    """ST3: a commit is appended if it differs from the last appended one, is *keepalive* seconds younger, or had activity since."""

    fields = ("goal", "current_step", "intent_label", "activity")
    kept = "at long, goal string, current_step string, intent_label string"
    out = ("session_id", "id", "at", "goal", "current_step", "intent_label")

    def __init__(self, keepalive: int = S.KEEPALIVE_SECONDS):
        self.keepalive = keepalive * 1_000_000

    def step(self, key, kept, row):
        at, ident, goal, step, label, activity = row
        same = kept is not None and tuple(kept[1:]) == (goal, step, label)
        if same and at - kept[0] < self.keepalive and (activity is None or int(activity) <= kept[0]):
            return kept, None
        return (at, goal, step, label), (str(key[0]), ident, at, goal, step, label)


class EdgeRule(InOrder):
    """An output links to the row before it among calls and outputs if that is a call, a reply to the one among outputs and replies if that is an output."""

    fields = ("event_id", "type")
    kept = "call string, output string"
    out = ("session_id", "from_event_id", "to_event_id", "edge_type")

    def step(self, key, kept, row):
        _, _, event, kind = row
        call, output = kept or (None, None)
        said = None
        if kind == "tool_output" and call is not None:
            said = (str(key[0]), call, event, "tool_output")
        elif kind == "assistant_message" and output is not None:
            said = (str(key[0]), output, event, "decision")
        if kind == "tool_call":
            call = event
        elif kind == "tool_output":
            call, output = None, event
        elif kind == "assistant_message":
            output = None
        return (call, output), said


def waiting_rows(rows: DataFrame, rule: InOrder, delay: str) -> DataFrame:
    """The columns that a rule takes; ``id`` decides among rows of one time."""
    ts = F.col("ts").cast("timestamp")
    narrow = rows.select("session_id", ts.alias("ts"), F.unix_micros(ts).alias("at"), F.col("id").cast("long").alias("id"), *[F.col(f).cast("string").alias(f) for f in rule.fields])
    return narrow.withWatermark("ts", delay)


def live_snapshots(commits: DataFrame, delay: str = "1 hour", keepalive: int = S.KEEPALIVE_SECONDS) -> DataFrame:
    """ST3 live: commits (session_id, id, ts, goal, current_step, intent_label, activity_ts) to the rows that the log gains."""
    rule = SnapshotRule(keepalive)
    narrow = waiting_rows(commits.withColumn("activity", F.unix_micros(F.col("activity_ts").cast("timestamp"))), rule, delay)
    out = "session_id string, id long, at long, goal string, current_step string, intent_label string"
    return narrow.groupBy("session_id").transformWithStateInPandas(rule, out, "Append", "EventTime")


def live_edges(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """W3, G2 live: events (session_id, event_id, ts, type) to edges.  Ids have to be numbers or ordered as *id* says."""
    rule = EdgeRule()
    named = events if "id" in events.columns else events.withColumn("id", F.col("event_id").cast("long"))
    narrow = waiting_rows(named.filter(F.col("type").isin("tool_call", "tool_output", "assistant_message")), rule, delay)
    out = "session_id string, from_event_id string, to_event_id string, edge_type string"
    return narrow.groupBy("session_id").transformWithStateInPandas(rule, out, "Append", "EventTime")


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what such a stream says to a table; reads what is there and ends."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:  # a query takes the settings of its start with it
        return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)
