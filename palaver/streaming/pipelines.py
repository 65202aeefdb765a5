"""Structured Streaming forms of ingest and the live state (S2, S5, ST1).

Offsets and state live in the query's checkpoint folder, which must be on shared storage.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palaver.functions.text import clip, strip

STATE_OUT = "session_id string, goal string, current_step string, last_tool string, last_tool_output_summary string, turn_count long"
#: A field is kept with the place (time in microseconds, event) of what it was taken from.
FIELDS = ("goal", "current_step", "last_tool", "last_tool_output_summary")
#: The partition column of an ingested log.
DAY = "ingest_day"


def read_events(spark: SparkSession, path: str, schema, files: int = 1000) -> DataFrame:
    """New files below a path, so many in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """An event counts once; ids are forgotten when the watermark passes them, so state is bounded."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def start_ingest(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """S5 against a growing log: each micro-batch drops repeats and what the log holds, then is appended.

    The log is partitioned by the day of ``ts``.  A repeated event has its first time, so a batch meets only the
    partitions of its own days, and what a batch costs does not grow with the log.  A batch that is run again after a
    failure finds its own rows in the log and adds nothing.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["event_id"]).withColumn(DAY, F.to_date("ts")).persist()
        days = [r[0] for r in fresh.select(DAY).distinct().collect()]  # days of one micro-batch
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        new = fresh
        if days and hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            known = spark.read.schema(fresh.schema).parquet(path).filter(F.col(DAY).isin(*days) | F.col(DAY).isNull())
            new = fresh.join(known.select("event_id"), "event_id", "left_anti")
        new.write.mode("append").partitionBy(DAY).parquet(path)
        fresh.unpersist()

    return events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_state(state: dict, rows: pd.DataFrame) -> dict:
    """ST1 row by row, which :func:`live_states` is tested against: some events of one session, in any order; state holds (place, value) for each field, and turn_count.

    A place is (time, event); the goal is that of the earliest user message, the other fields those of the latest event.
    """
    for row in rows.itertuples(index=False):
        text = row.content if isinstance(row.content, str) else ""
        place = (int(row.at), row.event_key)

        def put(field: str, value, last: bool = True) -> None:
            held = state.get(field)
            if held is None or (place > held[0] if last else place < held[0]):  # noqa: B023
                state[field] = (place, value)  # noqa: B023

        if row.type == "user_message" and text.strip():
            state["turn_count"] = state.get("turn_count", 0) + 1
            put("goal", text.strip()[:500], last=False)
            put("current_step", text.strip()[:300])
        elif row.type == "tool_call":
            put("last_tool", row.tool_name)
        elif row.type == "tool_output" and text:
            put("last_tool_output_summary", text[:100] + "..." if len(text) > 100 else text)
        elif row.type == "assistant_message" and text:
            put("current_step", text[:200])
    return state


def live_states(events: DataFrame, idle: str = "30 days") -> DataFrame:
    """ST1 as a streaming aggregate: what the micro-batches so far say of a session, in parts by the span of time (*idle* long) of its events.

    A part has the session, the start of its span (since), each field with the place it was taken from, and turn_count.  A
    micro-batch hands on the parts that it touches as they are from then on; :func:`session_states` joins them.  Events may come late
    and in any order, as each field knows its place.  The watermark is *idle* behind the latest event: what belongs to a span that
    it has passed is dropped, and the part is forgotten; its last form has been handed on.  An event without a time is an error.
    """
    key = F.format_string("%020d", "event_id") if dict(events.dtypes)["event_id"] in ("bigint", "int") else F.col("event_id").cast("string")
    ts = F.coalesce(F.col("ts").cast("timestamp"), F.raise_error(F.lit("an event of a live state has no ts")).cast("timestamp"))
    narrow = events.select("session_id", key.alias("event_key"), ts.alias("ts"), "type", "content", "tool_name").withWatermark("ts", idle)
    place, text, kind = F.struct(F.unix_micros("ts").alias("at"), F.col("event_key").alias("event")), F.coalesce("content", F.lit("")), F.col("type")
    bare = strip(text)
    user, call = (kind == "user_message") & (bare != ""), kind == "tool_call"
    reply, output = (kind == "assistant_message") & (text != ""), (kind == "tool_output") & (text != "")
    step = F.when(user, F.left(bare, F.lit(300))).when(reply, F.left(text, F.lit(200)))
    found = {
        "goal": (user, F.left(bare, F.lit(500))), "current_step": (user | reply, step), "last_tool": (call, F.col("tool_name")),
        "last_tool_output_summary": (output, clip(text, 100, "...")),
    }
    rows = narrow.select("session_id", "ts", user.alias("turn"), *[F.when(of, F.struct(place.alias("place"), value.alias("value"))).alias(f) for f, (of, value) in found.items()])
    parts = rows.groupBy("session_id", F.window("ts", idle).alias("span")).agg(*_best(), F.coalesce(F.sum(F.col("turn").cast("long")), F.lit(0)).alias("turn_count"))
    return parts.select(F.col("session_id").cast("string").alias("session_id"), F.col("span.start").alias("since"), *FIELDS, "turn_count")


def _best() -> list[Column]:
    """Of each field the earliest (goal) or the latest (others) that has a place."""
    return [(F.min_by if f == "goal" else F.max_by)(f, f"{f}.place").alias(f) for f in FIELDS]


def session_states(parts: DataFrame) -> DataFrame:
    """STATE_OUT: the state of each session from what :func:`live_states` has handed on, in one or more forms of each part."""
    newest = parts.groupBy("session_id", "since").agg(*_best(), F.max("turn_count").alias("turn_count"))  # a part's turns only grow
    whole = newest.groupBy("session_id").agg(*_best(), F.sum("turn_count").alias("turn_count"))
    return whole.select("session_id", *[F.col(f"{f}.value").alias(f) for f in FIELDS], "turn_count")
