"""Chat messages as a source: event parsing, ids, cursors, idempotent writes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver import schemas as S


def tokens(text: Column) -> Column:
    """A token is four characters."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def event_id(*parts: Column) -> Column:
    """SHA-256 of the parts, null as empty, with NUL between."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def ascii_json(text: Column) -> Column:
    """JSON text in ASCII; other characters as the escapes of their UTF-16 units."""
    control = text  # digits of control characters in lower case
    for digit in "ABCDEF":
        control = F.regexp_replace(control, rf"(?<!\\)((?:\\\\)*\\u00[01]){digit}", f"$1{digit.lower()}")
    text = F.when(text.rlike(r"\\u00[01][A-F]"), control).otherwise(text)
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    shown = F.transform(units, lambda u: F.when(u < "0080", F.char(F.conv(u, 16, 10).cast("long"))).otherwise(F.concat(F.lit("\\u"), F.lower(u))))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(shown, "")).otherwise(text)


def json_value(value: Column, kind: T.DataType = T.StringType()) -> Column:
    """F16: a value as JSON in ASCII; in objects and lists a space follows each colon and comma outside of strings."""
    listed = F.to_json(F.array(value))
    literal = F.substr(listed, F.lit(2), F.length(listed) - 2)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        literal = F.regexp_replace(literal, r'\G((?:"(?:[^"\\]++|\\.)*+"|[^",:]++)*+[,:])', "$1 ")
    return ascii_json(literal)


def function_json(call: Column, kind: T.StructType) -> Column:
    """F16: a call's function with all its fields in their order; name and arguments always, others where they are given."""
    parts = []
    for f in kind.fields:
        value = call["function"][f.name]
        part = F.concat(F.lit(json.dumps(f.name) + ": "), json_value(value, f.dataType))
        parts.append(part if f.name in ("name", "arguments") else F.when(value.isNotNull(), part))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def parse_messages(messages: DataFrame) -> DataFrame:
    """One event for a user, tool or plain assistant message, one for each tool call, none for other roles."""
    if "tool_calls" not in messages.columns:
        messages = messages.withColumn("tool_calls", F.lit(None).cast("array<struct<id:string,function:struct<name:string,arguments:string>>>"))
    if "name" not in messages.columns:
        messages = messages.withColumn("name", F.lit(None).cast("string"))
    calls = F.when((F.col("role") == "assistant") & (F.size("tool_calls") > 0), F.col("tool_calls"))
    rows = messages.select("*", F.posexplode_outer(calls).alias("pos", "call"))
    called = F.col("call").isNotNull()
    kind = (
        F.when(F.col("role") == "user", "user_message")
        .when(called, "tool_call")
        .when(F.col("role") == "assistant", "assistant_message")
        .when(F.col("role") == "tool", "tool_output")
    )
    function = function_json(F.col("call"), messages.schema["tool_calls"].dataType.elementType["function"].dataType)
    content = F.when(called, function).otherwise(F.col("content"))
    sub = F.coalesce("pos", F.lit(0))
    estimate = F.when(called, F.floor(tokens(F.col("content")) / F.size("tool_calls"))).otherwise(tokens(F.col("content")))
    return rows.filter(kind.isNotNull()).select(
        event_id(F.col("session_id"), F.col("msg_index"), sub, F.col("role"), content).alias("event_id"),
        "session_id", "msg_index", sub.alias("sub_index"), kind.alias("type"), "role", content.alias("content"),
        F.when(called, F.col("call.function.name")).when(F.col("role") == "tool", F.col("name")).alias("tool_name"),
        F.when(called, F.coalesce("call.function.arguments", F.lit("{}"))).alias("tool_input"),
        estimate.cast("long").alias("token_estimate"),
    )


def binding_anchor(messages: DataFrame) -> DataFrame:
    """S3: where reading a session starts: 0 if it has any reply or tool turn, else its last user message."""
    return messages.groupBy("session_id").agg(
        F.when(F.coalesce(F.bool_or(F.col("role").isin("assistant", "tool")), F.lit(False)), F.lit(0))
        .otherwise(F.coalesce(F.max(F.when(F.col("role") == "user", F.col("msg_index"))), F.lit(0)))
        .alias("anchor")
    )


def read_from_cursor(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages at or after the session's cursor; a buffer that shrank is read anew."""
    length = messages.groupBy("session_id").agg((F.max("msg_index") + 1).alias("length"))
    start = F.when(F.coalesce("cursor", F.lit(0)) > F.col("length"), 0).otherwise(F.coalesce("cursor", F.lit(0)))
    at = length.join(cursors, "session_id", "left").select("session_id", start.alias("start"))
    return messages.join(at, "session_id").filter("msg_index >= start").drop("start")


def ingest(existing: DataFrame, incoming: DataFrame, key: str = "event_id") -> DataFrame:
    """The log after an insert that ignores known keys; ``inserted`` marks the new rows.

    One shuffle on the key serves the anti-join and the removal of repeats.
    """
    fresh = incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return existing.withColumn("inserted", F.lit(False)).unionByName(fresh.withColumn("inserted", F.lit(True)))


def latest_by_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """An upsert as the newest row of each key, by partial aggregation."""
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return newest.select(*key, *[F.col(f"row.{c}").alias(c) for c in rest])


def sessions_of(events: DataFrame) -> DataFrame:
    """The session rows that events imply."""
    return events.groupBy("session_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_active"))


def replay_messages(events: DataFrame) -> DataFrame:
    """The message list of a session, in order."""
    order = W.partitionBy("session_id").orderBy("ts", "event_id")
    role = (
        F.when(F.col("type") == "user_message", "user").when(F.col("type").isin("assistant_message", "tool_call"), "assistant").when(F.col("type") == "tool_output", "tool")
    )
    return events.withColumn("role", role).filter("role IS NOT NULL").select(
        "session_id", (F.row_number().over(order) - 1).cast("long").alias("msg_index"), "role", "content"
    )


def write_trace(trace: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Append as JSON lines; files are rolled by rows."""
    trace.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)


def read_trace(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """The trace, unreadable lines left out; *last*: the newest so many turns."""
    rows = spark.read.schema(S.TRACE).option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.col("timestamp").desc(), "turn_id").limit(last) if last else rows


def stale_vectors(vectors: DataFrame, model: str) -> DataFrame:
    """Models other than the target, with their vectors' count."""
    return vectors.filter(F.col("embedding_model_id") != model).groupBy("embedding_model_id").agg(F.count(F.lit(1)).alias("stale"))


def reindex_rows(events: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """What is embedded again: events with text whose vector is of another model, or that have none."""
    current = vectors.filter(F.col("embedding_model_id") == model).select("event_id")
    return events.filter(F.length(F.trim("content")) > 5).join(current, "event_id", "left_anti")
