"""Views of the provided tables in the engine's data model (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The pinned time of recency scores: just after the data ends.
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("session_id"),
        "ts",
        F.when(F.col("event_type") == "view", "user_message")
        .when(F.col("event_type") == "click", "tool_call")
        .when(F.col("event_type") == "purchase", "tool_output")
        .when(F.col("event_type") == "signup", "assistant_message")
        .otherwise("decision")
        .alias("type"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "props",
        F.floor("value").cast("long").alias("token_estimate"),
    )
    order = W.partitionBy("session_id").orderBy("ts", "event_id")
    cut = ((F.col("type") == "user_message") & (F.col("k") % 10 == 0)).cast("int")
    return (
        raw.withColumn("seq", F.row_number().over(order).cast("long"))
        .withColumn("seg_no", 1 + F.sum(cut).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("segment_id", F.concat_ws("_", F.lit("seg"), "session_id", "seg_no"))
        .withColumn("tool_name", F.when(F.col("type") == "tool_call", F.concat(F.lit("tool_"), (F.col("k") % 5).cast("string"))))
        .withColumn("content", F.concat_ws(" ", "type", "props"))
        .drop("props")
    )


EV_SQL = """
ev0 AS (SELECT event_id, user_id AS session_id, ts,
    CASE event_type WHEN 'view' THEN 'user_message' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'tool_output'
      WHEN 'signup' THEN 'assistant_message' ELSE 'decision' END AS type,
    CAST(json_extract_string(props, '$.k') AS INT) AS k, props, CAST(floor(value) AS BIGINT) AS token_estimate FROM events),
ev AS (SELECT event_id, session_id, ts, type, k, token_estimate, row_number() OVER w AS seq,
    1 + sum(CASE WHEN type = 'user_message' AND k % 10 = 0 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS seg_no,
    'seg_' || session_id || '_' || (1 + sum(CASE WHEN type = 'user_message' AND k % 10 = 0 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS segment_id,
    CASE WHEN type = 'tool_call' THEN 'tool_' || (k % 5) END AS tool_name, type || ' ' || props AS content
  FROM ev0 WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label stands in for the session."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("event_id"), "embedding", F.col("label").cast("long").alias("session_id"), F.lit("m0").alias("embedding_model_id")
    )


VEC_SQL = "vec AS (SELECT vec_id AS event_id, embedding::DOUBLE[] AS embedding, label::BIGINT AS session_id FROM embeddings)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("msg_index"), "role", F.col("text").alias("content")
    )


MSG_SQL = "msg AS (SELECT conv_id AS session_id, turn::INT AS msg_index, role, text AS content FROM conversations)"


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct().filter("conv_id % 5 <> 0")
    return ids.select((F.col("conv_id") - 1).alias("old_session_id"), F.col("conv_id").alias("new_session_id"))


LINEAGE_SQL = "lin AS (SELECT DISTINCT conv_id - 1 AS o, conv_id AS n FROM conversations WHERE conv_id % 5 <> 0)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return event_log(spark, sf_dir).filter("type = 'user_message'").select(
        F.col("event_id").alias("id"), "session_id", "ts",
        F.concat(F.lit("goal_"), (k % 10).cast("string")).alias("goal"),
        F.concat(F.lit("step_"), k.cast("string")).alias("current_step"),
        F.when(k % 7 != 0, F.concat(F.lit("intent_"), (k % 3).cast("string"))).alias("intent_label"),
    )


HIST_SQL = """
hist AS (SELECT event_id AS id, session_id, ts, 'goal_' || (k % 10) AS goal, 'step_' || k AS current_step,
    CASE WHEN k % 7 <> 0 THEN 'intent_' || (k % 3) END AS intent_label FROM ev WHERE type = 'user_message')"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
