"""Execution state (ST1-ST6): folds as windows and aggregates; the snapshot rule as a fold per session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.functions.text import clip, strip


def live_state(events: DataFrame) -> DataFrame:
    """ST1: the state after all events of a session, by partial aggregation."""
    at, text = F.struct("ts", "event_id"), F.coalesce("content", F.lit(""))
    bare, kind = strip(text), F.col("type")
    user = (kind == "user_message") & (bare != "")
    reply = (kind == "assistant_message") & (text != "")
    output = (kind == "tool_output") & (text != "")
    step = F.when(user, F.left(bare, F.lit(300))).when(reply, F.left(text, F.lit(200)))
    return events.groupBy("session_id").agg(
        F.min_by(F.when(user, F.left(bare, F.lit(500))), F.when(user, at)).alias("goal"),
        F.max_by(step, F.when(user | reply, at)).alias("current_step"),
        F.max_by(F.when(kind == "tool_call", F.col("tool_name")), F.when(kind == "tool_call", at)).alias("last_tool"),
        F.max_by(F.when(output, clip(text, 100, "...")), F.when(output, at)).alias("last_tool_output_summary"),
        F.sum(user.cast("int")).alias("turn_count"),
    )


def rebuilt_state(events: DataFrame) -> DataFrame:
    """ST2: from tool events only; a turn is a tool call."""
    at, kind, text = F.struct("ts", "event_id"), F.col("type"), F.coalesce("content", F.lit(""))
    output = (kind == "tool_output") & (text != "")
    return events.groupBy("session_id").agg(
        F.max_by(F.when(kind == "tool_call", F.col("tool_name")), F.when(kind == "tool_call", at)).alias("last_tool"),
        F.max_by(F.when(output, clip(text, 100, "...")), F.when(output, at)).alias("last_tool_output_summary"),
        F.sum((kind == "tool_call").cast("int")).alias("turn_count"),
    )


def snapshot_log(commits: DataFrame, keepalive: int = S.KEEPALIVE_SECONDS) -> DataFrame:
    """ST3: commits that are appended: changed, old enough, or with activity since the last appended one.

    commits: session_id, id, ts, goal, current_step, intent_label, activity_ts (latest event at the commit).
    What is appended depends on what was, so this is a fold; it holds one row, and sessions stream through it.
    """

    def fold(batches: Iterator) -> Iterator:
        last: dict = {"session": None, "state": None, "ts": None}
        for pdf in batches:
            keep = []
            for row in pdf.itertuples(index=False):
                state = tuple(None if v is None or v != v else v for v in (row.goal, row.current_step, row.intent_label))
                fresh = row.session_id != last["session"]
                differs = fresh or state != last["state"]
                aged = not differs and (row.ts - last["ts"]).total_seconds() >= keepalive
                active = not differs and row.activity_ts == row.activity_ts and row.activity_ts is not None and row.activity_ts > last["ts"]
                keep.append(differs or aged or active)
                if keep[-1]:
                    last = {"session": row.session_id, "state": state, "ts": row.ts}
            yield pdf[keep]

    dealt = commits.repartition("session_id").sortWithinPartitions("session_id", "id")
    return dealt.mapInPandas(fold, commits.schema)


def recovered_state(history: DataFrame) -> DataFrame:
    """ST4: goal, step and intent of the last snapshot, with markers of the recovery."""
    last = history.groupBy("session_id").agg(F.max(F.struct("id", "ts", "goal", "current_step", "intent_label")).alias("h"))
    return last.select(
        "session_id", F.coalesce("h.goal", F.lit("")).alias("goal"), F.coalesce("h.current_step", F.lit("")).alias("current_step"), "h.intent_label",
        F.lit(True).alias("recovered_from_history"), F.col("h.ts").alias("recovered_timestamp"),
    )


def shorten(text: Column) -> Column:
    """ST6: beyond 200 characters the first and last sentence, or a head."""
    parts = F.split(text, r"\. ", -1)
    ends = F.concat(F.element_at(parts, 1), F.lit(". ... "), F.element_at(parts, -1))
    return F.when(F.length(text) > 200, F.when(F.size(parts) > 2, ends).otherwise(F.concat(F.left(text, F.lit(200)), F.lit("...")))).otherwise(text)


def last_of(values: Column, n: int) -> Column:
    return F.when(F.size(values) > n, F.slice(values, -n, n)).otherwise(values)


def compress_state(states: DataFrame, cap: int | None = None) -> DataFrame:
    """ST6: what a state keeps whose JSON has more than *cap* tokens (None: every state): enrichment blanked, lists cut to their last, texts shortened."""
    over = F.lit(True)
    if cap is not None:
        over = F.floor(F.length(F.to_json(F.struct(*[c for c in states.columns if c != "session_id"]))) / S.CHARS_PER_TOKEN) > cap
    small = {c: shorten(F.col(c)) for c in ("goal", "current_step") if c in states.columns}
    small |= {c: last_of(F.col(c), n) for c, n in (("open_loops", 3), ("decision_stack", 3), ("active_entities", 5)) if c in states.columns}
    if "enrichment" in states.columns:
        small["enrichment"] = F.lit(None).cast(states.schema["enrichment"].dataType)
    marked = states.withColumn("__over", over)
    return marked.withColumns({c: F.when(F.col("__over"), new).otherwise(F.col(c)) for c, new in small.items()}).drop("__over")
