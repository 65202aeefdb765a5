"""Session timelines as windows and aggregates.

Windows are partitioned by session (and segment); aggregates combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.functions.text import clip, is_switch

SO_FAR = (W.unboundedPreceding, 0)


def session():
    return W.partitionBy("session_id")


def forward():
    return session().orderBy("ts", "event_id")


def backward():
    return session().orderBy(F.col("ts").desc(), F.col("event_id").desc())


def type_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Events by type as a map, from two aggregations on the same keys."""
    per = rows.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type"))


def type_text(by_type: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(by_type)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


def session_stats(events: DataFrame, lineage: DataFrame) -> DataFrame:
    """A1, A2: counts, time range, events by type and direct parents."""
    per_type = events.groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    base = per_type.groupBy("session_id").agg(
        F.sum("n").alias("total_events"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type"),
    )
    segments = events.select("session_id", "segment_id").distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("total_segments"))
    parents = lineage.groupBy(F.col("new_session_id").alias("session_id")).agg(F.count(F.lit(1)).alias("compressed_ancestors"))
    return base.join(segments, "session_id").join(parents, "session_id", "left").fillna(0, ["compressed_ancestors"])


def asof_latest(left: DataFrame, right: DataFrame, keys: list[str], at: str, ts: str, order: str, value: str, out: str) -> DataFrame:
    """For each left row, *value* of the right row with the largest *order* among those with ts <= at.

    One union and one window instead of an inequality join: a running maximum over time per key, so a hot
    key costs its rows once.
    """
    taken = F.lit(0)
    marks = right.filter(F.col(value).isNotNull()).select(*keys, F.col(ts).alias("__t"), F.struct(F.col(order), F.col(value)).alias("__v"), taken.alias("__side"))
    probe = left.select(*keys, F.col(at).alias("__t"), F.lit(None).cast(marks.schema["__v"].dataType).alias("__v"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"))
    both = marks.withColumn("__row", F.lit(None).cast(probe.schema["__row"].dataType)).unionByName(probe)
    so_far = W.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(*SO_FAR)
    done = both.withColumn("__best", F.max("__v").over(so_far)).filter("__side = 1")
    return done.select("__row.*", F.col(f"__best.{value}").alias(out))


def segment_manifest(events: DataFrame, history: DataFrame, limit: int | None = None, tags: DataFrame | None = None) -> DataFrame:
    """Per segment its count, range, events by type, first and last user snippet, goal at its end.

    *tags*: session_id and topic_tags as the session's enrichment has them; every segment of the session gets these.
    """
    user, at = F.col("type") == "user_message", F.struct("ts", "event_id")
    base = events.groupBy("session_id", "segment_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by(F.when(user, F.col("content")), F.when(user, at)).alias("first_user"), F.max_by(F.when(user, F.col("content")), F.when(user, at)).alias("last_user"),
    )
    base = base.join(type_counts(events, ["session_id", "segment_id"]), ["session_id", "segment_id"])
    with_goal = asof_latest(base, history, ["session_id"], "last_ts", "ts", "id", "goal", "goal_at_end")
    rank = F.row_number().over(session().orderBy(F.col("last_ts").desc(), F.col("segment_id").desc()))
    out = with_goal.withColumn("rank", rank)
    out = out.filter(F.col("rank") <= limit) if limit else out
    out = out.withColumns({"first_user": F.left("first_user", F.lit(200)), "last_user": F.left("last_user", F.lit(200))})
    return out if tags is None else out.join(tags.select("session_id", "topic_tags"), "session_id", "left")


def segment_skeleton(events: DataFrame, most: int = 15, head: int = 5) -> DataFrame:
    """Users, tool calls and the last reply of a segment; beyond *most*, the first 5 and the last rest."""
    seg = W.partitionBy("session_id", "segment_id")
    last = F.max(F.when(F.col("type") == "assistant_message", F.struct("ts", "event_id"))).over(seg)
    spine = events.withColumn("last_reply", last["event_id"]).filter(
        F.col("type").isin("user_message", "tool_call") | (F.col("event_id") == F.col("last_reply"))
    )
    place = F.row_number().over(seg.orderBy("ts", "event_id"))
    sized = spine.withColumns({"pos": place, "n": F.count(F.lit(1)).over(seg)})
    return sized.filter((F.col("n") <= most) | (F.col("pos") <= head) | (F.col("pos") > F.col("n") - (most - head))).drop("last_reply")


def recent_events(events: DataFrame, n: int) -> DataFrame:
    """The last n of each session."""
    return events.withColumn("back", F.row_number().over(backward())).filter(F.col("back") <= n)


def recent_turns(events: DataFrame, turns: int) -> DataFrame:
    """Events of the last turns, numbered from 1; a turn starts with a user message."""
    user = (F.col("type") == "user_message").cast("int")
    numbered = events.withColumn("turn", F.sum(user).over(forward().rowsBetween(*SO_FAR))).withColumn("turns", F.sum(user).over(session()))
    kept = numbered.filter((F.col("turn") > 0) & (F.col("turn") > F.col("turns") - turns))
    index = F.col("turn") - F.greatest(F.lit(0), F.col("turns") - turns)
    return kept.withColumn("turn_index", index).withColumn("content", clip(F.col("content"), 600, "…")).drop("turn", "turns")


def latest_segment(events: DataFrame) -> DataFrame:
    """A7."""
    return events.groupBy("session_id").agg(F.max_by("segment_id", F.struct("ts", "event_id")).alias("segment_id"))


def last_active_other(sessions: DataFrame) -> DataFrame:
    """For each session the most recently active other one, from the two latest of all that are active (where a status is known)."""
    live = sessions.filter("status = 'active'") if "status" in sessions.columns else sessions
    top = live.orderBy(F.col("last_active").desc(), F.col("session_id").desc()).limit(2)
    best = top.agg(F.sort_array(F.collect_list(F.struct("last_active", "session_id")), False).alias("top"))  # two rows
    first, second = F.element_at("top", 1)["session_id"], F.try_element_at("top", F.lit(2))["session_id"]
    return sessions.join(F.broadcast(best), how="left").select("session_id", F.when(first == F.col("session_id"), second).otherwise(first).alias("other"))


def phantom_sessions(registry: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions without events."""
    return registry.join(events.select("session_id"), "session_id", "left_anti")


def recent_unique_goals(history: DataFrame, n: int) -> DataFrame:
    """The last n different goals, each with its latest row, oldest first."""
    per = history.filter(F.coalesce("goal", F.lit("")) != "").groupBy("session_id", "goal").agg(F.max(F.struct("id", "ts")).alias("x"))
    back = F.row_number().over(session().orderBy(F.col("x.id").desc()))
    kept = per.withColumn("back", back).filter(F.col("back") <= n)
    return kept.select("session_id", "goal", F.col("x.id").alias("id"), F.col("x.ts").alias("ts"), F.row_number().over(session().orderBy("x.id")).alias("pos"))


def goal_history(history: DataFrame, n: int) -> DataFrame:
    """The last n snapshots, oldest first."""
    kept = history.withColumn("back", F.row_number().over(session().orderBy(F.col("id").desc()))).filter(F.col("back") <= n)
    return kept.withColumn("pos", F.row_number().over(session().orderBy("id"))).drop("back")


def segment_ordinals(messages: DataFrame) -> DataFrame:
    """W2, ST8 (hard cuts): the segment number of each message; a switch phrase opens the next one."""
    cut = ((F.col("role") == "user") & is_switch(F.col("content"), S.SEGMENT_PHRASES)).cast("int")
    order = session().orderBy("msg_index").rowsBetween(*SO_FAR)
    return messages.withColumn("segment", 1 + F.sum(cut).over(order))


def change_log(history: DataFrame) -> DataFrame:
    """Snapshots that differ from the one before, null-safe."""
    now = F.struct("goal", "current_step", "intent_label")
    before = F.lag(now).over(session().orderBy("id"))
    first = F.row_number().over(session().orderBy("id")) == 1
    return history.withColumn("differs", first | ~now.eqNullSafe(before)).filter("differs").drop("differs")


def memory_streaks(calls: DataFrame, memory: Column, least: int = S.CHECKPOINT_CALLS) -> DataFrame:
    """Consecutive memory calls; any other call ends the streak, firing does not."""
    island = F.sum((~F.col("memory")).cast("int")).over(forward().rowsBetween(*SO_FAR))
    in_island = W.partitionBy("session_id", "island").orderBy("ts", "event_id").rowsBetween(*SO_FAR)
    rows = calls.withColumn("memory", memory).withColumn("island", island)
    streak = F.sum(F.col("memory").cast("int")).over(in_island)
    return rows.withColumn("streak", streak).withColumn("checkpoint", F.col("memory") & (F.col("streak") >= least)).drop("island")


def running_overhead(usage: DataFrame, start: int = S.OVERHEAD_START) -> DataFrame:
    """The largest prompt overhead seen so far."""
    extra = F.greatest(F.lit(0), F.col("prompt_tokens") - F.col("content_tokens"))
    return usage.withColumn("overhead", F.greatest(F.lit(start), F.max(extra).over(forward().rowsBetween(*SO_FAR))))


def anchors(events: DataFrame, last: int) -> DataFrame:
    """The latest tool output and reply among the last events of a session."""
    recent = recent_events(events, last).filter(F.col("type").isin("tool_output", "assistant_message"))
    return recent.groupBy("session_id", "type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def active_since(sessions: DataFrame, events: DataFrame, at: str) -> DataFrame:
    """Sessions with an event after their own time *at*."""
    latest = events.groupBy("session_id").agg(F.max("ts").alias("latest"))
    return sessions.join(latest, "session_id").filter(F.col("latest") > F.col(at)).drop("latest")


def enrichment_runs(messages: DataFrame, every: int = S.ENRICH_EVERY) -> DataFrame:
    """With one user turn per commit, every n-th user turn."""
    turn = F.row_number().over(session().orderBy("msg_index"))
    return messages.filter("role = 'user'").withColumn("turn", turn).filter(F.col("turn") % every == 0)
