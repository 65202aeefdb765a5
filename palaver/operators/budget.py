"""Token budgets and packing.

Packing is a running sum in the given order; it stops at the first misfit, so a prefix of the sum decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.sources.messages import tokens

SO_FAR = (W.unboundedPreceding, 0)


def chunk_header(kind: Column, event_id: Column) -> Column:
    """B5."""
    ident = event_id.cast("string")
    return F.when(F.coalesce(ident, F.lit("")) != "", F.concat(F.lit("["), kind, F.lit(" id="), ident, F.lit("] "))).otherwise(F.concat(F.lit("["), kind, F.lit("] ")))


def pack_retrieved(candidates: DataFrame, budget: Column | int, key: str = "query_id") -> DataFrame:
    """Whole chunks by falling score while they fit, then maybe a head of the first misfit.

    Every chunk costs a token at least (its header has four characters or more), so of a budget given as a number
    that many chunks can fit: only the best so many and the first misfit reach the running sum of a query.

    Adds chunk (text), chunk_tokens, used (tokens so far) and partial.  A head is cut to the content budget of
    four characters a token, then to nine tenths until header and head fit; lengths shrink the same way
    whatever the text, so the length is found over a short sequence.
    """
    order = W.partitionBy(key).orderBy(F.col("score").desc(), "event_id")
    if isinstance(budget, int):
        place = F.row_number().over(order)
        candidates, budget = candidates.withColumn("place", place).filter(F.col("place") <= budget + 1).drop("place"), F.lit(budget)
    header = chunk_header(F.col("type"), F.col("event_id"))
    rows = candidates.withColumns({"header": header, "budget": budget}).withColumn("chunk", F.concat("header", F.coalesce("content", F.lit(""))))
    rows = rows.withColumn("chunk_tokens", tokens(F.col("chunk")))
    rows = rows.withColumn("run", F.sum("chunk_tokens").over(order.rowsBetween(*SO_FAR)))
    rows = rows.withColumn("misfits", F.sum((F.col("run") > F.col("budget")).cast("int")).over(order.rowsBetween(*SO_FAR)))
    remaining = F.col("budget") - (F.col("run") - F.col("chunk_tokens"))
    content_budget = remaining - tokens(F.col("header")) - S.MESSAGE_TOKENS
    start = F.least(F.length(F.coalesce("content", F.lit(""))).cast("long"), content_budget * S.CHARS_PER_TOKEN)
    fits = lambda n: F.floor((F.length("header") + n) / S.CHARS_PER_TOKEN) <= remaining
    length = F.aggregate(
        F.sequence(F.lit(1), F.lit(200)), start, lambda n, _: F.when(fits(n) | (n <= 0), n).otherwise(F.floor(n * F.lit(0.9)).cast("long"))
    )
    may = (F.col("misfits") == 1) & (remaining >= S.MIN_PARTIAL_TOKENS) & (content_budget >= S.MIN_PARTIAL_TOKENS)
    head = F.concat("header", F.substr("content", F.lit(1), length.cast("int")))
    rows = rows.withColumn("partial", F.col("misfits") > 0).filter((F.col("misfits") == 0) | (may & (length > 0)))
    rows = rows.withColumn("chunk", F.when(F.col("partial"), head).otherwise(F.col("chunk"))).withColumn("chunk_tokens", tokens(F.col("chunk")))
    return rows.withColumn("used", F.sum("chunk_tokens").over(order.rowsBetween(*SO_FAR))).drop("header", "run", "misfits", "budget")


def most_chunks(candidates: DataFrame, budget: int) -> int:
    """How many of the best rows of a query :func:`pack_retrieved` may look at: as many of the shortest chunk as fit, and the first misfit."""
    chunk = F.concat(chunk_header(F.col("type"), F.col("event_id")), F.coalesce("content", F.lit("")))
    least = candidates.agg(F.min(tokens(chunk))).first()[0] or 1
    return budget // max(1, least) + 1


def message_cost(text: Column) -> Column:
    return tokens(text) + S.MESSAGE_TOKENS


def token_budgets(messages: DataFrame, total: int, system_tokens: int, overhead: int, prompt_tokens: DataFrame | None = None) -> DataFrame:
    """Content tokens, the shares of the effective budget, and whether a session passes unchanged.

    *prompt_tokens*: session_id, current_tokens as the host has counted them; the larger number decides.
    """
    eff = total - system_tokens
    per = messages.groupBy("session_id").agg(F.sum(message_cost(F.col("content"))).alias("content_tokens"))
    known = F.col("content_tokens")
    if prompt_tokens is not None:
        per = per.join(prompt_tokens.groupBy("session_id").agg(F.max("current_tokens").alias("current_tokens")), "session_id", "left")
        known = F.greatest(known, F.coalesce("current_tokens", F.lit(0)))
    return per.select(
        "session_id", "content_tokens", F.lit(eff).cast("long").alias("effective"), F.lit(int(eff * S.TAIL_RATIO)).cast("long").alias("tail_budget"),
        F.lit(int(eff * S.RETRIEVED_RATIO)).cast("long").alias("retrieved_budget"), (known + overhead < total).alias("pass_through"),
    )


def pack_tail(messages: DataFrame, tail_budget: int, effective: int, floor_n: int = S.TAIL_FLOOR, other: Column | None = None) -> DataFrame:
    """The protected tail of each session and the older messages that extend it.

    The last user message is the current one and not part of the tail.  Of the last floor_n messages the
    oldest go while their sum is over the tail budget, but never the last two; older messages than the
    floor are added newest first while the whole, with *other* tokens, stays within the effective budget less a margin.
    """
    back = W.partitionBy("session_id").orderBy(F.col("msg_index").desc())
    rows = messages.withColumn("back", F.row_number().over(back))
    ends = F.max(F.when((F.col("back") == 1) & (F.col("role") == "user"), F.col("content"))).over(W.partitionBy("session_id"))
    rows = rows.withColumn("current", F.coalesce(ends, F.lit(""))).filter(~((F.col("back") == 1) & (F.col("role") == "user")))
    rows = rows.withColumns({"back": F.row_number().over(back), "cost": message_cost(F.col("content"))})
    run = F.sum("cost").over(back.rowsBetween(*SO_FAR))
    in_floor = F.col("back") <= floor_n
    tail = rows.withColumn("run", run).withColumn("kept", in_floor & ((F.col("run") <= tail_budget) | (F.col("back") <= 2)))
    used = F.sum(F.when(F.col("kept"), F.col("cost"))).over(W.partitionBy("session_id"))
    older = F.sum(F.when(~in_floor, F.col("cost")).otherwise(0)).over(back.rowsBetween(*SO_FAR))
    room = F.lit(effective - S.SAFETY_TOKENS) - (F.lit(0) if other is None else other)
    sized = tail.withColumns({"held": F.coalesce(used, F.lit(0)), "older": older})
    added = ~in_floor & (F.col("held") + tokens(F.col("current")) + F.col("older") <= room)
    return sized.withColumn("extended", added).filter(F.col("kept") | F.col("extended")).select(
        "session_id", "msg_index", "role", "content", "cost", "extended"
    )


def resolve_collision(blocks: DataFrame, effective: int) -> DataFrame:
    """Over budget, retrieved chunks go from the lowest score, then the oldest tail down to two; if that
    is not enough, all retrieved go and two tail messages stay.

    blocks: session_id, kind ('fixed', 'retrieved', 'tail'), place (1 = goes last), cost.  What goes before a
    row is exactly the rows of its kind with a larger place, so running sums give each row's fate.
    """
    ends = W.partitionBy("session_id").orderBy(F.col("kind") == "tail", F.col("place").desc()).rowsBetween(W.unboundedPreceding, -1)
    movable = (F.col("kind") == "retrieved") | ((F.col("kind") == "tail") & (F.col("place") > 2))
    fixed, moving = blocks.filter(~movable | (F.col("kind") == "fixed")), blocks.filter(movable)
    totals = blocks.groupBy("session_id").agg(F.sum("cost").alias("total"))
    gone = F.coalesce(F.sum("cost").over(ends), F.lit(0))
    kept = moving.join(totals, "session_id").withColumn("gone", gone).filter(F.col("total") - F.col("gone") <= effective).drop("gone", "total")
    return fixed.unionByName(kept)


def assemble(system: DataFrame, retrieved: DataFrame, tail: DataFrame, current: DataFrame) -> DataFrame:
    """(session_id, pos, role, content): system block, retrieved context, tail, current message.

    system: session_id, pos, block; retrieved: session_id, pos, chunk; tail: session_id, msg_index, role, content.
    """
    text = lambda df, col, sep: df.groupBy("session_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", col))), lambda x: x[col]), sep).alias("content")
    )
    head = text(system, "block", "\n\n").select("session_id", F.lit(0).alias("part"), F.lit(0).alias("msg_index"), F.lit("system").alias("role"), "content")
    found = text(retrieved, "chunk", "\n").select(
        "session_id", F.lit(1).alias("part"), F.lit(0).alias("msg_index"), F.lit("user").alias("role"), F.concat(F.lit("[RETRIEVED CONTEXT]\n"), "content").alias("content")
    )
    body = tail.select("session_id", F.lit(2).alias("part"), "msg_index", "role", "content")
    last = current.select("session_id", F.lit(3).alias("part"), F.lit(0).alias("msg_index"), F.lit("user").alias("role"), "content")
    rows = head.unionByName(found).unionByName(body).unionByName(last)
    pos = F.row_number().over(W.partitionBy("session_id").orderBy("part", "msg_index")) - 1
    return rows.withColumn("pos", pos.cast("long")).select("session_id", "pos", "role", "content")


def goal_trail(goals: DataFrame, title: str = "[GOAL TRAIL]") -> DataFrame:
    """One block per session, oldest goal first."""
    listed = goals.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("pos", "goal"))).alias("g"))
    lines = F.transform("g", lambda x: F.concat(x["pos"].cast("string"), F.lit(". "), x["goal"]))
    return listed.select("session_id", F.concat_ws("\n", F.lit(title), F.array_join(lines, "\n")).alias("block"))


def checkpoint_block(calls: Column, goal: Column, prior: Column) -> Column:
    """B12."""
    return F.concat_ws(
        "\n", F.concat(F.lit("[CHECKPOINT] "), calls.cast("string"), F.lit(" memory calls in a row")), F.concat(F.lit("goal: "), F.coalesce(goal, F.lit("<none>"))),
        F.when(prior.isNotNull() & ~prior.eqNullSafe(goal), F.concat(F.lit("prior goal: "), prior)),
    )


def memory_hint(stats: DataFrame, threshold: int = S.TAIL_FLOOR, short: str = "Memory tools are available.", long: str = "Older turns are kept outside this window; search them with the memory tools.") -> DataFrame:
    """A short hint, or a long one with figures for sessions beyond the window."""
    figures = F.concat_ws(" ", F.lit("[MEMORY STATS] events:"), F.col("total_events").cast("string"), F.lit("segments:"), F.col("total_segments").cast("string"))
    past = F.when(F.col("compressed_ancestors") > 0, F.concat(F.lit(" compressed:"), F.col("compressed_ancestors").cast("string"))).otherwise("")
    hint = F.when(F.col("total_events") <= threshold, F.lit(short)).otherwise(F.concat(F.lit(long + "\n\n"), figures, past))
    return stats.select("session_id", hint.alias("hint"))


def dependency_usage(selected: DataFrame, n: int = 5) -> DataFrame:
    """The share of the best n that the dependency graph raised, and how many there were."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "event_id"))
    return selected.withColumn("r", rank).filter(F.col("r") <= n).groupBy("query_id").agg(F.avg(F.when(F.coalesce("bonus", F.lit(0.0)) > 0, 1.0).otherwise(0.0)).alias("ratio"), F.count(F.lit(1)).alias("n"))


def hit_metric(hits: Column) -> Column:
    """A10: an average that moves half way to 1 at each hit."""
    return 1 - F.pow(F.lit(2.0), -hits)


def moving_metric(ratios: Column) -> Column:
    """A10: an average that moves half way to each value in order."""
    return F.aggregate(ratios, F.lit(0.0), lambda m, r: (m + r) / 2)
