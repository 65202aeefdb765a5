"""The enrichment state of sessions after many answers (F13, T5), folded in parallel.

A decision that the stack does not hold is put on it, and of more than five the oldest go; so what an answer does depends on
the stack it meets, and the fold has no bounded form that could be merged in any order.  Sessions of at most ``BLOCK_TURNS``
answers are one block each, which starts from an empty stack and is done.  Longer ones are cut into blocks of so many answers,
every block is folded from a guess of the stack it starts with, empty at first, and then from what the block before ended
with.  Only blocks whose start has changed are folded again; as stacks forget what is older than their last five decisions,
this ends after two or three rounds as a rule.  A session that ``ROUNDS`` rounds have not settled, such as one that has the
same few decisions over and over, is folded once from its start to its end, block after block, by a task that holds one
stack; so rounds do not grow with a session's length.  Folding a block is one expression over its answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.operators.graph import cut

#: Decisions that a stack keeps; answers of one block; rounds of guesses before a session is folded in order.
KEPT, BLOCK_TURNS, ROUNDS = 5, 500, 4
STACK = "array<struct<decision:string,rationale:string>>"


def folded(start: Column, answers: Column, kept: int = KEPT) -> Column:
    """The stack after a block's *answers* (in order, each with its decisions), from the stack *start*."""

    def put(stack: Column, decision: Column) -> Column:
        return F.when(F.array_contains(stack, decision), stack).otherwise(F.array_append(stack, decision))

    def answer(stack: Column, a: Column) -> Column:
        full = F.aggregate(a["decisions"], stack, put)
        return F.when(F.size(full) > kept, F.slice(full, -kept, kept)).otherwise(full)

    return F.aggregate(answers, start, answer)


def folded_in_order(blocks: DataFrame, kept: int = KEPT) -> DataFrame:
    """(session_id, decision_stack) of *blocks* (session_id, block, answers), one after the other; a task holds one stack."""
    out = f"session_id {dict(blocks.dtypes)['session_id']}, decision_stack {STACK}"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, stack = None, None

        def said(ended: list) -> pa.RecordBatch:
            kinds = [kind, pa.list_(pa.struct([("decision", pa.string()), ("rationale", pa.string())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ended, strict=True), kinds, strict=True)], names=["session_id", "decision_stack"])

        for batch in batches:
            ended, kind = [], batch.column(0).type
            for now, answers in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if stack is None or now != session:
                    if stack is not None:
                        ended.append((session, stack))
                    session, stack = now, []
                for answer in answers.as_py():
                    for decision in answer["decisions"]:
                        if decision not in stack:
                            stack.append(decision)
                    stack = stack[-kept:]
            if ended:
                yield said(ended)
        if stack is not None:
            yield said([(session, stack)])

    dealt = blocks.repartition("session_id").sortWithinPartitions("session_id", "block")
    return dealt.select("session_id", "answers").mapInArrow(fold, out)


def decision_stacks(answers: DataFrame, block_turns: int = BLOCK_TURNS, kept: int = KEPT, rounds: int = ROUNDS) -> DataFrame:
    """(session_id, decision_stack) after all answers (session_id, turn, decisions), in order of turn; blocks have *block_turns* answers."""
    empty = F.array().cast(STACK)
    rows = answers.filter(F.size("decisions") > 0).select("session_id", "turn", F.col("decisions").cast(STACK).alias("decisions"))
    place = F.row_number().over(W.partitionBy("session_id").orderBy("turn", "decisions")) - 1
    numbered = rows.withColumn("block", F.floor(place / block_turns))
    blocks = cut(numbered.groupBy("session_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "decisions"))).alias("answers")))
    ends = cut(blocks.select("session_id", "block", empty.alias("start"), folded(empty, F.col("answers"), kept).alias("stack")))
    settled = []
    for r in range(rounds + 1):
        previous = ends.select("session_id", (F.col("block") + 1).alias("block"), F.col("stack").alias("now"))
        met = ends.filter("block > 0").join(previous, ["session_id", "block"])
        changed = cut(met.filter(~F.col("now").eqNullSafe(F.col("start"))).select("session_id", "block", "now"))
        if changed.isEmpty():
            break
        open_ones = changed.select("session_id").distinct()
        settled.append(ends.join(open_ones, "session_id", "left_anti"))
        if r == rounds:
            in_order = folded_in_order(blocks.join(open_ones, "session_id", "left_semi"), kept)
            return last_stacks(settled).unionByName(in_order)
        mine = ends.join(open_ones, "session_id", "left_semi")
        again = blocks.join(changed, ["session_id", "block"]).select("session_id", "block", F.col("now").alias("start"), folded(F.col("now"), F.col("answers"), kept).alias("stack"))
        ends = cut(mine.join(changed.select("session_id", "block"), ["session_id", "block"], "left_anti").unionByName(again))
    return last_stacks([*settled, ends])


def last_stacks(parts: list[DataFrame]) -> DataFrame:
    """The stack after the last block of each session."""
    return reduce(DataFrame.unionByName, parts).groupBy("session_id").agg(F.max_by("stack", "block").alias("decision_stack"))


def enrichment_states(answers: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(session_id, intent_label, topic_tags, decision_stack, decision_summary): label and tags as last given, the stack, and the last decision made."""
    said = lambda c, given: F.max_by(c, F.when(given, F.col("turn")))
    made = F.size("decisions") > 0
    last = answers.groupBy("session_id").agg(
        said("intent_label", F.coalesce("intent_label", F.lit("")) != "").alias("intent_label"), said("topic_tags", F.size("topic_tags") > 0).alias("topic_tags"),
        said(F.try_element_at("decisions", F.lit(-1))["decision"], made).alias("decision_summary"),
    )
    return last.join(decision_stacks(answers, block_turns), "session_id", "left").withColumn("decision_stack", F.coalesce("decision_stack", F.array().cast(STACK)))
