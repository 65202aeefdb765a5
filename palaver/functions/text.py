"""Text functions: questions, entities, intent, summaries, snippets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver import schemas as S

SPACE = r"(?U)^\s+|\s+$"
ENVELOPE = r"^\s*\[RETRIEVED CONTEXT\][\s\S]*?(?:\n\n|\z)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def clean_message(text: Column) -> Column:
    """Without a retrieved-context envelope of our own."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), ENVELOPE, ""))


def clip(text: Column, n: int, mark: str = "") -> Column:
    """P5: the first n characters, with a mark if something is cut."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def embeddable(text: Column) -> Column:
    """P4."""
    return F.length(strip(F.coalesce(text, F.lit("")))) > 5


def matches_any(text: Column, phrases) -> Column:
    """any phrase, whatever the case."""
    return F.coalesce(text, F.lit("")).rlike("(?iu)" + "|".join(phrases))


def holds_any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def is_switch(text: Column, phrases=S.SWITCH_PHRASES) -> Column:
    return matches_any(text, phrases)


def is_question(text: Column) -> Column:
    """ends with a question mark, or starts with a question word."""
    bare = strip(F.coalesce(text, F.lit("")))
    first = F.lower(F.regexp_extract(bare, r"(?U)^(\S+)", 1))
    first = F.regexp_replace(first, r"^[.,!:;\-—()\[\]{}'\"]+|[.,!:;\-—()\[\]{}'\"]+$", "")
    return F.endswith(bare, F.lit("?")) | first.isin(*S.QUESTION_WORDS)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """*body* of a value that is computed once; inside a lambda an expression is computed once an element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def entities(text: Column, most: int = 30) -> Column:
    """quoted and capitalised names, first spelling of each, in order of kind."""
    text = F.coalesce(text, F.lit(""))
    one, rest = F.lit(1), F.lit(0)
    found = F.concat(
        F.regexp_extract_all(text, F.lit(r"`([^`\n]{2,40})`"), one),
        F.regexp_extract_all(text, F.lit(r'"([^"\n]{2,40})"'), one),
        F.regexp_extract_all(text, F.lit(r"'([^'\n]{2,40})'"), one),
        F.regexp_extract_all(text, F.lit(r"(?U)\b[A-ZА-ЯЁ][A-Za-zА-Яа-яЁё0-9_-]{2,}\b"), rest),
    )
    bare = F.transform(found, lambda t: F.regexp_replace(strip(t), r"^[.,;:!?()\[\]{}<>]+|[.,;:!?()\[\]{}<>]+$", ""))
    kept = F.filter(bare, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*S.STOPWORDS))
    first = lambda names, low: F.filter(names, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    return F.slice(bound(kept, lambda names: bound(F.transform(names, F.lower), lambda low: first(names, low))), 1, most)


def contradicts(text: Column, names: Column) -> Column:
    """an entity and a negation, both as substrings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(F.exists(names, lambda e: F.contains(low, F.lower(e))), F.lit(False)) & holds_any(low, S.NEGATIONS)


def asks_about(text: Column, names: Column) -> Column:
    """a question that names an entity of the last reply."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return is_question(text) & F.coalesce(F.exists(names, lambda e: F.contains(low, F.lower(e))), F.lit(False))


def intent(switch: Column, contradiction: Column, drift: Column, question: Column, threshold: float = S.DRIFT_THRESHOLD) -> Column:
    """F8: the first signal decides."""
    return (
        F.when(switch | contradiction, "SWITCH").when(drift > threshold, "NEW_TASK").when(question, "CLARIFICATION").otherwise("CONTINUATION")
    )


def signals(switch: Column, contradiction: Column, drift: Column, question: Column, threshold: float = S.DRIFT_THRESHOLD) -> Column:
    """what a message's intent was decided from, and the intent."""
    return F.struct(
        switch.alias("is_switch"), contradiction.alias("contradicts"), drift.alias("drift"), (drift > threshold).alias("drifts"), question.alias("asks_about_output"),
        intent(switch, contradiction, drift, question, threshold).alias("intent"),
    )


def mode(text: Column, last_tool: Column) -> Column:
    """The retrieval mode of a message."""
    low, tool = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(last_tool, F.lit("")))
    return (
        F.when(holds_any(low, S.DEBUG_WORDS) | (tool.isin(*S.DEBUG_TOOLS) & holds_any(low, S.DEBUG_DOUBTS)), "debugging")
        .when(holds_any(low, S.REASONING_WORDS) | (F.length(low) > 500), "reasoning")
        .when(holds_any(low, S.FACTUAL_WORDS), "factual")
        .otherwise("general")
    )


def query_text(goal: Column, step: Column, summary: Column, names: Column, message: Column, of_intent: Column, fallback: Column) -> Column:
    """The parts that say something, or else the latest user event."""
    some = lambda c: F.when(c != "", c)
    joined = strip(
        F.concat_ws(
            " ", some(goal), some(step), F.when(of_intent != "CONTINUATION", some(summary)),
            F.when(of_intent == "CLARIFICATION", some(F.array_join(F.slice(names, 1, 10), " "))), some(clean_message(message)),
        )
    )
    return F.coalesce(some(joined), some(clean_message(fallback)))


def summarize(text: Column, threshold: int = S.SUMMARY_THRESHOLD, summary: int = S.SUMMARY_TOKENS, per: int = S.CHARS_PER_TOKEN) -> Column:
    """head, mark and tail of a long tool output."""
    head = summary * per // 2
    tail = summary * per - head
    cut = F.concat(
        F.left(text, F.lit(head)), F.lit("\n...[truncated "), (F.length(text) - head - tail).cast("string"), F.lit(" chars]...\n"), F.right(text, F.lit(tail))
    )
    return F.when(F.length(text) > threshold * per, cut).otherwise(text)


def format_history_line(role: Column, text: Column) -> Column:
    """'[role] text', long texts as 600 characters, a mark and the last 200."""
    bare = strip(F.coalesce(text, F.lit("")))
    short = F.when(F.length(bare) > 800, F.concat(F.left(bare, F.lit(600)), F.lit(" ...[truncated]... "), F.right(bare, F.lit(200)))).otherwise(bare)
    return F.when(bare != "", F.concat(F.lit("["), role, F.lit("] "), short))
