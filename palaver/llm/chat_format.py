"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is
trainable.  A conversation that does not end with an assistant turn also yields one example without a
target, so that every turn stands in the output.  Turns are written as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Control strings inside texts get one backslash after their first character (strings that hold
backslashes there get one more), which :func:`unescape` takes away again.

Edge cases: null texts and roles count as empty; turns follow by turn (null first), then role and text,
repeated rows included; a conversation without assistant turns has one example without a target; a null
conv_id is a conversation; a very long text stands whole in every example that has it as context; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates: fixed values, first character and rest.
CONTROL_REST = (
    r"\|im_start\|>", r"\|im_end\|>", r"\|endoftext\|>", r"\|system\|>", r"\|user\|>", r"\|assistant\|>",
    r"/?s>", r"</?SYS>>", r"/?INST\]",
)
_REST = "(" + "|".join(CONTROL_REST) + ")"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = unescape(role)
    # a doubled backslash first becomes a mark that no escaped role holds (a bare line break)
    marked = F.replace(plain, F.lit("\\\\"), F.lit("\n"))
    split = F.transform(F.split(marked, "\n", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(split, "\\")


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per example: conv_id, example, formatted, loss_start, loss_end, trainable.

    loss_start and loss_end are code points of ``formatted``, end exclusive; equal where nothing is trained.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    conv = conv.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == ASSISTANT).alias("target"), head(t).alias("head"), escape(t["text"]).alias("body")
            ),
        ).alias("parts"),
    )
    n = F.size("parts")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("parts", i)["target"])
    open_end = F.when(F.element_at("parts", -1)["target"], F.array().cast("array<int>")).otherwise(F.array(n))
    examples = conv.select("conv_id", "parts", F.explode(F.concat(targets, open_end)).alias("last"))
    whole = lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))
    final = F.element_at("parts", F.col("last"))
    examples = examples.select(
        "conv_id",
        F.col("last").alias("example"),
        final["target"].alias("trainable"),
        final.alias("final"),
        F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("last") - 1), whole), "").alias("context"),
    )
    start = F.length("context") + F.length("final.head")
    return examples.select(
        "conv_id",
        "example",
        F.concat("context", whole(F.col("final"))).alias("formatted"),
        start.alias("loss_start"),
        (start + F.when(F.col("trainable"), F.length("final.body")).otherwise(0)).alias("loss_end"),
        "trainable",
    )


def parse_formatted(formatted: Column) -> Column:
    """array<struct<role, text>> read back from one formatted string."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1_000_000_000)

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        body = F.substr(piece, cut + 1)
        return F.struct(
            unescape_role(F.substr(piece, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substr(body, F.lit(1), F.length(body) - len(END) - 1)).alias("text"),
        )

    return F.transform(pieces, turn)


def trained_text(formatted: Column, start: Column, end: Column) -> Column:
    return unescape(F.substr(formatted, start + 1, end - start))
