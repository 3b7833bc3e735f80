"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn gives an example of its own: all preceding turns as context, then that reply,
which alone is trainable (``loss_start``, ``loss_end``: code points in ``formatted``, end
exclusive). A conversation that doesn't end with an assistant turn also gives one example without
a target, so that no turn is lost.

Template: a turn is ``### <role>: <text></turn>`` and a line feed. Inside texts and roles the
backslash is written ``\\b``, ``###`` as ``\\h`` and ``</turn>`` as ``\\e``, and in roles the colon as
``\\c``; so control strings in ``formatted`` are those of the template, and reading back is exact.

Defined cases: null text or role is the empty string; turns are ordered by turn, then role, then
text, null turns first; repeated rows are turns of their own; rows with a null ``conv_id`` are one
conversation; a conversation without assistant turns has no trainable text; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>\n"
TRAINED_ROLE = "assistant"


def escaped(col: Column) -> Column:
    col = F.replace(col, F.lit("\\"), F.lit("\\b"))
    col = F.replace(col, F.lit("###"), F.lit("\\h"))
    return F.replace(col, F.lit("</turn>"), F.lit("\\e"))


def unescaped(col: Column) -> Column:
    col = F.replace(col, F.lit("\\h"), F.lit("###"))
    col = F.replace(col, F.lit("\\e"), F.lit("</turn>"))
    return F.replace(col, F.lit("\\b"), F.lit("\\"))


def escaped_role(col: Column) -> Column:
    return F.replace(escaped(col), F.lit(":"), F.lit("\\c"))


def unescaped_role(col: Column) -> Column:
    return unescaped(F.replace(col, F.lit("\\c"), F.lit(":")))


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, example, formatted, loss_start, loss_end)``; example: the position of its last turn."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    convs = convs.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(F.concat(F.lit("### "), escaped_role(t.role), F.lit(": ")).alias("head"), escaped(t.text).alias("body"), (t.role == TRAINED_ROLE).alias("trained"))).alias("parts"),
    )
    convs = convs.select("conv_id", "parts", F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(TURN_END))).alias("lines"))
    each = convs.select("conv_id", "parts", "lines", F.posexplode("parts").alias("example", "part")).filter(F.col("part.trained") | (F.col("example") == F.size("parts") - 1))
    context = F.array_join(F.slice("lines", F.lit(1), F.col("example")), "")
    each = each.select("conv_id", "example", "part", context.alias("context"))
    start = F.char_length(F.concat("context", "part.head"))
    return each.select(
        "conv_id",
        "example",
        F.concat("context", "part.head", "part.body", F.lit(TURN_END)).alias("formatted"),
        F.when(F.col("part.trained"), start).otherwise(F.lit(0)).alias("loss_start"),
        F.when(F.col("part.trained"), start + F.char_length("part.body")).otherwise(F.lit(0)).alias("loss_end"),
    )


def parsed(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted example."""
    lines = F.split(formatted, "</turn>\\n")
    lines = F.slice(lines, F.lit(1), F.size(lines) - 1)

    def turn(line: Column) -> Column:
        at = F.instr(line, ": ")
        return F.struct(unescaped_role(F.substring(line, F.lit(5), at - 5)).alias("role"), unescaped(F.substring(line, at + 2, F.char_length(line))).alias("text"))

    return F.transform(lines, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples alone."""
    rows = formatted.select(
        "conv_id",
        "example",
        "formatted",
        F.char_length("formatted").cast("bigint").alias("chars"),
        F.when(F.col("loss_end") > 0, unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))).alias("target"),
    )
    convs = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", "target")))).alias("targets"),
    )
    convs = convs.select("conv_id", "formatted_chars", parsed(F.col("formatted")).alias("turns"), F.array_join("targets.target", "").alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return convs.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
