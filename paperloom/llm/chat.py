"""Chat formatting: sorted turn structs become one templated text per conversation.

Only Spark expressions. A conversation is formatted as

    <|open|>role<|text|>first text<|next|>second text<|close|> ...

where adjacent turns of one role share a block, their texts parted by ``<|next|>``.
Inside roles and texts ``\\`` becomes ``\\\\`` and then ``<|`` becomes ``<\\|``, so no
control string can occur in them and the original is always recovered.

Defined results: null text and null role count as empty; a null turn sorts first; equal
turn numbers are ordered by role, then text; repeated rows stay; rows with a null
conversation id form one conversation; a very long text is one string of the row that holds its
conversation; other columns, of any name, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, TEXT, NEXT, CLOSE = "<|open|>", "<|text|>", "<|next|>", "<|close|>"


def _literal(mark: str) -> str:
    return mark.replace("|", "\\|")


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """conv_id, formatted string, segments array<struct<text, loss>>.

    The segments concatenate to ``formatted``; ``loss`` marks those a model is trained on.
    One conversation is one output row, so its turns meet in one task; only that
    conversation's rows do.
    """
    packed = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t")
    )

    def pieces(x: Column, i: Column) -> Column:
        before = F.get(F.col("t"), i - 1)["role"]
        head = F.when(i == 0, F.concat(F.lit(OPEN), escape(x["role"]), F.lit(TEXT))).when(before == x["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(CLOSE + OPEN), escape(x["role"]), F.lit(TEXT)))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("text"), (x["role"] == learn_role).alias("loss")),
        )

    end = F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))
    cut = packed.select("conv_id", F.concat(F.flatten(F.transform("t", pieces)), end).alias("segments"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns array<struct<role, text>> that a formatted text holds."""
    blocks = F.split(formatted, _literal(CLOSE), -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, len(OPEN) + 1, 2**31 - 1), _literal(TEXT), -1)
        return F.transform(F.split(F.get(parts, F.lit(1)), _literal(NEXT), -1), lambda t: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
