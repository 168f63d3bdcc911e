"""Chat formatting by prefix-target expansion, in SQL functions only.

A turn is written as TURN role BODY text END. Control strings inside roles and texts, those of this template and
those of other common ones, get a backslash after their first character (one more if there are some already), so
that no text can open or close a turn; reading back takes one backslash away again.

Every assistant turn gives one example: all turns before it as context and itself as the target. What follows
the last assistant turn gives one example without a target, so that nothing of a conversation is lost.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Control strings of this template, then of other public templates.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
FOREIGN = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
ASSISTANT = "assistant"

_TAILS = "|".join(re.escape(c[1:]) for c in [TURN, BODY, END, *FOREIGN])
_INSIDE = rf"([<\[])(\\*)({_TAILS})"
_ESCAPED = rf"([<\[])\\(\\*)({_TAILS})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _INSIDE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation, its turns in order as array<struct(role, text)>.

    Order is turn, nulls first, then role and text where turns tie. Null roles and texts are empty; repeated rows stay.
    """
    row = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    sorted_rows = F.sort_array(F.collect_list(row))
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(sorted_rows.alias("turns"))


def examples(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 1), last, formatted, loss_start, loss_end.

    loss_start and loss_end are code-point positions (end exclusive) of the trainable reply inside `formatted`, equal
    where nothing is trainable; last marks the example that holds the whole conversation. The expansion of a
    conversation of n turns is quadratic in n by its nature; conversations never meet in one row. An empty table gives no
    rows, extra columns are ignored.
    """
    segment = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY), escape(t["text"]), F.lit(END))
    placed = conversations_of(turns).select(
        "conv_id",
        F.transform("turns", segment).alias("segments"),
        F.transform("turns", lambda t: F.struct((t["role"] == ASSISTANT).alias("trains"), F.char_length(escape(t["text"])).alias("chars"))).alias("marks"),
    )
    number = F.sequence(F.lit(1), F.size("marks"))
    ends = F.filter(number, lambda i: F.element_at("marks", i)["trains"] | (i == F.size("marks")))
    cut = placed.select("conv_id", "segments", "marks", F.posexplode(ends).alias("k", "upto"))
    mark = F.element_at("marks", F.col("upto"))
    formatted = F.array_join(F.slice("segments", 1, F.col("upto")), "")
    loss_end = F.char_length("formatted") - len(END)
    return (
        cut.select("conv_id", (F.col("k") + 1).alias("example"), (F.col("upto") == F.size("marks")).alias("last"), formatted.alias("formatted"), mark["trains"].alias("trains"), mark["chars"].alias("chars"))
        .select(
            "conv_id",
            "example",
            "last",
            "formatted",
            F.when(F.col("trains"), loss_end - F.col("chars")).otherwise(F.lit(0)).alias("loss_start"),
            F.when(F.col("trains"), loss_end).otherwise(F.lit(0)).alias("loss_end"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """array<struct(role, text)> read back from a formatted string."""
    bodies = F.filter(F.split(formatted, re.escape(TURN)), lambda s: s != "")
    at = lambda s: F.instr(s, BODY)
    return F.transform(
        bodies,
        lambda s: F.struct(
            unescape(F.substring(s, F.lit(1), at(s) - 1)).alias("role"),
            unescape(F.substring(s, at(s) + len(BODY), F.char_length(s) - at(s) - len(BODY) - len(END) + 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The unescaped text under the loss mask."""
    return unescape(F.substring(formatted, start + 1, end - start))


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The examples of a conversation already lie in one partition, so this adds no exchange.
    """
    turn_text = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = rows.select(
        "conv_id",
        "example",
        F.char_length("formatted").cast("long").alias("chars"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.when(F.col("last"), F.size(read_turns(F.col("formatted"))).cast("long")).alias("n_turns"),
        F.when(F.col("last"), F.sha2(turn_text, 256)).alias("turns_sha256"),
    )
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "")
    return (
        read.groupBy("conv_id")
        .agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
