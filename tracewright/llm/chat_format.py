"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns up to and including it are
rendered, and only its text is trainable (a span of code points).

Template, for each turn: ``[INST]role[/INST]text</s>``. Control strings inside roles and
texts get one ``~`` after their bracket (``</s>`` becomes ``<~/s>``, ``<~/s>`` becomes
``<~~/s>``), so that none is left and unescape() gives back the original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(~*)(/?)(s>|INST\])"
_ESCAPED = r"([<\[])~(~*)(/?)(s>|INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, "$1~$2$3$4")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1$2$3$4")


def format_chats(conversations: DataFrame, keep_rest: bool = True) -> DataFrame:
    """One row per assistant turn: conv_id, example (its turn's place, from 1), trainable,
    formatted, loss_start, loss_chars (code points of `formatted`, from 0).

    Turns are ordered by turn, then role, then text; nulls come first, null text and role
    count as empty, and a null conv_id is a conversation like another. Repeated rows are
    repeated turns. With keep_rest, a conversation that does not end with an assistant turn
    also gives a row without a loss (trainable false) that holds all its turns, so that
    nothing is lost. Very long texts are kept whole. An empty table gives no rows. Other
    columns are ignored. The rows of one conversation meet in one task, as they do in the last
    example itself.
    """
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rendered = turns.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == "assistant").alias("target"),
                F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE)).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("turns"),
    )
    chosen = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: F.element_at("turns", i)["target"] | (F.lit(keep_rest) & (i == F.size("turns"))),
    )
    examples = rendered.select("conv_id", "turns", F.explode(chosen).alias("example"))
    own = F.element_at("turns", F.col("example"))
    before = F.array_join(
        F.transform(F.slice("turns", F.lit(1), F.col("example") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""
    )
    return (
        examples.select("conv_id", "example", own.alias("own"), F.concat(before, own["head"]).alias("prefix"))
        .select(
            "conv_id",
            "example",
            F.col("own.target").alias("trainable"),
            F.concat("prefix", F.col("own.body"), F.lit(END)).alias("formatted"),
            F.char_length("prefix").alias("loss_start"),
            F.when(F.col("own.target"), F.char_length(F.col("own.body"))).otherwise(0).alias("loss_chars"),
        )
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: its turns and the text under the loss mask."""
    loss = unescape(F.expr("substring(formatted, loss_start + 1, loss_chars)"))
    whole = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("trainable"), F.struct("example", loss.alias("text"))))).alias("losses"),
        F.sum(F.char_length("formatted").cast("long")).alias("formatted_chars"),
    )
    parts = F.split("longest", END, -1)
    return whole.select(
        "conv_id",
        F.transform(
            F.slice(parts, F.lit(1), F.size(parts) - 1),
            lambda p: F.struct(
                unescape(F.regexp_extract(p, r"(?s)^\[INST\](.*?)\[/INST\]", 1)).alias("role"),
                unescape(F.regexp_extract(p, r"(?s)\[/INST\](.*)$", 1)).alias("text"),
            ),
        ).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["text"]), "").alias("loss"),
        "formatted_chars",
    )


def digests(back: DataFrame) -> DataFrame:
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
