"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation is once the assistant: the whole dialogue is rendered with that speaker's turns as
``assistant``, the others as ``user`` with their name, and the mask names the character spans to learn, the speaker's
contents with their end marks.  System turns take part in every rendering and are nobody's perspective.

A dialogue is one row for each speaker, however long.  Whoever needs bounded rows asks for parts of so many turn numbers;
these follow each other by their number, and rows without a turn number are part -1.  Built-in functions only.

Defined results: turns are in the order of turn, role and text, nulls first; a null text is empty; a turn without a
role is an unnamed user's and a null role no participant; conversations of system turns only have no perspective; null
conversation ids form one conversation; repeated rows are repeated turns.  Marks inside texts and roles are broken up by
a blank and line ends inside roles are blanks, so no text can end its own turn and no role begin one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    return F.regexp_replace(_plain(role), "[\\r\\n]+", " ")


def perspectives(conversations: DataFrame, system: tuple[str, ...] = ("system",), part_turns: int | None = None) -> DataFrame:
    """conv_id, speaker, part, n_turns, text, mask (``start:end`` code points, comma-joined), n_learned (characters)."""
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)) if part_turns else F.lit(0)
    turns = conversations.select("conv_id", part.cast("long").alias("part"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("said"))
    speakers = turns.where(F.col("role").isNotNull() & ~F.col("role").isin(*system)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    mine = F.col("role").eqNullSafe(F.col("speaker"))
    name = F.when(mine, "assistant").when(F.col("role").isin(*system), _name(F.col("role"))).when(F.col("role").isNull(), "user").otherwise(F.concat(F.lit("user name="), _name(F.col("role"))))
    seen = turns.join(speakers, turns["conv_id"].eqNullSafe(speakers["_conv"])).drop("_conv")
    seen = seen.withColumns({"head": F.concat(F.lit(OPEN), name, F.lit("\n")), "body": F.concat(_plain(F.col("said")), F.lit(CLOSE))})

    ordered = Window.partitionBy("conv_id", "speaker", "part").orderBy("turn", "role", "said")
    end = F.sum(F.length("head") + F.length("body") + 1).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    seen = seen.select("conv_id", "speaker", "part", F.row_number().over(ordered).alias("place"), F.concat("head", "body", F.lit("\n")).alias("said"), F.when(mine, F.length("body").cast("long")).alias("learned"), end.alias("end"))
    span = F.concat_ws(":", F.col("end") - F.col("learned"), F.when(F.col("learned").isNotNull(), F.col("end")))
    turn = F.struct("place", "said", F.when(F.col("learned").isNotNull(), span).alias("span"))
    grouped = seen.groupBy("conv_id", "speaker", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.coalesce(F.sum("learned"), F.lit(0)).alias("n_learned"))
    return grouped.select(
        "conv_id",
        "speaker",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.said", "").alias("text"),
        F.array_join("turns.span", ",").alias("mask"),
        "n_learned",
    )
