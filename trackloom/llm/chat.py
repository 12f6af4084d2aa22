r"""Chat formatting by rotation of perspective.

For every participant the dialogue is rendered once with that speaker as the assistant, the others as users
named by a header, system turns as they are; what is to be learned (the mask) is the assistant's text. The
result is long: one row per conversation, perspective and turn, in the order of `turn`, so that no task has to
hold a conversation; dialogues() joins the segments of each perspective where the turns are known to be few.

Texts and names can't forge a turn: "<|" in them is written "<\|", and blanks of any kind in a name "_", so that a
header has but the fields it is given; unescaped() gives a text back.

Defined results: a null speaker is rendered as the user "unknown" and gets no perspective; null text renders as
empty; system turns appear in every perspective and never train; a conversation with system turns alone gives no
rows; repeated turns are rendered as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm._common import text_or_empty

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """Without the marks of this format; a backslash that stands there already is doubled, so that it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1$1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", lambda m: "<" + m[1][: len(m[1]) // 2] + "|", text)


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """conv_id, perspective, turn, speaker, shown_as, segment, train, mask_start, mask_length (characters of segment).

    Participants are counted map-side; turns meet them in one join on the conversation, which Spark splits where
    a conversation is hot.
    """
    t = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{speaker_col}`").alias("speaker"), escaped(text_or_empty(F.col(f"`{text_col}`"))).alias("said"))
    people = t.where(F.col("speaker").isNotNull() & (F.col("speaker") != system)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    rows = t.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    shown: Column = F.when(F.col("speaker") == system, "system").when(own, "assistant").otherwise("user")
    header = F.concat(F.lit(BEGIN), shown, F.when(shown == "user", F.concat(F.lit(" name="), F.regexp_replace(escaped(F.coalesce("speaker", F.lit("unknown"))), r"\s", "_"))).otherwise(F.lit("")), F.lit("\n"))
    return rows.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        shown.alias("shown_as"),
        F.concat(header, "said", F.lit(END)).alias("segment"),
        own.alias("train"),
        F.when(own, F.length(header)).cast("long").alias("mask_start"),
        F.when(own, F.length("said")).otherwise(0).cast("long").alias("mask_length"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, rendered, masks (start, length in rendered). For conversations known to fit a task."""
    w = Window.partitionBy("conv_id", "perspective").orderBy("turn", "speaker", "segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.withColumn("at", F.coalesce(F.sum(F.length("segment")).over(w), F.lit(0)))
    item = F.struct("turn", "speaker", "segment", "at", "train", (F.col("at") + F.col("mask_start")).alias("start"), F.col("mask_length").alias("length"))
    g = placed.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(item)).alias("items"))
    masks = F.transform(F.filter("items", lambda x: x["train"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return g.select("conv_id", "perspective", F.concat_ws("", F.transform("items", lambda x: x["segment"])).alias("rendered"), masks.alias("masks"))
