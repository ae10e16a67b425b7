"""Chat formatting: every participant's view of a dialogue.

For each speaker of a conversation the whole dialogue is rendered with that
speaker as the assistant and the others as named users. The result is a row per
turn and speaker: the rendered segment, where it starts and ends in the view (code
points), and whether a model learns from it (the speaker's own turns). Segments of
a view, joined in their order, are the dialogue.

Offsets come from two sums, over blocks of turns and inside a block, so a long
conversation is spread over its blocks. Turns are in the order of turn, role and
text, nulls first; repeated rows are repeated turns. A null role is the speaker
``unknown``; a null text is empty; a null conv_id is one conversation. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 256


def _segment(own: Column, role: Column, text: Column) -> Column:
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    return F.concat(head, text, F.lit("<|end|>\n"))


def perspectives(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, speaker, position, segment, start, end, learned) per turn and speaker."""
    turns = conversations.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    # Repeated rows become one counted row, so that equal turns need no order.
    turns = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    part = F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62)))
    turns = turns.withColumn("part", part).withColumn("chars", F.length("text"))
    speakers = turns.select("conv_id", F.col("role").alias("speaker")).distinct()
    length = F.length(_segment(F.col("role") == F.col("speaker"), F.col("role"), F.lit(""))) + F.col("chars")
    views = turns.alias("t").join(speakers.alias("s"), F.expr("t.conv_id <=> s.conv_id")).select("t.*", "s.speaker")
    views = views.withColumn("chars", length.cast("long")).withColumn("all_chars", F.col("chars") * F.col("copies"))
    blocks = views.groupBy("conv_id", "speaker", "part").agg(
        F.sum("all_chars").alias("block_chars"), F.sum("copies").alias("block_turns")
    )
    before = W.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("c"),
        F.col("speaker").alias("s"),
        F.col("part").alias("p"),
        F.coalesce(F.sum("block_chars").over(before), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("block_turns").over(before), F.lit(0)).alias("turns_before"),
    )
    inside = (
        W.partitionBy("conv_id", "speaker", "part")
        .orderBy("turn", "role", "text")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    placed = views.withColumns(
        {
            "chars_in": F.coalesce(F.sum("all_chars").over(inside), F.lit(0)),
            "turns_in": F.coalesce(F.sum("copies").over(inside), F.lit(0)),
        }
    ).join(blocks, F.expr("conv_id <=> c and speaker = s and part = p"))
    copy = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = F.col("chars_before") + F.col("chars_in") + F.col("copy") * F.col("chars")
    own = F.col("role") == F.col("speaker")
    return copy.select(
        "conv_id",
        "speaker",
        (F.col("turns_before") + F.col("turns_in") + F.col("copy")).alias("position"),
        _segment(own, F.col("role"), F.col("text")).alias("segment"),
        start.alias("start"),
        (start + F.col("chars")).alias("end"),
        own.alias("learned"),
    )


def dialogues(views: DataFrame) -> DataFrame:
    """(conv_id, speaker, text, masks) of whole views; for conversations that fit into a row."""
    rows = F.sort_array(F.collect_list(F.struct("position", "segment", "start", "end", "learned")))
    whole = views.groupBy("conv_id", "speaker").agg(rows.alias("rows"))
    return whole.select(
        "conv_id",
        "speaker",
        F.concat_ws("", F.transform("rows", lambda r: r["segment"])).alias("text"),
        F.transform(
            F.filter("rows", lambda r: r["learned"]), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))
        ).alias("masks"),
    )
