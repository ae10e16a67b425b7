"""Conversations as prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxrank.functions.text import chat_line

def conversation_lines(messages: DataFrame) -> DataFrame:
    """The lines of every conversation's prompt as rows ``(conv_id, turn, line)``, the closing one last."""
    extras = F.col("extras") if "extras" in messages.columns else None
    lines = messages.select(
        "conv_id", "turn", chat_line(F.col("role"), F.col("text"), extras).alias("line")
    )
    closing = messages.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    return lines.unionByName(closing.withColumn("line", F.lit("assistant: ")))


def conversation_prompts(messages: DataFrame, turns_per_part: int | None = None) -> DataFrame:
    """One prompt per conversation: its lines in turn order, then ``assistant: ``.

    ``messages(conv_id, turn, role, text[, extras])``, turns unique within a
    conversation -> ``(conv_id, part, prompt)``. Only where ``turns_per_part`` is given
    does a conversation come in several parts, which joined by newlines are its prompt.
    """
    part = F.lit(0) if turns_per_part is None else F.floor(F.col("turn") / turns_per_part)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return (
        conversation_lines(messages)
        .groupBy("conv_id", part.cast("long").alias("part"))
        .agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("prompt"))
    )
