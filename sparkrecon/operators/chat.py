"""Folding of chat turns ``(conv_id, turn, role, text)`` and text deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.plans.prefix import ordered_concat

# The message of an otherwise empty conversation, and the text between system
# messages.
EMPTY_MESSAGE = "Continue."
SYSTEM_SEPARATOR = "\n\n"


def system_text(turns: DataFrame) -> DataFrame:
    """``(conv_id, system)``: the system texts of a conversation in order."""
    system = turns.filter((F.col("role") == "system") & (F.coalesce("text", F.lit("")) != ""))
    return ordered_concat(system, ["conv_id"], "turn", "text", SYSTEM_SEPARATOR, "system")


def fold_messages(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``: what is sent, one row per message.

    Empty and system turns are left out and any role but assistant counts as user. A
    conversation with nothing left gets one user message; its turn is null.
    """
    sends = (F.coalesce("role", F.lit("")) != "system") & (F.coalesce("text", F.lit("")) != "")
    messages = turns.filter(sends).select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"),
        "text",
    )
    silent = turns.groupBy("conv_id").agg(F.bool_or(sends).alias("_any")).filter(~F.col("_any"))
    return messages.unionByName(
        silent.select(
            "conv_id",
            F.lit(None).cast("long").alias("turn"),
            F.lit("user").alias("role"),
            F.lit(EMPTY_MESSAGE).alias("text"),
        )
    )


def fold_conversation(turns: DataFrame) -> DataFrame:
    """``(conv_id, system, n_messages, n_user)`` per conversation, nothing collected."""
    counted = (
        fold_messages(turns)
        .groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("n_messages"),
            F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("n_user"),
        )
    )
    return counted.join(system_text(turns), "conv_id", "left").select("conv_id", "system", "n_messages", "n_user")


def assemble_chunks(deltas: DataFrame, keys: list[str], pos: str, text: str = "text", kind: str | None = None) -> DataFrame:
    """``(keys, text)``: text pieces in order; blank pieces and other kinds are skipped."""
    pieces = deltas.filter(F.coalesce(F.col(text), F.lit("")) != "")
    if kind is not None:
        pieces = pieces.filter(F.col(kind) == "text")
    return ordered_concat(pieces, keys, pos, text, "", "text")
