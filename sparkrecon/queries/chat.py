"""Folding of the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrecon.operators import chat as H
from sparkrecon.queries.registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

# Some turns are emptied and some roles are unknown, so that every rule applies.
TURNS = """(SELECT conv_id, turn, CASE WHEN conv_id % 5 = 1 AND role = 'assistant' THEN 'tool' WHEN conv_id % 9 = 0 THEN 'system' ELSE role END AS role,
    CASE WHEN conv_id % 7 = 2 AND role <> 'system' THEN '' ELSE text END AS text FROM conversations)"""
MESSAGES = f"""(SELECT conv_id, turn, CASE role WHEN 'assistant' THEN role ELSE 'user' END AS role, text FROM {TURNS} WHERE role <> 'system' AND text <> ''
    UNION ALL SELECT conv_id, NULL, 'user', 'Continue.' FROM {TURNS} GROUP BY 1 HAVING NOT bool_or(role <> 'system' AND text <> ''))"""


def turns(t):
    conv, role = F.col("conv_id"), F.col("role")
    return t.conversations.select(
        "conv_id",
        "turn",
        F.when((conv % 5 == 1) & (role == "assistant"), "tool").when(conv % 9 == 0, "system").otherwise(role).alias("role"),
        F.when((conv % 7 == 2) & (role != "system"), "").otherwise(F.col("text")).alias("text"),
    )


@query(
    "fold_conversation",
    f"""SELECT m.conv_id, system, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user FROM {MESSAGES} m
        LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS system FROM {TURNS}
                   WHERE role = 'system' AND text <> '' GROUP BY 1) s USING (conv_id) GROUP BY 1, 2""",
)
def fold_conversation(t):
    return H.fold_conversation(turns(t))


@query("fold_messages", f"SELECT * FROM {MESSAGES}")
def fold_messages(t):
    return H.fold_messages(turns(t))


@query(
    "assemble_chunks",
    """SELECT conv_id, role, string_agg(text, '' ORDER BY turn) AS text FROM conversations
       WHERE role <> 'system' GROUP BY 1, 2""",
)
def assemble_chunks(t):
    """Every turn cut into lines as text deltas, put together again per speaker."""
    lines = F.posexplode(F.split("text", "(?<=\n)")).alias("piece", "text")
    deltas = t.conversations.select("conv_id", "role", "turn", lines).select(
        "conv_id",
        "role",
        (F.col("turn") * 100_000 + F.col("piece")).alias("pos"),
        "text",
        F.when(F.col("role") == "system", "ping").otherwise("text").alias("kind"),
    )
    return H.assemble_chunks(deltas, ["conv_id", "role"], "pos", "text", "kind")
