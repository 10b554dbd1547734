"""The unified prompt relation and its small dimensions."""

from __future__ import annotations

from pyspark.sql import types as T

#: Names of sources and origins.
SOURCES = ("hermes", "claude-code", "copilot", "codex", "chatgpt", "json-import")
ORIGINS = ("human", "machine")

PROMPT_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("message_ref", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("origin", T.StringType(), False),
        T.StructField("cwd", T.StringType()),
        T.StructField("git_repo", T.StringType()),
        T.StructField("model", T.StringType()),
    ]
)
PROMPT_COLUMNS = tuple(PROMPT_SCHEMA.fieldNames())

#: Order of equal timestamps wherever an order is needed.
TIE = ("source", "session_id", "message_ref")

#: Rules of the scorecard with their titles, and who judges them.
RULES = (
    ("A1", "explicit instructions", "model"),
    ("A2", "positive phrasing", "model"),
    ("A3", "reasons given", "model"),
    ("A4", "structured prompt", "text"),
    ("A5", "output contract", "text"),
    ("A6", "worked examples", "text"),
    ("A7", "reasoning control", "text"),
    ("A8", "grounded in sources", "model"),
    ("A9", "verification step", "text"),
    ("A10", "self-check", "text"),
    ("A11", "long-context placement", "text"),
    ("A12", "cache-friendly prefix", "text"),
    ("A13", "sampling control", "text"),
)
JUDGED = tuple(r for r, _, by in RULES if by == "model")
