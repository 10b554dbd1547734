"""A deterministic prompt relation over the driver's conversations, the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

NOW = 1711843200
HOME = "/home/u"

_VIEW = """select
  case conv_id % 6 when 0 then 'hermes' when 1 then 'claude-code' when 2 then 'copilot' when 3 then 'codex' when 4 then 'chatgpt' else 'json-import' end as source,
  cast(conv_id as {S}) as session_id,
  concat(cast(conv_id as {S}), ':', cast(turn as {S})) as message_ref,
  concat(case when conv_id % 5 = 0 then 'TASK: ' else '' end,
    case when (conv_id*8+turn) % 11 = 0 then repeat(concat(text, ' '), 9) when (conv_id*8+turn) % 13 = 0 then 'ok' else text end,
    case (conv_id*8+turn) % 9 when 0 then ' For example, use a == b.' when 1 then ' You must return only json.'
      when 2 then ' Verify: it works. Think step by step.' when 3 then ' Redo everything.'
      when 4 then concat(chr(10), '- first', chr(10), '- second') when 5 then ' Double-check it; temperature 0.'
      when 6 then ' Put it in <b> please.' else '' end) as content,
  1704067200 + (conv_id*7919*13) % 7776000 + turn*60 as ts,
  case (conv_id*3+turn) % 7 when 0 then 'claude-haiku-4-5' when 1 then 'claude-opus-4-8' when 2 then 'qwen3-coder-30b'
    when 3 then 'llama3:8b' when 4 then 'copilot/auto' when 5 then 'gpt-5-codex' else null end as model,
  case when conv_id % 17 = 0 then null else concat('/home/u/p', cast(conv_id % 13 as {S}), case when turn % 4 = 2 then '/src' else '' end) end as cwd,
  conv_id*8+turn as k
from {table} where role = 'user' and text is not null"""


def re2(name: str) -> str:
    """A cue pattern for DuckDB, quoted."""
    flags, body = X.PATTERNS[name]
    return "'" + (f"(?{flags})" if flags else "") + body.replace("'", "''") + "'"


def hit(name: str, column: str = "content") -> str:
    return f"regexp_matches({column}, {re2(name)})"


#: The relation as a CTE named p for DuckDB.
P_SQL = f"""with v as ({_VIEW.format(S="varchar", table="conversations")}),
p as (select *, sha256(trim(regexp_replace(content, '\\s+', ' ', 'g'))) as content_hash, case when {hit("machine")} then 'machine' else 'human' end as origin,
  length(content) as n, concat(source, ':', session_id, ':', message_ref) as prompt_ref from v)
"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation with the columns of the prompt schema, and k, a number to vary test data by."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    view = spark.sql(_VIEW.format(S="string", table="{conversations}"), conversations=conversations)
    return view.select("source", "session_id", "message_ref", "content", X.content_hash().alias("content_hash"), F.timestamp_seconds("ts").alias("timestamp"), X.origin().alias("origin"), "cwd", F.col("cwd").alias("git_repo"), "model", "k")
