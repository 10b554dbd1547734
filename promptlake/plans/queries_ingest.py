"""Registered queries of the readers, the ingest operators and the streams, with their DuckDB twins.

The logs are built by Spark from the driver's conversations, in the shapes the readers expect.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import infer, ingest, triggers
from ..schema import SOURCES
from ..sources import readers
from ..streaming import streams
from . import imports, reports
from .queries import _COUNT_CELLS, _FIT_CELLS, _KIND, _PATTERN_CELLS, _RUBRIC_CELLS, _STRIP, _STYLE_CELLS, ORACLES, _all_cells, _digests, query
from .testview import NOW, prompts

_TS = "1704067200 + (conv_id*7919*13) % 7776000 + turn*60"
_C = f"with c as (select *, conv_id*8+turn as k, {_TS} as ts, cast(conv_id as varchar) as sid from conversations where text is not null), "


def _conversations(spark, sf_dir) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    t = t.selectExpr("*", "conv_id*8+turn as k", f"{_TS} as ts", "cast(conv_id as string) as sid")
    iso = F.concat(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return t.withColumn("iso", iso).withColumn("q", _quoted("text"))


def _quoted(column):
    """A text as a JSON string."""
    j = F.to_json(F.struct((F.col(column) if isinstance(column, str) else column).alias("c")))
    return F.substring(j, F.lit(6), F.length(j) - 6)


def _rows(df: DataFrame) -> DataFrame:
    return df.select("source", "session_id", "message_ref", "content", F.unix_seconds("timestamp").alias("ts"), "cwd", "model")


def _rounds(start: str, n: int = 5) -> str:
    out = f", k0 as materialized (select * from {start})\n"
    for i in range(n):
        out += f""", m{i} as (select *, row_number() over (partition by source, session_id, message_ref order by ord) = 1 and row_number() over (partition by content_hash, ts order by ord) = 1 as won from k{i}),
w{i} as materialized (select * exclude (won) from m{i} where won),
k{i + 1} as materialized (select k.* from k{i} k where not exists (select 1 from w{i} w where w.source = k.source and w.session_id = k.session_id and w.message_ref = k.message_ref) and not exists (select 1 from w{i} w where w.content_hash = k.content_hash and w.ts = k.ts))
"""
    return out + ", acc as (" + " union all ".join(f"select * from w{i}" for i in range(n)) + ")\n"


# -- agent transcripts ---------------------------------------------------------------------


def transcript_lines(spark, sf_dir) -> DataFrame:
    c = _conversations(spark, sf_dir)
    k = F.col("k") % 10
    note = F.lit("<system-reminder>be\nbrief</system-reminder> ")
    text = F.when(k == 3, F.concat(F.lit("<command-name>x</command-name>"), "text")).when(k == 4, F.concat(note, "text")).when(k == 6, note).otherwise(F.col("text"))
    content = F.when(k == 5, F.concat(F.lit('[{"type":"text","text":'), "q", F.lit('},{"type":"text","text":"more"}]'))).otherwise(_quoted(text))
    uid = F.concat(F.lit("u"), "sid", F.lit(":"), F.col("turn").cast("string"))
    user = F.concat(
        F.lit('{"type":"user","isSidechain":'), F.when(k == 0, "true").otherwise("false"), F.lit(',"origin":{"kind":"'), F.when(k == 1, "hook").otherwise("human"), F.lit('"},"promptSource":"'), F.when(k == 2, "resumed").otherwise("typed"), F.lit('","timestamp":"'), F.when(k == 7, "bad").otherwise(F.col("iso")), F.lit('"'),
        F.when(k == 8, "").otherwise(F.concat(F.lit(',"uuid":"'), uid, F.lit('","sessionId":"'), "sid", F.lit('"'))), F.lit(',"cwd":"/w/'), "sid", F.lit('","message":{"role":"user","content":'), content, F.lit("}}"),
    )
    parent = F.concat(F.lit("u"), "sid", F.lit(":"), (F.col("turn") - 1).cast("string"))
    model = F.when(F.col("conv_id") % 3 == 0, "<synthetic>").otherwise(F.concat(F.lit("model-"), (F.col("turn") % 3).cast("string")))
    reply = F.concat(F.lit('{"type":"assistant","parentUuid":"'), parent, F.lit('","message":{"role":"assistant","model":"'), model, F.lit('","content":[]}}'))
    value = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", reply).otherwise('{"type":"snapshot"}')
    file = F.concat(F.lit("/logs/p/"), "sid", F.lit(".jsonl"))
    lines = c.select(file.alias("file"), (F.col("turn") * 2).alias("line_no"), value.alias("value"))
    torn = c.where("turn = 0").select(file.alias("file"), F.lit(1).cast("bigint").alias("line_no"), F.lit('{"type":"user", torn').alias("value"))
    return lines.unionByName(torn)


_TR = _C + f"""t as (select c.*, case k % 10 when 5 then {_STRIP.format("concat(text, chr(10), 'more')")} else {_STRIP.format('text')} end as content from c where role = 'user' and k % 10 in (4, 5, 8, 9)),
tr as (select 'claude-code' as source, case when t.k % 10 = 8 then 'unknown' else t.sid end as session_id, case when t.k % 10 = 8 then left(sha256(trim(regexp_replace(content, '\\s+', ' ', 'g'))), 16) else concat('u', t.sid, ':', t.turn) end as message_ref,
  content, t.ts, concat('/w/', t.sid) as cwd, case when t.k % 10 <> 8 and a.conv_id % 3 <> 0 then concat('model-', a.turn % 3) end as model from t left join c a on a.conv_id = t.conv_id and a.turn = t.turn + 1 and a.role = 'assistant' where content <> '')
"""


@query(_TR + "select source, session_id, message_ref, content, ts, cwd, model from tr", cte="")
def src_transcript_filter(spark, sf_dir):
    return _rows(readers.transcripts(transcript_lines(spark, sf_dir)))


@query(_TR + "select message_ref, model from tr where model is not null", cte="")
def attach_reply_model(spark, sf_dir):
    return readers.transcripts(transcript_lines(spark, sf_dir)).where("model is not null").select("message_ref", "model")


@query(_C + "x as (select sid, count(*) as n from c group by sid), z as (select distinct sid from c where turn = 0) select concat('/logs/p/', x.sid, '.jsonl') as file, n + (z.sid is not null)::int as lines, (z.sid is not null)::int as malformed from x left join z using (sid)", cte="")
def malformed_line_counts(spark, sf_dir):
    return readers.line_counts(transcript_lines(spark, sf_dir)).select("file", "lines", F.col("malformed").cast("int").alias("malformed"))


def _in_batches(spark, lines: DataFrame, parts: int) -> Iterator[str]:
    """Lines (file, line_no, value, seen) as files of a stream, a part of the line numbers at a time, then one that only moves the time on. Yields their folder after each."""
    home = _scratch(spark)
    last = spark.createDataFrame([("/heartbeat", 0, "{}", parts + 100)], "file string, line_no bigint, value string, part int").coalesce(1)
    dealt = lines.withColumn("part", F.least(F.floor(F.col("line_no") / 5), F.lit(parts - 1)).cast("int"))
    for rows in (*(dealt.where(F.col("part") == i) for i in range(parts)), last):
        rows.select("file", "line_no", "value", F.timestamp_seconds(F.lit(NOW) + F.col("part") * 600).alias("seen")).write.mode("append").parquet(f"{home}/in")
        yield home


@query(_TR + "select source, session_id, message_ref, content, ts, cwd, model from tr", cte="")
def stream_reply_model(spark, sf_dir):
    """Transcripts in three micro-batches: prompts wait for replies that come later, and leave by event time when none comes."""
    for home in _in_batches(spark, transcript_lines(spark, sf_dir), 3):
        lines = spark.readStream.schema("file string, line_no bigint, value string, seen timestamp").parquet(f"{home}/in")
        streams.run_once(streams.attach_replies(lines, "seen", "30 minutes"), f"{home}/out", f"{home}/state")
    return _rows(spark.read.parquet(f"{home}/out"))


# -- rollout logs -----------------------------------------------------------------------------


def rollout_lines(spark, sf_dir) -> DataFrame:
    c = _conversations(spark, sf_dir)
    file = F.concat(F.lit("/r/2024/01/02/rollout-"), "sid", F.lit(".jsonl"))
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit("# seen\n\n## My request for Codex:\n"), "text")).otherwise(F.col("text"))
    kind = F.when(F.col("k") % 3 == 0, "environment_context").otherwise("plain")
    user = F.concat(F.lit('{"type":"event_msg","timestamp":"'), "iso", F.lit('","payload":{"type":"user_message","kind":"'), kind, F.lit('","message":'), _quoted(text), F.lit("}}"))
    turn = F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit('{"type":"turn_context","payload":{"model":"m'), (F.col("turn") % 3).cast("string"), F.lit('"}}'))).otherwise('{"type":"other"}')
    value = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", turn).otherwise('{"type":"event_msg","payload":{"type":"token_count"}}')
    lines = c.select(file.alias("file"), (F.col("turn") * 10 + 10).alias("line_no"), value.alias("value"))
    one = c.select("sid", "conv_id").distinct()
    meta = lambda cwd: F.concat(F.lit('{"type":"session_meta","payload":{"cwd":"'), cwd, F.lit('"}}'))
    first = one.where("conv_id % 4 <> 0").select(file.alias("file"), F.lit(0).cast("bigint").alias("line_no"), meta(F.concat(F.lit("/a/"), "sid")).alias("value"))
    later = one.where("conv_id % 6 = 0").select(file.alias("file"), F.lit(25).cast("bigint").alias("line_no"), meta(F.lit("/moved")).alias("value"))
    return lines.unionByName(first).unionByName(later)


_RO = _C + f"""u as (select *, {_STRIP.format('text')} as content, turn * 10 + 10 as line from c where role = 'user' and k % 3 <> 0),
n as (select *, lead(line) over (partition by conv_id order by line) as next_line from u where content <> ''),
m as (select n.conv_id, n.line, arg_min(concat('m', a.turn % 3), a.turn) as model from n join c a on a.conv_id = n.conv_id and a.role = 'assistant' and a.conv_id % 5 <> 0 and a.turn * 10 + 10 > n.line and (n.next_line is null or a.turn * 10 + 10 < n.next_line) group by 1, 2),
ro as (select 'codex' as source, concat('rollout-', n.sid) as session_id, left(sha256(trim(regexp_replace(content, '\\s+', ' ', 'g'))), 16) as message_ref, content, n.ts,
  case when n.conv_id % 6 = 0 and n.line > 25 then '/moved' when n.conv_id % 4 <> 0 then concat('/a/', n.sid) end as cwd, m.model from n left join m using (conv_id, line))
"""


@query(_RO + "select source, session_id, message_ref, content, ts, cwd, model from ro", cte="")
def src_rollout_events(spark, sf_dir):
    return _rows(readers.rollouts(rollout_lines(spark, sf_dir)))


@query(_RO + "select session_id, message_ref, ts, model from ro", cte="")
def attach_turn_model(spark, sf_dir):
    return _rows(readers.rollouts(rollout_lines(spark, sf_dir))).select("session_id", "message_ref", "ts", "model")


@query(_RO + "select session_id, message_ref, ts, cwd from ro", cte="")
def attach_session_cwd(spark, sf_dir):
    return _rows(readers.rollouts(rollout_lines(spark, sf_dir))).select("session_id", "message_ref", "ts", "cwd")


# -- patch logs ---------------------------------------------------------------------------------


def patch_lines(spark, sf_dir) -> DataFrame:
    c = _conversations(spark, sf_dir).where("role = 'user'")
    k = F.col("k") % 7
    ref = F.when(k == 2, "null").otherwise(F.concat(F.lit('"q'), "sid", F.lit("-"), F.col("turn").cast("string"), F.lit('"')))
    stamp = F.when(k == 1, '"soon"').when(k == 3, F.concat(F.lit('"'), (F.col("ts") * 1000).cast("string"), F.lit('"'))).otherwise((F.col("ts") * 1000).cast("string"))
    req = F.concat(F.lit('{"requestId":'), ref, F.lit(',"timestamp":'), stamp, F.lit(',"message":{"text":'), F.when(k == 0, '"  "').otherwise(_quoted(F.concat(F.lit(" "), "text"))), F.lit('},"modelId":"mod'), (F.col("k") % 3).cast("string"), F.lit('"}'))
    value = F.when(F.col("turn") < 2, F.concat(F.lit('{"kind":0,"v":{"requests":['), req, F.lit("]}}"))).when(F.col("k") % 3 == 1, F.concat(F.lit('{"kind":1,"k":["x"],"v":['), req, F.lit("]}"))).otherwise(F.concat(F.lit('{"kind":2,"k":["requests"],"v":['), req, F.lit("]}")))
    return c.select(F.concat(F.lit("/ws/chatSessions/"), "sid", F.lit(".jsonl")).alias("file"), F.col("turn").alias("line_no"), value.alias("value"))


_PA = _C + """pa as (select 'copilot' as source, sid as session_id, case when k % 7 = 2 then left(sha256(trim(regexp_replace(concat(' ', text), '\\s+', ' ', 'g'))), 16) else concat('q', sid, '-', turn) end as message_ref,
  concat(' ', text) as content, ts, null::varchar as cwd, concat('mod', k % 3) as model from c where role = 'user' and k % 7 > 1 and k % 7 <> 3 and (turn < 2 or k % 3 <> 1))
"""


@query(_PA + "select source, session_id, message_ref, content, ts, cwd, model from pa", cte="")
def src_patchlog_requests(spark, sf_dir):
    return _rows(readers.patch_logs(patch_lines(spark, sf_dir)))


# -- tables, session lists, exports -----------------------------------------------------------


def chat_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = _conversations(spark, sf_dir)
    messages = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("sid").alias("session_id"), "role", F.when(F.col("k") % 9 == 0, "  ").otherwise(F.col("text")).alias("content"), F.col("ts").cast("double").alias("timestamp"), (F.col("k") % 6 != 0).cast("int").alias("active"), (F.col("k") % 10 == 1).cast("int").alias("compacted"))
    some = c.groupBy("conv_id", "sid").agg(F.min("ts").alias("ts"), F.min_by("text", "turn").alias("first")).where("conv_id % 8 <> 7")
    sessions = some.select(F.col("sid").alias("id"), F.timestamp_seconds("ts").alias("started_at"), F.when(F.col("conv_id") % 3 != 0, F.substring("first", 1, 12)).alias("title"), F.concat(F.lit("/c/"), "sid").alias("cwd"), F.lit(None).cast("string").alias("git_repo_root"), F.lit("hermes-1").alias("model"))
    return messages, sessions


_CH = _C + """ch as (select 'hermes' as source, sid as session_id, cast(conv_id * 100 + turn as varchar) as message_ref, text as content, ts, concat('/c/', sid) as cwd, 'hermes-1' as model from c
  where role = 'user' and k % 9 <> 0 and k % 6 <> 0 and k % 10 <> 1 and conv_id % 8 <> 7)
"""


@query(_CH + "select source, session_id, message_ref, content, ts, cwd, model from ch", cte="")
def src_relational_join(spark, sf_dir):
    return _rows(readers.chat_tables(*chat_tables(spark, sf_dir)))


@query(_C + f"s as (select conv_id, sid, min(ts) as ts, arg_min(text, turn) as t from c group by 1, 2) select sid as id, strftime(to_timestamp(ts) at time zone 'UTC', '%Y-%m-%d') as day, left(t, 12) as title from s where conv_id % 8 <> 7 and conv_id % 3 <> 0 and ts >= {NOW} - 84 * 86400 order by ts desc, sid limit 30", cte="")
def session_titles(spark, sf_dir):
    start = F.timestamp_seconds(F.lit(X.since("12w", NOW)))
    return readers.session_titles(chat_tables(spark, sf_dir)[1], start)


def session_files(spark, sf_dir) -> DataFrame:
    """A file a conversation: entries that repeat or lack a session id, times as text, as a number, or none."""
    c = _conversations(spark, sf_dir)
    message = F.struct("turn", "role", F.when(F.col("k") % 9 == 0, " \n").otherwise(F.col("text")).alias("content"))
    each = c.groupBy("conv_id", "sid").agg(F.min("iso").alias("iso"), F.min("ts").alias("ts"), F.array_sort(F.collect_list(message)).alias("messages"))
    said = F.to_json(F.struct("messages"))
    rest = F.substring(said, F.lit(2), F.length(said))
    name = F.when(F.col("conv_id") % 6 == 1, "").otherwise(F.concat(F.lit('"session_id":"'), "sid", F.lit('",')))
    stamp = F.when(F.col("conv_id") % 5 == 0, '"timestamp":"unknown",').when(F.col("conv_id") % 5 == 1, F.concat(F.lit('"timestamp":'), F.col("ts").cast("string"), F.lit(".5,"))).when(F.col("conv_id") % 5 == 2, "").otherwise(F.concat(F.lit('"timestamp":"'), "iso", F.lit('",')))
    one = F.concat(F.lit("{"), name, stamp, F.lit('"title":"t",'), rest)
    again = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit(","), one)).otherwise("")
    return each.select(F.concat(F.lit("/in/"), "sid", F.lit(".json")).alias("file"), F.concat(F.lit("["), one, F.lit(',7,{"messages":"none"}'), again, F.lit("]")).alias("value"))


_JS = _C + """s0 as (select sid, min(ts) as first_ts from c group by sid),
j0 as (select *, case when conv_id % 6 = 1 then 'import' else c.sid end as session_id, case conv_id % 5 when 0 then 0 when 2 then 0 else first_ts end as began,
  row_number() over (partition by conv_id order by turn) - 1 as nth from c join s0 using (sid) where role = 'user' and k % 9 <> 0),
js as (select 'json-import' as source, session_id, concat(session_id, ':', nth) as message_ref, text as content, began as ts, null::varchar as cwd, null::varchar as model
  from j0 join (values (0), (1)) copies(again) on again = 0 or conv_id % 4 = 0)
"""


@query(_JS + "select source, session_id, message_ref, content, ts, cwd, model from js", cte="")
def src_json_sessions(spark, sf_dir):
    return _rows(readers.json_sessions(readers.route(session_files(spark, sf_dir)).where("kind = 'sessions'")))


def export_files(spark, sf_dir) -> DataFrame:
    c = _conversations(spark, sf_dir)
    parts = F.when(F.col("k") % 4 == 0, F.array(F.concat(F.lit(" "), "text"), F.lit("part two "))).otherwise(F.array("text"))
    kind = F.when(F.col("k") % 6 == 1, "code").otherwise("text")
    message = F.struct(F.struct("role").alias("author"), F.when(F.col("k") % 5 != 0, F.col("ts").cast("double")).alias("create_time"), F.struct(kind.alias("content_type"), parts.alias("parts")).alias("content"), F.struct((F.col("k") % 7 == 3).alias("is_visually_hidden_from_conversation")).alias("metadata"))
    node = F.struct(F.concat(F.lit("n"), F.col("turn").cast("string")).alias("key"), F.struct(message.alias("message")).alias("value"))
    each = c.groupBy("conv_id", "sid").agg(F.map_from_entries(F.array_sort(F.collect_list(node), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))).alias("mapping"), F.min("ts").cast("double").alias("create_time"))
    one = F.struct(F.when(F.col("conv_id") % 2 == 0, F.col("sid")).alias("conversation_id"), F.concat(F.lit("id-"), "sid").alias("id"), F.when(F.col("conv_id") % 3 != 0, F.col("create_time")).alias("create_time"), "mapping")
    return each.select(F.concat(F.lit("/ex/"), "sid").alias("file"), F.concat(F.lit("["), F.to_json(one), F.lit("]")).alias("value"))


_EX = _C + f"""s0 as (select sid, min(ts) as first_ts from c group by sid),
ex as (select 'chatgpt' as source, case when conv_id % 2 = 0 then sid else concat('id-', sid) end as session_id, concat('n', turn) as message_ref, {_STRIP.format("case when k % 4 = 0 then concat(' ', text, chr(10), 'part two ') else text end")} as content,
  case when k % 5 <> 0 then ts when conv_id % 3 <> 0 then first_ts else 0 end as ts, null::varchar as cwd, null::varchar as model from c join s0 using (sid) where role = 'user' and k % 6 <> 1 and k % 7 <> 3)
"""


@query(_EX + "select source, session_id, message_ref, content, ts, cwd, model from ex", cte="")
def src_export_tree(spark, sf_dir):
    return _rows(readers.exports(readers.route(export_files(spark, sf_dir)).where("kind = 'export'")))


_IM = _JS + f""", u0 as (select 'json-import' as source, session_id, concat(session_id, ':', nth) as message_ref, text as content, began * 2 + case when conv_id % 5 = 1 then 1 else 0 end as ts, 2 as kind, concat('/in/', sid, '.json') as file, again, lpad(nth::varchar, 9, '0') as place
    from j0 join (values (0), (1)) copies(again) on again = 0 or conv_id % 4 = 0
  union all select 'chatgpt', case when conv_id % 2 = 0 then sid else concat('id-', sid) end, concat('n', turn), {_STRIP.format("case when k % 4 = 0 then concat(' ', text, chr(10), 'part two ') else text end")},
    2 * case when k % 5 <> 0 then ts when conv_id % 3 <> 0 then first_ts else 0 end, 1, concat('/ex/', sid), 0, concat('n', turn) from c join s0 using (sid) where role = 'user' and k % 6 <> 1 and k % 7 <> 3),
u as (select source, session_id, message_ref, sha256(trim(regexp_replace(content, '\\s+', ' ', 'g'))) as content_hash, ts, row_number() over (order by kind, file, again, place) as ord from u0),
fi as (select unnest(['chatgpt', 'json-import']) as source, count(*) as files from s0 union all select null, count(*) from s0 where sid::bigint % 10 = 0)
"""


@query(_IM + _rounds("u") + "select fi.source, files, coalesce(scanned, 0) as scanned, coalesce(added, 0) as added, coalesce(scanned, 0) - coalesce(added, 0) as deduped from fi left join (select source, count(*) as scanned from u group by source) using (source) left join (select source, count(*) as added from acc group by source) using (source)", cte="")
def import_files(spark, sf_dir):
    """One import of exports, session lists and files that are neither, with first-wins de-duplication."""
    sessions, home = session_files(spark, sf_dir), _scratch(spark)
    torn = sessions.where(F.regexp_extract("file", r"(\d+)", 1).cast("bigint") % 10 == 0).select(F.concat("file", F.lit(".part")).alias("file"), F.expr("substring(value, 2)").alias("value"))
    return imports.import_files(sessions.unionByName(export_files(spark, sf_dir)).unionByName(torn), f"{home}/rows", f"{home}/keys", 0)


LISTS = 16


def list_folder(spark, sf_dir) -> str:
    """Exports as 16 lists of many conversations, with plain values between and at both ends, and two files that are no list."""
    one = export_files(spark, sf_dir).select(F.element_at(F.split("file", "/"), -1).cast("bigint").alias("conv_id"), F.expr("substring(value, 2, length(value) - 2)").alias("value"))
    nameless = F.regexp_replace("value", r'^\{("conversation_id":"\d+",)?"id":"id-\d+"', '{"by":"}],[{"')
    one = one.select((F.col("conv_id") % LISTS).alias("list"), "conv_id", F.concat(F.when(F.col("conv_id") % 5 == 0, nameless).otherwise(F.col("value")), F.when(F.col("conv_id") % 3 == 0, ",[null],").otherwise(",")).alias("value"))
    ends = one.select("list").distinct()
    every = one.unionByName(ends.select("list", F.lit(-1).alias("conv_id"), F.lit('["}",').alias("value"))).unionByName(ends.select("list", F.lit(2**62).alias("conv_id"), F.lit("7]").alias("value")))
    home = _scratch(spark)
    every.repartition(LISTS, "list").sortWithinPartitions("list", "conv_id").drop("conv_id").write.partitionBy("list").text(f"{home}/in")
    odd = spark.createDataFrame([('{"a":[{"mapping":{}}]}',), ('[{"id":"x","mapping":{',)], "value string")
    odd.repartition(2).withColumn("list", F.lit(LISTS)).write.mode("append").partitionBy("list").text(f"{home}/in")
    return f"{home}/in"


_LISTS = _EX.rstrip() + f""", nt as (select conv_id, sum(case when conv_id % 3 = 0 then 2 else 1 end) over (partition by conv_id % {LISTS} order by conv_id) - case when conv_id % 3 = 0 then 1 else 0 end as nth from (select distinct conv_id from c)),
li as (select 'chatgpt' as source, case when e.conv_id % 5 = 0 then concat('conv-', nth) else e.session_id end as session_id, message_ref, content, ts, cwd, model
  from (select *, regexp_extract(session_id, '[0-9]+')::bigint as conv_id from ex) e join nt using (conv_id))
"""


@query(_LISTS + "select source, session_id, message_ref, content, ts, cwd, model from li", cte="")
def src_export_lists(spark, sf_dir):
    """Large lists read in blocks; conversations without an id are named by their place in the list."""
    return _rows(readers.export_items(readers.list_items(spark, f"{list_folder(spark, sf_dir)}/*")))


def _sources(spark, sf_dir) -> tuple[DataFrame, dict[str, str]]:
    return readers.union_sources(
        [
            ("claude-code", lambda: readers.transcripts(transcript_lines(spark, sf_dir))),
            ("copilot", lambda: readers.patch_logs(patch_lines(spark, sf_dir))),
            ("hermes", lambda: readers.chat_tables(*chat_tables(spark, sf_dir))),
            ("chatgpt", lambda: spark.read.parquet(f"{sf_dir}/no-such-export")),
        ]
    )


def _union(spark, sf_dir) -> DataFrame:
    found, failed = _sources(spark, sf_dir)
    assert set(failed) == {"chatgpt"}
    return found


_PARTS = [_TR, _PA.replace(_C, ", "), _CH.replace(_C, ", ")]
_UN = "".join(_PARTS) + ", un as (select * from tr union all by name select * from pa union all by name select * from ch)\n"


@query(_UN + "select source, session_id, message_ref, ts from un", cte="")
def union_sources(spark, sf_dir):
    return _rows(_union(spark, sf_dir)).select("source", "session_id", "message_ref", "ts")


@query(_UN + ", i as (select source, count(distinct session_id) as sessions, count(*) as prompts from un group by source) select source, prompts is not null as available, coalesce(sessions, 0) as sessions, coalesce(prompts, 0) as prompts from (select unnest(['hermes', 'claude-code', 'copilot', 'codex', 'chatgpt', 'json-import']) as source) left join i using (source)", cte="")
def source_inventory(spark, sf_dir):
    return readers.inventory(_union(spark, sf_dir), list(SOURCES))


_STATES = _UN + """, i as (select source, count(*) as prompts from un group by source),
st as (select source, coalesce(prompts, 0) as prompts, case when source = 'chatgpt' then 'failed' when prompts is not null then 'read' else 'absent' end as state from (select unnest(['hermes', 'claude-code', 'copilot', 'codex', 'chatgpt', 'json-import']) as source) left join i using (source))
"""


def _states(spark, sf_dir) -> DataFrame:
    found, failed = _sources(spark, sf_dir)
    return readers.states(found, list(SOURCES), failed)


@query(_STATES + "select source, state, prompts, case when state = 'failed' then 'PATH_NOT_FOUND' end as reason from st", cte="")
def source_states(spark, sf_dir):
    """One source has no file: it is failed, with its reason, and the others go on."""
    out = _states(spark, sf_dir)
    return out.select("source", "state", "prompts", F.regexp_extract("reason", r"^\[(\w+)", 1).alias("reason"))


@query(_STATES + "select count(*) filter (where prompts > 0) as sources, count(*) filter (where state = 'failed') as stale from st", cte="")
def source_health(spark, sf_dir):
    return readers.health(_states(spark, sf_dir))


@query(_UN + """, i as (select source, count(*) as n from un where source <> 'copilot' group by source)
select source, case when n is null then 'failed' else 'read' end as state, coalesce(n, 0) as scanned, coalesce(n, 0) as landed from (select unnest(['claude-code', 'copilot', 'hermes', 'chatgpt']) as source) left join i using (source)""", cte="")
def source_quarantine(spark, sf_dir):
    """Four sources written by jobs of their own: one has no file, one breaks while it runs; the others land and are counted."""
    broken = lambda: readers.patch_logs(patch_lines(spark, sf_dir)).withColumn("content", F.when(F.length("message_ref") > 0, F.raise_error(F.lit("torn record"))).otherwise(F.col("content")))
    path = f"{ingest.shared_folder(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    sources = [("claude-code", lambda: readers.transcripts(transcript_lines(spark, sf_dir))), ("copilot", broken), ("hermes", lambda: readers.chat_tables(*chat_tables(spark, sf_dir))), ("chatgpt", lambda: spark.read.parquet(f"{sf_dir}/no-such-export"))]
    states = readers.land(spark, sources, path)
    landed = spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("landed"))
    return states.join(landed, "source", "left").select("source", "state", "scanned", F.coalesce("landed", F.lit(0)).alias("landed"))


@query(_UN + """, u0 as (select *, sha256(trim(regexp_replace(content, '\\s+', ' ', 'g'))) as content_hash, case source when 'claude-code' then 0 else 1 end as place from un where source <> 'copilot'),
u as (select source, session_id, message_ref, content_hash, ts, row_number() over (order by place, ts, session_id, message_ref) as ord from u0)
""" + _rounds("u") + """, sc as (select source, count(*) as scanned from u group by source), ad as (select source, count(*) as added from acc group by source)
select source, case when scanned is null then 'failed' else 'read' end as state, coalesce(scanned, 0) as scanned, coalesce(added, 0) as added, coalesce(scanned, 0) - coalesce(added, 0) as deduped,
  case source when 'copilot' then 'torn record' when 'chatgpt' then 'PATH_NOT_FOUND' end as reason from (select unnest(['claude-code', 'copilot', 'hermes', 'chatgpt']) as source) left join sc using (source) left join ad using (source)""", cte="")
def ingest_sources(spark, sf_dir):
    """One sync of four sources: two fail, one of them while it runs, and are named in the counters; the others are appended."""
    broken = lambda: readers.patch_logs(patch_lines(spark, sf_dir)).withColumn("content", F.when(F.length("message_ref") > 0, F.raise_error(F.lit("torn record"))).otherwise(F.col("content")))
    home = _scratch(spark)
    sources = [("claude-code", lambda: readers.transcripts(transcript_lines(spark, sf_dir))), ("copilot", broken), ("hermes", lambda: readers.chat_tables(*chat_tables(spark, sf_dir))), ("chatgpt", lambda: spark.read.parquet(f"{sf_dir}/no-such-export"))]
    told = imports.import_sources(spark, sources, f"{home}/landed", f"{home}/rows", f"{home}/keys", 0)
    return told.withColumn("reason", F.nullif(F.regexp_extract("reason", "(torn record|PATH_NOT_FOUND)", 1), F.lit("")))


_TITLE_CELLS = f"""select 'titles' as section, concat(day, ' ', title) as "row", 'sessions' as col, count(*)::double as value from ({ORACLES['session_titles']}) group by 2"""
_MORE_CELLS = """select 'skipped' as section, 'chatgpt' as "row", 'failed' as col, 1.0::double as value union all select 'model', 'available', 'model', 1.0"""


@query(_all_cells([*_COUNT_CELLS, _STYLE_CELLS, _RUBRIC_CELLS, _FIT_CELLS, _PATTERN_CELLS, _TITLE_CELLS, _MORE_CELLS]), cte="")
def report_sections(spark, sf_dir):
    """All sections of the report: with patterns, titles, the sources that failed and whether a model was there."""
    frames = reports.report_since(prompts(spark, sf_dir), F.timestamp_seconds(F.lit(0)), infer.merge_patterns(_digests(spark, sf_dir)), session_titles(spark, sf_dir), _states(spark, sf_dir))
    return reports.cells(frames).withColumn("value", F.round("value", 9))


@query("""select 'state' as section, case when count(*) = 0 then 'empty table' else 'quiet window' end as "row", unnest(['all_rows', 'window_rows']) as col, unnest([count(*), 0])::double as value from p""")
def report_quiet(spark, sf_dir):
    """The report of a window without prompts is one frame. It begins after all of them (in 2242)."""
    return reports.cells(reports.report_since(prompts(spark, sf_dir), F.timestamp_seconds(F.lit(2**33))))


# -- de-duplication and incremental state -------------------------------------------------------

_KEYED = """, u as (select source, session_id, message_ref, content_hash, ts, k * 4 as ord from p
  union all select source, concat('f', session_id), message_ref, content_hash, ts, k * 4 + case when k % 2 = 0 then 1 else -2 end from p where k % 3 = 0
  union all select source, session_id, message_ref, concat('x', content_hash), ts + 1, k * 4 + case when k % 4 = 0 then 2 else -3 end from p where k % 5 = 0
  union all select source, concat('f', session_id), message_ref, concat('x', content_hash), ts + 1, k * 4 + 3 from p where k % 2 = 0)
"""


def _batch(spark, sf_dir) -> DataFrame:
    """The relation with forks (same text and time, other session), re-sent rows (same reference) and rows that are both."""
    p = prompts(spark, sf_dir).select("source", "session_id", "message_ref", "content_hash", "timestamp", "k", (F.col("k") * 4).alias("ord"))
    fork = F.concat(F.lit("f"), "session_id")
    again = {"content_hash": F.concat(F.lit("x"), "content_hash"), "timestamp": F.timestamp_seconds(F.unix_seconds("timestamp") + 1)}
    a = p.where("k % 3 = 0").withColumns({"session_id": fork, "ord": F.col("ord") + F.when(F.col("k") % 2 == 0, 1).otherwise(-2)})
    b = p.where("k % 5 = 0").withColumns(again | {"ord": F.col("ord") + F.when(F.col("k") % 4 == 0, 2).otherwise(-3)})
    c = p.where("k % 2 = 0").withColumns(again | {"session_id": fork, "ord": F.col("ord") + 3})
    return p.unionByName(a).unionByName(b).unionByName(c).drop("k")


@query(_KEYED + _rounds("u") + "select source, session_id, message_ref, ord from acc")
def dedupe_two_key(spark, sf_dir):
    return ingest.dedupe_two_key(_batch(spark, sf_dir), "ord").select("source", "session_id", "message_ref", "ord")


@query(_KEYED + "select source, session_id, message_ref, ord from u qualify row_number() over (partition by content_hash, ts order by ord) = 1")
def dedupe_fork(spark, sf_dir):
    return ingest.dedupe_fork(_batch(spark, sf_dir), F.col("ord")).select("source", "session_id", "message_ref", "ord")


_NEW = """, tg as (select * from u where ord % 3 = 0),
nw as (select u.* from u where not exists (select 1 from tg w where w.source = u.source and w.session_id = u.session_id and w.message_ref = u.message_ref) and not exists (select 1 from tg w where w.content_hash = u.content_hash and w.ts = u.ts))
"""


@query(_KEYED + _NEW + _rounds("nw") + "select source, session_id, message_ref, ord from acc")
def ingest_insert_ignore(spark, sf_dir):
    batch = ingest.cut(_batch(spark, sf_dir))
    return ingest.insert_ignore(batch.where("ord % 3 = 0"), batch, "ord").select("source", "session_id", "message_ref", "ord")


@query(_KEYED + "select source, count(*) as scanned, 0 as added, count(*) as deduped from u group by source")
def ingest_idempotent(spark, sf_dir):
    batch = ingest.cut(_batch(spark, sf_dir))
    table = ingest.cut(ingest.dedupe_two_key(batch, "ord"))
    return ingest.ingest_stats(batch, ingest.insert_ignore(table, batch, "ord"))


@query(_KEYED + _rounds("u") + "select source, scanned, coalesce(added, 0) as added, scanned - coalesce(added, 0) as deduped from (select source, count(*) as scanned from u group by source) left join (select source, count(*) as added from acc group by source) using (source)")
def ingest_stats(spark, sf_dir):
    batch = ingest.cut(_batch(spark, sf_dir))
    return ingest.ingest_stats(batch, ingest.dedupe_two_key(batch, "ord"))


_PART = "least(2, greatest(0, floor(ord * 3.0 / (select max(ord) + 1 from u))))::bigint"


def _parts(batch: DataFrame) -> DataFrame:
    """The batch dealt to three parts in its order."""
    top = batch.agg(F.max("ord") + 1).first()[0]
    return batch.withColumn("part", F.least(F.lit(2), F.greatest(F.lit(0), F.floor(F.col("ord") * 3.0 / F.lit(top)))).cast("bigint"))


@query(_KEYED + _rounds("u") + f", sc as (select source, {_PART} as part, count(*) as scanned from u group by all), ad as (select source, {_PART} as part, count(*) as added from acc group by all) select source, part, scanned, coalesce(added, 0) as added, scanned - coalesce(added, 0) as deduped from sc left join ad using (source, part)")
def ingest_append(spark, sf_dir):
    """Three batches, each appended to a table by source where its keys are new in the key folders of the batches before."""
    home, batch = _scratch(spark), ingest.cut(_parts(_batch(spark, sf_dir)))
    told = [ingest.append_batch(batch.where(F.col("part") == i).drop("part"), f"{home}/rows", f"{home}/keys", i, "ord").withColumn("part", F.lit(i)) for i in range(3)]
    return reduce(DataFrame.unionByName, told).select("source", "part", "scanned", "added", "deduped")


@query(_KEYED + _rounds("u") + "select source, session_id, message_ref, content_hash, ts from acc")
def ingest_merged_keys(spark, sf_dir):
    """Three appended batches with the key folders merged after each; the last is then repeated, as after a failure."""
    home, batch = _scratch(spark), ingest.cut(_parts(_batch(spark, sf_dir)))
    for i in (0, 1, 2, 2):
        ingest.merge_keys(spark, f"{home}/keys", i)
        ingest.append_batch(batch.where(F.col("part") == i).drop("part"), f"{home}/rows", f"{home}/keys", i, "ord")
    return spark.read.parquet(f"{home}/rows").select("source", "session_id", "message_ref", "content_hash", F.unix_seconds("timestamp").alias("ts"))


_FILES = ", fl as (select concat('/f/', session_id) as path, max(ts) as mtime, sum(n)::bigint as size from p group by session_id)\n"


def _listing(spark, sf_dir) -> DataFrame:
    return prompts(spark, sf_dir).groupBy("session_id").agg(F.max(F.unix_seconds("timestamp")).alias("mtime"), F.sum(F.length("content")).cast("bigint").alias("size")).select(F.concat(F.lit("/f/"), "session_id").alias("path"), "mtime", "size")


def _manifest(listing: DataFrame) -> DataFrame:
    """An older state: some files unknown, some grown, some touched since."""
    old = listing.where("mtime % 5 <> 0")
    return old.select("path", F.when(F.col("mtime") % 5 == 1, F.col("mtime") - 7).otherwise(F.col("mtime")).alias("mtime"), F.when(F.col("mtime") % 5 == 2, F.col("size") - 1).otherwise(F.col("size")).alias("size"), F.lit(1).alias("run_ts"))


@query(_FILES + "select path, mtime, size from fl where mtime % 5 < 3")
def manifest_changed_files(spark, sf_dir):
    listing = _listing(spark, sf_dir)
    return ingest.changed_files(listing, _manifest(listing))


@query(_FILES + "select path, mtime - case when mtime % 5 = 1 then 7 else 0 end as mtime, size - case when mtime % 5 = 2 then 1 else 0 end as size, 1 as run_ts from fl where mtime % 5 <> 0 and mtime % 2 = 0 union all select path, mtime, size, 2 from fl where mtime % 2 = 1")
def manifest_merge(spark, sf_dir):
    listing = _listing(spark, sf_dir)
    return ingest.merge_manifest(_manifest(listing), listing.where("mtime % 2 = 1").withColumn("run_ts", F.lit(2)))


def _marks(p: DataFrame) -> DataFrame:
    """High marks ten days before each source's last row; one source has none yet."""
    return ingest.cut(p.where("source <> 'codex'").groupBy("source").agg(F.max("timestamp").alias("t")).select("source", F.timestamp_seconds(F.unix_seconds("t") - 864000).alias("high_ts")))


_HIGH = ", h as (select source, max(ts) - 864000 as high from p where source <> 'codex' group by source) "


@query(_HIGH + "select p.source, count(*) filter (where ts < high) as late from p left join h using (source) group by p.source")
def watermark_late(spark, sf_dir):
    p = prompts(spark, sf_dir)
    return ingest.late_counts(p, _marks(p))


@query(_FILES + _HIGH + "select 'files' as state, count(*) as forced, count(*) filter (where mtime % 5 < 3) as plain from fl union all select 'marks', count(*), count(*) filter (where high is null or ts >= high) from p left join h using (source)")
def force_refresh(spark, sf_dir):
    """What a forced run reads, against a plain one, under both kinds of state."""
    p, listing = prompts(spark, sf_dir), _listing(spark, sf_dir)
    old, marks = _manifest(listing), _marks(p)
    read = {"files": lambda force: ingest.changed_files(listing, old, force), "marks": lambda force: ingest.watermark_increment(p, marks, force)}
    sides = [f(force).select(F.lit(state).alias("state"), F.lit(force).alias("force")) for state, f in read.items() for force in (True, False)]
    return reduce(DataFrame.unionByName, sides).groupBy("state").agg(F.count_if("force").alias("forced"), F.count_if(~F.col("force")).alias("plain"))


@query(_HIGH + "select p.source, message_ref, ts from p left join h using (source) where high is null or ts >= high")
def watermark_increment(spark, sf_dir):
    p = prompts(spark, sf_dir)
    return ingest.watermark_increment(p, _marks(p)).select("source", "message_ref", F.unix_seconds("timestamp").alias("ts"))


@query(", e as (select content_hash as key, ts as created_at, concat('v', n) as payload from p union all select content_hash, ts + 5, concat('w', n) from p where k % 2 = 0) select key, arg_max(payload, (created_at, payload)) as payload, max(created_at) as created_at from e group by key")
def memo_latest(spark, sf_dir):
    p = prompts(spark, sf_dir).select(F.col("content_hash").alias("key"), F.unix_seconds("timestamp").alias("created_at"), F.length("content").cast("string").alias("n"), "k")
    first = p.select("key", "created_at", F.concat(F.lit("v"), "n").alias("payload"))
    second = p.where("k % 2 = 0").select("key", (F.col("created_at") + 5).alias("created_at"), F.concat(F.lit("w"), "n").alias("payload"))
    return ingest.memo_latest(first.unionByName(second))


@query("select message_ref, case when source <> 'hermes' then model end as model from p")
def schema_evolve_union(spark, sf_dir):
    p = prompts(spark, sf_dir).select("source", "message_ref", "model")
    return ingest.evolve(p.where("source = 'hermes'").drop("model"), p.where("source <> 'hermes'")).select("message_ref", "model")


# -- streams ------------------------------------------------------------------------------------


def _scratch(spark) -> str:
    return f"{ingest.shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return streams.read_prompts(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("select event_type, count(*) as n, sum(event_id)::bigint as ids from events group by event_type", cte="")
def stream_ingest(spark, sf_dir):
    home = _scratch(spark)
    streams.run_once(_events(spark, sf_dir).select("event_id", "event_type"), f"{home}/out", f"{home}/state")
    return spark.read.parquet(f"{home}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("select distinct user_id, event_type from events", cte="")
def stream_dedupe(spark, sf_dir):
    home = _scratch(spark)
    out = streams.dedupe(_events(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "3650 days")
    streams.run_once(out.select("user_id", "event_type"), f"{home}/out", f"{home}/state")
    return spark.read.parquet(f"{home}/out")


@query(_KEYED + _rounds("u") + "select source, session_id, message_ref, ord from acc")
def stream_two_key(spark, sf_dir):
    """Exact two-key ingest of a stream in three micro-batches; equal to the rule applied to all rows in order."""
    home, batch = _scratch(spark), ingest.cut(_parts(_batch(spark, sf_dir)))
    for i in range(3):
        batch.where(F.col("part") == i).coalesce(1).write.mode("append").parquet(f"{home}/in")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    streams.ingest_stream(stream.drop("part"), f"{home}/rows", f"{home}/state", "ord")
    return spark.read.parquet(f"{home}/rows").select("source", "session_id", "message_ref", "ord")


def _complete(spark, df: DataFrame) -> DataFrame:
    home = _scratch(spark)
    streams.run_complete(df, f"{home}/out", f"{home}/state")
    return spark.read.parquet(f"{home}/out")


@query("select event_type, epoch(date_trunc('week', ts))::bigint as week, count(*) as n from events group by 1, 2", cte="")
def stream_weekly(spark, sf_dir):
    out = _complete(spark, streams.weekly(_events(spark, sf_dir), "event_type", "ts", "1 day"))
    return out.select("event_type", F.unix_seconds("week").alias("week"), "n")


@query("select epoch(date_trunc('day', ts))::bigint as day, count(*) as n from events group by 1", cte="")
def stream_late_counts(spark, sf_dir):
    out = _complete(spark, streams.late_counts(_events(spark, sf_dir), "ts", "1 day"))
    return out.select(F.unix_seconds("day").alias("day"), "n")


@query("""with e as (select *, event_id % 3 as part from events), b as (select part, max(ts) as high from e group by part),
h as (select e.*, (select max(high) from b where b.part < e.part) as held from e)
select part, event_type, count(*) filter (where coalesce(ts < held - interval 1 day, false)) as late, count(*) filter (where not coalesce(ts < held - interval 1 day, false)) as kept, coalesce(sum(event_id) filter (where ts < held - interval 1 day), 0)::bigint as late_ids from h group by part, event_type""", cte="")
def stream_late_rows(spark, sf_dir):
    """Events in three micro-batches that each span the whole time: rows before the held mark are late, and are kept aside."""
    home = _scratch(spark)
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("event_id") % 3).alias("part"))
    for i in range(3):
        t.where(F.col("part") == i).coalesce(1).write.mode("append").parquet(f"{home}/in")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    streams.split_late(stream, "ts", "1 day", f"{home}/out", f"{home}/state")
    side = lambda name: spark.read.parquet(f"{home}/out/{name}").select("part", "event_type", "event_id", F.lit(name == "late").alias("late"))
    both = side("late").unionByName(side("rows"))
    return both.groupBy("part", "event_type").agg(F.count_if("late").alias("late"), F.count_if(~F.col("late")).alias("kept"), F.coalesce(F.sum(F.when(F.col("late"), F.col("event_id"))), F.lit(0)).alias("late_ids"))


@query("select cast(user_id as varchar) as session_id, arg_min(event_id, (ts, event_id)) as event_id, arg_min(case when event_type = 'error' then 'shape' else 'scope' end, (ts, event_id)) as kind from events where event_type in ('error', 'signup') group by user_id", cte="")
def trigger_session_gate(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "shape").when(F.col("event_type") == "signup", "scope")
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session_id"), "event_id", "ts", kind.alias("kind"))
    home = _scratch(spark)
    streams.run_once(streams.session_gate(rows), f"{home}/out", f"{home}/state")
    return spark.read.parquet(f"{home}/out").select("session_id", "event_id", "kind")


@query(f", g as (select session_id, message_ref, {_KIND} as kind, ts from p) select session_id, message_ref, kind from g where kind is not null qualify row_number() over (partition by session_id order by ts, message_ref) = 1")
def session_gate_batch(spark, sf_dir):
    return triggers.session_gate(prompts(spark, sf_dir), ["timestamp", "message_ref"]).select("session_id", "message_ref", "kind")
