"""Registered queries of the prompt operators, each with its DuckDB twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..functions import text as X
from ..operators import docs as D
from ..operators import fit, index, infer, ingest, metrics, rubric, search, triggers
from ..schema import SOURCES
from . import reports
from .testview import HOME, NOW, P_SQL, hit, prompts, re2

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, cte: str = P_SQL):
    """Registers a query under its function's name; sql follows the relation's CTE."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = cte + sql
        return f

    return add


def ts(column: str = "timestamp", name: str = "ts"):
    return F.unix_seconds(column).alias(name)


# -- scans and filters -----------------------------------------------------------------


@query("select source, session_id, message_ref, content_hash, ts, origin, cwd, model from p")
def scan_prompts(spark, sf_dir):
    return prompts(spark, sf_dir).select("source", "session_id", "message_ref", "content_hash", ts(), "origin", "cwd", "model")


@query(f"select source, message_ref, ts from p where ts >= {NOW} - 28 * 86400")
def filter_since(spark, sf_dir):
    start = X.since("4w", NOW)
    return prompts(spark, sf_dir).where(F.col("timestamp") >= F.timestamp_seconds(F.lit(start))).select("source", "message_ref", ts())


@query("select source, message_ref, origin from p where origin = 'machine'")
def filter_origin(spark, sf_dir):
    return prompts(spark, sf_dir).where("origin = 'machine'").select("source", "message_ref", "origin")


@query("select source, message_ref from p where source = 'codex'")
def filter_source(spark, sf_dir):
    return prompts(spark, sf_dir).where("source = 'codex'").select("source", "message_ref")


@query("select source, session_id, message_ref, ts from p order by ts, source, session_id, message_ref limit 50")
def limit_oldest(spark, sf_dir):
    return prompts(spark, sf_dir).orderBy("timestamp", "source", "session_id", "message_ref").limit(50).select("source", "session_id", "message_ref", ts())


@query("select message_ref, n from p where n >= 40")
def filter_substantive(spark, sf_dir):
    return rubric.substantive(prompts(spark, sf_dir)).select("message_ref", F.length("content").alias("n"))


@query("select message_ref, source from p where source in ('codex', 'hermes')")
def filter_enabled_sources(spark, sf_dir):
    from ..sources import readers

    return readers.enabled(prompts(spark, sf_dir), ["codex", "hermes"], SOURCES).select("message_ref", "source")


@query(f"select count(*) as all_rows, count(*) filter (where ts >= {NOW + 1}) as window_rows, case when count(*) = 0 then 'empty table' when count(*) filter (where ts >= {NOW + 1}) = 0 then 'quiet window' else 'ok' end as state from p")
def empty_state(spark, sf_dir):
    return metrics.empty_state(prompts(spark, sf_dir), F.timestamp_seconds(F.lit(NOW + 1)))


# -- text functions ----------------------------------------------------------------------


@query("""select message_ref, case k % 4 when 0 then content when 1 then concat(content, chr(10), 'tail') when 2 then '' end as flat from p""")
def norm_content_blocks(spark, sf_dir):
    p = prompts(spark, sf_dir)
    text = F.to_json(F.struct(F.col("content").alias("c")))
    quoted = F.expr("substring(j, 6, length(j) - 6)")
    p = p.withColumn("j", text).withColumn("q", quoted)
    blocks = F.concat(F.lit('[{"type":"text","text":'), "q", F.lit('},{"type":"image","text":"no"},{"type":"text","text":""},{"type":"text","text":"tail"}]'))
    raw = F.when(F.col("k") % 4 == 0, F.col("q")).when(F.col("k") % 4 == 1, blocks).when(F.col("k") % 4 == 2, F.lit('[{"type":"image"}]')).otherwise(F.lit("5"))
    return p.select("message_ref", X.flatten_content(raw).alias("flat"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"""select message_ref, case k % 3 when 1 then null else nullif({_STRIP.format('content')}, '') end as kept from p""")
def norm_strip_reminders(spark, sf_dir):
    note = F.lit("<system-reminder>one\ntwo</system-reminder>")
    raw = F.when(F.col("k") % 3 == 0, F.concat(note, F.lit(" \n"), "content", note)).when(F.col("k") % 3 == 1, F.concat(note, F.lit(" "))).otherwise(F.col("content"))
    return prompts(spark, sf_dir).select("message_ref", X.strip_reminders(raw).alias("kept"))


@query("select message_ref, k % 5 < 3 as echo from p")
def norm_reject_markers(spark, sf_dir):
    mark = F.when(F.col("k") % 5 < 3, F.element_at(F.array(*map(F.lit, X.ECHO_MARKS)), (F.col("k") % 5 + 1).cast("int"))).otherwise("")
    return prompts(spark, sf_dir).select("message_ref", X.echoes_command(F.concat("content", mark)).alias("echo"))


@query(f"select message_ref, {_STRIP.format('content')} as request from p")
def norm_ide_wrapper(spark, sf_dir):
    head = F.when(F.col("k") % 2 == 0, F.lit("# Context\nopen files\n\n## my request for Codex:  \n")).otherwise("")
    return prompts(spark, sf_dir).select("message_ref", X.ide_request(F.concat(head, "content")).alias("request"))


@query("select message_ref, case k % 4 when 1 then ts - 7200 when 3 then null else ts end as ts from p")
def norm_timestamps(spark, sf_dir):
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+02:00"), F.lit(""), F.lit(" nonsense")), (F.col("k") % 4 + 1).cast("int"))
    return prompts(spark, sf_dir).select("message_ref", F.unix_seconds(X.parse_time(F.concat(iso, zone))).alias("ts"))


@query("select message_ref, content_hash from p")
def content_hash(spark, sf_dir):
    return prompts(spark, sf_dir).select("message_ref", X.content_hash("content").alias("content_hash"))


@query("select message_ref, origin from p")
def classify_origin(spark, sf_dir):
    return prompts(spark, sf_dir).select("message_ref", X.origin("content").alias("origin"))


@query("select message_ref, origin = 'machine' or k % 4 = 0 as machine from p")
def classify_machine_event(spark, sf_dir):
    text = F.when(F.col("k") % 4 == 0, F.concat(F.lit(" <bash-input> "), "content")).otherwise(F.col("content"))
    return prompts(spark, sf_dir).select("message_ref", X.machine_event(text).alias("machine"))


@query("select message_ref, n / 4.0::double as tokens from p")
def token_estimate(spark, sf_dir):
    return prompts(spark, sf_dir).select("message_ref", X.token_estimate().alias("tokens"))


@query("select message_ref, " + ", ".join(f"{hit(c)} as {c}" for c in ("example", "constraint", "structured")).replace(" as constraint", ' as "constraint"') + " from p")
def cue_flags(spark, sf_dir):
    return prompts(spark, sf_dir).select("message_ref", *(X.has(c).alias(c) for c in ("example", "constraint", "structured")))


@query("select message_ref, " + ", ".join(f"{hit(c)} as {c}" for c in ("heading_list", "fence_tag", "verify", "self_check", "reasoning", "sampling", "contract")) + " from p")
def rubric_flags(spark, sf_dir):
    return prompts(spark, sf_dir).select("message_ref", *rubric.flag_columns())


_TAIL = "right(content, greatest(200, n // 5))"


@query(f"select message_ref, {_TAIL} as tail from p")
def rubric_a11_tail(spark, sf_dir):
    return prompts(spark, sf_dir).select("message_ref", X.tail("content").alias("tail"))


_LONG = f"(n >= 200 and not ({hit('example')} or {hit('structured')}))"
_VAGUE = f"(n < 200 and {hit('broad_scope')} and not {hit('constraint')})"
_KIND = f"case when origin = 'machine' or {hit('harness')} then null when {_LONG} then 'shape' when {_VAGUE} then 'scope' end"


@query(f"select message_ref, {hit('broad_scope')} as broad, {_LONG} as long_unstructured, {_VAGUE} as short_vague from p")
def trigger_flags(spark, sf_dir):
    return prompts(spark, sf_dir).select("message_ref", X.has("broad_scope").alias("broad"), triggers.long_unstructured().alias("long_unstructured"), triggers.short_vague().alias("short_vague"))


@query(f"select message_ref, {_KIND} as kind from p")
def trigger_kind(spark, sf_dir):
    return prompts(spark, sf_dir).select("message_ref", triggers.trigger_kind().alias("kind"))


_BAND = "case when s is null then 'n/a' when s >= 0.7 then 'good' when s >= 0.4 then 'fair' else 'weak' end"
_SCORED = "(select message_ref, case when k % 7 = 0 then null else (n % 101) / 100.0::double end as s, k % 5 as c from p)"


def _scored(spark, sf_dir):
    return prompts(spark, sf_dir).select("message_ref", F.when(F.col("k") % 7 != 0, F.length("content") % 101 / F.lit(100.0)).alias("s"), (F.col("k") % 5).alias("c"))


@query(f"select message_ref, {_BAND} as band from {_SCORED}")
def score_band(spark, sf_dir):
    return _scored(spark, sf_dir).select("message_ref", X.score_band("s").alias("band"))


@query(f"select message_ref, case when s is null then 'n/a' else concat(printf('%.2f', s), ' ', {_BAND}, case when c > 0 and c < 3 then ' (low n)' else '' end) end as label from {_SCORED}")
def score_label(spark, sf_dir):
    return _scored(spark, sf_dir).select("message_ref", X.score_label("s", "c").alias("label"))


def _tier(m: str = "model") -> str:
    size = f"try_cast(nullif(regexp_extract(lower({m}), {re2('model_size')}, 1), '') as int)"
    return f"case when {m} is null or lower({m}) in ('', 'copilot/auto') then null when contains(lower({m}), 'haiku') then 'small' when contains(lower({m}), 'sonnet') then 'medium' when contains(lower({m}), 'opus') then 'large' when {size} <= 9 then 'small' when {size} <= 39 then 'medium' when {size} is not null then 'large' end"


_DEMAND = "case when n < 200 then 'low' when n >= 1200 then 'high' else 'medium' end"


@query(f"select message_ref, {_tier()} as tier from p")
def model_tier(spark, sf_dir):
    return prompts(spark, sf_dir).select("message_ref", X.model_tier().alias("tier"))


@query(f"select message_ref, {_DEMAND} as demand from p")
def demand_tier(spark, sf_dir):
    return prompts(spark, sf_dir).select("message_ref", X.demand_tier().alias("demand"))


@query("select message_ref, case when length(f) > 200 then concat(left(f, 200), '...') else f end as snippet from (select message_ref, trim(regexp_replace(content, '\\s+', ' ', 'g')) as f from p)")
def search_snippets(spark, sf_dir):
    return prompts(spark, sf_dir).select("message_ref", X.snippet("content").alias("snippet"))


@query("""select message_ref, case k % 4 when 0 then concat('{"a":', n, '}') when 1 then concat('{"b":', n, '}') else null end as found from p""")
def extract_json(spark, sf_dir):
    n = F.length("content").cast("string")
    said = F.when(F.col("k") % 4 == 0, F.concat(F.lit('So:\n```json\n{"a":'), n, F.lit("}\n```\ndone {x}"))).when(F.col("k") % 4 == 1, F.concat(F.lit('I say {"b":'), n, F.lit("} and stop"))).when(F.col("k") % 4 == 2, F.lit("{no json}")).otherwise("none")
    return prompts(spark, sf_dir).select("message_ref", X.json_object(said).alias("found"))


@query("select message_ref, case k % 2 when 0 then ['one', 'two', 'six', 'seven', 'eight'] else ['only'] end as items from p")
def pattern_items(spark, sf_dir):
    raw = F.when(F.col("k") % 2 == 0, F.lit('["one",{"pattern":"two","n":2},3,true,["x"],"six","seven","eight","nine"]')).otherwise(F.lit('[{"other":1},"only"]'))
    return prompts(spark, sf_dir).select("message_ref", infer.pattern_items(raw).alias("items"))


@query("""select message_ref, unnest([1, 2, 3]) as rank, unnest(['b', 'a', 'c']) as topic, unnest([1.0::double, (n % 101) / 100.0::double, 0.0::double]) as share from p where n % 101 between 1 and 99""")
def topic_shares(spark, sf_dir):
    share = (F.length("content") % 101 / F.lit(100.0)).cast("string")
    raw = F.concat(F.lit('[{"topic":"a","share":'), share, F.lit('},{"topic":"b","share":7},{"topic":"c","share":"much"}]'))
    rows = prompts(spark, sf_dir).where((F.length("content") % 101).between(1, 99)).select("message_ref", raw.alias("raw"))
    return infer.topic_shares(rows, "message_ref", "raw")


# -- project documents -----------------------------------------------------------------------

_DOCS = """(select doc_id, concat('/home/u/p', doc_id % 13) as dir, case doc_id % 3 when 0 then 'CLAUDE.md' when 1 then 'AGENTS.md' else 'notes.md' end as name,
  case when doc_id % 5 = 0 then 'Please see AGENTS.md for all of it.' when doc_id % 4 = 0 then concat('# Title', chr(10), '- one', chr(10), '2. two', chr(10), coalesce(text, '')) else coalesce(text, '') end as text,
  case when doc_id % 6 = 0 then null else {NOW} - (doc_id % 200) * 86400 end as last from documents)"""


def _documents(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = spark.sql("select * from " + _DOCS.format(NOW=NOW).replace("documents", "{documents}"), documents=t)
    return rows.withColumn("last_commit", F.timestamp_seconds("last")).withColumn("stale_days", X.staleness_days("last_commit", F.timestamp_seconds(F.lit(NOW))))


_WORDS = "case when regexp_matches(text, '\\S') then len(regexp_extract_all(text, '\\S+')) else 0 end"
_HEADS, _ITEMS = (f"len(regexp_extract_all(text, {re2(x)}))" for x in ("doc_heading", "doc_list"))
_STUB = f"({_WORDS} <= 30 and (contains(text, 'CLAUDE.md') or contains(text, 'AGENTS.md') or contains(text, 'README.md')))"
_STALE = f"case when last is not null then greatest({NOW} - last, 0) / 86400.0::double end"
_FLAGS = f"list_filter([case when not {_STUB} and {_WORDS} < 150 then 'sparse' end, case when not {_STUB} and {_WORDS} >= 150 and {_HEADS} = 0 and {_ITEMS} = 0 then 'unstructured' end, case when {_STALE} > 90 then 'stale' end], lambda x: x is not null)"
_D = "with d as (select * from " + _DOCS.format(NOW=NOW) + ") "


@query(f"select doc_id, {_WORDS} as words, {_HEADS} as headings, {_ITEMS} as items from d", cte=_D)
def doc_measures(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.word_count("text").alias("words"), X.heading_count("text").alias("headings"), X.list_count("text").alias("items"))


@query(f"select doc_id, {_STUB} as redirect from d", cte=_D)
def doc_redirect(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.redirect_stub("text").alias("redirect"))


@query(f"select doc_id, {_FLAGS} as flags from d", cte=_D)
def doc_flags(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.doc_flags("text", "stale_days").alias("flags"))


@query(f"select doc_id, {_FLAGS} as flags from d where len({_FLAGS}) > 0", cte=_D)
def doc_flagged(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.doc_flags("text", "stale_days").alias("flags")).where(F.size("flags") > 0)


@query(f"select doc_id, {_STALE} as stale_days from d", cte=_D)
def doc_staleness(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", "stale_days")


@query("select doc_id, concat('~/p', doc_id % 13, '/', name) as shown from d", cte=_D)
def doc_paths(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.display_path(F.concat_ws("/", "dir", "name"), HOME).alias("shown"))


_NAMED = _DOCS.format(NOW=NOW)
_NEAR = f""", c as (select distinct cwd from p where cwd is not null),
s as (select cwd, 0 as depth, cwd as dir from c union all select cwd, 1, regexp_replace(cwd, '/src$', '') from c where cwd like '%/src'),
f as (select distinct dir, concat(dir, '/', name) as path from {_NAMED} where name in ('CLAUDE.md', 'AGENTS.md') and doc_id % 13 < 9),
h as (select cwd, path, depth, min(depth) over (partition by cwd) as best from s join f using (dir)),
near as (select c.cwd, h.path, h.depth from c left join (select * from h where depth = best) h using (cwd))
"""


def _project_docs(spark, sf_dir):
    return _documents(spark, sf_dir).where("doc_id % 13 < 9")


@query(_NEAR + "select * from near")
def docs_nearest(spark, sf_dir):
    return D.nearest(prompts(spark, sf_dir).where("cwd is not null"), _project_docs(spark, sf_dir), HOME)


@query(_NEAR + "select count(distinct cwd) as cwds, count(*) filter (where path is null) as without_docs, count(distinct path) as docs from near")
def docs_summary(spark, sf_dir):
    return D.summary(prompts(spark, sf_dir).where("cwd is not null"), _project_docs(spark, sf_dir), HOME)


# -- metrics ----------------------------------------------------------------------------------

_STYLE = f""", e as (select *, unnest([origin, 'overall']) as segment from p),
s as (select segment, source, session_id, count(*) as c, sum(n) as chars, arg_min(n, (ts, source, session_id, message_ref)) as first_n from e group by all),
a as (select segment, count(*) as prompts, avg(n / 4.0::double) as avg_tokens, median(n / 4.0::double) as median_tokens, avg({hit("example")}::int) as example_rate, avg({hit("constraint")}::int) as constraint_rate, avg({hit("structured")}::int) as structured_rate from e group by segment),
b as (select segment, count(*) as sessions, avg((c > 1)::int) as refinement_rate, coalesce(avg(case when chars > 0 then first_n::double / chars end), 0.0) as first_message_ratio from s group by segment),
m as (select *, prompts / sessions as prompts_per_session from a join b using (segment))
"""


@query(_STYLE + "select segment, prompts, sessions, round(avg_tokens, 9) as avg_tokens, median_tokens, prompts_per_session, refinement_rate, example_rate, constraint_rate, structured_rate, round(first_message_ratio, 9) as first_message_ratio from m")
def style_metrics(spark, sf_dir):
    return metrics.style_metrics(prompts(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("avg_tokens", "first_message_ratio")})


_TALL = " union all ".join(f"select segment, '{m}' as measure, {m}::double as value from m" for m in metrics.MEASURES[1:])


@query(_STYLE + f"select measure, round(max(value) filter (where segment = 'human'), 9) as human, round(max(value) filter (where segment = 'machine'), 9) as machine from ({_TALL}) group by measure")
def stats_table(spark, sf_dir):
    return metrics.stats_table(prompts(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("human", "machine")})


@query(", s as (select source, count(*) as prompts, count(distinct session_id) as sessions from p group by source) select source, prompts, sessions from s union all select 'total', sum(prompts)::bigint, sum(sessions)::bigint from s")
def counts_by_source(spark, sf_dir):
    return metrics.counts_by_source(prompts(spark, sf_dir))


@query("select count(*) as prompts, count(distinct (source, session_id)) as sessions from p")
def window_totals(spark, sf_dir):
    return metrics.window_totals(prompts(spark, sf_dir))


@query(_STYLE + "select segment, source, session_id, c as prompts, chars, round(case when chars > 0 then first_n::double / chars end, 9) as ratio from s")
def session_first_ratio(spark, sf_dir):
    return metrics.session_ratios(prompts(spark, sf_dir)).select("segment", "source", "session_id", "prompts", "chars", F.round("ratio", 9).alias("ratio"))


_WEEKLY = f""", w as (select source, least(11, (ts - {NOW - 12 * 604800}) // 604800) as week, count(*) as n from p where ts >= {NOW - 12 * 604800} group by 1, 2),
g as (select source, week, coalesce(n, 0) as n from (select distinct source from w) cross join (select unnest(range(12)) as week) left join w using (source, week))
"""


@query(_WEEKLY + "select source, week, n from g")
def weekly_volumes(spark, sf_dir):
    return metrics.weekly_volumes(prompts(spark, sf_dir), NOW)


@query(_WEEKLY + "select source, sum(n)::bigint as total, row_number() over (order by source <> 'claude-code', sum(n) desc, source) as place from g group by source")
def volume_ordered(spark, sf_dir):
    return metrics.volume_ordered(metrics.weekly_volumes(prompts(spark, sf_dir), NOW), "claude-code")


@query(", r as (select source, message_ref, n, row_number() over (partition by source order by n desc, message_ref) as rank from p) select source, message_ref, n, rank, null::bigint as more from r where rank <= 3 union all select source, null, null, 4, count(*) from r where rank > 3 group by source")
def topk_with_remainder(spark, sf_dir):
    rows = prompts(spark, sf_dir).select("source", "message_ref", F.length("content").alias("n"))
    return metrics.top_with_remainder(rows, "source", [F.desc("n"), F.col("message_ref")], 3)


# -- rubric -----------------------------------------------------------------------------------


def _of(x: str, c: str = "content") -> str:
    return hit(x, c)


_RULE_SQL = {
    "A4": f"case when n >= 200 then ({_of('heading_list')} or {_of('fence_tag')})::int::double end",
    "A5": f"({_of('contract')} or {_of('structured')})::int::double",
    "A6": f"{_of('example')}::int::double",
    "A7": f"case when origin = 'machine' then {_of('reasoning')}::int::double end",
    "A9": f"case when origin = 'machine' then {_of('verify')}::int::double end",
    "A10": f"case when origin = 'machine' then {_of('self_check')}::int::double end",
    "A11": f"case when n >= 800 then ({_of('contract', _TAIL)} or {_of('verify', _TAIL)} or {_of('constraint', _TAIL)})::int::double end",
    "A12": "null::double",
    "A13": f"case when origin = 'machine' then {_of('sampling')}::int::double end",
}
_SCORES = ", sc as (" + " union all ".join(f"select prompt_ref, origin, ts, '{r}' as rule, {e} as score from p where n >= 40" for r, e in _RULE_SQL.items()) + ")\n"


def _scores(spark, sf_dir):
    return rubric.scores(rubric.substantive(prompts(spark, sf_dir)))


@query(_SCORES + "select prompt_ref, origin, ts, rule, score from sc")
def rubric_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("prompt_ref", "origin", ts(), "rule", "score")


_SUMMARY = (
    _SCORES
    + """, su as (select rule, avg(score) filter (where origin = 'human') as human_mean, avg(score) filter (where origin = 'machine') as machine_mean, count(score) as coverage,
  arg_min(prompt_ref, (-score, ts, prompt_ref)) filter (where score is not null) as best_ref, arg_min(prompt_ref, (score, ts, prompt_ref)) filter (where score is not null) as worst_ref from sc group by rule),
ru as (select unnest(['A1','A2','A3','A4','A5','A6','A7','A8','A9','A10','A11','A12','A13']) as rule)
"""
)


@query(_SUMMARY + "select rule, round(human_mean, 9) as human_mean, round(machine_mean, 9) as machine_mean, coalesce(coverage, 0) as coverage, coalesce(coverage, 0) > 0 as applicable from ru left join su using (rule)")
def rubric_summary(spark, sf_dir):
    out = rubric.summary(_scores(spark, sf_dir))
    return out.select("rule", F.round("human_mean", 9).alias("human_mean"), F.round("machine_mean", 9).alias("machine_mean"), "coverage", "applicable")


@query(_SUMMARY + "select rule, best_ref, worst_ref from ru left join su using (rule)")
def rubric_best_worst(spark, sf_dir):
    return rubric.summary(_scores(spark, sf_dir)).select("rule", "best_ref", "worst_ref")


@query(_SUMMARY + "select rule, coverage from su where coverage > 0")
def rubric_applicable(spark, sf_dir):
    return rubric.summary(_scores(spark, sf_dir)).where("coverage > 0").select("rule", "coverage")


_SIZE, _PATTERNS = 150, 300


def _sample_sql(size: int) -> str:
    return f""", st as (select source, origin, count(*) as c from p where n >= 40 group by 1, 2), tt as (select sum(c) as t from st),
pl as (select source, origin, t, greatest(1, round_even({size}::double * c / t, 0)::int) as share from st cross join tt),
r1 as (select p.*, t, share, row_number() over (partition by p.source, p.origin order by ts desc, prompt_ref) as nw from p join pl using (source, origin) where p.n >= 40),
r2 as (select *, nw <= share // 2 + share % 2 as late from r1),
r3 as (select *, row_number() over (partition by source, origin, late order by md5('1337|' || prompt_ref), prompt_ref) as pk from r2),
r4 as (select * from r3 where t <= {size} or late or pk <= share // 2),
sa as (select * from (select *, row_number() over (order by source, origin, late desc, case when late then nw else pk end, prompt_ref) as sample_pos from r4) where sample_pos <= {size})
"""


_SAMPLE = _sample_sql(_SIZE)


def _sample(spark, sf_dir, size: int = _SIZE):
    return rubric.stratified_sample(rubric.substantive(prompts(spark, sf_dir)), size)


@query(_SAMPLE + "select sample_pos, prompt_ref from sa")
def stratified_sample(spark, sf_dir):
    return _sample(spark, sf_dir).select("sample_pos", X.prompt_ref().alias("prompt_ref"))


# -- inference --------------------------------------------------------------------------------

_KEYS = _SAMPLE + """, ba as (select *, (sample_pos - 1) // 5 as batch, (sample_pos - 1) % 5 + 1 as slot from sa),
ke as (select batch, sha256(concat(string_agg(content_hash, '' order by content_hash), 'rubric-1', 'stub')) as key, count(*) as n from ba group by batch)
"""


def _batched(spark, sf_dir):
    return ingest.cut(infer.batches(_sample(spark, sf_dir), 5))


@query(_KEYS + "select batch, key, n from ke")
def batch_keys(spark, sf_dir):
    return infer.batch_keys(_batched(spark, sf_dir))


_BLOCK = """concat(slot, '. \"\"\"', left(content, 1500), case when length(content) > 1500 then '...' else '' end, '\"\"\"')"""


@query(_KEYS + f"select batch, left(string_agg({_BLOCK}, chr(10) || chr(10) order by slot), 32000) as block from ba group by batch")
def prompt_blocks(spark, sf_dir):
    return infer.prompt_blocks(_batched(spark, sf_dir))


@query(_KEYS + "select batch, key, case when batch % 3 = 0 then concat('{\"batch\":', batch, '}') end as payload from ke")
def memo_split(spark, sf_dir):
    keys = infer.batch_keys(_batched(spark, sf_dir))
    memo = keys.where("batch % 3 = 0").select("key", F.concat(F.lit('{"batch":'), F.col("batch").cast("string"), F.lit("}")).alias("payload"))
    return infer.memo_split(keys, memo).select("batch", "key", "payload")


def _judged(spark, sf_dir):
    batched = _batched(spark, sf_dir)
    keys = infer.batch_keys(batched)
    asked = infer.prompt_blocks(batched).join(keys, "batch").select("key", "block")
    return infer.judge_scores(batched, keys, ingest.cut(infer.infer(asked.repartition(4), infer.stub_judge)))


_CUT = "(least(n, 1500) + case when n > 1500 then 3 else 0 end)"


@query(_KEYS + f"select prompt_ref, origin, rule, (({_CUT} + i) % 5) / 4.0::double as score from ba cross join (values ('A1', 0), ('A2', 1), ('A3', 2), ('A8', 3)) j(rule, i)")
def judge_scores(spark, sf_dir):
    return _judged(spark, sf_dir).select("prompt_ref", "origin", "rule", "score")


@query(_KEYS + "select origin, count(distinct prompt_ref) as prompts from ba group by origin")
def judged_prompts(spark, sf_dir):
    return infer.judged_prompts(_judged(spark, sf_dir))


@query(_KEYS + "select source as item, count(*) as n from p group by source union all select 'prompts', count(*) from p union all select 'memo', count(distinct key) from ke")
def table_info(spark, sf_dir):
    return metrics.table_info(prompts(spark, sf_dir), infer.batch_keys(_batched(spark, sf_dir)))


_DIGEST = _sample_sql(_PATTERNS) + f""", ba as (select *, (sample_pos - 1) // 25 as batch, {_CUT} as shown from sa),
di as (select batch, list_sort(list_distinct(list(concat('length ', shown % 4)))) as patterns, avg((shown >= 200)::int) as long_share from ba group by batch)
"""


def _digests(spark, sf_dir):
    batched = ingest.cut(infer.batches(_sample(spark, sf_dir, _PATTERNS), 25))
    memo = spark.createDataFrame([], "key string, payload string")
    return ingest.cut(infer.pattern_digests(batched, memo, infer.stub_digest))


@query(_DIGEST + "select batch, patterns, round(long_share, 9) as long_share from di")
def pattern_digests(spark, sf_dir):
    """Each batch of 25 prompts through the model; the stub's patterns are lengths modulo 4 and its topic the share of long texts."""
    return _digests(spark, sf_dir).select("batch", "patterns", F.round(F.col("topics")[0]["share"], 9).alias("long_share"))


@query(_DIGEST + "select pattern, count(distinct batch) as support from (select batch, unnest(patterns) as pattern from di) group by pattern")
def pattern_merge(spark, sf_dir):
    return infer.merge_patterns(_digests(spark, sf_dir))


@query(_DIGEST + "select 'long' as topic, count(*) as batches, round(avg(long_share), 9) as share from di")
def pattern_topics(spark, sf_dir):
    return infer.merge_topics(_digests(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(_DIGEST + """, sp as (select distinct unnest(patterns) as item from di) select 'strengths' as part, row_number() over (order by item) as rank, item, null::double as share from sp qualify rank <= 5
union all select 'topics', 1, 'long', round(max(long_share), 9) from di""")
def pattern_report(spark, sf_dir):
    """All digests merged by the model in rounds of bounded blocks; the stub joins patterns and keeps a topic's greatest share."""
    memo = spark.createDataFrame([], "key string, payload string")
    merged, _ = infer.reduce_patterns(_digests(spark, sf_dir), memo, infer.stub_reduce)
    return infer.pattern_report(merged).withColumn("share", F.round("share", 9))


# -- model fit --------------------------------------------------------------------------------

_FIT = f""", t as (select source, prompt_ref, model, {_tier()} as tier, {_DEMAND} as demand from p where origin = 'human' and n >= 40),
f as (select *, case when demand = 'high' and tier = 'small' then 'underpowered' when demand = 'low' and tier = 'large' then 'overpowered' end as direction from t),
b as (select source, max(model) filter (where tier = 'small') as small, max(model) filter (where tier = 'medium') as medium, max(model) filter (where tier = 'large') as large from (select source, model, {_tier()} as tier from p) group by source)
"""


@query("select source, list_sort(list_distinct(list(model))) as models from p where model is not null group by source")
def models_seen(spark, sf_dir):
    return fit.models_seen(prompts(spark, sf_dir))


@query("select message_ref from p where origin = 'human' and n >= 40")
def fit_eligible(spark, sf_dir):
    return fit.eligible(prompts(spark, sf_dir)).select("message_ref")


@query(_FIT + "select source, prompt_ref, model, tier, demand, direction from f where direction is not null")
def fit_findings(spark, sf_dir):
    return fit.findings(prompts(spark, sf_dir))


@query(_FIT + "select source, prompt_ref, model, tier, demand, direction, coalesce(medium, case when direction = 'underpowered' then large else small end) as suggestion from f left join b using (source) where direction is not null")
def fit_suggestions(spark, sf_dir):
    return fit.suggestions(prompts(spark, sf_dir))


@query(_FIT + "select count(*) as eligible, count(tier) as coverage, count(*) filter (where direction = 'underpowered') as underpowered, count(*) filter (where direction = 'overpowered') as overpowered from f")
def fit_summary(spark, sf_dir):
    return fit.summary(prompts(spark, sf_dir))


# -- triggers ---------------------------------------------------------------------------------

_OVERRIDES = [("/home/u", "off"), ("/home/u/p1", "coach"), ("/home/u/p1/src/", "always"), ("/home/u/p11", "always"), ("/home/u/p2/s", "coach")]
_OV = ", o as (select * from (values " + ", ".join(f"('{p.rstrip('/')}', '{m}')" for p, m in _OVERRIDES) + ") o(path, mode))\n"


@query(_OV + "select message_ref, cwd, coalesce(arg_max(mode, length(path)), 'coach') as mode from p left join o on p.cwd = o.path or starts_with(p.cwd, o.path || '/') group by message_ref, cwd")
def resolve_mode_prefix(spark, sf_dir):
    rules = spark.createDataFrame(_OVERRIDES, "path string, mode string")
    return triggers.resolve_mode(prompts(spark, sf_dir).select("message_ref", "cwd"), rules, "coach")


@query("select source, session_id, place, message_ref from (select *, row_number() over (partition by source, session_id order by ts desc, message_ref desc) as place from p where origin = 'human') where place <= 2")
def session_last_prompts(spark, sf_dir):
    return triggers.last_prompts(prompts(spark, sf_dir), 2).select("source", "session_id", "place", "message_ref")


@query(f""", h as (select source, session_id, message_ref, ts, {_STRIP.format('content')} as t from p where origin = 'human'),
l as (select source, session_id, arg_max(t, (ts, message_ref)) as now_t from h group by 1, 2),
r as (select h.*, row_number() over (partition by source, session_id order by ts desc, message_ref desc) as place from h join l using (source, session_id) where t <> now_t)
select source, session_id, place, left(t, 300) as text from r where place <= 3""")
def session_context(spark, sf_dir):
    return triggers.session_context(prompts(spark, sf_dir))


_BEFORE = "case when length(hp.{0}) > 0 and hp.{0} <> hp.t then concat('- ', left(hp.{0}, 300)) end"
_CONTEXT = _NEAR + f""", dx as (select dir, name, arg_min(text, doc_id) as text from {_NAMED} where name in ('CLAUDE.md', 'AGENTS.md') and doc_id % 13 < 9 group by dir, name),
us as (select concat(dir, '/', name) as path, name, {_STRIP.format('text')} as text from dx where {_STRIP.format('text')} <> '' and not {_STUB}),
ex as (select cwd, arg_min(concat('Project doc (', name, ', excerpt):', chr(10), left(text, 1500)), case name when 'CLAUDE.md' then 1 else 2 end) as doc from near join us using (path) group by cwd),
h0 as (select *, {_STRIP.format('content')} as t from p where origin = 'human'),
hp as (select *, lag(t, 1) over w as b1, lag(t, 2) over w as b2, lag(t, 3) over w as b3 from h0 window w as (partition by source, session_id order by ts, message_ref)),
b as (select source, session_id, message_ref, concat_ws(chr(10), {_BEFORE.format('b1')}, {_BEFORE.format('b2')}, {_BEFORE.format('b3')}) as earlier from hp),
fl as (select *, {_KIND} as kind from p),
cx as (select f.source, f.session_id, f.message_ref, f.kind, f.content, nullif(concat_ws(chr(10) || chr(10), case when f.cwd <> '' then concat('Working directory: ', f.cwd) end, ex.doc,
    case when b.earlier <> '' then concat('Earlier prompts this session (newest first):', chr(10), b.earlier) end), '') as context
  from fl f left join b on b.source = f.source and b.session_id = f.session_id and b.message_ref = f.message_ref left join ex on ex.cwd = f.cwd where f.kind is not null)
"""


def _contexts(spark, sf_dir):
    once = _project_docs(spark, sf_dir).groupBy("dir", "name").agg(F.min_by("text", "doc_id").alias("text"))
    return triggers.rewrite_context(prompts(spark, sf_dir), once, HOME)


@query(_CONTEXT + "select source, session_id, message_ref, kind, context from cx")
def rewrite_context(spark, sf_dir):
    """The context of every triggered prompt: directory, nearest document, the prompts before it."""
    return _contexts(spark, sf_dir).select("source", "session_id", "message_ref", "kind", "context")


@query(_CONTEXT + """, bl as (select *, length(case when context is null then content else concat('SESSION CONTEXT:', chr(10), context, chr(10), chr(10), 'PROMPT TO REWRITE:', chr(10), content) end) as size from cx)
select source, session_id, message_ref, kind, case when size % 7 > 2 then concat('rewritten from ', size, ' characters') end as rewrite from bl""")
def rewrites(spark, sf_dir):
    """Every triggered prompt rewritten by the model in its context; the stub is silent, blank or no text for some."""
    return triggers.rewrites(_contexts(spark, sf_dir), spark.createDataFrame([], "key string, payload string"), infer.stub_rewrite)


@query(f"""select message_ref, content_hash, origin, n / 4.0::double as tokens, {_tier()} as tier, {_DEMAND} as demand, {_KIND} as kind, {hit('example')} as example, {hit('constraint')} as bound,
{_WORDS.replace('text', 'content')} as words, len(regexp_extract_all(content, {re2('doc_list')})) as items, case when starts_with(cwd, '/home/u/') then concat('~/', substr(cwd, 9)) else cwd end as shown from p""")
def sql_functions(spark, sf_dir):
    """The scalar families called from Spark SQL by name."""
    sql.register(spark)
    return spark.sql(
        """select message_ref, content_hash(content) as content_hash, prompt_origin(content) as origin, token_estimate(content) as tokens, model_tier(model) as tier, demand_tier(content) as demand, trigger_kind(content) as kind,
        cue_example(content) as example, cue_constraint(content) as bound, word_count(content) as words, list_count(content) as items, display_path(cwd, '/home/u') as shown from {p}""",
        p=prompts(spark, sf_dir),
    )


_SKIP = f""", ev as (select session_id, seq, kind, triggered, row_number() over (partition by session_id order by seq) as rn
  from (select session_id, split_part(message_ref, ':', 2)::bigint as seq, case when k % 5 < 2 then 'consume' else 'submit' end as kind, {_KIND} is not null as triggered from p)),
r as (select session_id, 0::bigint as rn, 0::bigint as seq, '' as kind, '' as outcome, false as pending, false as passing from ev group by session_id
  union all select e.session_id, e.rn, e.seq, e.kind,
    case when e.kind = 'consume' then case when r.pending then 'consumed' else 'nothing' end when r.passing then 'passed' when e.triggered then 'blocked' else 'none' end,
    case when e.kind = 'consume' then false when r.passing then r.pending else r.pending or e.triggered end,
    case when e.kind = 'consume' then r.passing or r.pending else false end
  from r join ev e on e.session_id = r.session_id and e.rn = r.rn + 1)
select session_id, seq, kind, outcome from r where rn > 0"""


@query(_SKIP, cte=P_SQL.replace("with v as", "with recursive v as", 1))
def trigger_skip_next(spark, sf_dir):
    p = prompts(spark, sf_dir)
    events = p.select("session_id", F.split("message_ref", ":")[1].cast("bigint").alias("seq"), F.when(F.col("k") % 5 < 2, "consume").otherwise("submit").alias("kind"), triggers.trigger_kind().isNotNull().alias("triggered"))
    return triggers.skip_next(events)


_EVENT, _MODE = ["accept", "original", "stop", "pre_call"], "case when k % 11 < 2 then 'off' when k % 11 < 5 then 'always' else 'coach' end"
_DECIDE = f""", e0 as (select session_id, split_part(message_ref, ':', 2)::bigint as seq, case when k % 7 <> 2 then content end as content, case k % 7 when 0 then 'accept' when 1 then 'original' when 2 then 'stop' when 3 then 'pre_call' else 'submit' end as event,
  {_MODE} as mode, case when n % 3 <> 0 then concat('Rewritten: ', left(content, 50)) end as rewrite, {_KIND} as kind, (origin = 'machine' or {hit('harness')}) as machine from p),
ev as (select *, row_number() over (partition by session_id order by seq) as rn, coalesce(mode <> 'off' and content <> '', false) as live from e0),
r as (select session_id, 0::bigint as rn, 0::bigint as seq, '' as event, '' as outcome, null::varchar as text, false as nudged, false as passing, null::varchar as original, null::varchar as offer, null::varchar as last from ev group by session_id
  union all select e.session_id, e.rn, e.seq, e.event,
    case when e.event in ('accept', 'original') then case when r.offer is null then 'nothing' else 'released' end
      when e.tip and e.event = 'pre_call' then 'context' when e.tip and e.event = 'stop' then 'message' when e.passed then 'passed'
      when e.held and e.rewrite is not null then 'blocked' when e.held and e.mode = 'coach' then 'message' else 'none' end,
    case when e.event = 'accept' then r.offer when e.event = 'original' then r.original when e.tip and e.event = 'stop' then r.last when e.tip then e.kind
      when e.held and e.rewrite is not null then e.rewrite when e.held and e.mode = 'coach' then e.kind end,
    r.nudged or e.tip or (e.held and e.mode = 'coach'),
    case when e.event in ('accept', 'original') then r.passing or r.offer is not null when e.passed then false else r.passing end,
    case when e.event in ('accept', 'original') then null when e.held and e.rewrite is not null then e.content else r.original end,
    case when e.event in ('accept', 'original') then null when e.held and e.rewrite is not null then e.rewrite else r.offer end,
    case when e.event = 'submit' and e.content <> '' and not e.machine and not (e.held and e.rewrite is not null) then e.kind else r.last end
  from r join lateral (select ev.*, not r.nudged and ((live and kind is not null and event = 'pre_call') or (event = 'stop' and mode = 'coach' and r.last is not null)) as tip, live and event = 'submit' and r.passing as passed,
      live and event = 'submit' and not r.passing and ((mode = 'always' and not machine) or (mode = 'coach' and kind is not null and not r.nudged)) as held
    from ev where ev.session_id = r.session_id and ev.rn = r.rn + 1) e on true)
select session_id, seq, event, outcome, text from r where rn > 0"""


@query(_DECIDE, cte=P_SQL.replace("with v as", "with recursive v as", 1))
def trigger_decisions(spark, sf_dir):
    """Decisions on submit, stop, pre-call and choice events under the three modes, with the session's gate, pending rewrite and pass."""
    p = prompts(spark, sf_dir)
    event = F.coalesce(*(F.when(F.col("k") % 7 == i, e) for i, e in enumerate(_EVENT)), F.lit("submit"))
    offer = F.when(F.length("content") % 3 != 0, F.concat(F.lit("Rewritten: "), F.substring("content", 1, 50)))
    return triggers.decide(p.select("session_id", F.split("message_ref", ":")[1].cast("bigint").alias("seq"), event.alias("event"), F.expr(_MODE).alias("mode"), F.when(event != "stop", F.col("content")).alias("content"), offer.alias("rewrite")))


# -- retrieval --------------------------------------------------------------------------------

_INDEX = """with w as (select doc_id as doc, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+') as w from documents),
t as (select doc, len(w) as doc_len, unnest(w) as term, unnest(range(len(w))) as pos from w),
st as (select count(*) as stats_n, avg(len(w)) as avg_len from w),
bq as (select item_id as query, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') as w from benchmark),
"""
_BM = "greatest(1e-6, ln((stats_n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))"
_PHRASES = (
    _INDEX
    + f"""q as (select query, len(w) as m, unnest(w) as term, unnest(range(len(w))) as slot from bq where len(w) > 0),
a as (select query, m, doc, doc_len, pos - slot as start, count(distinct slot) as got from q join t using (term) group by all),
h as (select query, doc, doc_len, count(*) as tf from a where got = m group by all), hd as (select query, count(*) as df from h group by query),
s1 as (select query, doc, {_BM} as score from h join hd using (query) cross join st)
"""
)


def _terms_sql(which: str = "true") -> str:
    return f"""wd as (select distinct item_id as query, unnest(string_split_regex(trim(text), '\\s+')) as word from benchmark where {which}),
u as (select distinct query, strip_accents(lower(word)) as term from wd where regexp_full_match(word, '[\\p{{L}}\\p{{N}}]+')), nd as (select query, count(*) as m from u group by query),
tf as (select term, doc, doc_len, count(*) as tf from t group by all), df as (select term, count(*) as df from tf group by term),
e as (select query, doc, {_BM} as x from u join tf using (term) join df using (term) cross join st),
s2 as (select query, doc, sum(x) as score from e join nd using (query) group by query, doc, m having count(*) = m)
"""


def _ranked(of: str, k: int) -> str:
    return f"r as (select *, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from {of}), hits as (select * from r where rank <= {k})\n"


_QUESTIONS = _PHRASES + ", " + _terms_sql("item_id not in (select query from h)") + ", al as (select *, 'phrase' as way from s1 union all select *, 'terms' as way from s2), " + _ranked("al", 12)


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))


def _asked(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query"), F.col("text").alias("question"))


_STORED: dict[tuple[str, str], str] = {}


def _stored(spark, sf_dir) -> str:
    """The stored index over the documents: built in the shared folder by the first query that asks, then read by all."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{ingest.shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        index.add(path, _docs(spark, sf_dir))
        _STORED[key] = path
    return _STORED[key]


def _opened(spark, sf_dir):
    """The questions, the postings they need and the corpus numbers."""
    asked = _asked(spark, sf_dir)
    return asked, *index.read(spark, _stored(spark, sf_dir), asked)


@query(_INDEX + "x as (select term, doc, doc_len, list(pos order by pos) as positions, count(*) as tf from t group by all) select term, doc, doc_len, positions, tf from x", cte="")
def fts_postings(spark, sf_dir):
    return search.postings(_docs(spark, sf_dir))


@query(_INDEX + "x as (select term, doc, doc_len, list(pos order by pos) as positions, count(*) as tf from t group by all) select term, doc, doc_len, positions, tf, stats_n, round(avg_len, 9) as avg_len from x cross join st", cte="")
def fts_stored_index(spark, sf_dir):
    """Documents added in five parts, with a merge on the way; the index equals one that is built at once."""
    path = f"{ingest.shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    for i in range(5):
        index.add(path, _docs(spark, sf_dir).where(F.pmod("doc", F.lit(5)) == i))
    rows, stats = index.read(spark, path)
    return rows.crossJoin(F.broadcast(stats)).withColumn("avg_len", F.round("avg_len", 9))  # one row


@query(_PHRASES + ", " + _ranked("s1", 12) + "select query, rank, doc, round(score, 6) as score from hits", cte="")
def search_phrase(spark, sf_dir):
    asked, rows, stats = _opened(spark, sf_dir)
    return search.phrase_search(rows, stats, asked, 12).withColumn("score", F.round("score", 6))


@query(_INDEX + _terms_sql() + ", " + _ranked("s2", 20) + "select query, rank, doc, round(score, 6) as score from hits", cte="")
def search_all_terms(spark, sf_dir):
    asked, rows, stats = _opened(spark, sf_dir)
    return search.all_terms_search(rows, stats, asked).withColumn("score", F.round("score", 6))


@query(_QUESTIONS + "select query, rank, doc, round(score, 6) as score, way from hits", cte="")
def search_questions(spark, sf_dir):
    """Whole questions as phrases; those without a hit by all their words."""
    asked, rows, stats = _opened(spark, sf_dir)
    return search.search(rows, stats, asked, 12).withColumn("score", F.round("score", 6))


def _dated(spark, sf_dir, hits):
    """The documents that are hits, with a day and a snippet; the table has no times, so the day follows the doc_id."""
    day = F.date_format(F.timestamp_seconds(F.lit(NOW) - F.col("doc") % 1000 * 86400), "yyyy-MM-dd")
    return search.of_hits(_docs(spark, sf_dir), hits).select("doc", "text", day.alias("day"), X.snippet("text").alias("snippet"))


_FALLBACK = _QUESTIONS + f""", sn as (select doc_id as doc, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as f, strftime(to_timestamp({NOW} - doc_id % 1000 * 86400) at time zone 'UTC', '%Y-%m-%d') as day from documents),
li as (select query, string_agg(concat('- [', day, '] (', doc, ') ', case when length(f) > 200 then concat(left(f, 200), '...') else f end), chr(10) order by rank) as answer, count(*) as n_hits from hits join sn using (doc) group by query),
fa as (select bq.query, coalesce(n_hits, 0) as n_hits, coalesce(answer, 'nothing matches this question') as answer from bq left join li using (query))
"""


@query(_FALLBACK + "select query, n_hits, answer from fa", cte="")
def answer_fallback(spark, sf_dir):
    asked, rows, stats = _opened(spark, sf_dir)
    hits = ingest.cut(search.search(rows, stats, asked, 12))
    return search.fallback_answers(asked, hits, _dated(spark, sf_dir, hits))


@query(_QUESTIONS + ", us as (select query, unnest([0, 1, 2, 3, 4]) as place, unnest([2, 1, 99, 1, 0]) as rank from bq) select us.query, us.place, us.rank, hits.doc from us join hits using (query, rank)", cte="")
def answer_citations(spark, sf_dir):
    asked, rows, stats = _opened(spark, sf_dir)
    used = asked.select("query", F.array(*map(F.lit, (2, 1, 99, 1, 0))).alias("used_refs"))
    return search.cited(used, search.search(rows, stats, asked, 12))


_TALK = """, ct as (select doc_id as doc, case when length(coalesce(text, '')) > 800 then concat(left(text, 800), '...') else coalesce(text, '') end as f, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) as hash from documents),
bl as (select query, string_agg(concat('[', rank, '] (', doc, ') ', f), chr(10) || chr(10) order by rank) as block, string_agg(hash, '' order by rank) as hashes, count(*) as n from hits join ct using (doc) group by query),
an as (select bq.query, n, sha256(concat(text, hashes, 'answer-1', 'stub')) as key, case when n is null then 'none' when length(block) % 5 in (1, 2) then 'failed' else 'ok' end as status, concat('answer from ', n, ' excerpts of ', length(block), ' characters') as said, length(block) % 2 = 0 as sure
  from (select item_id as query, text from benchmark) bq left join bl using (query)),
so as (select query, concat(chr(10), chr(10), 'Sources:', string_agg(concat(chr(10), '- [', day, '] ', doc), '' order by rank desc)) as lines from hits join sn using (doc) where rank <= 2 group by query)
"""


@query(_FALLBACK + _TALK + """select an.query, case when n is not null then key end as key, status, case when status <> 'ok' then fa.answer else concat(said, so.lines, case when sure then '' else concat(chr(10), chr(10), '(partial: the excerpts answer this only in part)') end) end as text
from an join fa using (query) left join so using (query)""", cte="")
def answer_model(spark, sf_dir):
    """Whole questions answered by the model from numbered excerpts, with dated sources, a partial note, and snippets where it gives no answer."""
    asked, rows, stats = _opened(spark, sf_dir)
    hits = ingest.cut(search.search(rows, stats, asked, 12))
    docs = _dated(spark, sf_dir, hits)
    excerpts = ingest.cut(hits.join(docs, "doc").select("query", "rank", F.col("doc").alias("ref"), "day", F.col("text").alias("content"), X.content_hash("text").alias("content_hash")))
    memo = spark.createDataFrame([], "key string, payload string")
    got = ingest.cut(infer.answers(asked, excerpts, memo, infer.stub_answer))
    texts = infer.answer_texts(got, excerpts.select("query", "rank", "ref", "day"), search.fallback_answers(asked, hits, docs))
    return texts.join(got.select("query", "key"), "query").select("query", "key", "status", "text")


# -- composite ----------------------------------------------------------------------------------


def _cells_sql(section: str, row: str, columns: tuple[str, ...], of: str) -> str:
    names, values = ", ".join(f"'{c}'" for c in columns), ", ".join(f"{c}::double" for c in columns)
    return f"select '{section}' as section, {row} as \"row\", unnest([{names}]) as col, round(unnest([{values}]), 9) as value from ({ORACLES[of]})"


_STYLE_CELLS = _cells_sql("style", "measure", ("human", "machine"), "stats_table")
_RUBRIC_CELLS = _cells_sql("rubric", "rule", ("human_mean", "machine_mean", "coverage"), "rubric_summary")
_FIT_CELLS = _cells_sql("fit", "'all'", ("eligible", "coverage", "underpowered", "overpowered"), "fit_summary")
_COUNT_CELLS = [_cells_sql("totals", "'window'", ("prompts", "sessions"), "window_totals"), _cells_sql("sources", "source", ("prompts", "sessions"), "counts_by_source")]
_VOLUME_CELLS = f"select 'volumes' as section, source as \"row\", concat('w', week) as col, n::double as value from ({ORACLES['weekly_volumes']})"


def _all_cells(parts: list[str]) -> str:
    return "select * from (" + " union all ".join(parts) + ") where value is not null"


@query(_all_cells([*_COUNT_CELLS, _STYLE_CELLS, _RUBRIC_CELLS, _FIT_CELLS]), cte="")
def report_cells(spark, sf_dir):
    return reports.cells(reports.report(prompts(spark, sf_dir))).withColumn("value", F.round("value", 9))


@query(_all_cells([_VOLUME_CELLS, _STYLE_CELLS, _RUBRIC_CELLS, _FIT_CELLS]), cte="")
def dash_cells(spark, sf_dir):
    return reports.cells(reports.dashboard(prompts(spark, sf_dir), NOW)).withColumn("value", F.round("value", 9))


_DOC_CELLS = _cells_sql("docs", "'all'", ("cwds", "without_docs", "docs"), "docs_summary")
_PATTERN_CELLS = _cells_sql("patterns", "pattern", ("support",), "pattern_merge")


@query(_all_cells([_VOLUME_CELLS, _STYLE_CELLS, _RUBRIC_CELLS, _FIT_CELLS, _DOC_CELLS]), cte="")
def dash_cells_with_docs(spark, sf_dir):
    frames = reports.dashboard(prompts(spark, sf_dir), NOW, _project_docs(spark, sf_dir), HOME)
    return reports.cells(frames).withColumn("value", F.round("value", 9))


@query(_all_cells([*_COUNT_CELLS, _STYLE_CELLS, _RUBRIC_CELLS, _FIT_CELLS, _PATTERN_CELLS]), cte="")
def report_file(spark, sf_dir):
    """The report with the model's patterns, written to a file and read back."""
    path = f"{ingest.shared_folder(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    reports.write(reports.cells(reports.report(prompts(spark, sf_dir), infer.merge_patterns(_digests(spark, sf_dir)))), path)
    return reports.read(spark, path).withColumn("value", F.round("value", 9))
