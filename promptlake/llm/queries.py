"""The registered queries of the operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language_id, line_dedup, lm_score, near_dedup, packing, periodic_runs, prefix_trie, quality_model, quality_rules, token_counts, token_files
from .cluster import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.round("log_score", 3).alias("log_score"))


def op2_lm_score_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With trigrams; the SQL twin of op2_lm_score is fixed to bigrams."""
    out = lm_score.score(table(spark, sf_dir, "documents"), order=3)
    return out.select("doc_id", "n_tokens", F.round("log_score", 3).alias("log_score"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality_rules.verdicts(table(spark, sf_dir, "documents"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.scratch(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"))
    return token_files.digests(token_files.read(spark, path))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedupe_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs(table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html_text, op2_lm_score, op2_lm_score_order3, op3_token_counts, op4_quality_model, op5_best_fit_packing, op6_quality_rules, op7_decontamination, op8_token_files, op9_line_dedup, op10_near_dedup, op11_periodic_runs, op12_language_id, op13_prefix_trie, pipeline)}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""


def _shingles(of: str, table_name: str, k: int) -> str:
    return f"""select distinct {of}, unnest(case when len(w) >= {k} then list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from (select {of}, {_WORDS} as w from {table_name})"""


_CRC32 = """list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast({0} as varchar), ''), lambda ch: ascii(ch)::bigint)), lambda acc, byte: list_reduce(list_concat([xor(acc, byte)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384)))"""

ORACLES: dict[str, str] = {
    "op13_prefix_trie": f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, md5(concat(coalesce(role, ''), chr(0), coalesce(text, '')))) - 1 as pos from conversations where conv_id is not null),
c as (select conv_id, xor({_CRC32.format("conv_id")}, 4294967295) % 6 as h from (select distinct conv_id from t)),
r as (select c.conv_id, 0 as own, pos, role, text from c join t on t.conv_id = c.conv_id - c.conv_id % 100 and pos < h union all select c.conv_id, 1, pos, role, text from c join t using (conv_id) where pos >= h),
o as (select conv_id, row_number() over (partition by conv_id order by own, pos) as depth, md5(concat(role, chr(0), text)) as turn, length(text) as len from r),
m as (select conv_id, depth, string_agg(turn, '') over (partition by conv_id order by depth) as key, len from o union all select conv_id, 0, '', 0 from c),
last as (select conv_id, max(depth) as depth from m group by conv_id),
e as (select m.depth, m.key, sha256(string_agg(conv_id, ',' order by conv_id)) as ends from m join last using (conv_id, depth) group by all),
n as (select depth, key, min(conv_id) as owner, count(*) as n, (count(*) - 1) * min(len) as own, left(key, greatest(0, 32 * (depth - 1)::int)) as up from m group by depth, key),
k as (select depth - 1 as depth, up as key, count(*) as children from n where depth > 0 group by all),
x as (select n.*, coalesce(children, 0) as children, coalesce(ends, sha256('')) as ends from n left join k using (depth, key) left join e using (depth, key)),
s as (select m.depth, m.key, sum((x.children = 0)::bigint) as leaves, sum(x.own) as saved from x join m on m.conv_id = x.owner and m.depth <= x.depth group by all)
select x.owner as conv_id, x.depth::bigint as depth, p.owner as parent_conv_id, x.n as n_convs, x.children as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, x.ends as ends_sha256
from x join s using (depth, key) left join n p on p.depth = x.depth - 1 and p.key = x.up""",
    "op7_decontamination": f"""
with d as ({_shingles("doc_id", "documents", 5)}), b as ({_shingles("item_id", "benchmark", 5)}),
n as (select item_id, count(*) as n_shingles from b group by item_id),
m as (select doc_id, item_id, count(*) as n_shared from d join b using (s) group by doc_id, item_id)
select doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles as containment from m join n using (item_id) where 100 * n_shared >= 80 * n_shingles""",
    "op2_lm_score": f"""
with t as (select doc_id, w, len(w) as m from (select doc_id, {_WORDS} as w from documents)),
p as (select doc_id, m, unnest(w) as b, unnest(list_concat([null], w[1:m - 1])) as a from t where m > 0),
uni as (select b, count(*) as c from p group by b), uni_own as (select doc_id, b, count(*) as c from p group by doc_id, b),
bi as (select a, b, count(*) as c from p where a is not null group by a, b), bi_own as (select doc_id, a, b, count(*) as c from p where a is not null group by doc_id, a, b),
n as (select sum(m) as n from t),
x as (select p.doc_id, p.a is not null as has, n.n - p.m as others, u.c - uo.c as c1, coalesce(bi.c - bo.c, 0) as c2, coalesce(h.c - ho.c, 0) as ctx
  from p cross join n join uni u using (b) join uni_own uo on uo.doc_id = p.doc_id and uo.b = p.b
  left join bi on bi.a = p.a and bi.b = p.b left join bi_own bo on bo.doc_id = p.doc_id and bo.a = p.a and bo.b = p.b
  left join uni h on h.b = p.a left join uni_own ho on ho.doc_id = p.doc_id and ho.b = p.a),
s as (select doc_id, count(*) as k, sum(case when c2 > 0 and ctx > 0 then ln(c2 / ctx)
  else case when c1 > 0 then ln(c1 / others) else -ln(others + 1.0) end + case when has then ln(0.4) else 0 end end) as s from x group by doc_id)
select t.doc_id, cast(t.m as bigint) as n_tokens, round(coalesce(s, 0.0), 3) as log_score from t left join s using (doc_id)""",
    "op9_line_dedup": r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.doc_id, k.pos, k.line, f.keeper is not null and f.keeper <> k.doc_id as gone from k left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256 from m group by doc_id""",
    "op10_near_dedup": f"""
with recursive s as ({_shingles("doc_id", "documents", 2)}), n as (select doc_id, count(*) as n from s group by doc_id),
i as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y using (s) where x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from i join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
g as (select a, b from e union all select b, a from e),
r as (select doc_id as v, doc_id as c from documents union select g.b, r.c from r join g on g.a = r.v where r.c < g.b),
m as (select v, min(c) as component_id from r group by v)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from documents d left join n using (doc_id) join m on m.v = d.doc_id""",
}
