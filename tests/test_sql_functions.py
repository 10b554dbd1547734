"""Each SQL function against the column function of its family, over texts that reach every branch."""

import pytest
from pyspark.sql import functions as F

from promptlake.functions import sql
from promptlake.functions import text as X
from promptlake.operators import triggers

TEXTS = [
    None, "", "    ", " plain text\n", "TASK: go", "<command-name>x</command-name>", "<task-notification> y", "improve everything", "improve everything, you must", "such as json schema " * 20, "w " * 150, "w " * 160 + "\n# Head\n- item", "w " * 700, "See AGENTS.md", "a<system-reminder>b\nc</system-reminder>d",
    "x ## My request for Codex:\n real ", '"a\\"b"', '[{"type":"text","text":"one"},{"type":"image"},{"type":"text","text":"two"}]', '[{"type":"text","text":""}]', '{"a":1}', 'so: ```json\n{"a": [1]}\n``` end', "no { json }", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00+02:00", "2024-01-01", "not a time", "claude-haiku", "Sonnet", "opus-4", "qwen3-8b", "llama-39B", "llama-70b", "gpt-5", "copilot/auto",
    "don't", 'say "hi" verify: temperature = 0, re-read, think step by step, output only json', "# a\n## b\n1. c\n* d", "/home/u/p/x", "/home/u", "/home/user/x",
]
def pairs():
    T = F.col("t")
    return {
        "strip_text": X.strip(T), "collapse_text": X.collapse(T), "content_hash": X.content_hash(T), "flatten_content": X.flatten_content(T), "strip_reminders": X.strip_reminders(T), "echoes_command": X.echoes_command(T), "ide_request": X.ide_request(T), "parse_time": X.parse_time(T), "prompt_origin": X.origin(T), "machine_event": X.machine_event(T),
        "token_estimate": X.token_estimate(T), "prompt_tail": X.tail(T), "trigger_kind": triggers.trigger_kind(T), "model_tier": X.model_tier(T), "demand_tier": X.demand_tier(T), "word_count": X.word_count(T), "heading_count": X.heading_count(T), "list_count": X.list_count(T), "redirect_stub": X.redirect_stub(T), "snippet": X.snippet(T), "json_object_in": X.json_object(T),
        **{f"cue_{n}": X.has(n, T) for n in X.PATTERNS if n not in ("model_size", "reminder", "ide_request")},
    }


@pytest.fixture(scope="module")
def names(spark):
    return sql.register(spark)


def test_equal_the_column_functions(spark, names):
    each = pairs()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    both = rows.select("i", "t", *(F.expr(f"{n}(t)").alias(f"{n}_s") for n in each), *(c.alias(f"{n}_c") for n, c in each.items()))
    for r in both.collect():
        assert {n: r[f"{n}_s"] for n in each} == {n: r[f"{n}_c"] for n in each}, r["t"]


def test_of_numbers_times_and_paths(spark, names):
    values = spark.createDataFrame([(v, n) for v in (None, 0.1, 0.4, 0.69, 0.7, 1.0) for n in (0, 1, 2, 3)], "v double, n bigint")
    got = values.select(F.expr("score_band(v)"), X.score_band("v"), F.expr("score_label(v, n)"), X.score_label("v", "n")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)
    times = spark.createDataFrame([(None,), (0,), (5 * 86400,)], "s bigint").select(F.timestamp_seconds("s").alias("seen"), F.timestamp_seconds(F.lit(86400)).alias("now"))
    assert all(r[0] == r[1] for r in times.select(F.expr("staleness_days(seen, now)"), X.staleness_days("seen", F.col("now"))).collect())
    texts = spark.createDataFrame([(t, d) for t in TEXTS for d in (None, 90.0, 90.5)], "t string, d double")
    assert all(r[0] == r[1] for r in texts.select(F.expr("doc_flags(t, d)"), X.doc_flags("t", "d")).collect())
    for home in ("/home/u", "/home/u/"):
        assert all(r[0] == r[1] for r in texts.select(F.expr(f"display_path(t, '{home}')"), X.display_path("t", home)).collect())


def test_every_function_is_covered(spark, names):
    assert set(names) - set(pairs()) == {"score_band", "score_label", "model_size", "staleness_days", "doc_flags", "display_path"}


def test_no_python_in_the_plan(spark, names):
    plan = spark.sql("select model_tier(cast(id as string)), trigger_kind(cast(id as string)) from range(3)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
