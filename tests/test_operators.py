"""Cases of the operators with exact results."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from promptlake.functions import text as X
from promptlake.operators import docs, infer, ingest, metrics, search, triggers
from promptlake.sources import readers
from promptlake.streaming import streams


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("model", "tier"),
    [(None, None), ("", None), ("copilot/auto", None), ("claude-haiku-4-5", "small"), ("Sonnet", "medium"), ("opus-70b", "large"), ("llama3:8b", "small"), ("qwen3-coder-30b", "medium"), ("x-70b", "large"), ("gpt-5-codex", None), ("9bx", None)],
)
def test_model_tier(spark, model, tier):
    assert one(spark, X.model_tier(), model=model) == tier


@pytest.mark.parametrize(("said", "found"), [("a ```json\n{\"x\": 1}\n``` b", '{"x": 1}'), ("so {\"y\":2} end", '{"y":2}'), ("none", None), ("{bad}", None), (None, None)])
def test_json_object(spark, said, found):
    assert one(spark, X.json_object("s"), s=said) == found


def test_cue_needs_a_word_after_it(spark):
    assert one(spark, X.has("example", "s"), s="e.g. this") is False
    assert one(spark, X.has("example", "s"), s="For example this") is True


def test_relative_times():
    assert X.since("7d", 1_000_000) == 1_000_000 - 7 * 86400
    assert X.since("3m", 10_000_000) == 10_000_000 - 90 * 86400
    assert X.since("2024-01-02", 0) == 1704153600


def test_accents_map_one_to_one():
    assert len(search.ACCENTED) == len(search.PLAIN)


def sequential(rows):
    seen_rows, seen_texts, out = set(), set(), []
    for r in sorted(rows, key=lambda r: r[-1]):
        a, b = r[:3], r[3:5]
        if a not in seen_rows and b not in seen_texts:
            seen_rows.add(a)
            seen_texts.add(b)
            out.append(r[-1])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_two_key_dedupe_is_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [("s", f"s{rng.randrange(4)}", f"r{rng.randrange(6)}", f"h{rng.randrange(6)}", rng.randrange(5), i) for i in range(60)]
    df = spark.createDataFrame(rows, "source string, session_id string, message_ref string, content_hash string, timestamp bigint, ord bigint")
    got = [r["ord"] for r in ingest.dedupe_two_key(df, "ord").collect()]
    assert sorted(got) == sequential(rows)


def test_two_key_dedupe_of_nothing(spark):
    df = spark.createDataFrame([], "source string, session_id string, message_ref string, content_hash string, timestamp bigint, ord bigint")
    assert ingest.dedupe_two_key(df, "ord").count() == 0


def test_first_message_ratio(spark):
    rows = [("a", "s1", "1", "x" * 300, 1, "human"), ("a", "s1", "2", "y" * 100, 2, "human"), ("a", "s2", "1", "z" * 100, 3, "human")]
    p = spark.createDataFrame(rows, "source string, session_id string, message_ref string, content string, t bigint, origin string").withColumn("timestamp", F.timestamp_seconds("t"))
    m = {r["segment"]: r for r in metrics.style_metrics(p).collect()}
    assert set(m) == {"human", "overall"}
    assert m["human"]["first_message_ratio"] == pytest.approx(0.875)
    assert m["human"]["refinement_rate"] == 0.5
    assert m["human"]["median_tokens"] == 25.0


def test_nearest_docs_stop_at_home_and_six_levels(spark):
    d = spark.createDataFrame([("/h/u", "CLAUDE.md"), ("/h", "README.md"), ("/h/u/a/b", "AGENTS.md"), ("/h/u/z", "notes.md")], "dir string, name string")
    c = spark.createDataFrame([("/h/u/a/b/c",), ("/h/u/q",), ("/h/u/1/2/3/4/5/6",), ("/h/u/z",)], "cwd string")
    got = {r["cwd"]: r["path"] for r in docs.nearest(c, d, "/h/u").collect()}
    assert got == {"/h/u/a/b/c": "/h/u/a/b/AGENTS.md", "/h/u/q": "/h/u/CLAUDE.md", "/h/u/1/2/3/4/5/6": None, "/h/u/z": "/h/u/CLAUDE.md"}


def test_failed_batch_voids_all_judged_scores(spark):
    rows = [("s", "1", f"r{i}", "x" * (50 + i), "human", i + 1) for i in range(6)]
    b = infer.batches(spark.createDataFrame(rows, "source string, session_id string, message_ref string, content string, origin string, sample_pos int").withColumns({"timestamp": F.timestamp_seconds("sample_pos"), "content_hash": F.sha2("content", 256)}), 3)
    keys = infer.batch_keys(b)
    asked = infer.prompt_blocks(b).join(keys, "batch").select("key", "block")
    good = infer.infer(asked, infer.stub_judge)
    assert infer.judge_scores(b, keys, good).count() == 24

    def bad(blocks):
        return ["no json" if "x" * 53 in x else y for x, y in zip(blocks, infer.stub_judge(blocks), strict=True)]

    answers = infer.infer(asked, bad)
    assert {r["status"] for r in answers.collect()} == {"ok", "failed"}
    assert infer.judge_scores(b, keys, answers).count() == 0


def test_one_shot_pass():
    import pandas as pd

    rows = pd.DataFrame({"kind": ["submit", "consume", "submit", "submit", "consume", "consume"], "triggered": [True, False, True, True, False, False]})
    assert triggers.fold_rewrites(rows) == ["blocked", "consumed", "passed", "blocked", "consumed", "nothing"]


def test_readers_skip_what_does_not_fit(spark, tmp_path):
    lines = [("f", i, v) for i, v in enumerate(["[]", "7", "{torn", '{"type":"user"}', '{"type":"user","origin":3,"message":"x"}', ""])]
    df = spark.createDataFrame(lines, "file string, line_no bigint, value string")
    for reader in (readers.transcripts, readers.rollouts, readers.patch_logs):
        assert reader(df).count() == 0
    assert readers.line_counts(df).first()["malformed"] == 4


def test_files_keep_line_order(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(f"line {i}" for i in range(50)))
    got = readers.read_lines(spark, f"{tmp_path}/*.jsonl").orderBy("line_no").collect()
    assert [r["value"] for r in got] == [f"line {i}" for i in range(50)]


def test_zip_and_routing(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("x/conversations.json", '[{"id":"c","mapping":{"n":{"message":{"author":{"role":"user"},"content":{"content_type":"text","parts":["hi "]}}}}}]')
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    raw = spark.read.format("binaryFile").load(f"{tmp_path}/*.zip")
    files = readers.route(readers.unzip(raw))
    assert [r["kind"] for r in files.collect()] == ["export"]
    p = readers.exports(files).first()
    assert (p["session_id"], p["message_ref"], p["content"], p["timestamp"].year) == ("c", "n", "hi", 1970)


def test_unknown_source_is_an_error(spark):
    with pytest.raises(ValueError, match="nope"):
        readers.enabled(spark.createDataFrame([("a",)], "source string"), ["nope"], ("a",))


def test_stream_ingest_equals_batch(spark, tmp_path):
    kind = "source string, session_id string, message_ref string, content_hash string, timestamp bigint, ord bigint"
    rows = [("s", "1", f"r{i % 7}", f"h{i % 5}", i % 3, i) for i in range(40)]
    for n, part in enumerate((rows[:20], rows[20:])):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.read_prompts(spark, f"{tmp_path}/in", spark.createDataFrame([], kind).schema)
        streams.ingest_stream(stream, f"{tmp_path}/table", f"{tmp_path}/state", "ord")
    got = sorted(r["ord"] for r in spark.read.parquet(f"{tmp_path}/table").collect())
    assert got == sequential(rows)


def test_words_are_counted_without_a_list(spark):
    texts = ["", "  ", "a", " a\u00a0b\u2003c\n", "no end ", "w " * 200, "# h\n" + "w " * 200, "see README.md", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", X.word_count("t").alias("n"), X.doc_flags("t", F.lit(91.0)).alias("f")).orderBy("i").collect()
    assert [r["n"] for r in got] == [0, 0, 1, 3, 2, 200, 202, 2, None]
    assert [r["f"][:-1] for r in got] == [["sparse"]] * 5 + [["unstructured"], [], [], []]
    plan = rows.select(X.doc_flags("t", F.lit(91.0)).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("S+") == 2 and "split(" not in plan
