"""The reduce of digests in one and in many rounds, and rewrites with the context of each prompt."""

import json

import pytest
from pyspark.sql import functions as F

from promptlake.operators import infer, triggers

MEMO = "key string, payload string"


def digests(spark, n):
    said = [json.dumps({"topics": [{"topic": f"t{i % 3}", "share": i / (2 * n)}], "patterns": [f"p{i % 7}"]}) for i in range(n)]
    return spark.createDataFrame([(s, "ok") for s in said], "payload string, status string")


class Counted:
    """The stub, with the blocks it was asked left in files: it runs in the workers."""

    def __init__(self, path):
        self.path = str(path)

    def __call__(self, blocks):
        import uuid
        from pathlib import Path

        for b in blocks:
            Path(self.path, uuid.uuid4().hex).write_text(b)
        return infer.stub_reduce(blocks)


def report(spark, merged):
    return sorted((r["part"], r["rank"], r["item"], r["share"]) for r in infer.pattern_report(merged).collect())


def test_rounds_say_the_same_as_one(spark, tmp_path):
    one, _ = infer.reduce_patterns(digests(spark, 120), spark.createDataFrame([], MEMO), infer.stub_reduce)
    ask = Counted(tmp_path)
    many, memo = infer.reduce_patterns(digests(spark, 120).repartition(7), spark.createDataFrame([], MEMO), ask, limit=2400)
    assert report(spark, many) == report(spark, one)
    blocks = [p.read_text() for p in tmp_path.iterdir()]
    assert len(blocks) > 3 and max(map(len, blocks)) <= 2400 and memo.count() == len(blocks)
    # All digests took part in the first round, and nothing is asked again, whatever the order of the rows.
    assert sum(b.count('"patterns"') for b in blocks if '"strengths"' not in b) == 120
    again = Counted(tmp_path / "again")
    (tmp_path / "again").mkdir()
    other, none = infer.reduce_patterns(digests(spark, 120).orderBy(F.desc("payload")), memo, again, limit=2400)
    assert report(spark, other) == report(spark, one) and not list((tmp_path / "again").iterdir())


def test_many_long_digests_end(spark):
    """Long texts are cut, and every round has fewer: the reduce ends, also where no text fits beside another."""
    long = spark.range(40).select(F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 900), F.col("id").cast("string"), F.lit('"}')).alias("payload"), F.lit("ok").alias("status"))
    answer = json.dumps({"a": "y" * 900})
    got, _ = infer.reduce_patterns(long, spark.createDataFrame([], MEMO), lambda blocks: [answer] * len(blocks), limit=800)
    assert got.first()["status"] == "ok"


def test_failed_and_no_digests(spark):
    memo = spark.createDataFrame([], MEMO)
    some = digests(spark, 3)
    failed = some.unionByName(spark.createDataFrame([(None, "failed")], "payload string, status string"))
    status = lambda df, judge=infer.stub_reduce: tuple(infer.reduce_patterns(df, memo, judge)[0].first())
    assert status(failed) == ("failed", None)
    assert status(some.limit(0)) == ("none", None)
    assert status(some, lambda blocks: [None] * len(blocks)) == ("failed", None)
    assert infer.pattern_report(infer.reduce_patterns(some.limit(0), memo, infer.stub_reduce)[0]).count() == 0


def test_report_coerces_its_lists(spark):
    said = {"strengths": ["a", {"pattern": "b"}, 3, {"x": 1}], "growth_areas": "none", "topics": [{"topic": "low", "share": -1}, {"topic": "bad", "share": "x"}, {"topic": "high", "share": 7}]}
    got = report(spark, spark.createDataFrame([(json.dumps(said),)], "payload string"))
    assert got == [("strengths", 1, "a", None), ("strengths", 2, "b", None), ("topics", 1, "high", 1.0), ("topics", 2, "low", 0.0), ("topics", 3, "bad", 0.0)]


PROMPT = "source string, session_id string, message_ref string, content string, origin string, cwd string, s bigint"
BROAD = "improve everything"


@pytest.fixture(scope="module")
def contexts(spark):
    data = [
        ("a", "s", "1", "first " + "x" * 400, "human", "/h/p/src", 1), ("a", "s", "2", BROAD, "human", "/h/p/src", 2), ("a", "s", "3", "TASK: it", "machine", "/h/p/src", 3), ("a", "s", "4", f" {BROAD}\n", "human", "/h/p/src", 4), ("a", "s", "5", "fifth", "human", "/h/p/src", 5), ("a", "s", "6", "sixth", "human", "/h/p/src", 6),
        ("a", "s", "7", f"{BROAD}!", "human", "/h/p/src", 7), ("b", "s", "1", BROAD, "human", None, 1), ("a", "t", "1", BROAD, "human", "/h/q", 1), ("a", "u", "1", BROAD, "human", "", 1),
    ]
    prompts = spark.createDataFrame(data, PROMPT).withColumn("timestamp", F.timestamp_seconds("s"))
    documents = spark.createDataFrame([("/h/p", "CLAUDE.md", "See AGENTS.md"), ("/h/p", "AGENTS.md", "  Rules. " + "r" * 2000), ("/h/p", "README.md", "Readme text"), ("/h", "CLAUDE.md", "Home"), ("/h/q", "README.md", " \n"), ("/h/p", "notes.md", "no")], "dir string, name string, text string")
    return triggers.rewrite_context(prompts, documents, "/h").cache()


def test_context_of_every_prompt(contexts):
    got = {(r["source"], r["session_id"], r["message_ref"]): r["context"] for r in contexts.collect()}
    doc = "Project doc (AGENTS.md, excerpt):\nRules. " + "r" * 1493
    head, before = f"Working directory: /h/p/src\n\n{doc}", "\n\nEarlier prompts this session (newest first):\n- "
    first = ("first " + "x" * 400)[:300]
    assert got == {
        ("a", "s", "1"): head, ("a", "s", "2"): head + before + first, ("a", "s", "4"): head + before + first, ("a", "s", "7"): head + before + f"sixth\n- fifth\n- {BROAD}",
        ("b", "s", "1"): None, ("a", "t", "1"): "Working directory: /h/q", ("a", "u", "1"): None,
    }


def test_rewrites(spark, contexts):
    said = {"/h/q": json.dumps({"rewritten_prompt": " better\n"}), "sixth": json.dumps({"rewritten_prompt": 5}), "SESSION": "no json"}
    judge = lambda blocks: [next((a for mark, a in said.items() if mark in b), json.dumps({"rewritten_prompt": "plain"})) for b in blocks]
    got = {(r["source"], r["session_id"], r["message_ref"]): r["rewrite"] for r in triggers.rewrites(contexts, spark.createDataFrame([], MEMO), judge).collect()}
    assert got == {("a", "s", "1"): None, ("a", "s", "2"): None, ("a", "s", "4"): None, ("a", "s", "7"): None, ("b", "s", "1"): "plain", ("a", "t", "1"): "better", ("a", "u", "1"): "plain"}
    assert triggers.rewrites(contexts, spark.createDataFrame([], MEMO), None).where("rewrite is not null").count() == 0
