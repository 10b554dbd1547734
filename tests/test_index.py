"""The stored index: what an addition writes, what a search reads, merges, and equality with a rebuild."""

import os

import pytest
from pyspark.sql import functions as F

from promptlake.operators import index, search

TEXTS = {i: f"common word{i % 7} the quick brown fox number{i} jumps {'again ' * (i % 4)}" for i in range(60)}


def docs(spark, ids):
    return spark.createDataFrame([(i, TEXTS[i]) for i in ids], "doc bigint, text string")


def listed(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted((r["term"], r["doc"], r["doc_len"], tuple(r["positions"]), r["tf"]) for r in df.collect())


def test_addition_writes_its_segment_alone(spark, tmp_path):
    path = str(tmp_path / "index")
    index.add(path, docs(spark, range(20)))
    before = {f: os.path.getmtime(f) for f in listed(f"{path}/segments")}
    index.add(path, docs(spark, range(20, 25)))
    after = listed(f"{path}/segments")
    assert set(before) < after and all(os.path.getmtime(f) == t for f, t in before.items())
    new = spark.read.option("basePath", f"{path}/segments").parquet(*(after - set(before)))
    assert {r["doc"] for r in new.select("doc").distinct().collect()} == set(range(20, 25))


def test_merged_equals_rebuilt(spark, tmp_path):
    path = str(tmp_path / "index")
    for lo in range(0, 60, 10):
        index.add(path, docs(spark, range(lo, lo + 10)))
    _, segments = index.live(spark, path)
    assert sorted(s["level"] for s in segments) == [0, 0, 1] and sum(s["docs"] for s in segments) == 60
    assert len(os.listdir(f"{path}/segments")) == 3
    got, stats = index.read(spark, path)
    assert rows(got) == rows(search.postings(docs(spark, range(60))))
    want = search.corpus_stats(docs(spark, range(60))).first()
    assert tuple(stats.first()) == (want["stats_n"], pytest.approx(want["avg_len"]))


def test_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    path = str(tmp_path / "index")
    index.add(path, docs(spark, range(60)))
    asked = spark.createDataFrame([(1, "quick brown fox number7"), (2, "no-such-thing here")], "query int, question string")
    got, stats = index.read(spark, path, asked)
    files = got.inputFiles()
    wanted = {r["b"] for r in asked.select(F.explode(search.terms("question")).alias("term")).select(index.bucket().alias("b")).distinct().collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(wanted) < index.BUCKETS
    assert {r["term"] for r in got.select("term").distinct().collect()} == {"quick", "brown", "fox", "number7"}
    assert files
    hits = search.search(got, stats, asked).collect()
    assert [(r["query"], r["doc"], r["way"]) for r in hits] == [(1, 7, "phrase")]


def test_unfinished_addition_is_not_read(spark, tmp_path):
    path = str(tmp_path / "index")
    index.add(path, docs(spark, range(5)))
    version, _ = index.live(spark, path)
    index._write(spark, path, index._gaps(search.postings(docs(spark, [9])), "bigint").withColumn("bucket", index.bucket()))
    os.makedirs(f"{path}/manifest/{version + 1}")
    assert index.live(spark, path)[0] == version
    assert {r["doc"] for r in index.read(spark, path)[0].select("doc").distinct().collect()} == set(range(5))


def test_empty_texts_count_as_documents(spark, tmp_path):
    path = str(tmp_path / "index")
    index.add(path, spark.createDataFrame([(1, ""), (2, "..."), (3, "one two")], "doc bigint, text string"))
    got, stats = index.read(spark, path)
    assert {r["doc"] for r in got.collect()} == {3}
    assert tuple(stats.first()) == (3, pytest.approx(2 / 3))


def counted(spark, df, column):
    """The frame, and an accumulator of the rows whose column was computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def look(x):
        seen.add(1)
        return x

    return df.withColumn(column, look(column)), seen


def test_addition_splits_each_text_once(spark, tmp_path):
    some, seen = counted(spark, docs(spark, range(40)), "text")
    index.add(str(tmp_path / "index"), some)
    assert seen.value == 40


def test_counts_of_terms_decode_no_positions(spark, tmp_path):
    path = str(tmp_path / "index")
    index.add(path, docs(spark, range(20)))
    got, _ = index.read(spark, path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" in plan(got)
    counts = got.groupBy("term").count()
    assert "Arrow" not in plan(counts) and "gaps" not in plan(counts)


def test_only_hits_get_snippets(spark):
    hits = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 1, 7)], "query int, rank int, doc bigint")
    snippets, seen = counted(spark, search.of_hits(docs(spark, range(60)), hits).select("doc", F.lit("2024-01-01").alias("day"), F.col("text").alias("snippet")), "snippet")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query int")
    got = {r["query"]: (r["n_hits"], r["answer"]) for r in search.fallback_answers(asked, hits, snippets).collect()}
    assert got == {1: (2, f"- [2024-01-01] (7) {TEXTS[7]}\n- [2024-01-01] (8) {TEXTS[8]}"), 2: (1, f"- [2024-01-01] (7) {TEXTS[7]}"), 3: (0, search.NOTHING)}
    assert seen.value == 2


def test_gaps_and_places_agree(spark, tmp_path):
    path = str(tmp_path / "index")
    index.add(path, spark.createDataFrame([(1, "b a b b c " + "a " * 500), (2, "b"), (3, None)], "doc bigint, text string"))
    got, _ = index.read(spark, path)
    assert rows(got) == rows(search.postings(spark.createDataFrame([(1, "b a b b c " + "a " * 500), (2, "b")], "doc bigint, text string")))
