"""The memory of the pipeline: batches and chunks are bounded by bytes, and small tables are written in few files."""

import glob
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from promptlake.llm import cluster, line_dedup, quality_rules

D = "/root/testdata/sf0.001"


def test_batches_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    rows = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('word ', 10000) as text")
    got = [r["n"] for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert sum(got) > 400 * 50_000 and max(got) < 2_000_000


def test_chunks_need_little_memory():
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(map(str, rng.integers(0, 1 << 20, 400))) for _ in range(1500)])
    quality_rules.text_counts(texts)
    tracemalloc.start()
    quality_rules.text_counts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000


def test_few_files_of_many_partitions(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    docs = spark.read.parquet(f"{D}/documents.parquet").repartition(60)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        most = cluster.few(docs)
        assert most < 20
        out = {}
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, D)
            docs.write.parquet(path := f"{tmp_path}/{name}")
            assert len(glob.glob(f"{path}/part-*")) <= most
            docs = spark.read.parquet(path)
            out[name] = docs.count()
        whole = spark.read.parquet(f"{D}/documents.parquet")
        spark.conf.set("spark.sql.shuffle.partitions", before)
        for name, stage in corpus_pipeline.STAGES:
            whole = stage(spark, whole, D).cache()
            assert whole.count() == out[name]
        # Places in the sequences must be ranked over all parts: no two pieces overlap.
        at = sorted((r["sequence_id"], r["offset"], r["length"]) for r in docs.collect())
        for (s, o, n), (t, p, _) in zip(at, at[1:], strict=False):
            assert p == (o + n if s == t else 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scratch_keeps_all_rows(spark):
    with cluster.Scratch(spark, 3) as scratch:
        got = scratch.cut(spark.range(0, 10_000, 1, 40))
        assert got.count() == 10_000 and len(got.inputFiles()) == 3
    assert line_dedup.dropped(spark.createDataFrame([(1, "a line of more than twenty characters")], "doc_id bigint, text string")).count() == 0
