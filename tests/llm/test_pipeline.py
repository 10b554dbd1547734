import corpus_pipeline
from promptlake.llm import queries

D = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "pack"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, D).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_names():
    assert {n.split("_")[0] for n in queries.QUERIES} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in queries.QUERIES
