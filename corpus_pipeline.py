"""The corpus pipeline: quality rules, line dedup, near dedup, decontamination and packing.

Each stage works on all that its predecessor kept. All but the last return the columns
of documents; the last returns the packed pieces. ``run`` writes every stage as Parquet in the
cluster's shared folder, reads it again for the next one and deletes it when that is written.

Small tables stay in few parts, so that a stage writes no more files than its documents need.
Extra columns of the documents, whatever their names, pass through all stages but the last.
Rows without doc_id are documents of their own that no other stands for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from promptlake.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from promptlake.llm.cluster import checkpoint_dir, few, remove, table
from promptlake.session import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far off their language and source go."""
    prepare(spark)
    return quality_rules.kept_documents(docs.coalesce(few(docs)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text."""
    most = few(docs)
    return line_dedup.kept_lines(docs.coalesce(most)).coalesce(most)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    most = few(docs)
    return near_dedup.one_of_each(docs.coalesce(most), k=5, percent=80).coalesce(most)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs.coalesce(few(docs)), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left."""
    import public_tokenizers

    return packing.pack(docs.coalesce(few(docs)), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("decontaminate", benchmark), ("pack", pack)]

#: Robust estimates, signatures and tokenizers have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    home = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{home}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
