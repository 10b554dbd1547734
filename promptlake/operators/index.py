"""A stored full-text index: segments of postings by term bucket, merged by size, of which a question reads its terms' buckets.

    segments/segment=<id>/bucket=<n>   postings (term, doc, doc_len, gaps, tf); gaps: differences of the positions
    manifest/<version>                 the live segments (segment, level, docs, words)

Adding documents writes one segment with their postings only. ``FAN`` segments of a level are
merged to one of the next, so a posting is rewritten about log(n) / log(FAN) times and a
search opens few segments. A new manifest is written before merged segments are deleted; what a
failed run leaves behind is in no manifest. One writer at a time. A document is added once.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import search

BUCKETS, FAN = 64, 4
TERMS_BOUND = 100_000
_POSTING = "term string, doc {}, doc_len int, gaps array<int>, tf int"
_LIVE = "segment string, level int, docs bigint, words bigint, kind string"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.sc().hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def live(spark: SparkSession, path: str) -> tuple[int, list]:
    """The manifest's version (0: none yet) and its segments; a folder without Spark's mark of success does not count."""
    fs, at = _fs(spark, f"{path}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = [int(n) for n in names if n.isdigit() and fs.exists(_fs(spark, f"{path}/manifest/{n}/_SUCCESS")[1])]
    if not done:
        return 0, []
    return max(done), spark.read.schema(_LIVE).parquet(f"{path}/manifest/{max(done)}").orderBy("segment").collect()


def _publish(spark: SparkSession, path: str, version: int, segments: list[tuple]) -> None:
    spark.createDataFrame(segments, _LIVE).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{version}")


def bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _write(spark: SparkSession, path: str, rows: DataFrame) -> str:
    """Rows of a segment, in order of their terms; a large bucket goes over several files.

    Rows are dealt by their bucket, not by ranges: these would need a sample, for which all texts are split a second time.
    """
    name = uuid.uuid4().hex
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(f"{path}/segments/segment={name}")
    return name


def _gaps(postings: DataFrame, kind: str) -> DataFrame:
    """The positions as differences, by expressions alone: every posting passes here, and would go to Python and back once more."""
    place = F.col("positions")
    gaps = F.when(F.size(place) == 1, place).otherwise(F.transform(place, lambda p, i: p - F.when(i == 0, 0).otherwise(F.get(place, i - 1))))
    return postings.select("term", F.col("doc").cast(kind).alias("doc"), "doc_len", gaps.alias("gaps"), "tf")


@F.arrow_udf(ArrayType(IntegerType()))
def _places(lists: pa.Array) -> pa.Array:
    flat, size = lists.flatten().to_numpy().astype(np.int64), lists.value_lengths().to_numpy()
    total = np.concatenate([[0], np.cumsum(flat)])
    before = total[np.cumsum(size) - size]
    places = total[1:] - np.repeat(before, size)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(places.astype(np.int32)))


def _positions(rows: DataFrame) -> DataFrame:
    """Positions are a column, so what asks for none does not read them."""
    return rows.select("term", "doc", "doc_len", _places("gaps").alias("positions"), "tf")


def add(path: str, docs: DataFrame, key: str = "doc", text: str = "text") -> None:
    """Writes a segment of new documents (key, text) and merges levels that are full."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    name = _write(spark, path, _gaps(search.postings(docs, key, text), kind).withColumn("bucket", bucket()))
    words = _segments(spark, path, [name], kind).agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("bigint")).first()[0]
    version, segments = live(spark, path)
    segments = [*map(tuple, segments), (name, 0, docs.count(), words, kind)]
    _publish(spark, path, version + 1, segments)
    version += 1
    while (level := _full(segments)) is not None:
        old = [s for s in segments if s[1] == level]
        merged = _write(spark, path, _segments(spark, path, [s[0] for s in old], kind))
        segments = [*(s for s in segments if s[1] != level), (merged, level + 1, sum(s[2] for s in old), sum(s[3] for s in old), kind)]
        version += 1
        _publish(spark, path, version, segments)
        for s in old:
            _delete(spark, f"{path}/segments/segment={s[0]}")


def _full(segments: list[tuple]) -> int | None:
    """The least level with FAN segments."""
    levels = [s[1] for s in segments]
    return next((lv for lv in sorted(set(levels)) if levels.count(lv) >= FAN), None)


def _segments(spark: SparkSession, path: str, names: list[str], kind: str) -> DataFrame:
    rows = spark.read.schema(_POSTING.format(kind) + ", segment string, bucket int").option("basePath", f"{path}/segments").parquet(*(f"{path}/segments/segment={n}" for n in names))
    return rows.select("term", "doc", "doc_len", "gaps", "tf", "bucket")


def read(spark: SparkSession, path: str, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (term, doc, doc_len, positions, tf) and corpus numbers (stats_n, avg_len). queries: only what these questions need.

    Only the buckets of the asked terms are read, and in them only the files and row groups that can hold one.
    """
    _, segments = live(spark, path)
    if not segments:
        raise FileNotFoundError(f"no index at {path}")
    kind = segments[0]["kind"]
    rows = _segments(spark, path, [s["segment"] for s in segments], kind)
    if queries is not None:
        asked = queries.select(F.explode(search.terms("question")).alias("term")).distinct()
        wanted = [r["b"] for r in asked.select(bucket().alias("b")).distinct().collect()]  # at most BUCKETS
        small = asked.limit(TERMS_BOUND + 1).count() <= TERMS_BOUND
        rows = rows.where(F.col("bucket").isin(wanted)).join(F.broadcast(asked) if small else asked, "term", "left_semi")
    docs, words = sum(s["docs"] for s in segments), sum(s["words"] for s in segments)
    stats = spark.range(1).select(F.lit(docs).cast("bigint").alias("stats_n"), F.lit(words / docs if docs else 0.0).alias("avg_len"))
    return _positions(rows), stats
