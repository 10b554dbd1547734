"""Imports of files of mixed formats, of lists of any size and of all sources into the prompt table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..schema import TIE
from ..sources import readers

#: What reads each kind of file, and the source its prompts are of.
READERS = {"export": ("chatgpt", readers.exports), "sessions": ("json-import", readers.json_sessions)}


def import_files(files: DataFrame, target: str, keys: str, n: int, archives: DataFrame | None = None) -> DataFrame:
    """Appends the prompts of files (file, value) and of zipped exports (path, content) as batch n; counts by source.

    (source, files, scanned, added, deduped); source is null for files that are no JSON list, which
    give no prompt. Of rows that share a key the first goes in: exports before session lists, then by
    name of file and place in it. What earlier batches brought is not added again.
    """
    every = files.select("file", "value")
    if archives is not None:
        every = every.unionByName(readers.unzip(archives).select("file", "value"))
    routed = ingest.cut(readers.route(every).repartitionByRange("file").sortWithinPartitions("file"))
    return _append(routed, [f(routed.where(F.col("kind") == kind)) for kind, (_, f) in READERS.items()], F.count("*"), target, keys, n)


def import_lists(spark: SparkSession, glob: str, target: str, keys: str, n: int) -> DataFrame:
    """The same of a folder's exports and session lists of any size: an entry is a row, a file is never held whole.

    Files without an entry, among them those that are no JSON list, are counted under a null source.
    """
    items = ingest.cut(readers.route_items(readers.list_items(spark, glob)).repartitionByRange("file", "nth").sortWithinPartitions("file", "nth"))
    read = [f(items.where(F.col("kind") == kind)) for kind, f in (("export", readers.export_items), ("sessions", readers.session_items))]
    told = _append(items, read, F.count_if(F.col("nth") == 0), target, keys, n)
    # Only names are listed, no content is read.
    every = spark.read.format("binaryFile").load(glob).agg(F.count("path").alias("files"))
    rest = every.select((F.col("files") - F.lit(items.where("nth = 0").count())).alias("files")).where("files > 0")
    return told.unionByName(rest.selectExpr("cast(null as string) as source", "files", "0L as scanned", "0L as added", "0L as deduped"))


def _append(routed: DataFrame, read: list[DataFrame], files: Column, target: str, keys: str, n: int) -> DataFrame:
    """Appends what was read of routed files; the counts of both by source."""
    # Readers keep the order of the files and of what is in them, so the numbers follow it.
    batch = ingest.cut(read[0].unionByName(read[1]).withColumn("_order", F.monotonically_increasing_id()))
    told = ingest.append_batch(batch, target, keys, n, "_order")
    source = F.coalesce(*(F.when(F.col("kind") == kind, name) for kind, (name, _) in READERS.items()))
    seen = routed.groupBy(source.alias("source")).agg(files.alias("files"))
    return seen.join(told, "source", "left").select("source", "files", _count("scanned"), _count("added"), _count("deduped"))


def _count(c: str) -> Column:
    return F.coalesce(c, F.lit(0)).alias(c)


def import_sources(spark: SparkSession, sources: list[tuple[str, object]], landing: str, target: str, keys: str, n: int) -> DataFrame:
    """Lands sources, given as (name, function), each by a job of its own, and appends what landed as batch n.

    (source, state, scanned, added, deduped, reason) of every source, failed ones too: these give no
    row, and the others go in. Of rows that share a key the first goes in: by place of the source, then oldest first.
    """
    states = ingest.cut(readers.land(spark, sources, landing))
    names = [r["source"] for r in states.where("state = 'read'").collect()]  # a row for each source
    if not names:
        return states.selectExpr("source", "state", "0L as scanned", "0L as added", "0L as deduped", "reason")
    rank = F.coalesce(*(F.when(F.col("source") == name, i) for i, name in enumerate(names)))
    order = ["_rank", "timestamp", *TIE]
    rows = spark.read.option("basePath", landing).parquet(*(f"{landing}/source={name}" for name in names)).withColumn("_rank", rank)
    rows = ingest.cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_order", F.monotonically_increasing_id()))
    told = ingest.append_batch(rows.drop("_rank"), target, keys, n, "_order")
    return states.drop("scanned").join(told, "source", "left").select("source", "state", _count("scanned"), _count("added"), _count("deduped"), "reason")
