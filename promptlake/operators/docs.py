"""Quality of project documents and the documents nearest to a working directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

LEVELS = 6


def measures(documents: DataFrame, now: Column, home: str) -> DataFrame:
    """One row of measures for each document (dir, name, text, last_commit)."""
    path = F.concat_ws("/", "dir", "name")
    rows = documents.withColumn("path", path).withColumn("stale_days", X.staleness_days("last_commit", now))
    return rows.select("path", "dir", "name", X.display_path("path", home).alias("shown"), X.word_count("text").alias("words"), X.heading_count("text").alias("headings"), X.list_count("text").alias("items"), X.redirect_stub("text").alias("redirect"), "stale_days", X.doc_flags("text", "stale_days").alias("flags"))


def _ancestors(cwd: Column, home: str) -> Column:
    """The directory and its parents, nearest first: at most LEVELS, not above home or the root."""
    parts = F.array_remove(F.split(cwd, "/"), "")
    n = F.size(parts)
    paths = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(n, F.lit(LEVELS - 1)))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), n - i)), "/")))
    home = home.rstrip("/")
    at_home = F.array_position(paths, home)
    return F.when(at_home > 0, F.slice(paths, F.lit(1), at_home.cast("int"))).otherwise(paths)


def nearest(cwds: DataFrame, documents: DataFrame, home: str) -> DataFrame:
    """(cwd, path, depth): the documents at the nearest ancestor that has any; path is null where none has."""
    dirs = cwds.select("cwd").distinct()
    steps = dirs.select("cwd", F.posexplode(_ancestors(F.col("cwd"), home)).alias("depth", "dir"))
    named = documents.where(F.col("name").isin(*X.DOC_NAMES)).select("dir", F.concat_ws("/", "dir", "name").alias("path")).distinct()
    hits = steps.join(named, "dir")
    first = hits.groupBy("cwd").agg(F.min("depth").alias("depth"))
    found = hits.join(first, ["cwd", "depth"]).select("cwd", "path", "depth")
    return dirs.join(found, "cwd", "left")


def summary(cwds: DataFrame, documents: DataFrame, home: str) -> DataFrame:
    near = nearest(cwds, documents, home)
    return near.agg(F.count_distinct("cwd").alias("cwds"), F.count_if(F.col("path").isNull()).alias("without_docs"), F.count_distinct("path").alias("docs"))
