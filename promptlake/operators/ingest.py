"""Incremental ingest: two-key first-wins de-duplication, manifests, watermarks and memo tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROW_KEY = ("source", "session_id", "message_ref")
TEXT_KEY = ("content_hash", "timestamp")
#: A round accepts at least every key's first row; only chains of alternating keys need many.
ROUNDS = 200


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut through the cluster's shared checkpoint folder (a folder of our own only where none is set and the master is local)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="promptlake-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def _first(key: tuple[str, ...], order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*key).orderBy(order)) == 1


def dedupe_fork(rows: DataFrame, order: Column) -> DataFrame:
    """First row of each text and time, whatever its session."""
    return rows.withColumn("_first", _first(TEXT_KEY, order)).where("_first").drop("_first")


def dedupe_two_key(rows: DataFrame, order: str) -> DataFrame:
    """The rows a sequential insert-or-ignore under both keys would accept, in order of a unique column.

    A row is dropped if either of its keys is held by an accepted earlier row. Each round
    accepts the rows that come first under both keys and removes every row that shares a key
    with them; what is left goes to the next round. Only keys and the order column take part
    in the rounds; the lineage is cut between them. Nulls in a key are equal to each other.
    """
    keys = cut(rows.select(*ROW_KEY, *TEXT_KEY, order))
    accepted = None
    for _ in range(ROUNDS):
        by = F.col(order)
        marked = keys.withColumn("_both", _first(ROW_KEY, by) & _first(TEXT_KEY, by))
        won = cut(marked.where("_both").drop("_both"))
        accepted = won.select(order) if accepted is None else accepted.unionByName(won.select(order))
        keys = cut(_without(_without(keys, won, ROW_KEY), won, TEXT_KEY))
        if keys.isEmpty():
            return rows.join(accepted, order, "left_semi")
    raise RuntimeError(f"rows left after {ROUNDS} rounds of de-duplication; is {order} unique?")


def _without(rows: DataFrame, held: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The rows whose key, nulls included, is not in held."""
    names = [f"_held{i}" for i in range(len(key))]
    other = held.select(*(F.col(c).alias(n) for c, n in zip(key, names, strict=True)))
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(key, names, strict=True)]
    return rows.join(other, on, "left_anti")


def insert_ignore(target: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """The rows of batch that go into target: both keys new there, and accepted within the batch."""
    return dedupe_two_key(_without(_without(batch, target, ROW_KEY), target, TEXT_KEY), order)


#: Fixed for a table's life: folders of row keys, by source and session.
KEY_BUCKETS = 4096
#: The day of rows without a time.
NO_DAY = -1_000_000


def _bucketed(rows: DataFrame) -> dict[str, DataFrame]:
    """The two keys of rows, each with the folder it is kept in: row keys by a hash of source and session, text keys by day."""
    day = F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / 86400)
    return {
        "row_keys": rows.select(*ROW_KEY, F.pmod(F.xxhash64("source", "session_id"), F.lit(KEY_BUCKETS)).alias("folder")),
        "text_keys": rows.select(*TEXT_KEY, F.coalesce(day, F.lit(NO_DAY)).cast("bigint").alias("folder")),
    }


#: A folder with more rows than this is written by several tasks.
FOLDER_ROWS = 1_000_000


def _dealt(rows: DataFrame, *names: str) -> DataFrame:
    """Rows dealt by folder to a fixed number of tasks: the time goes into the many folders, and a rebalance by size would leave a small batch's to one task.

    Of large folders only the numbers come to the driver; their rows (keys: names) go to several tasks.
    """
    large = [r["folder"] for r in rows.groupBy("folder").count().where(F.col("count") > FOLDER_ROWS).collect()]
    part = F.when(F.col("folder").isin(large), F.pmod(F.xxhash64(*names), F.lit(64))).otherwise(0) if large else F.lit(0)
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "folder", part)


def write_keys(rows: DataFrame, keys: str, n: int) -> None:
    """Both keys of rows as batch n of the key tables; written again, the batch's folders are replaced."""
    for name, some in _bucketed(rows).items():
        spread = _dealt(some.withColumn("batch", F.lit(n).cast("bigint")), *(ROW_KEY if name == "row_keys" else TEXT_KEY))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder", "batch").parquet(f"{keys}/{name}")


def held_keys(batch: DataFrame, keys: str, n: int) -> dict[str, DataFrame]:
    """What batches before n left in the folders that this batch's keys fall into. Other folders are neither read nor listed.

    Of the batch only its folder numbers come to the driver: at most KEY_BUCKETS of the one kind, its days of the other.
    """
    spark, out = batch.sparkSession, {}
    for name, some in _bucketed(batch).items():
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{keys}/{name}")
        fs = root.getFileSystem(spark._jsc.sc().hadoopConfiguration())
        there = {f.getPath().getName() for f in fs.listStatus(root)} if fs.exists(root) else set()
        hit = [f"{keys}/{name}/{d}" for d in sorted(f"folder={r['folder']}" for r in some.select("folder").distinct().collect()) if d in there]
        kind = some.withColumn("batch", F.lit(n).cast("bigint"))
        old = spark.read.schema(kind.schema).option("basePath", f"{keys}/{name}").parquet(*hit) if hit else kind.limit(0)
        out[name] = old.where(F.col("batch") < n)
    return out


def append_batch(batch: DataFrame, target: str, keys: str, n: int, order: str) -> DataFrame:
    """Inserts the rows of batch n whose keys are both new into a table by source; tells rows scanned, added and deduped by source.

    The keys are looked up in their folders, so the work grows with the batch and the sessions and
    days it touches, not with the history. Numbers of batches rise; a batch that is repeated after
    a failure meets only the batches before it and replaces what it wrote, so it lands once.
    A table from elsewhere is made known by write_keys(rows, keys, -1).
    """
    batch = cut(batch)
    held = held_keys(batch, keys, n)
    fresh = _without(_without(batch, held["row_keys"], ROW_KEY), held["text_keys"], TEXT_KEY)
    added = cut(dedupe_two_key(fresh, order))
    write_keys(added, keys, n)
    rows = added.withColumn("batch", F.lit(n).cast("bigint")).hint("rebalance", "source")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "batch").parquet(target)
    return ingest_stats(batch, added)


def merge_keys(spark: SparkSession, keys: str, n: int, least: int = 2) -> int:
    """Merges the files that batches before n left in a key folder into one set, where there are at least so many of them; tells the folders merged.

    Call it between batches: batch n and later ones are left alone, so a repeated batch n still meets
    only the ones before it. The merged keys are written before the old ones go: after a failure
    between the two, keys are there twice, which changes no answer, and the next call ends the work.
    Only names of folders come to the driver.
    """
    merged = 0
    for name in ("row_keys", "text_keys"):
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{keys}/{name}")
        fs = root.getFileSystem(spark._jsc.sc().hadoopConfiguration())
        batches = lambda at: [p for f in fs.listStatus(at) if (p := f.getPath()).getName().startswith("batch=") and int(p.getName()[6:]) < n]
        folders = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("folder=")] if fs.exists(root) else []
        old = [got for f in folders if len(got := batches(f)) >= least]
        if not old:
            continue
        merged += len(old)
        key = ROW_KEY if name == "row_keys" else TEXT_KEY
        rows = spark.read.option("basePath", f"{keys}/{name}").parquet(*(p.toString() for some in old for p in some))
        # A number below all batches and of this call alone, so that no folder that is read is written.
        low = min(int(p.getName()[6:]) for some in old for p in some)
        new = rows.select(*key, "folder").distinct().withColumn("batch", F.lit(min(low, -1) - 1).cast("bigint"))
        _dealt(new, *key).write.mode("append").partitionBy("folder", "batch").parquet(f"{keys}/{name}")
        for some in old:
            for p in some:
                fs.delete(p, True)
    return merged


def ingest_stats(batch: DataFrame, added: DataFrame) -> DataFrame:
    """Rows scanned, added and dropped as duplicates, by source."""
    seen = batch.groupBy("source").agg(F.count("*").alias("scanned"))
    new = added.groupBy("source").agg(F.count("*").alias("added"))
    out = seen.join(new, "source", "left").withColumn("added", F.coalesce("added", F.lit(0)))
    return out.withColumn("deduped", F.col("scanned") - F.col("added"))


def changed_files(listing: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files of a listing (path, mtime, size) that are new or differ from the manifest (force: all); they are read again whole."""
    if force:
        return listing
    return listing.join(manifest.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def merge_manifest(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """One row a path (path, mtime, size, run_ts): that of the latest run."""
    both = manifest.unionByName(listing)
    return both.groupBy("path").agg(F.max_by(F.struct("mtime", "size", "run_ts"), "run_ts").alias("r")).select("path", "r.*")


def watermark_increment(rows: DataFrame, marks: DataFrame, force: bool = False) -> DataFrame:
    """Rows at or after their source's high mark (milliseconds; sources without a mark, or with force all, are read whole)."""
    if force:
        return rows
    floor = F.timestamp_millis(F.floor(F.unix_micros("high_ts") / 1000).cast("bigint"))
    at = marks.select("source", floor.alias("_floor"))
    return rows.join(at, "source", "left").where(F.col("_floor").isNull() | (F.col("timestamp") >= F.col("_floor"))).drop("_floor")


def late_counts(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """(source, late): the rows before their source's high mark, which the increment does not read."""
    floor = F.timestamp_millis(F.floor(F.unix_micros("high_ts") / 1000).cast("bigint"))
    both = rows.select("source", "timestamp").join(marks.select("source", floor.alias("_floor")), "source", "left")
    return both.groupBy("source").agg(F.count_if(F.col("timestamp") < F.col("_floor")).alias("late"))


def raise_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    new = rows.groupBy("source").agg(F.max("timestamp").alias("high_ts"))
    return marks.select("source", "high_ts").unionByName(new).groupBy("source").agg(F.max("high_ts").alias("high_ts"))


def memo_latest(memo: DataFrame) -> DataFrame:
    """The last written payload of each key (equal times: the greater payload)."""
    return memo.groupBy("key").agg(F.max_by("payload", F.struct("created_at", "payload")).alias("payload"), F.max("created_at").alias("created_at"))


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an older schema with the new one: missing columns are null."""
    return old.unionByName(new, allowMissingColumns=True)
