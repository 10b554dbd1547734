"""Shared storage between the steps of an operator, and joins that common keys do not overload."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more than one part in so many of all rows are handled apart; so there are at most so many of them.
HOT_KEYS = 1_000
#: Documents of a part of a table, for tables that would otherwise have more parts than they need.
DOCS_A_PART = 4_000
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is named and the master is local, a folder of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="promptlake-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def few(docs: DataFrame) -> int:
    """As many parts as so many documents need, two a core at least.

    Each part is a file. Without its native library Hadoop starts a process for a new local file's
    mode, which before it runs its program shares, and shows, all of the executor's memory.
    """
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(docs.count() / DOCS_A_PART))


class Scratch:
    """Tables between the steps of one operator, in the shared folder: reliable against lost executors, gone at the end.

    Each ``cut`` is written as Parquet and read back. Its shuffle files go when it is written,
    its own files with ``drop`` or when the block ends. What an operator returns must be
    kept outside (``keep``) or read from elsewhere. most: parts of a table at most.
    """

    def __init__(self, spark: SparkSession, most: int | None = None):
        self.spark, self.most = spark, most
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def __enter__(self) -> Scratch:
        self.clean = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        return self

    def __exit__(self, *_) -> None:
        if self.clean is None:
            self.spark.conf.unset(_CLEAN)
        else:
            self.spark.conf.set(_CLEAN, self.clean)
        remove(self.spark, self.path)

    def cut(self, df: DataFrame, most: int | None = None) -> DataFrame:
        path, self.n = f"{self.path}/{self.n}", self.n + 1
        most = most or self.most
        (df.coalesce(most) if most else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.held = [*getattr(self, "held", []), out]  # an id must not be used again
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in frames:
            remove(self.spark, self.paths.pop(id(df)))


def cut(df: DataFrame) -> DataFrame:
    """The rows, read back from a checkpoint in the shared folder.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes it once nothing refers to it.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


keep = cut


def spread_join(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined by key with table, whose column ``size`` says how many of the ``total`` rows have the key.

    The at most ``HOT_KEYS`` keys with over one part in ``HOT_KEYS`` of the rows meet by broadcast,
    so that no task gets such a key's rows; all others shuffle. Only these keys' hashes come to the driver.
    """
    mark = F.xxhash64(key)
    hot = [r["h"] for r in table.where(F.col(size) > total / HOT_KEYS).select(mark.alias("h")).collect()]
    if not hot:
        return rows.join(table, key)
    common = mark.isin(hot)
    return rows.where(~common).join(table.where(~common), key).unionByName(rows.where(common).join(F.broadcast(table.where(common)), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col="text"):
    return F.coalesce(F.col(col), F.lit(""))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
