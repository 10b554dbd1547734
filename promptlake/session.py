"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of an Arrow batch. Documents can be long: the default of 10,000 would be tens of megabytes in each Python worker.
BATCH_ROWS = "2000"
#: Bytes of an Arrow batch, a longer row aside: 2,000 rows of long texts are several megabytes, which both sides of each worker hold more than once.
BATCH_BYTES = "1m"
_ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a local session import this library (a cluster gets it by --py-files) and bounds Arrow batches."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)
    return spark
