"""Structured Streaming forms of ingest, de-duplication, weekly volumes and the session gate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ingest
from ..sources import readers

WEEK_ZERO_SHIFT = "4 days"  # epoch weeks begin on a Thursday; tumbling windows here begin on Mondays


def read_prompts(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream. Grown files need the manifest job instead."""
    return spark.readStream.schema(schema).parquet(path)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drains what is there into a Parquet folder; progress is in the checkpoint. The ended query tells its metrics."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drains what is there and writes the whole aggregate, replacing the last one."""
    query = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_stream(stream: DataFrame, target: str, checkpoint: str, order: str, keys: str | None = None) -> None:
    """Exact two-key ingest against all history: each micro-batch is inserted where both keys are new, and reads only the key folders it falls into."""
    folder = keys or target.rstrip("/") + "-keys"

    def each(batch: DataFrame, n: int) -> None:
        ingest.append_batch(batch, target, folder, n, order)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def dedupe(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First row of each key within the watermark: bounded state, for sources that repeat themselves soon."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def weekly(stream: DataFrame, group: str, time: str, delay: str) -> DataFrame:
    """Counts by tumbling week."""
    return stream.withWatermark(time, delay).groupBy(group, F.window(time, "7 days", startTime=WEEK_ZERO_SHIFT)).agg(F.count("*").alias("n")).select(group, F.col("window.start").alias("week"), "n")


def late_counts(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Rows by day behind a watermark; later ones are dropped by the operator and show in its metrics."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")


def session_gate(stream: DataFrame, idle: str = "30 days") -> DataFrame:
    """The first triggered event of each session (session_id, event_id, ts, kind); a session's state ends after idle event time.

    In one micro-batch "first" is the least (ts, event_id); across batches it is arrival.
    """
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True)
        fired = state.exists
        state.update((True,))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + ms)
        if not fired:
            yield rows.sort_values(["ts", "event_id"]).iloc[:1][["session_id", "event_id", "ts", "kind"]]

    rows = stream.where("kind is not null and coalesce(session_id, '') <> ''").select("session_id", "event_id", "ts", "kind").withWatermark("ts", idle)
    return rows.groupBy("session_id").applyInPandasWithState(first, "session_id string, event_id bigint, ts timestamp, kind string", "fired boolean", "append", GroupStateTimeout.EventTimeTimeout)


REPLIED = "file string, line_no bigint, ref string, content string, micros bigint, session string, cwd string, model string"
_HELD = pa.schema([(c, pa.int64() if c in ("line_no", "micros", "deadline") else pa.string()) for c in ("file", "line_no", "ref", "content", "micros", "session", "cwd", "deadline")])
#: Files share a state by their hash: a function call for each file of a micro-batch would cost more than its work.
REPLY_BUCKETS = 2048


def _packed(held: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD) as out:
        out.write_table(pa.Table.from_pandas(held[_HELD.names], schema=_HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _replied(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(prompts that leave, with their model or none; each file's last prompt if it has no reply yet) of rows in order by file and line."""
    file, prompt = rows["file"].to_numpy(dtype=object), rows["ref"].notna().to_numpy()
    at = np.flatnonzero(prompt)
    # Each row's last prompt, if that is of the same file.
    last = np.cumsum(prompt) - 1
    known = last >= 0
    known[known] = file[at[last[known]]] == file[known]
    answers = np.flatnonzero(known & ~prompt)
    ref, parent, model = (rows[c].to_numpy(dtype=object) for c in ("ref", "parent", "model"))
    answers = answers[parent[answers] == ref[at[last[answers]]]]
    answered, first = np.unique(last[answers], return_index=True)
    models = np.full(len(at), None, dtype=object)
    models[answered] = model[answers[first]]
    waits = np.append(file[at[1:]] != file[at[:-1]], True)[: len(at)]
    waits[answered] = False
    prompts = rows.iloc[at].assign(model=models)
    return prompts[~waits], prompts[waits]


def attach_replies(lines: DataFrame, seen: str, wait: str = "1 hour", buckets: int = REPLY_BUCKETS) -> DataFrame:
    """Prompts of a stream of transcript lines (file, line_no, value and the time they were seen), with the model of the reply.

    A file's prompt is held until its reply, its next prompt or, by event time, until nothing of
    the file was seen for so long: then it leaves without a model. So at most one prompt a file is held;
    those of the files of one bucket are one state, which ends with the last of them. A task holds one bucket's part
    of a micro-batch at a time. Lines of a file must come in order, over any number of micro-batches. buckets must not
    change while a checkpoint is in use.
    """
    ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    names = [c.split()[0] for c in REPLIED.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = pa.ipc.open_stream(bytes(state.get[0])).read_all().to_pandas() if state.exists else _HELD.empty_table().to_pandas()
        new = [] if state.hasTimedOut else [f for f in frames if len(f)]
        out = []
        if new:
            rows = pd.concat(new, ignore_index=True)
            mine = held["file"].isin(rows["file"])
            both = pd.concat([held[mine].assign(new=0), rows.assign(new=1)], ignore_index=True).sort_values(["file", "new", "line_no"], kind="stable", ignore_index=True)
            done, waiting = _replied(both)
            out.append(done)
            deadline = waiting["file"].map(rows.groupby("file")["seen_ms"].max()).clip(lower=mark) + ms
            held, fresh = held[~mine], waiting.assign(deadline=deadline)
        over = held["deadline"] <= mark
        out.append(held[over].assign(model=None))
        held = pd.concat([held[~over], fresh[_HELD.names]]) if new else held[~over]
        if len(held):
            state.update((_packed(held),))
            state.setTimeoutTimestamp(int(held["deadline"].min()))
        elif state.exists:
            state.remove()
        yield from (f[names] for f in out if len(f))

    rows = readers.transcript_events(lines.withColumn("seen", F.col(seen)).withWatermark("seen", wait), "seen")
    rows = rows.withColumn("micros", F.coalesce(F.unix_micros("timestamp"), F.lit(0))).drop("timestamp").withColumn("seen_ms", F.unix_millis("seen"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(buckets)))
    got = rows.groupBy("bucket").applyInPandasWithState(run, REPLIED, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return readers.transcript_prompts(got.withColumn("timestamp", F.timestamp_micros("micros")))


def split_late(stream: DataFrame, time: str, delay: str, path: str, checkpoint: str) -> None:
    """Appends a stream to path/rows, and to path/late the rows before the mark held when their micro-batch came.

    The mark is the greatest time of all earlier micro-batches less the delay. Each micro-batch has
    folders of its own, which a repeated one writes anew; so late rows are counted and kept, once.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        marks = f"{path}/marks"
        at = spark._jvm.org.apache.hadoop.fs.Path(marks)
        held = None
        if at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(at):
            held = spark.read.schema("high timestamp, batch bigint").parquet(marks).where(F.col("batch") < n).agg(F.max("high").alias("high")).first()["high"]
        late = F.lit(False) if held is None else F.coalesce(F.col(time) < F.lit(held) - F.expr(f"interval {delay}"), F.lit(False))
        rows = ingest.cut(batch.withColumn("_late", late))
        for name, some in (("late", rows.where("_late")), ("rows", rows.where("not _late"))):
            some.drop("_late").write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")
        rows.agg(F.max(time).alias("high")).write.mode("overwrite").parquet(f"{marks}/batch={n}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
