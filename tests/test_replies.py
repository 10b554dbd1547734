"""Transcripts as a stream: replies in later micro-batches, prompts without one, and state that ends."""

import json
import random

from pyspark.sql import functions as F

from promptlake.plans import queries_ingest
from promptlake.sources import readers
from promptlake.streaming import streams

KIND = "file string, line_no bigint, value string, seen timestamp"


def user(ref, text="do it"):
    return json.dumps({"type": "user", "promptSource": "typed", "origin": {"kind": "human"}, "uuid": ref, "timestamp": "2024-01-01T00:00:00Z", "sessionId": "s", "message": {"content": text}})


def reply(to, model):
    return json.dumps({"type": "assistant", "parentUuid": to, "message": {"model": model}})


BATCHES = [
    [("/a.jsonl", 1, user("a1")), ("/b.jsonl", 1, user("b1")), ("/c.jsonl", 1, user("c1")), ("/a.jsonl", 0, "torn {")],
    [("/a.jsonl", 5, reply("other", "m0")), ("/a.jsonl", 6, reply("a1", "<synthetic>")), ("/b.jsonl", 3, user("b2")), ("/b.jsonl", 2, reply("b1", "m1"))],
    [("/a.jsonl", 9, reply("a1", "m2")), ("/a.jsonl", 10, reply("a1", "m3")), ("/b.jsonl", 4, user("b3"))],
    [("/z.jsonl", 1, "{}")],
]


def test_replies_across_batches(spark, tmp_path):
    for n, batch in enumerate(BATCHES):
        rows = spark.createDataFrame(batch, "file string, line_no bigint, value string").withColumn("seen", F.timestamp_seconds(F.lit(1_700_000_000 + n * 600 + (100_000 if n == 3 else 0))))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streams.run_once(streams.attach_replies(stream, "seen", "30 minutes"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r["message_ref"]: r["model"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"a1": "m2", "b1": "m1", "b2": None, "b3": None, "c1": None}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    lines = spark.createDataFrame([x for b in BATCHES for x in b], "file string, line_no bigint, value string")
    assert {r["message_ref"]: r["model"] for r in readers.transcripts(lines).collect()} == got


def random_lines(rng, files, n):
    """Lines of files, in order, with replies to the last prompt, to earlier ones and to none."""
    for f in range(files):
        refs = ["none"]
        for i in range(n):
            if rng.random() < 0.4:
                refs.append(f"f{f}r{i}")
                yield f"/{f}.jsonl", i, user(refs[-1])
            else:
                yield f"/{f}.jsonl", i, reply(rng.choice(refs[-2:]), rng.choice(["<synthetic>", f"m{i}"]))


def test_files_share_states(spark, tmp_path):
    """A state for each bucket of files, and the batch reader's models."""
    lines = spark.createDataFrame(list(random_lines(random.Random(3), 60, 12)), "file string, line_no bigint, value string").cache()
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
    held = []
    for n in range(5):
        rows = lines.where(F.floor(F.col("line_no") / 3) == n) if n < 4 else spark.createDataFrame([("/z.jsonl", 1, "{}")], lines.schema)
        rows.withColumn("seen", F.timestamp_seconds(F.lit(1_700_000_000 + n * 600 + (100_000 if n == 4 else 0)))).write.mode("append").parquet(f"{tmp_path}/in")
        query = streams.run_once(streams.attach_replies(stream, "seen", "30 minutes", buckets=5), f"{tmp_path}/out", f"{tmp_path}/state")
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(held) == 5 and held[-1] == 0
    pairs = lambda df: sorted(map(tuple, df.select("message_ref", F.coalesce("model", F.lit("-"))).collect()))
    assert pairs(spark.read.parquet(f"{tmp_path}/out")) == pairs(readers.transcripts(lines))


def test_batches_are_written_by_several_tasks(spark):
    lines = spark.range(40, numPartitions=4).select(F.concat(F.lit("/"), "id").alias("file"), (F.col("id") * 7 % 15).alias("line_no"), F.lit("{}").alias("value"))
    counts = [len(spark.read.parquet(f"{home}/in").inputFiles()) for home in queries_ingest._in_batches(spark, lines, 3)]
    assert counts == [4, 8, 12, 13]


def test_windows_sort_no_text(spark):
    lines = spark.createDataFrame([("/a.jsonl", 1, user("a1"))], "file string, line_no bigint, value string")
    for reader in (readers.transcripts, readers.rollouts):
        plan = reader(lines)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.split("\n"):
            if "Window [" in line:
                assert "content" not in line and "message" not in line


def test_sessions_and_requests_of_odd_shapes(spark):
    value = json.dumps([{"session_id": "x", "timestamp": 12.5, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}, {"role": "user", "content": "c"}]}, {"session_id": "x", "messages": [{"role": "user", "content": "d"}]}, {"timestamp": "2024-01-01T00:00:00Z", "messages": [3, {"role": "user", "content": "e"}]}, 5, {"messages": 7}])
    got = readers.json_sessions(spark.createDataFrame([("f", value)], "file string, value string")).select("message_ref", "content", F.unix_micros("timestamp").alias("t")).collect()
    assert sorted(map(tuple, got)) == [("import:0", "e", 1_704_067_200_000_000), ("x:0", "a", 12_500_000), ("x:0", "d", 0), ("x:1", "c", 12_500_000)]
    request = lambda stamp: {"requestId": f"r{stamp}", "timestamp": stamp, "message": {"text": "t"}}
    log = json.dumps({"kind": 0, "v": {"requests": [request("1700000000000"), 4, request(1_700_000_000_000), {"requestId": {}, "timestamp": {}, "message": "no"}]}})
    got = readers.patch_logs(spark.createDataFrame([("f.jsonl", 1, log)], "file string, line_no bigint, value string")).collect()
    assert [r["message_ref"] for r in got] == ["r1700000000000"]
