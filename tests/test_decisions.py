"""Null keys in ingest, and event decisions in batch and over micro-batches."""

import pytest
from pyspark.sql import functions as F

from promptlake.operators import ingest, triggers
from promptlake.sources import readers
from promptlake.streaming import streams

ROWS = "source string, session_id string, message_ref string, content_hash string, timestamp timestamp, n bigint"


def test_null_keys_end_and_count_as_equal(spark):
    rows = spark.createDataFrame([("a", "s", None, "h1", None, 1), ("a", "s", None, "h2", None, 2), ("a", "s", "m", "h1", None, 3), ("a", "s", "m", "h3", None, 4)], ROWS)
    assert {r["n"] for r in ingest.dedupe_two_key(rows, "n").collect()} == {1, 4}
    assert ingest.insert_ignore(rows, rows, "n").count() == 0


def test_rounds_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ingest, "ROUNDS", 1)
    chain = spark.createDataFrame([("a", "s", f"m{i // 2}", f"h{(i + 1) // 2}", None, i) for i in range(8)], ROWS)
    with pytest.raises(RuntimeError):
        ingest.dedupe_two_key(chain, "n")


BROAD = "improve everything"
EVENTS = [("stop", "always", BROAD, None), ("submit", "coach", "a plain question about line 3", "better"), ("submit", "always", "one", "uno"), ("original", "off", "", None), ("submit", "always", "one", "uno"), ("accept", "coach", "", None), ("submit", "always", "two", None), ("submit", "off", "x", "y"), ("submit", "always", "", "y"), ("submit", "always", "three", "tres"), ("accept", "coach", "", None), ("stop", "coach", None, None)]
WANT = [("none", None), ("none", None), ("blocked", "uno"), ("released", "one"), ("passed", None), ("nothing", None), ("none", None), ("none", None), ("none", None), ("blocked", "tres"), ("released", "tres"), ("none", None)]
KIND = "session_id string, seq bigint, event string, mode string, content string, rewrite string"


def rows(spark):
    data = [(s, i, *e) for s in ("a", "b") for i, e in enumerate(EVENTS)]
    return spark.createDataFrame([*data, (None, 1, "submit", "always", "x", "y"), ("", 1, "submit", "always", "x", "y")], KIND)


def test_decisions(spark):
    got = triggers.decide(rows(spark)).orderBy("session_id", "seq").collect()
    assert [(r["outcome"], r["text"]) for r in got] == WANT * 2
    assert triggers.decide(rows(spark).limit(0)).count() == 0


def test_tips_come_once_whatever_the_event(spark):
    long = "word " * 60
    events = [("s", 1, "pre_call", "always", long, None), ("s", 2, "stop", "coach", long, None), ("s", 3, "submit", "coach", long, None), ("t", 1, "stop", "coach", long, None), ("u", 1, "submit", "coach", long, None), ("v", 1, "submit", "coach", long, "offer"), ("v", 2, "pre_call", "coach", long, None)]
    got = triggers.decide(spark.createDataFrame(events, KIND)).orderBy("session_id", "seq").collect()
    assert [(r["outcome"], r["text"]) for r in got] == [("context", "shape"), ("none", None), ("none", None), ("message", "shape"), ("message", "shape"), ("blocked", "offer"), ("none", None)]


def test_decisions_over_micro_batches(spark, tmp_path):
    """State, with both texts of a pending rewrite, lasts from one batch to the next."""
    every = rows(spark)
    for i, part in enumerate(("seq < 3", "seq >= 3 and seq < 5", "seq >= 5")):
        timed = every.where(part).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
        timed.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = triggers.decide_stream(streams.read_prompts(spark, f"{tmp_path}/in", timed.schema), "at")
        streams.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("session_id", "seq").collect()
    assert [(r["outcome"], r["text"]) for r in got] == WANT * 2


def test_stop_events_without_text_judge_the_last_prompt(spark, tmp_path):
    long = "word " * 60
    held = [("s", 1, "submit", "off", long, None), ("s", 2, "stop", "coach", None, None), ("s", 3, "stop", "coach", None, None), ("t", 1, "stop", "coach", None, None), ("u", 1, "submit", "off", long, None), ("u", 2, "submit", "off", "TASK: " + long, None), ("u", 3, "submit", "off", "fine", None), ("u", 4, "stop", "coach", None, None), ("v", 1, "submit", "coach", long, "offer"), ("v", 2, "stop", "always", None, None)]
    want = [("none", None), ("message", "shape"), ("none", None), ("none", None), ("none", None), ("none", None), ("none", None), ("none", None), ("blocked", "offer"), ("none", None)]
    every = spark.createDataFrame(held, KIND)
    got = triggers.decide(every).orderBy("session_id", "seq").collect()
    assert [(r["outcome"], r["text"]) for r in got] == want
    for i in range(1, 5):
        timed = every.where(F.col("seq") == i).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
        timed.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = triggers.decide_stream(spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "at")
    streams.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("session_id", "seq").collect()
    assert [(r["outcome"], r["text"]) for r in got] == want


def test_state_ends_after_idle_time(spark, tmp_path):
    """Sessions that saw nothing for the idle time lose their state; sessions without any keep none."""
    long = "word " * 60
    for day in range(4):
        rows_ = [(f"d{day}s{i}", 1, "submit", "coach", long if i < 10 else "fine", None) for i in range(20)]
        timed = spark.createDataFrame(rows_, KIND).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000 + day * 86400)))
        timed.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = triggers.decide_stream(spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "at", "1 hour")
    query = streams.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 10
    assert spark.read.parquet(f"{tmp_path}/out").where("outcome = 'message'").count() == 40


def test_late_rows_are_kept_aside_once(spark, tmp_path):
    base = 1_700_000_000
    for i, times in enumerate(([0, 90_000], [1_000, 100_000], [5_000, 20_000, 200_000])):
        spark.createDataFrame([(i, base + t) for t in times], "part int, s bigint").select("part", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("part int, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):
        streams.split_late(stream, "at", "1 day", f"{tmp_path}/out", f"{tmp_path}/check")
    seen = {n: sorted(r["s"] - base for r in spark.read.parquet(f"{tmp_path}/out/{n}").select(F.unix_seconds("at").alias("s")).collect()) for n in ("late", "rows")}
    assert seen == {"late": [1_000, 5_000], "rows": [0, 20_000, 90_000, 100_000, 200_000]}


def test_a_corrupt_file_stops_its_source_alone(spark, tmp_path):
    for name in ("good", "bad"):
        spark.range(100).select(F.lit(name).alias("source"), "id").repartition(4).write.parquet(f"{tmp_path}/{name}")
    victim = sorted((tmp_path / "bad").glob("part-*.parquet"))[1]
    whole = victim.read_bytes()
    victim.write_bytes(whole[:20] + b"x" * (len(whole) - 20))
    (tmp_path / "bad" / f".{victim.name}.crc").unlink()
    schema = "source string, id bigint"
    sources = [(n, lambda n=n: spark.read.schema(schema).parquet(f"{tmp_path}/{n}")) for n in ("good", "bad")]
    got = {r["source"]: (r["state"], r["scanned"], bool(r["reason"])) for r in readers.land(spark, sources, f"{tmp_path}/landed").collect()}
    assert got == {"good": ("read", 100, False), "bad": ("failed", 0, True)}
    assert [(r["source"], r["count"]) for r in spark.read.parquet(f"{tmp_path}/landed").groupBy("source").count().collect()] == [("good", 100)]


def test_force_ignores_both_kinds_of_state(spark):
    listing = spark.createDataFrame([("p", 1, 2, 3)], "path string, mtime bigint, size bigint, run_ts bigint")
    assert ingest.changed_files(listing, listing).count() == 0 and ingest.changed_files(listing, listing, force=True).count() == 1
    data = spark.range(1).select(F.lit("a").alias("source"), F.timestamp_seconds(F.lit(5)).alias("timestamp"))
    marks = spark.range(1).select(F.lit("a").alias("source"), F.timestamp_seconds(F.lit(9)).alias("high_ts"))
    assert ingest.watermark_increment(data, marks).count() == 0 and ingest.watermark_increment(data, marks, force=True).count() == 1
