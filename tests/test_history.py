"""Appends that look keys up in folders of their own: equal to the sequential rule, bounded reads, batches that are repeated."""

import random

import pytest

from promptlake.operators import ingest

KIND = "source string, session_id string, message_ref string, content_hash string, timestamp timestamp, n bigint"
DAY = 86400


def rows(spark, data):
    from pyspark.sql import functions as F

    shape = spark.createDataFrame(data, "source string, session_id string, message_ref string, content_hash string, s bigint, n bigint")
    return shape.select("source", "session_id", "message_ref", "content_hash", F.timestamp_seconds("s").alias("timestamp"), "n")


def accepted(data):
    seen, kept = (set(), set()), []
    for r in sorted(data, key=lambda r: r[5]):
        if r[:3] not in seen[0] and r[3:5] not in seen[1]:
            seen[0].add(r[:3])
            seen[1].add(r[3:5])
            kept.append(r[5])
    return sorted(kept)


def test_equals_the_sequential_rule(spark, tmp_path):
    draw = random.Random(5)
    data = [("ab"[draw.randrange(2)], draw.choice(["s", "t", None]), f"m{draw.randrange(9)}", f"h{draw.randrange(12)}", draw.choice([0, DAY, 5 * DAY, None]), i) for i in range(150)]
    told = []
    for n in range(3):
        told += ingest.append_batch(rows(spark, data[n * 50 : n * 50 + 50]), f"{tmp_path}/t", f"{tmp_path}/k", n, "n").collect()
    got = sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/t").collect())
    assert got == accepted(data)
    assert sum(r["scanned"] for r in told) == 150 and sum(r["added"] for r in told) == len(got)


def test_reads_grow_with_the_batch_alone(spark, tmp_path):
    """A batch of one session and day reads what that session and day left, however much else there is."""
    mine = [("a", "mine", f"m{i}", f"h{i}", 7 * DAY + i, i) for i in range(10)]
    ingest.append_batch(rows(spark, mine), f"{tmp_path}/t", f"{tmp_path}/k", 0, "n")
    probe = rows(spark, [("a", "mine", "m3", "other", 7 * DAY + 99, 1000)])
    for n, many in ((1, 200), (2, 800)):
        other = [("b", f"s{n}-{i}", "m", f"x{n}-{i}", (10 + i % 50) * DAY, 2000 * n + i) for i in range(many)]
        ingest.append_batch(rows(spark, other), f"{tmp_path}/t", f"{tmp_path}/k", n, "n")
        held = {name: df.count() for name, df in ingest.held_keys(probe, f"{tmp_path}/k", 9).items()}
        assert held["text_keys"] == 10 and 10 <= held["row_keys"] <= 12
    assert ingest.append_batch(probe, f"{tmp_path}/t", f"{tmp_path}/k", 9, "n").first()["added"] == 0


def test_a_repeated_batch_lands_once(spark, tmp_path):
    data = [("a", "s", f"m{i % 5}", f"h{i % 4}", i % 3, i) for i in range(30)]
    for n, part in ((0, data[:15]), (1, data[15:]), (1, data[15:]), (1, data[15:])):
        ingest.append_batch(rows(spark, part), f"{tmp_path}/t", f"{tmp_path}/k", n, "n")
    assert sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == accepted(data)


def test_failure_between_keys_and_rows(spark, tmp_path, monkeypatch):
    """Keys that a failed batch left behind do not hide its rows when it comes again."""
    batch = rows(spark, [("a", "s", "m", "h", 1, 1)])
    ingest.write_keys(batch, f"{tmp_path}/k", 4)
    assert ingest.append_batch(batch, f"{tmp_path}/t", f"{tmp_path}/k", 4, "n").first()["added"] == 1
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1


def test_an_older_table_is_made_known(spark, tmp_path):
    old = rows(spark, [("a", "s", "m", "h", 1, 1)])
    ingest.write_keys(old, f"{tmp_path}/k", -1)
    new = rows(spark, [("a", "s", "m", "g", 2, 2), ("a", "s", "k", "h", 1, 3), ("a", "s", "k", "g", 2, 4)])
    assert ingest.append_batch(new, f"{tmp_path}/t", f"{tmp_path}/k", 0, "n").first()["added"] == 1


@pytest.mark.parametrize("empty_first", [True, False])
def test_empty_batches(spark, tmp_path, empty_first):
    none = rows(spark, [("a", "s", "m", "h", 1, 1)]).limit(0)
    some = rows(spark, [("a", "s", "m", "h", 1, 1)])
    for n, batch in enumerate((none, some) if empty_first else (some, none)):
        ingest.append_batch(batch, f"{tmp_path}/t", f"{tmp_path}/k", n, "n")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1


def key_files(path):
    return sorted(str(p.relative_to(path)) for p in path.glob("*/folder=*/batch=*/*.parquet"))


def test_merged_keys(spark, tmp_path):
    """Merges between batches change no answer, leave one set of files a folder, and spare the batches from n on."""
    draw = random.Random(8)
    data = [("ab"[draw.randrange(2)], draw.choice(["s", "t", None]), f"m{draw.randrange(30)}", f"h{draw.randrange(30)}", draw.choice([0, DAY, None]), i) for i in range(200)]
    for n in range(5):
        ingest.merge_keys(spark, f"{tmp_path}/k", n)
        ingest.append_batch(rows(spark, data[n * 40 : n * 40 + 40]), f"{tmp_path}/t", f"{tmp_path}/k", n, "n")
    assert sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == accepted(data)
    last = [f for f in key_files(tmp_path / "k") if "batch=4/" in f]
    assert last and ingest.merge_keys(spark, f"{tmp_path}/k", 4) == 0
    assert ingest.merge_keys(spark, f"{tmp_path}/k", 5) > 0
    folders = [f.rsplit("/", 2)[0] for f in key_files(tmp_path / "k")]
    assert len(folders) == len(set(folders)) and ingest.merge_keys(spark, f"{tmp_path}/k", 5) == 0
    again = ingest.append_batch(rows(spark, data), f"{tmp_path}/t", f"{tmp_path}/k", 5, "n").collect()
    assert sum(r["added"] for r in again) == 0


def test_merge_stopped_before_the_old_keys_go(spark, tmp_path):
    data = [("a", "s", f"m{i}", f"h{i}", i, i) for i in range(6)]
    for n in range(2):
        ingest.append_batch(rows(spark, data[n * 3 : n * 3 + 3]), f"{tmp_path}/t", f"{tmp_path}/k", n, "n")
    # Merged keys are there, the old ones still too.
    ingest.write_keys(rows(spark, data), f"{tmp_path}/k", -2)
    assert ingest.merge_keys(spark, f"{tmp_path}/k", 2) == 2
    assert spark.read.parquet(f"{tmp_path}/k/row_keys").count() == spark.read.parquet(f"{tmp_path}/k/text_keys").count() == 6
    assert ingest.append_batch(rows(spark, data), f"{tmp_path}/t", f"{tmp_path}/k", 2, "n").first()["added"] == 0


def test_merge_of_no_keys(spark, tmp_path):
    assert ingest.merge_keys(spark, f"{tmp_path}/none", 3) == 0


def test_many_folders_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(300).selectExpr("'s' as source", "cast(id as string) as session_id", "'m' as message_ref", "cast(id as string) as content_hash", "timestamp_seconds(id * 3600 * (id % 2)) as timestamp")
    writers = lambda at, folder="*": {f.name.split("-")[1] for f in (tmp_path / at).glob(f"folder={folder}/batch=*/part-*.parquet")}
    for n in (0, 1):
        ingest.write_keys(rows, f"{tmp_path}/keys", n)
    assert len(writers("keys/row_keys")) > 4 and len(writers("keys/text_keys", "0")) == 1
    assert ingest.merge_keys(spark, f"{tmp_path}/keys", 2) > 100
    assert len(writers("keys/row_keys")) > 4
    monkeypatch.setattr(ingest, "FOLDER_ROWS", 100)
    ingest.write_keys(rows, f"{tmp_path}/large", 0)
    assert len(writers("large/text_keys", "0")) > 1
    assert spark.read.parquet(f"{tmp_path}/large/text_keys").count() == 300
