"""Lists read in blocks against json.loads, and their import."""

import json
import random

import pytest
from pyspark.sql import functions as F

from promptlake.plans import imports
from promptlake.sources import readers

RNG = random.Random(3)


def value(depth):
    r = RNG.random()
    if depth == 0 or r < 0.3:
        return RNG.choice(['a}"b', "\\", 'x\\"}', "[{", "]", "é}", "", 1, None, True, 2.5, '{"a":"\\\\"}', '"}]', "}" * 40, "\n,\n"])
    if r < 0.7:
        return {RNG.choice(["k", "}", '"', "]"]) + str(i): value(depth - 1) for i in range(RNG.randint(0, 3))}
    return [value(depth - 1) for _ in range(RNG.randint(0, 3))]


@pytest.fixture
def small_blocks(spark):
    """Files are cut every 150 bytes, so a list lies in many blocks and tasks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("150", "1"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def same(text, want):
    if isinstance(want, str) or want is None:
        return text == want
    return json.loads(text) == want


def test_equals_json_loads(spark, small_blocks, tmp_path):
    lists = {f"f{i:02}.json": [value(4) for _ in range(RNG.choice([1, 3, 25, 60]))] for i in range(14)} | {"none.json": []}
    for i, (name, items) in enumerate(lists.items()):
        (tmp_path / name).write_text(json.dumps(items, ensure_ascii=i % 2 == 0, indent=None if i % 3 else 2) + ("\n" if i % 4 == 1 else ""))
    for name, text in {"torn.json": '[{"a":1},{"b":"', "object.json": '{"a":[1,{"b":2}]}\n', "empty.json": "", "text.json": "hello }", "quote.json": '[{"a":1},"]'}.items():
        (tmp_path / name).write_text(text)
    got = {}
    df = readers.list_items(spark, str(tmp_path))
    for r in df.collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], {})[r["nth"]] = r["value"]
    assert set(got) == {name for name, items in lists.items() if items}
    for name, items in lists.items():
        mine = got.get(name, {})
        assert sorted(mine) == list(range(len(items)))
        assert all(same(mine[i], x) for i, x in enumerate(items)), name


def test_one_list_spreads_over_tasks(spark, small_blocks, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"session_id": str(i), "messages": [{"role": "user", "content": f"say {i}"}]} for i in range(200)]))
    pieces = spark.read.text(str(tmp_path), lineSep="}")
    assert pieces.rdd.getNumPartitions() > 20
    assert pieces.select(F.max(F.length("value"))).first()[0] < 80
    rows = readers.session_items(readers.list_items(spark, str(tmp_path)))
    assert {(r["session_id"], r["content"]) for r in rows.collect()} == {(str(i), f"say {i}") for i in range(200)}


def test_items_equal_whole_files(spark, small_blocks, tmp_path):
    node = lambda text, at: {"message": {"author": {"role": "user"}, "create_time": at, "content": {"content_type": "text", "parts": [text]}}}
    conversations = [7, *({"mapping": {f"n{j}": node(f"{i} {{}} {j}", i) for j in range(3)}} | ({"id": f"c{i}"} if i % 2 else {}) for i in range(20)), "}"]
    sessions = [{"session_id": "s", "timestamp": i, "messages": [{"role": "user", "content": f"{i}]"}, {"role": "x"}]} for i in range(30)]
    for folder, items, whole, one in (("e", conversations, readers.exports, readers.export_items), ("s", sessions, readers.json_sessions, readers.session_items)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.json").write_text(json.dumps(items if folder == "s" else items[1:-1]))
        at = str(tmp_path / folder)
        want = sorted(map(str, whole(readers.read_whole(spark, at)).collect()))
        assert sorted(map(str, one(readers.list_items(spark, at)).collect())) == want and want


def test_import_of_lists(spark, small_blocks, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    node = {"message": {"author": {"role": "user"}, "create_time": 5, "content": {"content_type": "text", "parts": ["one"]}}}
    (data / "e.json").write_text(json.dumps([{"id": "c", "mapping": {"n1": node}}]))
    (data / "a.json").write_text(json.dumps([{"session_id": "s", "timestamp": 8, "messages": [{"role": "user", "content": t} for t in ("first", "next")]}, {"session_id": "s", "timestamp": 9, "messages": [{"role": "user", "content": "late"}]}]))
    (data / "x.json").write_text('{"a": 1}')
    home = (f"{tmp_path}/t", f"{tmp_path}/k")
    told = lambda n: {r["source"]: tuple(r)[1:] for r in imports.import_lists(spark, str(data), *home, n).collect()}
    assert told(0) == {"chatgpt": (1, 1, 1, 0), "json-import": (1, 3, 2, 1), None: (1, 0, 0, 0)}
    assert sorted(r["content"] for r in spark.read.parquet(home[0]).collect()) == ["first", "next", "one"]
    assert told(1) == {"chatgpt": (1, 1, 0, 1), "json-import": (1, 3, 0, 3), None: (1, 0, 0, 0)}


def test_all_sources_fail(spark, tmp_path):
    told = imports.import_sources(spark, [("a", lambda: spark.read.parquet(f"{tmp_path}/none"))], f"{tmp_path}/l", f"{tmp_path}/t", f"{tmp_path}/k", 0)
    assert [tuple(r)[:5] for r in told.collect()] == [("a", "failed", 0, 0, 0)]
