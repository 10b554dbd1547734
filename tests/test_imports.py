"""The import of mixed files: order, repeated imports, archives and files of neither kind."""

import io
import json
import zipfile

from promptlake.plans import imports


def node(text, at):
    return {"message": {"author": {"role": "user"}, "create_time": at, "content": {"content_type": "text", "parts": [text]}}}


def zipped(member, value):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(member, value)
    return out.getvalue()


EXPORT = json.dumps([{"id": "c", "mapping": {"n1": node("one", 5), "n2": node("two", 6)}}])
LISTS = [
    ("/b.json", json.dumps([{"session_id": "s", "timestamp": 9, "messages": [{"role": "user", "content": "late"}]}])),
    ("/a.json", json.dumps([{"session_id": "s", "timestamp": 8, "messages": [{"role": "user", "content": "first"}, {"role": "user", "content": "next"}]}, {"session_id": "t", "timestamp": 5, "messages": [{"role": "user", "content": " one"}]}])),
]


def told(df):
    return {r["source"]: tuple(r)[1:] for r in df.collect()}


def test_mixed_files(spark, tmp_path):
    files = spark.createDataFrame([*LISTS, ("/e.json", EXPORT), ("/x.json", '{"a": 1}'), ("/y.json", "torn ["), ("/n.json", None), ("/empty.json", "[]")], "file string, value string")
    archives = spark.createDataFrame([("/z.zip", zipped("in/conversations.json", EXPORT)), ("/bad.zip", b"no"), ("/other.zip", zipped("notes.txt", "x"))], "path string, content binary")
    home = (f"{tmp_path}/t", f"{tmp_path}/k")
    got = told(imports.import_files(files, *home, 0, archives))
    # The archive repeats the export; the list's "one" has its text and time; s:0 of the second file has that of the first.
    assert got == {"chatgpt": (2, 4, 2, 2), "json-import": (3, 4, 2, 2), None: (3, 0, 0, 0)}
    assert sorted(r["content"] for r in spark.read.parquet(home[0]).collect()) == ["first", "next", "one", "two"]
    assert told(imports.import_files(files, *home, 1, archives)) == {"chatgpt": (2, 4, 0, 4), "json-import": (3, 4, 0, 4), None: (3, 0, 0, 0)}


def test_no_files(spark, tmp_path):
    files = spark.createDataFrame([], "file string, value string")
    assert told(imports.import_files(files, f"{tmp_path}/t", f"{tmp_path}/k", 0)) == {}
