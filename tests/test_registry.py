"""Registered queries against their SQL twins on the smallest tables."""

import math
import os

import duckdb
import pytest

from promptlake.plans import queries, queries_ingest  # noqa: F401

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="driver tables absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("conversations", "documents", "benchmark", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (int, str)) else float(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, D).count() > 0


def test_reports_hold_no_content(spark):
    from promptlake.plans import reports
    from promptlake.plans.testview import NOW, prompts

    for df in reports.dashboard(prompts(spark, D), NOW).values():
        assert "content" not in df.columns


def test_entry_without_llm(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def blocked(name, *a, **k):
        if name.startswith("promptlake.llm") or (name == "promptlake" and "llm" in (a[2] or () if len(a) > 2 else ())):
            raise ImportError(name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.startswith("promptlake.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    monkeypatch.setattr(builtins, "__import__", blocked)
    entry = importlib.import_module("__spark_entry__")
    assert "style_metrics" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    sys.modules.pop("__spark_entry__", None)
