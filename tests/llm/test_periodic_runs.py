"""Periodic runs against plain comparison of every period, and their digests."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from promptlake.llm import periodic_runs

KIND = "doc_id bigint, text string, n_runs int, _id string"


def brute_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def brute(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    runs = brute_runs(w)
    gone = {j for s, length, q in runs for j in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))


def random_words(rng, n):
    w = []
    while len(w) < n:
        kind = rng.integers(0, 3)
        unit = [str(x) for x in rng.integers(0, 3 if kind else 50, rng.integers(1, 9 if kind < 2 else 70))]
        w += unit * int(rng.integers(1, 8))
    return w[:n]


def codes_of(words):
    return np.append(np.unique(words, return_inverse=True)[1].astype(np.uint64), np.uint64(1 << 63)) if len(words) else np.array([1 << 63], dtype=np.uint64)


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_random_words(seed):
    rng = np.random.default_rng(seed)
    docs = [random_words(rng, int(rng.integers(0, 400))) for _ in range(12)] + [["a"] * 700, ["a", "b"] * 300, [], ["x"], ["a"] * 5, ["a"] * 6, ["a", "b", "c"] * 4]
    parts = [codes_of(w) for w in docs]
    for i, x in enumerate(parts):
        x[-1] += np.uint64(i)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    doc, *runs = periodic_runs.find_runs(np.concatenate(parts), bounds)
    got = list(zip(doc.tolist(), *(x.tolist() for x in runs), strict=True))
    assert got == [(i, *r) for i, w in enumerate(docs) for r in brute_runs(w)]


def test_extensions_equal_plain_comparison():
    rng = np.random.default_rng(3)
    w = random_words(rng, 900)
    codes = codes_of(w)
    e = periodic_runs.Extensions(codes)
    i, j = rng.integers(0, 900, 4000), rng.integers(0, 900, 4000)
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    got = e.lce(i, j)
    for a, b, n in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
        k = 0
        while codes[a + k] == codes[b + k]:
            k += 1
        assert n == k
    assert e.ready


def test_rows(spark):
    rng = np.random.default_rng(1)
    texts = {i: " ".join(random_words(rng, int(rng.integers(0, 200)))) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: " \n\t", 1003: "one", 1004: "a b  c\r\nd " * 9, 1005: "wörter " * 20_000, 1006: "Tie tie " * 8}
    rows = [(i, t, 1, "x") for i, t in texts.items()]
    rows += [rows[0], (None, "no id " * 9, 1, "x"), (None, None, 1, "x")]
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = [tuple(r[c] for c in names) for r in periodic_runs.runs(spark.createDataFrame(rows, KIND)).collect()]
    plain = lambda some: sorted((g for g in some if g[0] != 1005), key=repr)
    assert plain(got) == plain(brute(r[0], r[1]) for r in rows if r[0] != 1005)
    (long,) = [g for g in got if g[0] == 1005]
    assert long[1:6] == (1, 0, 20_000, 1, 20_000_000)


def test_nothing(spark):
    assert periodic_runs.runs(spark.createDataFrame([], KIND)).collect() == []


def test_no_runs_at_all(spark):
    got = periodic_runs.runs(spark.createDataFrame([(1, "one two three", 1, "x"), (2, None, 1, "x")], KIND)).collect()
    assert [(r["doc_id"], r["n_runs"], r["start"]) for r in got] == [(1, 0, None), (2, 0, None)]
