"""The prefix trie against a dictionary of prefixes: long conversations, many shards, copies, nulls, ties."""

import hashlib
import zlib

import numpy as np
import pytest

from promptlake.llm import prefix_trie

KIND = "conv_id bigint, turn bigint, role string, text string, conv int, hi string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = {}
    for c, turn, role, text in (r[:4] for r in rows):
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{role or ''}\0{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    members, ends = {}, {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full = tuple(own.get(c - c % 100, [])[:h] + t[h:])
        for d in range(len(full) + 1):
            members.setdefault(full[:d], []).append(c)
        ends.setdefault(full, []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def random_rows(rng, convs, longest):
    rows = []
    for c in convs:
        n = int(rng.integers(0, longest))
        rows += [(int(c), t, "user" if t % 2 else "assistant", f"t{rng.integers(0, 2)}", 1, "x") for t in range(n)]
    return rows


def check(spark, rows, **how):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(spark.createDataFrame(rows, KIND), **how).collect()), key=lambda r: (r[0], r[1]))
    assert got == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    """Blocks of three turns and shards of a few rows: every node is a boundary somewhere."""
    rng = np.random.default_rng(seed)
    check(spark, random_rows(rng, range(60), 12) + random_rows(rng, range(200, 230), 4) + random_rows(rng, [305, 399], 3), width=3, piece=2, shard_rows=(5, 40, 4000)[seed])


def test_copies_and_long(spark):
    rows = [(c, t, "user", f"same {t}", 1, "x") for c in range(1000, 1090) for t in range(40)] + [(7, t, "user", f"w{t}", 1, "x") for t in range(150)]
    check(spark, rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None, None, None, 1, "x"), (1, 0, "user", None, 1, "x"), (1, 0, "user", "", 1, "x"), (1, 0, "user", "b", 1, "x"), (1, 0, "user", "b", 1, "x"), (None, 1, "user", "no conversation", 1, "x"), (2, None, "user", "é" * 50_000, 1, "x"), (2, None, "", "", 1, "x"), (0, 5, "user", "b", 1, "x"), (3, 1, "user", "only", 1, "x"), (4, 2, None, "b", 1, "x")]
    check(spark, rows)


def test_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], KIND)).collect() == []
