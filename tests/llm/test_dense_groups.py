"""What a dense group exchanges grows with the group, and no link is lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptlake.llm import near_dedup
from promptlake.llm.cluster import Scratch

from .test_operators import brute_components


def family(n, rng, own=4):
    """Documents of one template with words of their own, all below the threshold; every tenth has a near copy."""
    base = [f"w{i}" for i in range(80)]
    out = []
    for i in range(n):
        w = list(base)
        for j in rng.choice(8, own, replace=False):
            w[10 * j + 3] = f"own{i}x{j}"
        out.append(w)
        if i % 10 == 0:
            out.append([*w[:-1], f"tail{i}"])
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed", [0, 1])
def test_family_below_the_threshold(spark, seed):
    pairs = family(150, np.random.default_rng(seed))
    _, label = brute_components(pairs, 2)
    got = near_dedup.near_duplicates(spark.createDataFrame(pairs, "doc_id bigint, text string"), 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == label


def exchanged(spark, n):
    """Rows of rare shingles and pairs that a group of documents sends, none of them linked before."""
    docs = spark.createDataFrame(family(n, np.random.default_rng(n), 5), "doc_id bigint, text string")
    with Scratch(spark) as scratch:
        sets = scratch.cut(near_dedup.signatures(docs, 2))
        groups = sets.select("doc", F.lit(0).cast("bigint").alias("group"), "n", *near_dedup.SKETCH, F.lit(1).alias("degree"))
        comps = spark.createDataFrame([], "node bigint, component bigint")
        full = near_dedup._full_sets(docs, docs.select(F.col("doc_id").alias("doc")), 2, scratch)
        rows = near_dedup._labelled(groups, comps).join(full, "doc")
        return docs.count(), near_dedup._rare_tokens(rows, 80).count(), near_dedup._rare_pairs(groups, comps, full, 80, scratch).count()


def test_twice_the_group_exchanges_twice_as_much(spark):
    (n1, rows1, pairs1), (n2, rows2, pairs2) = exchanged(spark, 300), exchanged(spark, 600)
    assert 1.9 * n1 < n2 < 2.1 * n1
    assert rows2 < 2.3 * rows1 and pairs2 < 2.3 * pairs1
    assert pairs1 >= 30


def template(n, rng):
    """Documents of one text, each with up to twelve words of its own at places of its own: similarities from 1 to far below the threshold."""
    out = []
    for i in range(n):
        w = [f"w{j}" for j in range(150)]
        for j in rng.choice(150, rng.integers(0, 13), replace=False):
            w[j] = f"own{i}x{j}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("percent", [80, 70])
def test_members_about_the_threshold_of_a_template(spark, percent):
    """Those outside the main component do not meet every other member by what all of them share, and no link is lost."""
    pairs = template(400, np.random.default_rng(5))
    docs = spark.createDataFrame(pairs, "doc_id bigint, text string")
    words = {d: t.split(" ") for d, t in pairs}
    shingles = {d: set(zip(w, w[1:], strict=False)) for d, w in words.items()}
    linked = [(a, b) for a in shingles for b in shingles if a < b and 100 * len(shingles[a] & shingles[b]) >= percent * len(shingles[a] | shingles[b])]
    with Scratch(spark) as scratch:
        sets = scratch.cut(near_dedup.signatures(docs, 2))
        groups = sets.select("doc", F.lit(0).cast("bigint").alias("group"), "n", *near_dedup.SKETCH, F.lit(1).alias("degree"))
        full = near_dedup._full_sets(docs, docs.select(F.col("doc_id").alias("doc")), 2, scratch)
        # As after a first round whose pivot was a member far from the others.
        star = max(shingles, key=lambda d: len(shingles[d] - shingles[0]))
        first = spark.createDataFrame([p for p in linked if star in p] or [(star, star)], "a bigint, b bigint")
        comps = scratch.cut(near_dedup.connected_components(first, scratch))
        found = scratch.cut(near_dedup._rare_pairs(groups, comps, full, percent, scratch))
        assert found.count() < 4 * len(pairs)
        comps = near_dedup.merged(comps, near_dedup._verify_in_blocks(found, full, percent), scratch)
        got = {r["node"]: r["component"] for r in comps.collect()}
    of = {d: d for d in shingles}

    def root(d):
        while of[d] != d:
            d = of[d]
        return d

    for a, b in linked:
        x, y = root(a), root(b)
        of[max(x, y)] = min(x, y)
    assert {d: got.get(d, d) for d in of} == {d: root(d) for d in of}


def test_frequencies_never_fall_short(spark):
    rng = np.random.default_rng(4)
    rows = [([int(x) for x in rng.integers(0, 500, 40)],) for _ in range(100)]
    often = near_dedup._frequencies(spark.createDataFrame(rows, "items array<bigint>").repartition(5))
    flat = np.array([x for (r,) in rows for x in r])
    values, counts = np.unique(flat, return_counts=True)
    assert (often[near_dedup._counter(values)] >= counts).all() and often.sum() == len(flat)
