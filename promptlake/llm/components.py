"""Connected components by alternating large-star and small-star rounds, all as joins and grouped minima."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch, keep

ROUNDS = 60
EDGES_A_PART = 250_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node in edges (a, b: bigint); the component is its least node.

    A hub's rows are pre-aggregated for its minimum, and the join that spreads the
    minimum can be split by AQE, so no neighbourhood is gathered. Edges are dealt to as many
    partitions as their number asks for; what fits one is not shuffled at all. Self-loops
    and repeated edges change nothing.
    """
    if scratch is None:
        with Scratch(edges.sparkSession) as own:
            return keep(connected_components(edges, own))
    e = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(e)
    for _ in range(ROUNDS):
        if not before[0]:
            break
        dealt = e.coalesce(math.ceil(before[0] / EDGES_A_PART))
        # The least of each node's neighbours and itself; edges lead from the greater node u to the lesser v.
        least = dealt.groupBy("u").agg(F.min("v").alias("m"))
        # A node v with greater neighbours sends them its least: that of its lesser neighbours, or itself.
        large = dealt.join(least.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        # Each node's edges move to the least of them, and that one stays.
        moved = large.join(floor, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = scratch.cut(moved.where("u <> v").distinct())
        scratch.drop(e)
        e, after = new, _state(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    pairs = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("x"))
    return pairs.select("x.node", "x.component").groupBy("node").agg(F.min("component").alias("component"))


def merged(comps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components (node, component) after further links (a, b): only the labels that the links join are worked on."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    top = scratch.cut(connected_components(edges, scratch))
    named = comps.join(top.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return scratch.cut(named.unionByName(top.join(comps.select("node"), "node", "left_anti")))
