"""Near-duplicate groups by a chosen-path set similarity join.

Each document is the set of its distinct k-word shingles (A-Z lower-cased). Documents
with one set collapse to a representative first. Representatives walk down independent
random trees: a node chooses one position of the MinHash signature, and a second one with
probability 1/4, by a hash of the node itself; a child is a chosen position with the
document's minwise token there. A node with at most ``SMALL`` documents is compared
exhaustively; larger ones branch on, to ``DEPTH`` at most. At 1.25 choices a node a pair at
the threshold 0.8 expects one common child. All trees choose from the same ``POSITIONS``
minwise values, so ``recall`` averages over how many of those a pair shares, and the number of
trees is the least that reaches ``RECALL`` at the threshold.

Small nodes are compared in two rounds. First all members meet one pivot, the least
doc_id. Then members in different components meet each other. So the pairs within a group
of copies are never expanded, and no link between components is lost.

Nodes that are still large at the last level hold documents that agree almost everywhere.
Overlapping ones are joined to dense groups, so each document stands there once. All of a
group meet its most central member; those that are left meet the most central of
themselves. What is then still outside the main component meets the rest of its group by differences: the
group's base are the shingles of over half of its sets, and each set stands for the shingles in which it differs from the
base. Sets that differ little are linked with the one that differs least. All others must share differences to be
linked, the more the further they are from the base, so one of the rarest is shared; the order goes by a bounded
sketch of how often a difference occurs, and one that occurs once is not even sent. What a family has in common takes no
part, nor the words of one document alone. So a group sends its differences, once, and no sets. Compared
are only pairs that share a rare difference so early in that order that enough others can follow. In a group of several
families that have little in common the base is small, and the differences are most of a set.

Candidates pass a sketch test with a margin of over four standard deviations and are
then confirmed on the full sets. Sets are taken from the texts again for the documents
of candidate pairs only; their ids are broadcast up to ``IDS_BOUND``, joined beyond.
Documents that many pairs share are copied to several tasks, each with a part of the pairs.

Null or empty texts have an empty set and are linked with nothing. Rows that share a
doc_id are one node. Rows without doc_id stay out of all links and are kept. Other columns
of the input, whatever their names, take no part; ``one_of_each`` returns them as they were.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .cluster import Scratch, few, keep, spread_join
from .components import connected_components, merged

POSITIONS = 64
SMALL, DEPTH, RECALL = 48, 5, 0.999
#: Of 64 four-bit minwise values, so many may differ; 52 agree on average at similarity 0.8, with a deviation of 3.1.
SKETCH_DIFFERS = 26
IDS_BOUND = 1_000_000
#: Counters of the sketch of shingle frequencies in dense groups, and the parts it is summed in.
COUNTERS, COUNTER_PARTS = 1 << 20, 64
#: Sets that choose a dense group's base; links do not depend on it.
BASE_OF = 256
#: Documents and shingles of a block when many pairs of a group are confirmed.
BLOCK, BLOCK_ITEMS = 1024, 2_000_000
PAIRS_A_COPY, HUBS = 1_000, 50_000
SKETCH = ("s0", "s1", "s2", "s3")


def survival(similarity: float, depth: int) -> float:
    """Chance that a pair shares a node at the given depth of one tree."""
    p = 1.0
    for _ in range(depth):
        a = similarity * p
        p = 0.75 * a + 0.25 * (1 - (1 - a) ** 2)
    return p


def recall(similarity: float, depth: int, trees: int) -> float:
    """Chance that a pair shares a node in some tree, over how many of the common minwise values it agrees in."""
    ways = ((math.comb(POSITIONS, i) * similarity**i * (1 - similarity) ** (POSITIONS - i), i / POSITIONS) for i in range(POSITIONS + 1))
    return sum(p * (1 - (1 - survival(agree, depth)) ** trees) for p, agree in ways)


def trees_for(similarity: float, depth: int, target: float) -> int:
    return next(t for t in range(1, 1000) if recall(similarity, depth, t) >= target)


# -- sets --------------------------------------------------------------------------------


def text_sets(column: pa.Array, k: int):
    """(first row, end row, distinct shingles, offsets) by chunks of texts."""
    for lo, hi, data, offsets in K.chunks(column):
        yield lo, hi, *K.distinct(*K.windows(*K.words(data, offsets, fold=True), k, short=True))


def _sketch(sig: np.ndarray) -> list[np.ndarray]:
    """Four longs of sixteen four-bit values."""
    nibbles = (K.mix(sig.astype(np.uint64)) & np.uint64(15)).reshape(len(sig), 4, 16)
    return [np.bitwise_or.reduce(nibbles[:, j] << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64) for j in range(4)]


_SETS = "doc bigint, n bigint, fa bigint, fb bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, sig binary"


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Size, 128-bit fingerprint, sketch and signature of every document's set."""

    def run(batches):
        for b in batches:
            for lo, hi, h, bounds in text_sets(b.column(1), k):
                at, full = bounds[:-1], np.flatnonzero(np.diff(bounds))
                prints = []
                for seed in (1, 2):
                    x = np.zeros(hi - lo, dtype=np.uint64)
                    if len(full):
                        with np.errstate(over="ignore"):
                            x[full] = np.add.reduceat(K.mix(h + np.uint64(seed)), at[full])
                    prints.append(x.view(np.int64))
                sig = K.minima(h, bounds, POSITIONS)
                width = 4 * POSITIONS
                binary = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.arange(0, (hi - lo + 1) * width, width, dtype=np.int32)), pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), *map(pa.array, prints), *map(pa.array, _sketch(sig)), binary], names=["doc", "n", "fa", "fb", "s0", "s1", "s2", "s3", "sig"])

    return docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").alias("_text")).mapInArrow(run, _SETS)


def _full_sets(docs: DataFrame, ids: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(doc, items) of the named documents, from their whole texts."""
    ids = F.broadcast(ids) if ids.count() <= IDS_BOUND else ids
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.col("text").alias("_text")).join(ids, "doc", "left_semi")

    def run(batches):
        for b in batches:
            for lo, hi, h, bounds in text_sets(b.column(1), k):
                items = pa.LargeListArray.from_arrays(pa.array(bounds.astype(np.int64)), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), items], names=["doc", "items"])

    return scratch.cut(named.mapInArrow(run, "doc bigint, items array<bigint>"))


# -- trees -------------------------------------------------------------------------------


def _children(node: np.ndarray, sig: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Child nodes of (node, row of sig) entries, and their rows."""
    h = K.mix(node)
    first = (h % np.uint64(POSITIONS)).astype(np.int64)
    two = (h >> np.uint64(40)) % np.uint64(4) == 0
    second = ((first + 1 + ((h >> np.uint64(8)) % np.uint64(POSITIONS - 1)).astype(np.int64)) % POSITIONS)[two]
    nodes = []
    for n, p, r in ((node, first, row), (node[two], second, row[two])):
        nodes.append(K.mix(n ^ K.mix((p.astype(np.uint64) << np.uint64(32)) | sig[r, p])))
    return np.concatenate(nodes), np.concatenate([row, row[two]])


def _expand(rows: DataFrame, roots: int = 0) -> DataFrame:
    """(doc, node) of the children of rows (doc, sig, node); roots: of so many tree roots instead."""

    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(-1, POSITIONS).astype(np.uint64)
            row = np.arange(b.num_rows)
            if roots:
                node, row = np.repeat(K.mix(np.arange(roots, dtype=np.uint64)), b.num_rows), np.tile(row, roots)
            else:
                node = b.column(2).to_numpy().view(np.uint64)
            child, at = _children(node, sig, row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(child.view(np.int64))], names=["doc", "node"])

    return rows.mapInArrow(run, "doc bigint, node bigint")


def _differs(columns: list[tuple[str, str]]):
    """How many of the 64 four-bit values of two sketches differ."""
    out = []
    for a, b in columns:
        x = F.col(a).bitwiseXOR(F.col(b))
        any_bit = reduce(lambda p, q: p.bitwiseOR(q), [x, *(F.shiftrightunsigned(x, i) for i in (1, 2, 3))])
        out.append(F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111))))
    return reduce(lambda p, q: p + q, out)


def _sizes_allow(a: str, b: str, percent: int):
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b), by their full sets."""
    total = pairs.count()
    # A document a with many pairs is copied; there are at most HUBS of these.
    each = max(PAIRS_A_COPY, total // HUBS)
    hubs = F.broadcast(pairs.groupBy("a").agg(F.ceil(F.count("*") / each).cast("int").alias("copies")).where("copies > 1"))
    dealt = pairs.join(hubs, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"), F.lit(0)).alias("copy"))
    left = sets.select(F.col("doc").alias("a"), F.col("items").alias("ia")).join(hubs, "a", "left")
    left = left.select("a", "ia", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("copies"), F.lit(1)) - 1)).alias("copy"))
    both = dealt.join(left, ["a", "copy"]).join(sets.select(F.col("doc").alias("b"), F.col("items").alias("ib")), "b")
    inter = F.size(F.array_intersect("ia", "ib"))
    both = both.select("a", "b", inter.alias("i"), (F.size("ia") + F.size("ib")).alias("t"))
    return both.where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b")


def _verify_in_blocks(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b), by their full sets; a set goes once to each pair of blocks that asks for it, whatever the pairs there."""
    named = _ids(pairs).join(sets.select("doc", F.size("items").alias("n")), "doc")
    docs, items = named.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n = max(1, -(-docs // BLOCK), -(-items // BLOCK_ITEMS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).alias(f"of_{c}")
    dealt = pairs.select("a", "b", block("a"), block("b"))
    side = lambda c: pairs.select(block("a").alias("at_a"), block("b").alias("at_b"), F.col(c).alias("doc")).distinct()
    asked = side("a").unionByName(side("b")).distinct().join(sets, "doc")

    def links(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            lists = right.column("items").combine_chunks()
            edge = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            flat = lists.flatten().to_numpy()
            at = {d: i for i, d in enumerate(right.column("doc").to_pylist())}
            a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
            for i in range(len(a)):
                x, y = at[int(a[i])], at[int(b[i])]
                p, q = flat[edge[x] : edge[x + 1]], flat[edge[y] : edge[y + 1]]
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    out_a.append(int(a[i]))
                    out_b.append(int(b[i]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return dealt.groupBy("of_a", "of_b").cogroup(asked.groupBy("at_a", "at_b")).applyInArrow(links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept for every row of docs."""
    most = few(docs)
    with Scratch(docs.sparkSession, most) as scratch:
        return keep(_groups(docs, k, percent, scratch).coalesce(most))


def _tree_nodes(reps: DataFrame, percent: int, scratch: Scratch) -> list[DataFrame]:
    """(doc, node, c) of the nodes that are compared; c: members of the node."""
    nodes = []
    level = _expand(reps.select("doc", "sig"), trees_for(percent / 100, DEPTH, RECALL))
    for depth in range(1, DEPTH + 1):
        level = scratch.cut(level)
        sizes = scratch.cut(level.groupBy("node").agg(F.count("*").alias("c")).where("c > 1"))
        held = scratch.cut(spread_join(level, sizes, "node", "c", level.count()))
        scratch.drop(level, sizes)
        large = held.where(F.col("c") > SMALL)
        nodes.append(held.where(F.col("c") <= SMALL).select("doc", "node", "c"))
        if depth == DEPTH or large.isEmpty():
            nodes.append(large.select("doc", "node", "c"))
            return nodes
        level = _expand(large.join(reps.select("doc", "sig"), "doc").select("doc", "sig", "node"))
    return nodes


def _groups(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    all_sets = scratch.cut(signatures(docs, k))
    some = all_sets.where("n > 0 and doc is not null")
    reps = scratch.cut(some.groupBy("fa", "fb").agg(F.min(F.struct("doc", "n", *SKETCH, "sig")).alias("r")).select("fa", "fb", "r.*"))
    member = scratch.cut(reduce(DataFrame.unionByName, _tree_nodes(reps, percent, scratch)).join(reps.select("doc", "n", *SKETCH), "doc"))

    # First round: every member with its node's pivot; in dense groups with the group's.
    groups = scratch.cut(_dense_groups(member.where(F.col("c") > SMALL), scratch))
    member = member.where(F.col("c") <= SMALL)
    pivots = member.groupBy("node").agg(F.min(F.struct("doc", "n", *SKETCH)).alias("p")).select("node", F.col("p.doc").alias("pivot"), F.col("p.n").alias("pn"), *(F.col(f"p.{c}").alias(f"p{c}") for c in SKETCH))
    member = member.join(pivots, "node")
    fits = _sizes_allow("n", "pn", percent) & (_differs([(c, f"p{c}") for c in SKETCH]) <= SKETCH_DIFFERS)
    stars = member.where((F.col("doc") != F.col("pivot")) & fits).select(F.col("pivot").alias("a"), F.col("doc").alias("b"))
    pairs = scratch.cut(stars.unionByName(_star(groups)).distinct())
    sets = _full_sets(docs, _ids(pairs), k, scratch)
    comps = scratch.cut(connected_components(_verify(pairs, sets, percent), scratch))

    # Second round: members of different components.
    if not groups.isEmpty():
        outside = scratch.cut(_outside(groups, comps))
        if not outside.isEmpty():
            comps = merged(comps, _verify(_star(outside), sets, percent), scratch)
            comps = merged(comps, scratch.cut(_verify_in_blocks(scratch.cut(_rare_pairs(groups, comps, sets, percent, scratch)), sets, percent)), scratch)
    member = member.drop("pn", *(f"p{c}" for c in SKETCH)).join(comps.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    more = scratch.cut(_small_nodes(member, percent).distinct().join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        rest = scratch.cut(_ids(more).join(sets.select("doc"), "doc", "left_anti"))
        comps = merged(comps, _verify(more, sets.unionByName(_full_sets(docs, rest, k, scratch)), percent), scratch)

    named = reps.join(comps.withColumnRenamed("node", "doc"), "doc", "left").select("fa", "fb", F.coalesce("component", "doc").alias("component"), F.lit(1).alias("one"))
    # All copies of one text have one fingerprint, so the few common ones are handled apart.
    common = some.groupBy("fa", "fb").agg(F.count("*").alias("rows"))
    named = scratch.cut(named.drop("one").join(common, ["fa", "fb"]).withColumn("print", F.struct("fa", "fb")).drop("fa", "fb"))
    full = all_sets.where("n > 0 and doc is not null").select("doc", "n", F.struct("fa", "fb").alias("print"))
    out = spread_join(full, named, "print", "rows", full.count()).select("doc", "n", "component")
    rest = all_sets.where("n = 0 or doc is null").select("doc", "n", F.col("doc").alias("component"))
    out = out.unionByName(rest).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc")).distinct().unionByName(pairs.select(F.col("b").alias("doc")).distinct()).distinct()


def _near(on, percent: int):
    return on & (F.col("x.component") != F.col("y.component")) & _sizes_allow("x.n", "y.n", percent) & (_differs([(f"x.{c}", f"y.{c}") for c in SKETCH]) <= SKETCH_DIFFERS)


def _pair(x: DataFrame, y: DataFrame, on) -> DataFrame:
    return x.alias("x").join(y.alias("y"), on).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))


def _small_nodes(member: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in nodes of 3 to SMALL members, the pivot's aside: those are done."""
    rest = member.where((F.col("c") > 2) & (F.col("c") <= SMALL) & (F.col("doc") != F.col("pivot"))).select("node", "doc", "component", "n", *SKETCH)
    return _pair(rest, rest, _near((F.col("x.node") == F.col("y.node")) & (F.col("x.doc") < F.col("y.doc")), percent))


# -- dense groups --------------------------------------------------------------------------


def _dense_groups(large: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, group, n, sketch, degree) of the members of large nodes; overlapping nodes make one group. degree: nodes it is in."""
    first = large.groupBy("node").agg(F.min("doc").alias("first"), F.first("c").alias("size"))
    edges = spread_join(large.select("doc", "node"), first, "node", "size", large.count()).select(F.col("first").alias("a"), F.col("doc").alias("b"))
    joined = connected_components(edges, scratch).select(F.col("node").alias("doc"), F.col("component").alias("group"))
    return joined.join(large.groupBy("doc", "n", *SKETCH).agg(F.count("*").alias("degree")), "doc")


def _star(groups: DataFrame) -> DataFrame:
    """Pairs of each group's most central member with all others, that member first."""
    center = groups.groupBy("group").agg(F.max(F.struct("degree", (-F.col("doc")).alias("d"))).alias("m"), F.count("*").alias("size")).select("group", (-F.col("m.d")).alias("center"), "size")
    return spread_join(groups, center, "group", "size", groups.count()).where("doc <> center").select(F.col("center").alias("a"), F.col("doc").alias("b"))


def _labelled(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """groups with component and main, the component most of the group is in."""
    named = groups.join(comps.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    sizes = named.groupBy("group", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("group").agg(F.max(F.struct("c", (-F.col("component")).alias("m"))).alias("x"), F.sum("c").alias("rows"))
    return spread_join(named, main.select("group", (-F.col("x.m")).alias("main"), "rows"), "group", "rows", groups.count())


def _outside(groups: DataFrame, comps: DataFrame) -> DataFrame:
    return _labelled(groups, comps).where("component <> main").select("doc", "group", "degree")


def _counter(items: np.ndarray) -> np.ndarray:
    return (K.mix(items.view(np.uint64)) % np.uint64(COUNTERS)).astype(np.int64)


def _frequencies(rows: DataFrame) -> np.ndarray:
    """How often each counter's shingles occur in rows (items): never less than any one of them does."""

    def count(batches):
        table = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            table += np.bincount(_counter(b.column(0).flatten().to_numpy()), minlength=COUNTERS)
        some = np.flatnonzero(table)
        edge = np.searchsorted(some, np.arange(0, COUNTERS + 1, COUNTERS // COUNTER_PARTS))
        used = np.flatnonzero(np.diff(edge))
        if len(used):
            at = np.append(edge[:-1][used], len(some)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(some)), pa.ListArray.from_arrays(pa.array(at), pa.array(table[some]))], names=["part", "at", "n"])

    def total(key: tuple, part: pa.Table) -> pa.Table:
        at, where = np.unique(part.column("at").combine_chunks().flatten().to_numpy(), return_inverse=True)
        n = np.bincount(where.reshape(-1), part.column("n").combine_chunks().flatten().to_numpy()).astype(np.int64)
        return pa.table({"at": pa.array([at], pa.list_(pa.int64())), "n": pa.array([n], pa.list_(pa.int64()))})

    out = np.zeros(COUNTERS, dtype=np.int64)
    parts = rows.select("items").mapInArrow(count, "part int, at array<bigint>, n array<bigint>").groupBy("part").applyInArrow(total, "at array<bigint>, n array<bigint>").toArrow()
    if parts.num_rows:
        out[parts.column("at").combine_chunks().flatten().to_numpy()] = parts.column("n").combine_chunks().flatten().to_numpy()
    return out


def _differences(rows: DataFrame, percent: int) -> DataFrame:
    """rows (group, doc, component, main, n, sketch, items) with diff: in what a set differs from its group's base, the shingles of over half of its sets (of about ``BASE_OF`` of them).

    For sets x and y with differences p and q, |x ^ y| = |p| + |q| - 2 |p & q|. So they are
    linked if excess(x) + excess(y) <= 2 (100 + percent) |p & q|. low: the least excess of the group.
    Those whose excess and low are not above 0 together are linked with hub, the member that has it: its
    component becomes theirs. Members of different components then share a difference, if they are linked.
    """
    total = rows.count()
    sizes = rows.groupBy("group").agg(F.count("*").alias("members"))
    # Any base gives the same links: some of a large group's sets are enough to choose it.
    some = spread_join(rows.select("group", "doc", "items"), sizes, "group", "members", total).where(F.pmod(F.xxhash64("doc"), F.ceil(F.col("members") / BASE_OF)) == 0)
    asked = some.groupBy("group").agg(F.count("*").alias("asked"))
    often = some.select("group", F.explode("items").alias("token")).groupBy("group", "token").agg(F.count("*").alias("c")).join(asked, "group").where("2 * c > asked")
    base = sizes.join(often.groupBy("group").agg(F.collect_list("token").alias("base")), "group", "left")
    both = spread_join(rows, base, "group", "members", total)
    diff = F.when(F.col("base").isNull(), F.col("items")).otherwise(F.concat(F.array_except("items", "base"), F.array_except("base", "items")))
    out = both.select("group", "doc", "component", "main", F.size("items").cast("bigint").alias("n"), *SKETCH, diff.alias("diff"))
    out = out.withColumn("excess", (100 + percent) * F.size("diff") - (100 - percent) * F.col("n"))
    least = out.groupBy("group").agg(F.min(F.struct("excess", "doc", "component")).alias("m"), F.count("*").alias("members"))
    out = spread_join(out, least.select("group", F.col("m.excess").alias("low"), F.col("m.doc").alias("hub"), F.col("m.component").alias("of_hub"), "members"), "group", "members", total).drop("members")
    joins = F.col("excess") + F.col("low") <= 0
    return out.withColumn("to_hub", joins & (F.col("component") != F.col("of_hub"))).withColumn("component", F.when(joins, F.col("of_hub")).otherwise(F.col("component")))


def _rare_tokens(rows: DataFrame, percent: int) -> DataFrame:
    """(group, doc, component, main, n, sketch, excess, token, left): the rarest differences of each set of rows, as many as a link needs, without those that occur once.

    left: differences from this one on. rows: sets, or their differences if these are there.
    """
    if "diff" not in rows.columns:
        rows = _differences(rows, percent)
    rows = rows.withColumnRenamed("diff", "items")
    shared = rows.sparkSession.sparkContext.broadcast(_frequencies(rows))
    kept = ["group", "doc", "component", "main", "n", *SKETCH, "excess"]

    def run(batches):
        often = shared.value
        for b in batches:
            lists, excess, low = b.column(len(kept)), b.column(len(kept) - 1).to_numpy(), b.column(len(kept) + 1).to_numpy()
            size = lists.value_lengths().to_numpy()
            items, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            n = often[_counter(items)]
            order = np.lexsort((items, n, owner))
            left = np.repeat(np.cumsum(size), size) - np.arange(len(order))
            common = np.maximum(-((excess + low) // (-2 * (100 + percent))), 1)
            early = (left >= common[owner]) & (n[order] > 1)
            use = order[early]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(owner[use])) for i in range(len(kept))), pa.array(items[use]), pa.array(left[early])], names=[*kept, "token", "left"])

    kinds = ", ".join(f"`{c}` bigint" for c in [*kept, "token", "left"])
    return rows.select(*kept, "items", "low").mapInArrow(run, kinds)


def _rare_pairs(groups: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of a member outside its group's main component and one of another component that share a rare difference from the base, or of one and its hub."""
    labelled = scratch.cut(_labelled(groups, comps))
    mixed = labelled.where("component <> main").select("group").distinct()
    rows = scratch.cut(_differences(scratch.cut(labelled.join(mixed, "group", "left_semi").join(sets, "doc")), percent))
    tokens = scratch.cut(_rare_tokens(rows, percent))
    # What the first common difference and all behind it can give must reach the overlap of a link.
    enough = 2 * (100 + percent) * F.least("x.left", "y.left") >= F.col("x.excess") + F.col("y.excess")
    on = (F.col("x.group") == F.col("y.group")) & (F.col("x.token") == F.col("y.token")) & enough
    hubs = rows.where("to_hub").select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b"))
    return hubs.unionByName(_pair(tokens.where("component <> main"), tokens, _near(on, percent))).distinct()


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that a smaller doc_id stands for; all columns stay."""
    inner = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)))
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = inner.join(gone, F.col(f"_c{docs.columns.index('doc_id')}").cast("bigint") == F.col("_gone"), "left_anti")
    return left.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))
