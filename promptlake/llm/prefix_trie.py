"""The prefix trie of rebuilt conversations, from padded turn-id matrices.

A turn is its role and text (null: empty), known by the 128 bits of an MD5. ``rebuild`` orders
the turns of each conversation and puts the first turns of the conversation that opens its
hundred before them. The rebuilt conversations are cut into blocks of ``WIDTH`` turns, so a row
is bounded whatever a conversation's length; a block knows a hash of all turns before it.

Blocks are dealt to range shards by (block, hash before, turn ids, conversation), so a group
of copies, however large, spreads over many shards. In a shard the turn ids become a padded
matrix of dense codes. A lexsort orders its rows, marks of changed columns are
OR-accumulated from left to right, a mark in column d starts a node of depth d, and
``reduceat`` over the starts gives the least member, the members and the subtree sums of every depth.

Only nodes that touch a shard's first or last row can go on in another shard, and only nodes
at the end of a block have their children in another block. These boundary nodes are few (at
most two paths a shard, one node a block); they recombine in a grouping by (depth, prefix
hash). What a boundary node itself adds goes to its ancestors along its path. A node of a
later block adds to the ancestors in earlier blocks by way of its least member: the
sums of what each conversation owns in its later blocks are carried to the path of its earlier ones.

The digest of a node's ends needs their ids in one order: interior nodes have them in one shard;
pieces of boundary nodes are hashed one after the other, sorted, in a stream that holds one piece.

Rows without conv_id belong to no conversation. Equal turn numbers are ordered by the turn's
MD5, so repeated rows are repeated turns. No rows: no nodes, not even the root. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernel as K
from .cluster import Scratch, keep

WIDTH = 32
#: Conversations that share their first turns, and the greatest number of turns that are shared less one.
FAMILY, SHARED = 100, 6
#: Block rows of a shard: a padded matrix of that many rows is about 20 MB.
SHARD_ROWS = 40_000
#: Ids of ends in one piece of a boundary node.
PIECE = 20_000

_TURNS = "conv bigint, turn bigint, hi bigint, lo bigint, len int"


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, hi, lo, len) of all turns; a turn's id is the MD5 of role, a zero byte and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.md5(F.concat(role, F.lit("\0"), text).cast("binary")).alias("id"), F.length(text).alias("len"))

    def split(batches):
        for b in batches:
            raw = np.frombuffer(bytes.fromhex("".join(b.column(2).to_pylist())), dtype=">u8").astype(np.uint64).reshape(-1, 2)
            raw ^= np.uint64(1 << 63)  # signed numbers then have the digests' order
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw[:, 0].copy().view(np.int64)), pa.array(raw[:, 1].copy().view(np.int64)), b.column(3)], names=["conv", "turn", "hi", "lo", "len"])

    return rows.mapInArrow(split, _TURNS)


def _numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """turns with pos, the place in the conversation: range shards count from 0, and those that go on add what lies before."""
    ordered = turns.repartitionByRange("conv", F.col("turn").asc_nulls_first(), F.col("hi"), F.col("lo")).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "hi", "lo")

    def count(batches):
        at, before = None, 0
        for b in batches:
            conv = b.column(0).to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            place = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if at is not None and conv[0] == at:
                place[: first[1] if len(first) > 1 else None] += before
            at, before = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(place), b.column(5)], names=["conv", "hi", "lo", "len", "pos", "shard"])

    rows = scratch.cut(ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(count, "conv bigint, hi bigint, lo bigint, len int, pos bigint, shard int"))
    sizes = rows.groupBy("conv", "shard").agg(F.count("*").alias("n"))
    by = Window.partitionBy("conv").orderBy("shard")
    # Conversations over several shards: at most one for each border between two shards.
    over = sizes.withColumn("before", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("before > 0").select("conv", "shard", "before")
    return rows.join(F.broadcast(over), ["conv", "shard"], "left").select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "hi", "lo", "len")


def rebuild(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, pos, hi, lo, len) of the rebuilt conversations; one without turns has a row with pos -1."""
    own = scratch.cut(_numbered(_turns(conversations), scratch))
    sizes = own.groupBy("conv").agg(F.count("*").alias("n"))
    shared = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(SHARED)).cast("int")
    # A conversation takes at most SHARED - 1 turns, so only those of a first conversation go out, to at most FAMILY others.
    head = own.where((F.col("pos") < SHARED - 1) & (F.col("conv") % FAMILY == 0)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "hi", "lo", "len"))).alias("turns"))
    plan = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), shared.alias("h")).join(head, "base", "left")
    plan = scratch.cut(plan.select("conv", "n", "h", F.slice(F.coalesce("turns", F.array().cast("array<struct<pos:bigint,hi:bigint,lo:bigint,len:int>>")), F.lit(1), F.col("h")).alias("turns")))
    given = plan.select("conv", F.explode("turns").alias("t")).select("conv", "t.*")
    shift = plan.select("conv", "h", F.size("turns").alias("taken"))
    rest = own.join(shift, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "hi", "lo", "len")
    none = plan.where("size(turns) = 0 and n <= h").select("conv", F.lit(-1).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("hi"), F.lit(0).cast("bigint").alias("lo"), F.lit(0).alias("len"))
    return given.unionByName(rest).unionByName(none)


# -- blocks ------------------------------------------------------------------------------


def _paths(ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values for each turn (rows of ids: hi, lo) at its place; a prefix is the XOR of its turns."""
    with np.errstate(over="ignore"):
        hi, lo, p = ids[:, 0].view(np.uint64), ids[:, 1].view(np.uint64), pos.astype(np.uint64)
        a = K.mix(hi ^ K.mix(p * np.uint64(2) + np.uint64(1))) ^ K.mix(lo + K.mix(p))
        b = K.mix(lo ^ K.mix(p * np.uint64(2) + np.uint64(1_000_003))) ^ K.mix(hi + K.mix(p + np.uint64(77)))
    return a, b


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Turn ids (n x 2) and turns of each row."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    return ids.flatten().to_numpy().reshape(-1, 2), ids.value_lengths().to_numpy() // 2


_BLOCKS = "conv bigint, block bigint, k1 bigint, k2 bigint, ids array<bigint>, lens array<int>, last boolean"


def blocks(rebuilt: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """(conv, block, k1, k2, ids, lens, last): up to width turns each, the hash of all before them, and whether they are the last."""
    block = F.greatest(F.floor(F.col("pos") / width), F.lit(0)).cast("bigint")
    each = F.when(F.col("pos") >= 0, F.struct("pos", "hi", "lo", "len"))
    rows = rebuilt.groupBy("conv", block.alias("block")).agg(F.array_sort(F.collect_list(each)).alias("t"))
    rows = scratch.cut(rows.select("conv", "block", F.flatten(F.transform("t", lambda x: F.array(x["hi"], x["lo"]))).alias("ids"), F.transform("t", lambda x: x["len"]).alias("lens")))
    long = rows.where(F.size("lens") == width)

    def hashes(batches):
        for b in batches:
            ids, n = _flat(b.column(2))
            owner = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            a, c = _paths(ids, b.column(1).to_numpy()[owner] * width + within)
            at = np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.bitwise_xor.reduceat(x, at).view(np.int64) if len(at) else np.zeros(0, dtype=np.int64)) for x in (a, c))], names=["conv", "block", "x1", "x2"])

    full = long.select("conv", "block", "ids").mapInArrow(hashes, "conv bigint, block bigint, x1 bigint, x2 bigint")
    by = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = full.select("conv", (F.col("block") + 1).alias("block"), F.bit_xor("x1").over(by).alias("k1"), F.bit_xor("x2").over(by).alias("k2"))
    known = rows.join(before, ["conv", "block"], "left").withColumns({"k1": F.coalesce("k1", F.lit(0)), "k2": F.coalesce("k2", F.lit(0))})
    # A block is the last one unless it is full and another follows.
    follows = rows.where("block > 0").select("conv", (F.col("block") - 1).alias("block"), F.lit(True).alias("follows"))
    known = known.join(follows, ["conv", "block"], "left")
    return scratch.cut(known.select("conv", "block", "k1", "k2", "ids", "lens", F.col("follows").isNull().alias("last")))


# -- shards --------------------------------------------------------------------------------

#: A node or a part of one. path: keys of the ancestors in the block and itself, of boundary nodes only.
#: leaves and saved: sums over the subtree; own_saved: of the node alone; size: code points of its last text.
_NODE = "depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, edge boolean, split boolean, conv bigint, parent bigint, n bigint, children bigint, leaves bigint, saved bigint, own_saved bigint, size bigint, ends binary, first bigint, sha string, path array<bigint>"
_NAMES = [c.split()[0] for c in _NODE.split(", ")]
_TYPES = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
_KINDS = [_TYPES[c.split()[1]] for c in _NODE.split(", ")]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def shard_nodes(table: pa.Table, width: int, piece: int) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard's block rows. Interior nodes are whole; boundary nodes (edge) and block ends (split) are parts."""
    ids, n = _flat(table.column("ids"))
    conv, block, last = (table.column(c).to_numpy() for c in ("conv", "block", "last"))
    base = [table.column(c).to_numpy().view(np.uint64) for c in ("k1", "k2")]
    rows, owner = len(n), np.repeat(np.arange(len(n)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    # Dense codes in the order of (hi, lo), so that rows come as in the range shards; a missing turn comes first.
    code = np.zeros(len(ids), dtype=np.int32)
    if len(ids):
        by = np.lexsort((ids[:, 1], ids[:, 0]))
        new = (ids[by][1:] != ids[by][:-1]).any(axis=1)
        code[by] = np.concatenate([[0], np.cumsum(new)])
    codes = np.full((rows, width), -1, dtype=np.int32)
    codes[owner, within] = code
    size = np.zeros((rows, width), dtype=np.int64)
    lens = table.column("lens").combine_chunks()
    size[owner, within] = lens.flatten().to_numpy()
    a, b = _paths(ids, block[owner] * width + within)
    keys = []
    for x, start in zip((a, b), base, strict=True):
        k = np.zeros((rows, width + 1), dtype=np.uint64)
        k[:, 0] = start
        k[owner, within + 1] = x
        keys.append(np.bitwise_xor.accumulate(k, axis=1).view(np.int64))
    signed = [k[:, 0] for k in keys]
    order = np.lexsort((conv, *codes.T[::-1], signed[1], signed[0], block))
    conv, block, last, n, codes, size = conv[order], block[order], last[order], n[order], codes[order], size[order]
    keys = [k[order] for k in keys]
    mark = np.ones((rows, width + 1), dtype=bool)
    mark[1:, 0] = (block[1:] != block[:-1]) | (keys[0][1:, 0] != keys[0][:-1, 0]) | (keys[1][1:, 0] != keys[1][:-1, 0])
    mark[1:, 1:] = codes[1:] != codes[:-1]
    mark = np.logical_or.accumulate(mark, axis=1)
    sums = {c: np.zeros(rows, dtype=np.int64) for c in ("leaves", "saved")}
    below = np.zeros(rows, dtype=np.int64)  # starts of present nodes one deeper
    node_conv = np.zeros((rows, width + 1), dtype=np.int64)
    edge_at = np.zeros((rows, width + 1), dtype=bool)
    found: list[dict] = []
    for d in range(width, -1, -1):
        s = np.flatnonzero(mark[:, d])
        e = np.append(s[1:], rows)
        there = n[s] >= d
        least, ended = np.minimum.reduceat(conv, s), np.add.reduceat(((n == d) & last).astype(np.int64), s)
        children = np.add.reduceat(below, s)
        edge = (s == 0) | (e == rows)
        goes_on = (np.add.reduceat((~last).astype(np.int64), s) > 0) if d == width else np.zeros(len(s), dtype=bool)
        length = size[s, d - 1] if d else np.zeros(len(s), dtype=np.int64)
        own = (e - s - 1) * length
        leaf = (children == 0) & ~goes_on
        whole = there & ~edge & ((block[s] == 0) | (d > 0))
        sums["saved"][s[whole]] += own[whole]
        sums["leaves"][s[whole]] += leaf[whole]
        sub = {c: np.add.reduceat(v, s) for c, v in sums.items()}
        root_of_later = (block[s] > 0) & (d == 0)
        for c, v in ((node_conv, least), (edge_at, edge | root_of_later)):
            c[s, d] = v
        below = np.zeros(rows, dtype=np.int64)
        # A boundary node counts as a child when it is whole; the others count where they are known.
        below[s[whole]] = 1
        use = np.flatnonzero(there)
        found.append({"d": d, "s": s[use], "e": e[use], "least": least[use], "ended": ended[use], "children": children[use], "edge": edge[use], "goes_on": goes_on[use], "root": root_of_later[use], "own": own[use], "size": length[use], **{c: v[use] for c, v in sub.items()}})
    first_of = np.maximum.accumulate(np.where(mark, np.arange(rows)[:, None], 0), axis=0)
    for x in reversed(found):
        d, s, e = x["d"], x["s"], x["e"]
        if not len(s):
            continue
        root, edge = x["root"], x["edge"] & ~x["root"]
        split = root | edge | x["goes_on"]
        up = first_of[s, d - 1] if d else s
        parent = [pa.array(k[s, d - 1]) for k in keys] if d else [pa.nulls(len(s), pa.int64())] * 2
        known = ~edge & ~root & ((~edge_at[up, d - 1]) if d else np.zeros(len(s), dtype=bool))
        digests, pieces, paths = [_NO_ENDS] * len(s), [None] * len(s), [None] * len(s)
        # Members that end here, in order; at a block's end others that go on lie between them.
        ends = pc.cast(pa.array(conv[(n == d) & last]), pa.string())
        stop = np.cumsum((n == d) & last)[e - 1]
        start = stop - x["ended"]
        for i in np.flatnonzero((x["ended"] > 0) & ~root):
            if not split[i]:
                digests[i] = hashlib.sha256(",".join(ends[start[i] : stop[i]].to_pylist()).encode()).hexdigest()
            elif x["ended"][i] <= piece:
                pieces[i] = ",".join(ends[start[i] : stop[i]].to_pylist()).encode()
        first = conv[(n == d) & last]
        first = first[np.minimum(start, len(first) - 1)] if len(first) else np.zeros(len(s), dtype=np.int64)
        for i in np.flatnonzero(edge):
            # The root of a later block is the end of the one before: what it gets is carried there.
            paths[i] = np.stack([k[s[i], int(block[s[i]] > 0) : d + 1] for k in keys], axis=1).ravel().tolist()
        columns = {
            "depth": pa.array(block[s] * width + d), "k1": pa.array(keys[0][s, d]), "k2": pa.array(keys[1][s, d]), "p1": parent[0], "p2": parent[1], "edge": pa.array(edge), "split": pa.array(split),
            "conv": pa.array(x["least"], mask=root), "parent": pa.array(node_conv[up, d - 1] if d else s, mask=~known), "n": pa.array(np.where(root, 0, e - s)), "children": pa.array(x["children"]), "leaves": pa.array(np.where(root, 0, x["leaves"])), "saved": pa.array(np.where(root, 0, x["saved"])),
            "own_saved": pa.array(np.where(root | edge, 0, x["own"])), "size": pa.array(np.where(root, 0, x["size"])), "ends": pa.array(pieces, pa.binary()), "first": pa.array(first), "sha": pa.array(digests, pa.string(), mask=split), "path": pa.array(paths, pa.list_(pa.int64())),
        }
        yield pa.RecordBatch.from_arrays([columns[c].cast(k) for c, k in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)
        # Long lists of ends of a boundary node leave in pieces of their own.
        for i in np.flatnonzero(split & (x["ended"] > piece) & ~root):
            for lo in range(start[i], stop[i], piece):
                some = ends[lo : min(lo + piece, stop[i])]
                part = {c: pa.nulls(1, k) for c, k in zip(_NAMES, _KINDS, strict=True)}
                part |= {c: columns[c].slice(i, 1) for c in ("depth", "k1", "k2")} | {c: pa.array([v]) for c, v in (("edge", False), ("split", True), ("n", 0), ("children", 0), ("leaves", 0), ("saved", 0), ("own_saved", 0), ("size", 0))}
                part |= {"ends": pa.array([",".join(some.to_pylist()).encode()]), "first": pa.array([int(some[0].as_py())])}
                yield pa.RecordBatch.from_arrays([part[c].cast(k) for c, k in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def _sharded(rows: DataFrame, shards: int, width: int, piece: int) -> DataFrame:
    """Parts of nodes, a shard at a time."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from shard_nodes(pa.Table.from_batches(held), width, piece)

    return rows.repartitionByRange(max(shards, 1), "block", "k1", "k2", "ids", "conv").mapInArrow(run, _NODE)


def _end_digests(parts: DataFrame) -> DataFrame:
    """(depth, k1, k2, sha) from the ordered pieces of ends of boundary nodes; a task holds one piece at a time."""
    pieces = parts.where("ends is not null").select("depth", "k1", "k2", "first", "ends")
    kind = "depth bigint, k1 bigint, k2 bigint, sha string"

    def run(batches):
        key, state, out = None, None, []
        for b in batches:
            for d, k1, k2, ends in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if (d, k1, k2) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (d, k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ends)
            yield from _rows(out, kind)
            out = []
        if key is not None:
            yield from _rows([(*key, state.hexdigest())], kind)

    return pieces.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "first").mapInArrow(run, kind)


def _rows(rows: list[tuple], kind: str) -> Iterator[pa.RecordBatch]:
    if rows:
        names, kinds = zip(*(c.split() for c in kind.split(", ")), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(v, _TYPES[k]) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _carried(nodes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(depth, k1, k2, more_leaves, more_saved): what the nodes of later blocks add to the nodes of earlier ones."""
    owned = nodes.where(F.col("depth") > width).groupBy("conv", F.floor((F.col("depth") - 1) / width).cast("bigint").alias("block")).agg(F.sum("own_leaf").alias("l"), F.sum("own_saved").alias("s"))
    later = rows.where("block > 0").select("conv", "block").join(owned, ["conv", "block"], "left")
    by = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    carry = later.select("conv", (F.col("block") - 1).alias("block"), F.coalesce(F.sum("l").over(by), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(by), F.lit(0)).alias("s")).where("l > 0 or s > 0")
    path = rows.join(carry, ["conv", "block"]).select("block", "k1", "k2", "ids", "l", "s")

    def run(batches):
        for b in batches:
            ids, n = _flat(b.column(3))
            if not len(n):
                continue
            block = b.column(0).to_numpy()
            # One place before each row's turns holds the hash before the block.
            at = np.repeat(np.arange(len(n)), n + 1)
            within = np.arange(len(at)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
            owner, turn = at[within > 0], within[within > 0] - 1
            out = []
            for x, k in zip(_paths(ids, block[owner] * width + turn), (1, 2), strict=True):
                m = np.zeros((len(n), width + 1), dtype=np.uint64)
                m[:, 0] = b.column(k).to_numpy().view(np.uint64)
                m[owner, turn + 1] = x
                out.append(np.bitwise_xor.accumulate(m, axis=1)[at, within].view(np.int64))
            use = (within > 0) | (block[at] == 0)
            columns = [(block[at] * width + within)[use], *(x[use] for x in out), b.column(4).to_numpy()[at][use], b.column(5).to_numpy()[at][use]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["depth", "k1", "k2", "l", "s"])

    each = path.mapInArrow(run, "depth bigint, k1 bigint, k2 bigint, l bigint, s bigint")
    return each.groupBy("depth", "k1", "k2").agg(F.sum("l").alias("more_leaves"), F.sum("s").alias("more_saved"))


def trie(conversations: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS, piece: int = PIECE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    with Scratch(conversations.sparkSession) as scratch:
        return keep(_trie(conversations, scratch, width, shard_rows, piece))


def _trie(conversations: DataFrame, scratch: Scratch, width: int, shard_rows: int, piece: int) -> DataFrame:
    rows = blocks(rebuild(conversations, scratch), scratch, width)
    shards = -(-rows.count() // shard_rows)
    parts = scratch.cut(_sharded(rows, shards, width, piece))
    key = ["depth", "k1", "k2"]

    # Boundary nodes: their parts meet by key.
    ends = _end_digests(parts.where("split"))
    met = parts.where("split").groupBy(*key).agg(F.max("edge").alias("edge"), F.first("p1", True).alias("p1"), F.first("p2", True).alias("p2"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("own_saved").alias("own_saved"), F.max("size").alias("size"), F.max("parent").alias("parent"), F.first("path", True).alias("path"))
    met = scratch.cut(met.join(ends, key, "left").withColumn("sha", F.coalesce("sha", F.lit(_NO_ENDS))).withColumn("own_saved", F.when(F.col("edge"), (F.col("n") - 1) * F.col("size")).otherwise(F.col("own_saved"))))
    child = met.where("edge and p1 is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("more"))
    met = met.join(child, key, "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")
    met = scratch.cut(met.withColumn("own_leaf", (F.col("children") == 0).cast("bigint")))
    # What a boundary node adds goes to itself and its ancestors in the block, all of them boundary nodes.
    steps = F.size("path") / 2
    up = met.where("edge and (own_leaf > 0 or own_saved > 0)").select("depth", "own_leaf", "own_saved", "path", steps.cast("int").alias("steps"))
    up = up.select((F.col("depth") - F.col("steps") + 1).alias("top"), "own_leaf", "own_saved", "path", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("i"))
    up = up.select((F.col("top") + F.col("i")).alias("depth"), F.col("path")[2 * F.col("i")].alias("k1"), F.col("path")[2 * F.col("i") + 1].alias("k2"), "own_leaf", "own_saved")
    up = up.groupBy(*key).agg(F.sum("own_leaf").alias("up_leaves"), F.sum("own_saved").alias("up_saved"))
    columns = [*key, "p1", "p2", "conv", "n", "children", "leaves", "saved", "own_leaf", "own_saved", "sha"]
    met = met.join(up, key, "left").withColumns({"leaves": F.col("leaves") + F.coalesce("up_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("up_saved", F.lit(0))}).select(*columns, "parent")
    inner = parts.where("not split").withColumn("own_leaf", (F.col("children") == 0).cast("bigint")).select(*columns, "parent")
    met = scratch.cut(met)
    nodes = inner.unionByName(met)

    # Later blocks.
    if not rows.where("block > 0").isEmpty():
        nodes = scratch.cut(nodes.join(_carried(nodes, rows, width), key, "left").withColumns({"leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))}).drop("more_leaves", "more_saved"))
    # A parent that is a boundary node is named after its parts have met.
    names = met.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("named"))
    open_ = nodes.where("parent is null and p1 is not null").join(names, ["depth", "p1", "p2"], "left").withColumn("parent", F.col("named")).drop("named")
    out = nodes.where("parent is not null or p1 is null").unionByName(open_)
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))
