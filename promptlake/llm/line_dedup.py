"""Line de-duplication over a sharded minimal perfect hash.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z
lower-cased. Keys of at least ``min_chars`` code points that occur in at least
``min_docs`` documents are frequent: all their lines go, except those in the largest
doc_id that holds the key.

The frequent keys' 128-bit hashes are dealt to shards. Each shard is indexed by a
minimal perfect hash (levels of bit arrays; a key's index is the rank of its bit), under
which lie flat arrays: a 64-bit fingerprint, the document count and the largest doc_id.
Documents send only the hashes of their long lines to the shards and probe the arrays;
neither lines nor texts are joined with each other. A shard that a very common line
makes hot is probed by several tasks, each with a copy of its arrays.

Null and empty texts are one empty line. Rows with one doc_id count as one document. Other
columns of the input, whatever their names, take no part and stay; only input columns with
the names of the two counts are replaced by them.
Rows without a doc_id are counted as one document that never keeps a frequent line
while another document has it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .cluster import Scratch, few, keep, parts

MIN_CHARS, MIN_DOCS = 20, 3
KEYS_A_SHARD = 200_000
LINES_A_PROBE = 100_000
GAMMA = 2.0
_NONE = -(1 << 63)

_A = K.mix(np.arange(256, dtype=np.uint64) + np.uint64(0xA11CE)) | np.uint64(1)
_B = K.mix(np.arange(256, dtype=np.uint64) + np.uint64(0xB0B)) | np.uint64(1)
for _t in (_A, _B):
    _t[65:91] = _t[97:123]


# -- lines ---------------------------------------------------------------------------


def line_keys(data: np.ndarray, offsets: np.ndarray):
    """Line starts and ends, two hashes of each key, code points of each key, lines' offsets by document."""
    n = len(data)
    newline = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], newline + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], newline]), kind="stable")
    per_doc = 1 + np.searchsorted(newline, offsets[1:]) - np.searchsorted(newline, offsets[:-1])
    solid = np.flatnonzero(~K.SEPARATOR[data])
    i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    has = j > i
    lo, hi = starts.copy(), starts.copy()
    lo[has], hi[has] = solid[i[has]], solid[j[has] - 1] + 1
    h1, h2 = (K.span_hashes(table, data, lo, hi, seed) for seed, table in ((1, _A), (2, _B)))
    run = np.zeros(n + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=run[1:])
    return starts, ends, h1, h2, run[hi] - run[lo], np.concatenate([[0], np.cumsum(per_doc)])


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, h1, h2): the distinct keys of each text that are long enough."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for lo, _, data, offsets in K.chunks(b.column(1)):
                _, _, h1, h2, size, bounds = line_keys(data, offsets)
                long = np.flatnonzero(size >= min_chars)
                own = K.owners(bounds)[long]
                order = np.lexsort((h2[long], h1[long], own))
                a, c, o = h1[long][order], h2[long][order], own[order]
                new = np.ones(len(o), dtype=bool)
                new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (o[1:] != o[:-1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(o[new] + lo)), pa.array(a[new].view(np.int64)), pa.array(c[new].view(np.int64))], names=["doc", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").alias("_text")).mapInArrow(run, "doc bigint, h1 bigint, h2 bigint")


# -- the index -------------------------------------------------------------------------


def _level(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (K.mix(h1 ^ K.mix(h2 + np.uint64(level))) % np.uint64(size)).astype(np.int64)


def build_index(h1: np.ndarray, h2: np.ndarray) -> tuple[bytes, bytes, np.ndarray]:
    """Minimal perfect hash of distinct 128-bit keys: level sizes, bits of all levels, and every key's index."""
    sizes, bits, where = [], [], np.full(len(h1), -1, dtype=np.int64)
    left, base = np.arange(len(h1)), 0
    while len(left):
        size = max(8, math.ceil(GAMMA * len(left)))
        at = _level(h1[left], h2[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        won = alone[at]
        rank = np.cumsum(alone) - 1
        where[left[won]] = base + rank[at[won]]
        base += int(alone.sum())
        sizes.append(size)
        bits.append(alone)
        left = left[~won]
    return np.array(sizes, dtype=np.int64).tobytes(), np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool)).tobytes(), where


def find(h1: np.ndarray, h2: np.ndarray, sizes: bytes, bits: bytes) -> np.ndarray:
    """Index of each key, -1 where no level holds it; an unknown key may get any index."""
    level_sizes = np.frombuffer(sizes, dtype=np.int64)
    flags = np.unpackbits(np.frombuffer(bits, dtype=np.uint8))[: level_sizes.sum()].astype(bool)
    rank = np.cumsum(flags) - 1
    out, left, base = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1)), 0
    for level, size in enumerate(level_sizes):
        at = base + _level(h1[left], h2[left], level, int(size))
        won = flags[at]
        out[left[won]] = rank[at[won]]
        left, base = left[~won], base + int(size)
    return out


_SHARD = "shard bigint, sizes binary, bits binary, prints binary, counts binary, keepers binary"


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    h1 = rows.column("h1").to_numpy().view(np.uint64)
    h2, n, keeper = (rows.column(c).to_numpy() for c in ("h2", "n_docs", "keeper"))
    sizes, bits, where = build_index(h1, h2.view(np.uint64))
    order = np.argsort(where)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "sizes": [sizes], "bits": [bits], "prints": [h2[order].tobytes()], "counts": [n[order].astype(np.uint32).tobytes()], "keepers": [keeper[order].tobytes()]})


def _probe(key: tuple, lines: pa.Table, shards: pa.Table) -> pa.Table:
    doc = lines.column("doc")
    if not shards.num_rows or not lines.num_rows:
        hit = np.zeros(0, dtype=np.int64)
        h2 = np.zeros(0, dtype=np.int64)
    else:
        h1, h2 = lines.column("h1").to_numpy().view(np.uint64), lines.column("h2").to_numpy()
        get = lambda c, t: np.frombuffer(shards.column(c)[0].as_py(), dtype=t)
        prints, keepers = get("prints", np.int64), get("keepers", np.int64)
        at = find(h1, h2.view(np.uint64), shards.column("sizes")[0].as_py(), shards.column("bits")[0].as_py())
        own = doc.combine_chunks().fill_null(_NONE + 1).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero((at >= 0) & (prints[at] == h2) & (keepers[at] != own))
    return pa.table({"doc": doc.take(pa.array(hit)), "h2": pa.array(h2[hit])})


def dropped(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, lost): the hashes of the lines that each document loses."""
    spark = docs.sparkSession
    most = few(docs)
    with Scratch(spark, most) as scratch:
        rows = scratch.cut(line_rows(docs, min_chars))
        once = rows.groupBy("h1", "h2", "doc").count()
        keys = scratch.cut(once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.coalesce(F.max("doc"), F.lit(_NONE + 1)).alias("keeper")).where(F.col("n_docs") >= min_docs))
        n = max(parts(spark), math.ceil(keys.count() / KEYS_A_SHARD))
        shard = F.pmod(F.xxhash64("h1"), F.lit(n))
        shards = keys.withColumn("shard", shard).groupBy("shard").applyInArrow(_build, _SHARD)
        target = max(LINES_A_PROBE, 2 * math.ceil(rows.count() / n))
        load = scratch.cut(rows.groupBy(shard.alias("shard")).agg(F.ceil(F.count("*") / target).cast("bigint").alias("copies")))
        small = F.broadcast(load) if n <= 1_000_000 else load
        asked = rows.withColumn("shard", shard).join(small, "shard").withColumn("copy", F.pmod(F.xxhash64("doc", "h2"), F.col("copies"))).drop("copies")
        index = shards.join(small, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).drop("copies")
        lost = asked.groupBy("shard", "copy").cogroup(index.groupBy("shard", "copy")).applyInArrow(_probe, "doc bigint, h2 bigint")
        return keep(lost.groupBy("doc").agg(F.collect_set("h2").alias("lost")).coalesce(most))


# -- documents ---------------------------------------------------------------------------


def _rewrite(texts: pa.Array, lost: pa.Array, min_chars: int) -> tuple[list[str], list[int], list[int]]:
    out, n_lines, n_dropped = [], [], []
    empty = pa.array([0])
    flat, edge = lost.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lost.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]) if len(lost) else empty
    for lo, hi, data, offsets in K.chunks(texts):
        starts, ends, _, h2, size, bounds = line_keys(data, offsets)
        h2 = h2.view(np.int64)
        raw = data.tobytes()
        for d in range(lo, hi):
            a, b = bounds[d - lo], bounds[d - lo + 1]
            gone = flat[edge[d] : edge[d + 1]]
            n_lines.append(int(b - a))
            if not len(gone):
                out.append(raw[offsets[d - lo] : offsets[d - lo + 1]].decode())
                n_dropped.append(0)
                continue
            keep = ~(np.isin(h2[a:b], gone) & (size[a:b] >= min_chars))
            out.append(b"\n".join(raw[starts[i] : ends[i]] for i in (a + np.flatnonzero(keep))).decode())
            n_dropped.append(int(b - a - keep.sum()))
    return out, n_lines, n_dropped


def dedupe_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the rewritten text, and at the end how many lines there were and how many are dropped."""
    docs = docs.drop(*counts)
    names, fields = docs.columns, {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    at = names.index("text")
    lost = dropped(docs, min_chars, min_docs)
    left = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(names)), F.col("doc_id").cast("bigint").alias("_doc"))
    both = left.join(lost, F.col("_doc").eqNullSafe(F.col("doc")), "left").drop("_doc", "doc")
    schema = ", ".join([*(f"_c{i} {fields[c]}" for i, c in enumerate(names)), "_n bigint, _d bigint"])

    def run(batches):
        for b in batches:
            texts, n, d = _rewrite(b.column(at), b.column(len(names)), min_chars)
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=[*(f"_c{i}" for i in range(len(names))), "_n", "_d"])

    return both.mapInArrow(run, schema).select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)), F.col("_n").alias(counts[0]), F.col("_d").alias(counts[1]))


def kept_lines(docs: DataFrame) -> DataFrame:
    """docs with the rewritten text alone; a column n_chars of a text that lost lines follows it."""
    lost = "lost"
    while lost.lower() in (c.lower() for c in docs.columns):
        lost += "_"
    out = dedupe_lines(docs, counts=(f"{lost}_of", lost))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(lost) > 0, size).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
