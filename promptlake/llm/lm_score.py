"""Language-model scores by stupid backoff, each document against all the others.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Documents are dealt to batches of a
bounded size. A batch explodes its texts to n-grams, counts them once and deals its count
table by hash range to a fixed number of shards (``2 ** BITS``). Up to as many batches meet in a shard, which
joins their tables: n-grams that several batches know get their total, which goes back
to those batches. Of more batches, groups of that many meet first; the merged tables are
dealt to finer shards and meet in the same way one level up, and the totals come back down.
So every table is dealt to a fixed number of rows, all rows and tasks keep their size, and
work grows with the input times the (few) levels. With the totals every word is scored

    S(w | context) = c(context w) / c(context)   if both counts are positive
                     0.4 * S(w | shorter context) otherwise,     S(w) = c(w) / N

and log S is summed per document. All counts leave out the document itself (else every
n-gram would have been seen); a word that no other document has counts 1 / (N + 1).

An n-gram takes one entry for each batch however common it is, so shards stay even; all
exchanges move sorted hashes as byte planes.

Null and empty texts have no words and score 0. Rows with the same doc_id and text are
documents of their own, each of which has seen the other. Other columns take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

ORDER, ALPHA = 2, 0.4
BATCH_BYTES = 16 << 20
BITS = 6


def _keys(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each n-gram, tagged with n, and the position of its last word."""
    grams, grams_at = K.windows(hashes, bounds, n)
    owner = K.owners(grams_at)
    last = np.arange(len(grams)) - grams_at[owner] + bounds[owner] + n - 1
    return K.mix(grams + np.uint64(n)), last


def _bytes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: the high planes are nearly empty and compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unbytes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).reshape(-1).view("<i8")


def _planes(sorted_keys: np.ndarray) -> bytes:
    """Differences of sorted keys."""
    return _bytes(np.diff(sorted_keys, prepend=np.uint64(0)))


def _unplanes(raw: bytes) -> np.ndarray:
    return np.cumsum(_unbytes(raw).view("<u8"), dtype=np.uint64)


def _counted(texts: pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a batch of texts, and their counts."""
    found = []
    for _, _, data, offsets in K.chunks(texts):
        hashes, bounds = K.words(data, offsets, fold=True)
        found += [_keys(hashes, bounds, n)[0] for n in range(1, order + 1)]
    keys = np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _own(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each entry's key occurs in its own document."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    out = np.empty(len(k), dtype=np.int64)
    out[order] = np.repeat(np.diff(np.append(first, len(k))), np.diff(np.append(first, len(k))))
    return out


def score_texts(texts: pa.ChunkedArray, total: int, keys: np.ndarray, counts: np.ndarray, order: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log score of each text. keys, counts: sorted n-gram keys of all texts with corpus totals."""
    words, scores = [], []
    for _, _, data, offsets in K.chunks(texts):
        hashes, bounds = K.words(data, offsets, fold=True)
        owner, size = K.owners(bounds), np.diff(bounds)
        seen = np.zeros((order + 1, len(hashes)), dtype=np.int64)
        for n in range(1, order + 1):
            key, last = _keys(hashes, bounds, n)
            seen[n, last] = counts[np.searchsorted(keys, key)] - _own(key, owner[last])
        others = (total - size)[owner]
        history = np.minimum(np.arange(len(hashes)) - bounds[owner], order - 1)  # words of context there are
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(seen[1] > 0, np.log(seen[1] / others), -np.log(others + 1.0)) + history * math.log(alpha)
            for n in range(2, order + 1):
                context = np.concatenate([[0], seen[n - 1][:-1]])
                good = (seen[n] > 0) & (context > 0)
                out[good] = np.log(seen[n][good] / context[good]) + (history[good] - (n - 1)) * math.log(alpha)
        sums = np.zeros(len(size))
        full = np.flatnonzero(size)
        if len(full):
            sums[full] = np.add.reduceat(out, bounds[full])
        words.append(size)
        scores.append(sums)
    return (np.concatenate(words), np.concatenate(scores)) if words else (np.zeros(0, dtype=np.int64), np.zeros(0))


_UP = "node bigint, shard bigint, grams binary, counts binary"
_DOWN = "node bigint, shard bigint, grams binary, totals binary"


def _deal(node: int, shard: int, depth: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.Table:
    """A sorted table dealt to the shards below ``shard``, which is told by the first depth * bits bits of its keys."""
    fan = 1 << bits
    below = [(shard << bits) + j for j in range(fan)]
    edges = np.searchsorted(keys, np.array([x << (64 - bits * (depth + 1)) for x in below[1:]], dtype=np.uint64))
    spans = list(zip([0, *edges], [*edges, len(keys)], strict=True))
    return pa.table({"node": pa.array([node] * fan, pa.int64()), "shard": pa.array(below, pa.int64()), "grams": pa.array([_planes(keys[a:b]) for a, b in spans], pa.binary()), "counts": pa.array([_bytes(counts[a:b]) for a, b in spans], pa.binary())})


def _joined(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All keys of some tables, row after row; where each row's begin; distinct keys, their summed counts and in how many tables they are."""
    parts = [_unplanes(r) for r in rows.column("grams").to_pylist()]
    counts = [_unbytes(r) for r in rows.column("counts").to_pylist()]
    everything = np.concatenate(parts)
    order = np.argsort(everything, kind="stable")  # sorted runs
    k = everything[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    totals = np.add.reduceat(np.concatenate(counts)[order], first) if len(k) else np.zeros(0, dtype=np.int64)
    return everything, np.cumsum([0, *map(len, parts)]), k[first], totals, np.diff(np.append(first, len(k)))


def _give(rows: pa.Table, above: pa.Table | None) -> pa.Table:
    """To each table the totals of the keys that others have as well. above: totals from one level up, of keys that other groups have."""
    everything, edge, keys, totals, times = _joined(rows)
    shared = times > 1
    if above is not None:
        for grams, known in zip(above.column("grams").to_pylist(), above.column("totals").to_pylist(), strict=True):
            at = np.searchsorted(keys, _unplanes(grams))
            totals[at], shared[at] = _unbytes(known), True
    out_keys, out_totals = [], []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        at = np.searchsorted(keys, everything[a:b])
        at = at[shared[at]]
        out_keys.append(_planes(keys[at]))
        out_totals.append(_bytes(totals[at]))
    return pa.table({"node": rows.column("node"), "shard": rows.column("shard"), "grams": pa.array(out_keys, pa.binary()), "totals": pa.array(out_totals, pa.binary())})


def _shared_totals(tables: DataFrame, nodes: int, depth: int, bits: int) -> DataFrame:
    """For the dealt count tables of nodes 0 .. nodes - 1 the totals of keys that several of them have. depth: levels of shards so far."""
    fan = 1 << bits
    if nodes <= fan:
        return tables.groupBy("shard").applyInArrow(lambda rows: _give(rows, None), _DOWN)
    group = F.floor(F.col("node") / fan).cast("bigint")
    grouped = tables.groupBy(group.alias("group"), "shard")

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        _, _, keys, totals, _ = _joined(rows)
        return _deal(key[0].as_py(), key[1].as_py(), depth, keys, totals, bits)

    above = _shared_totals(grouped.applyInArrow(merge, _UP), -(-nodes // fan), depth + 1, bits)
    above = above.groupBy(F.col("node").alias("group"), F.floor(F.col("shard") / fan).cast("bigint").alias("shard"))
    return grouped.cogroup(above).applyInArrow(lambda rows, known: _give(rows, known), _DOWN)


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_tokens and log_score of every row of docs."""
    kind, bits = docs.schema["doc_id"].dataType.simpleString(), BITS
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    batches = max(1, math.ceil(size / BATCH_BYTES))
    # Also rows that are alike in all spread over batches: the partition of the scan takes part.
    batch = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(batches))
    texts = docs.select("doc_id", F.col("text").alias("_text"), batch.alias("batch"))

    def send(key: tuple, rows: pa.Table) -> pa.Table:
        keys, counts = _counted(rows.column("_text"), order)
        return _deal(key[0].as_py(), 0, 0, keys, counts, bits)

    # N, from a cheap pass: it must be known before any word is scored.
    def count(batches_):
        for b in batches_:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(K.word_starts(d, o)) for _, _, d, o in K.chunks(b.column(0)))], pa.int64())], names=["n"])

    total = docs.select(F.col("text").alias("_text")).mapInArrow(count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def finish(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        keys, counts = _counted(rows.column("_text"), order)
        for grams, totals in zip(known.column("grams").to_pylist(), known.column("totals").to_pylist(), strict=True):
            counts[np.searchsorted(keys, _unplanes(grams))] = _unbytes(totals)
        n, s = score_texts(rows.column("_text"), total, keys, counts, order, alpha)
        return pa.table({"doc_id": rows.column("doc_id"), "n_tokens": pa.array(n.astype(np.int64)), "log_score": pa.array(s)})

    sent = texts.groupBy("batch").applyInArrow(send, _UP)
    known = _shared_totals(sent, batches, 1, bits)
    return texts.groupBy("batch").cogroup(known.groupBy("node")).applyInArrow(finish, f"doc_id {kind}, n_tokens bigint, log_score double")
