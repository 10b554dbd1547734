"""Token-id files with Simple-8b word-aligned coding.

A file is a table of segments. A segment holds the ids of a run of documents, in order,
as 64-bit words of four selector bits and sixty payload bits: selector s packs
``COUNT[s]`` ids of ``BITS[s]`` bits each, the largest count whose ids all fit; the last
selector is the escape, one id of up to sixty bits. Ids are coded in blocks of
``BLOCK``; ``offsets`` has the first word of each block, so blocks decode independently and the
decoder is plain array work. Beside the words stand the documents' ids and lengths and
the number of ids before the segment within its file.

Files are written by Spark's writer, one per range of doc_id, in ascending doc_id order
(nulls first; rows with one doc_id in order of their text's hash).

Null and empty texts have the end id alone.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import checkpoint_dir, parts
from .tokens import encoder

BLOCK = 256
SEGMENT = 1_000_000
COUNT = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_U = np.uint64


# -- the code ------------------------------------------------------------------------------


_SMALL = np.searchsorted(1 << BITS[:-1], np.arange(1 << 16), side="right").astype(np.uint8)


def _classes(ids: np.ndarray) -> np.ndarray:
    if not int(ids.max()) >> 16:
        return _SMALL[ids.astype(np.uint16)]
    return np.searchsorted((1 << BITS[:-1]).astype(_U), ids, side="right").astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block of BLOCK ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.uint32)
    if int(ids.max()) >> 60:
        raise ValueError("ids of more than 60 bits cannot be coded")
    ids = ids.astype(_U)
    blocks = -(-n // BLOCK)
    # Class of each id (the first selector wide enough), a row for each block, zeros behind its end.
    need = np.zeros((blocks, BLOCK + int(COUNT[0])), dtype=np.uint8)
    flat = np.zeros(blocks * BLOCK, dtype=np.uint8)
    flat[:n] = _classes(ids)
    need[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    # Widest class among the next 1, 2, 3, ... ids; the best selector is the first whose run fits.
    choice = np.full((blocks, BLOCK), len(COUNT) - 1, dtype=np.uint8)
    widest, reach = need[:, :BLOCK].copy(), 1
    for s in range(len(COUNT) - 1, -1, -1):
        while reach < COUNT[s]:
            np.maximum(widest, need[:, reach : reach + BLOCK], out=widest)
            reach += 1
        np.copyto(choice, np.uint8(s), where=widest <= s)
    choice = choice.reshape(-1)
    # Greedy starts: all blocks step together.
    cursor = np.arange(0, n, BLOCK)
    end = np.minimum(cursor + BLOCK, n)
    starts = []
    while len(cursor):
        starts.append(cursor)
        cursor = cursor + COUNT[choice[cursor]]
        live = cursor < end
        cursor, end = cursor[live], end[live]
    start = np.sort(np.concatenate(starts))
    pick = choice[start].astype(np.int64)
    stop = np.minimum(n, (start // BLOCK + 1) * BLOCK)
    take = np.minimum(COUNT[pick], stop - start)
    words = pick.astype(_U) << _U(60)
    count, bits = take, BITS[pick].astype(_U)
    for j in range(int(count.max())):
        has = count > j
        words[has] |= ids[start[has] + j] << (_U(j) * bits[has])
    return words, np.searchsorted(start, np.arange(0, n, BLOCK)).astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int, first_block: int = 0, end_block: int | None = None) -> np.ndarray:
    """The ids of blocks first_block .. end_block of n ids in all."""
    blocks = len(offsets)
    end_block = blocks if end_block is None else end_block
    if first_block >= end_block:
        return np.zeros(0, dtype=_U)
    edge = np.append(offsets.astype(np.int64), len(words))
    part = words[edge[first_block] : edge[end_block]]
    pick = (part >> _U(60)).astype(np.int64)
    count = COUNT[pick]
    # A block's last word may have room for more ids than the block still has.
    own = np.repeat(np.arange(first_block, end_block), np.diff(edge[first_block : end_block + 1]))
    size = np.minimum(BLOCK, n - own * BLOCK)
    run = np.cumsum(count) - count
    before = run - run[edge[own] - edge[first_block]]
    count = np.minimum(count, size - before)
    word = np.repeat(np.arange(len(part)), count)
    slot = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    bits = BITS[pick][word].astype(_U)
    return (part[word] >> (slot.astype(_U) * bits)) & ((_U(1) << bits) - _U(1))


# -- files -----------------------------------------------------------------------------------


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Writes the ids of every text, each with the end id behind it, as segments under path."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["file", "segment", "before", "n_ids", "doc_ids", "lengths", "words", "offsets"]

    def run(batches):
        file, segment, before = TaskContext.get().partitionId(), 0, 0
        doc, ids, total = [], [], 0

        def flush():
            words, offsets = encode(np.frombuffer(b"".join(ids), dtype="<u4"))
            row = [file, segment, before, total, doc, [len(x) // 4 for x in ids], words.astype("<u8").tobytes(), offsets.astype("<u4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        types = None
        for b in batches:
            types = types or [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(b.schema.field(0).type), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            for d, x in zip(b.column(0).to_pylist(), encoder(tokenizer, added=True).encoded(b.column(1)), strict=True):
                doc.append(d)
                ids.append(x + end)
                total += len(x) // 4 + 1
                if total >= SEGMENT:
                    yield flush()
                    segment, before, doc, ids, total = segment + 1, before + total, [], [], 0
        if doc:
            yield flush()

    schema = f"file bigint, segment int, before bigint, n_ids bigint, doc_ids array<{kind}>, lengths array<int>, words binary, offsets binary"
    picked = docs.select("doc_id", F.col("text").alias("_text"))
    ordered = picked.repartitionByRange(parts(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("_text"))
    ordered.mapInArrow(run, schema).write.option("compression", "none").mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document in the files at path."""
    segments = spark.read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    ends = segments.groupBy("file").agg(F.sum("n_ids").alias("all"))  # one row a file
    base = ends.select("file", (F.sum("all").over(Window.orderBy("file")) - F.col("all")).alias("base"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = decode(np.frombuffer(r["words"], dtype="<u8"), np.frombuffer(r["offsets"], dtype="<u4"), r["n_ids"]).astype("<u4")
                length = np.array(r["lengths"], dtype=np.int64)
                at = np.cumsum(length) - length
                raw = ids.tobytes()
                doc = pa.array(r["doc_ids"], b.schema.field("doc_ids").type.value_type)
                for lo in range(0, len(length), 256):
                    hi = min(lo + 256, len(length))
                    yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), pa.array(at[lo:hi] + r["before"] + r["base"]), pa.array(length[lo:hi]), pa.array([raw[4 * a : 4 * (a + n)] for a, n in zip(at[lo:hi], length[lo:hi], strict=True)], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return segments.join(F.broadcast(base), "file").mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def scratch(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"


def digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the ids' unsigned crc32."""
    return files.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
