"""Benchmark decontamination: size-partitioned MinHash containment search.

Items and documents are sets of distinct k-word shingles (A-Z lower-cased). Items are
partitioned by size: the class of an item is the largest power of two not above its
number of shingles. For each class the documents, however long, are read as blocks of so
many consecutive shingles, so that the MinHash of a block and of an item it overlaps stay
comparable. An item becomes a document's candidate when any of ``FUNCTIONS`` minwise
values agrees with any block. Also where its shingles lie scattered over the text, the
expected number of agreements is at least 0.4 a function at containment 0.8, so a
candidate is missed with a chance of about e^-12. Candidates are verified by exact
containment of the item's shingles in the whole document.

The items are the stated query set: they are sent to the tasks in blocks of at most
``BLOCK`` shingles, one pass over the documents for each block; documents are never shuffled.

Items without words match nothing. An item or text with fewer than k words counts as one
shingle of all its words. Repeated rows give repeated pairs for documents; repeated
item_ids are separate items.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .cluster import cut

SHINGLE, PERCENT = 5, 80
FUNCTIONS = 32
BLOCK = 2_000_000

_ODD = K.mix(np.arange(2 * FUNCTIONS, dtype=np.uint64) + np.uint64(0xC0FFEE))


def _values(h: np.ndarray, j: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h ^ _ODD[2 * j]) * (_ODD[2 * j + 1] | np.uint64(1))


class Items:
    """The index of one block of items."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        of = np.array([1 << (len(s).bit_length() - 1) for s in sets], dtype=np.int64)
        for size in np.unique(of):
            own = np.flatnonzero(of == size)
            table = []
            for j in range(FUNCTIONS):
                low = np.array([_values(sets[i], j).min() for i in own], dtype=np.uint64)
                order = np.argsort(low)
                table.append((low[order], own[order]))
            self.classes[int(size)] = table

    def matches(self, h: np.ndarray, bounds: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of the documents with shingles h."""
        found: set[tuple[int, int]] = set()
        starts = {}
        for size in self.classes:
            per = -(-np.diff(bounds) // size)
            own = np.repeat(np.arange(len(per)), per)
            starts[size] = bounds[own] + size * (np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)), own
        for j in range(FUNCTIONS) if len(h) else ():
            x = _values(h, j)
            for size, table in self.classes.items():
                at, own = starts[size]
                low = np.minimum.reduceat(x, at)
                keys, items = table[j]
                a, b = np.searchsorted(keys, low, side="left"), np.searchsorted(keys, low, side="right")
                for i in np.flatnonzero(b > a):
                    found.update((int(own[i]), int(t)) for t in items[a[i] : b[i]])
        out = []
        sets: dict[int, np.ndarray] = {}
        for d, t in sorted(found):
            if d not in sets:
                sets = {d: np.unique(h[bounds[d] : bounds[d + 1]])}
            item, doc = self.sets[t], sets[d]
            at = np.minimum(np.searchsorted(doc, item), len(doc) - 1)
            shared = int((doc[at] == item).sum())
            if 100 * shared >= percent * len(item):
                out.append((d, t, shared))
        return out


def _blocks(benchmark: DataFrame, k: int) -> list[Items]:
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in K.chunks(b.column(1)):
                h, bounds = K.distinct(*K.windows(*K.words(data, offsets, fold=True), k, short=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))], names=["item_id", "items"])

    sets = cut(benchmark.select("item_id", F.col("text").alias("_text")).mapInArrow(run, f"item_id {kind}, items array<bigint>").where(F.size("items") > 0))
    total = sets.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("n")).first()["n"]
    n = math.ceil(total / BLOCK)
    for i in range(n):
        rows = sets.where(F.pmod(F.xxhash64("items"), F.lit(n)) == i).collect()
        yield Items([r["item_id"] for r in rows], [np.array(r["items"], dtype=np.int64).view(np.uint64) for r in rows])


def contained(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_shared and containment of every pair at or above percent."""
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, n_shingles bigint, n_shared bigint"
    texts = docs.select("doc_id", F.col("text").alias("_text"))
    item_kind = pa.int64() if "item_id bigint" in schema else None
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, k):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            items = sent.value
            for b in batches:
                for lo, _, data, offsets in K.chunks(b.column(1)):
                    got = items.matches(*K.windows(*K.words(data, offsets, fold=True), k, short=True), percent)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([lo + d for d, _, _ in got], pa.int64())), pa.array([items.ids[t] for _, t, _ in got], item_kind), pa.array([len(items.sets[t]) for _, t, _ in got], pa.int64()), pa.array([s for _, _, s in got], pa.int64())], names=["doc_id", "item_id", "n_shingles", "n_shared"])

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that contain no item, with all their columns; rows are tested where they lie."""
    names, at = docs.columns, docs.columns.index("text")
    out = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(names)))
    for block in _blocks(benchmark, k):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for b in batches:
                bad = np.zeros(b.num_rows, dtype=bool)
                for lo, _, data, offsets in K.chunks(b.column(at)):
                    got = sent.value.matches(*K.windows(*K.words(data, offsets, fold=True), k, short=True), percent)
                    bad[[lo + d for d, _, _ in got]] = True
                yield b.filter(pa.array(~bad))

        out = out.mapInArrow(run, out.schema)
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))
