"""Best-fit packing of documents into sequences by exact-complement hashing.

Documents are tokenised where they lie and cut into pieces; the first piece of a long
document is the shorter one. The plan needs only how many pieces have each length, at
most ``capacity`` numbers. From the longest length down, one, two or three other lengths
that fill the gap exactly are found in an index of sums and used as often as the counts
allow; what is left goes by best fit. The plan is a bounded list of
intervals over each length's pieces, so every piece finds its place from its rank
within its length: a running number inside its partition plus the counts of the
partitions before. Nothing is sorted and no length is gathered, however common.

A null or empty text is one piece with the end id alone. Repeated rows are packed as
often as they occur. Ties between equal lengths fall by partition and row order.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import cut, few
from .tokens import encoder

CAPACITY = 2048


# -- the plan, over counts of lengths -----------------------------------------------------


class _Sums:
    """Index of the sums of one, two and three available lengths.

    A sum's entries are made when it is first asked for. Counts only fall, so an entry that
    is used up never comes back and is dropped for good.
    """

    def __init__(self, n: np.ndarray):
        self.n = n
        self.two: dict[int, list[int]] = {}
        self.three: dict[int, list[int]] = {}

    def _pair(self, total: int, held: int = 0) -> tuple[int, int] | None:
        """Two lengths of that sum that are there beside one of length held."""
        n = self.n
        if total not in self.two:
            x = np.arange((total + 1) // 2, total)
            self.two[total] = x[(n[x] > 0) & (n[total - x] > 0)].tolist()
        entries = self.two[total]
        while entries and (n[entries[-1]] < 1 + (2 * entries[-1] == total) or not n[total - entries[-1]]):
            entries.pop()
        for x in reversed(entries):
            y = total - x
            if n[x] >= 1 + (x == y) + (x == held) and n[y] >= 1 + (x == y) + (y == held):
                return x, y
        return None

    def find(self, total: int, size: int) -> tuple[int, ...] | None:
        """So many lengths of that sum, the first as long as possible."""
        n = self.n
        if size == 1:
            return (total,) if n[total] else None
        if size == 2:
            return self._pair(total)
        if total not in self.three:
            x = np.arange((total + 2) // 3, total - 1)
            self.three[total] = x[n[x] > 0].tolist()
        entries = self.three[total]
        while entries:
            x = entries[-1]
            rest = self._pair(total - x, x) if n[x] else None
            if rest:
                return x, *rest
            entries.pop()
        return None


def _fill_exactly(n: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Uses up counts n (by length) in combinations that sum to capacity; (lengths, times)."""
    out = []
    if n[capacity]:
        out.append(((capacity,), int(n[capacity])))
        n[capacity] = 0
    sums = _Sums(n)
    for length in range(capacity - 1, 0, -1):
        for size in (1, 2, 3):
            while n[length]:
                n[length] -= 1  # one is held; the rest may be partners
                others = sums.find(capacity - length, size)
                n[length] += 1
                if not others:
                    break
                combo = (length, *others)
                times = min(int(n[x]) // k for x, k in Counter(combo).items())
                for x in combo:
                    n[x] -= times
                out.append((combo, times))
    return out


def _best_fit(n: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts; equal bins are handled together."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in range(capacity, 0, -1):
        left = int(n[length])
        while left:
            gap = min((g for g, held in bins.items() if g >= length and held), default=None)
            if gap is None:
                each = capacity // length
                for per, times in ((each, left // each), (left % each, 1)):
                    if per and times:
                        bins[capacity - per * length][(length,) * per] += times
                break
            combo, times = next(iter(bins[gap].items()))
            used = min(left, times)
            if used == times:
                del bins[gap][combo]
            else:
                bins[gap][combo] -= used
            bins[gap - length][(*combo, length)] += used
            left -= used
    return [(combo, times) for held in bins.values() for combo, times in held.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Intervals sorted by (length, first): the ranks first.. of a length go to sequences base.. at an offset."""
    n = np.zeros(capacity + 1, dtype=np.int64)
    for length, c in counts.items():
        n[length] = c
    rows, used, base = [], defaultdict(int), 0
    for combo, times in [*_fill_exactly(n, capacity), *_best_fit(n, capacity)]:
        offset = 0
        for length in combo:
            rows.append((length, used[length], base, offset))
            used[length] += times
            offset += length
        base += times
    rows.sort()
    length, first, to, offset = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, dtype=np.int64),) * 4
    return {"length": length, "first": first, "base": to, "offset": offset, "sequences": np.array([base])}


# -- pieces --------------------------------------------------------------------------------


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): nth counts the pieces of one length in a partition."""
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                own, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encoder(path, added=True).encoded(b.column(1).slice(lo, 1024))):
                    ids += end
                    n = len(ids) // 4
                    at = 0
                    for k, to in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                        own.append(lo + i)
                        piece.append(k)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                        at = to
                size = np.array(length, dtype=np.int64)
                order = np.argsort(size, kind="stable")
                ranked = size[order]
                nth = np.empty(len(size), dtype=np.int64)
                nth[order] = np.arange(len(size)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(size, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), part)), pa.array(nth)], names=names)

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    rows = cut(pieces(docs, path, capacity, end_id))
    most = few(rows)
    held = cut(rows.groupBy("part", "length").agg(F.count("*").alias("c")).coalesce(most))
    counts = {r["length"]: r["c"] for r in held.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    chart = spark.sparkContext.broadcast(plan(counts, capacity))
    before = held.select("part", "length", (F.sum("c").over(Window.partitionBy("length").orderBy("part")) - F.col("c")).alias("before"))
    ranked = rows.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("_rank"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches):
        p = chart.value
        key = (p["length"] << 48) | p["first"]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(key, (length << 48) | rank, side="right") - 1
            sequence = p["base"][at] + rank - p["first"][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(p["offset"][at])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.coalesce(most).mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
