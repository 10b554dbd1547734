"""Periodic runs of words: harmonic grids driven by difference-cover LCE queries.

A run of smallest period q and ``length >= max(6, 4 q)`` is a stretch of positions i with
word i equal to word i + q, ``length - q`` of them. So a grid of step ``max(6, 4 p) - p`` for
each period p has a point in every such stretch; all grids together have about n log(n) / 3
points. A point whose two words differ is out at once. For the rest a longest common
extension (LCE) of i and i + p finds the end of the stretch, one more tells whether it can be
long enough, and a binary search over LCEs finds its start.

An LCE compares few words until both positions come to synchronised samples: the samples are
the positions whose remainder modulo 31 is in a difference cover of six remainders, so any
two positions have a common distance under 31 to samples. Only sampled suffixes are
sorted (blocks of 31 words by a lexsort, then by doubling), and a sparse table over the
lengths that neighbours in that order share answers the rest by a range minimum. The sort is
made only for documents with a point whose stretch may be long enough after a look at 31 words.

Documents are handled in chunks of about a megabyte, a long document by itself; each ends with
a word that occurs once. Memory goes with the chunk or the longest document; nothing is shuffled.

Null and empty texts have no words and no runs. Rows without doc_id keep their words as they are.
Repeated rows give repeated rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

#: A perfect difference set: every difference modulo 31 is one of two of its members.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
LEAST, POWER = 6, 4
#: Grid points that are looked at together.
POINTS = 1 << 20

_SYNC = np.zeros((MODULUS, MODULUS), dtype=np.int64)
for _i in range(MODULUS):
    for _j in range(MODULUS):
        _SYNC[_i, _j] = next(d for d in range(MODULUS) if (_i + d) % MODULUS in COVER and (_j + d) % MODULUS in COVER)


def _dense(a: np.ndarray) -> np.ndarray:
    return np.unique(a, return_inverse=True)[1].reshape(-1)


class Extensions:
    """Longest common extensions of positions of one sequence of codes whose last element occurs once."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.ready = False

    def _sort(self) -> None:
        """Orders the sampled suffixes and makes the range minimum table of what neighbours share."""
        n = len(self.codes)
        # Behind the end come words that occur once each, so blocks there differ.
        dense = np.concatenate([_dense(self.codes), n + np.arange(2 * MODULUS)])
        sample = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
        self.index = np.full(n + MODULUS, -1, dtype=np.int64)
        self.index[sample] = np.arange(len(sample))
        block = dense[sample[:, None] + np.arange(MODULUS)]
        order = np.lexsort(block.T[::-1])
        new = np.concatenate([[False], (block[order][1:] != block[order][:-1]).any(axis=1)])
        rank = np.empty(len(sample), dtype=np.int64)
        rank[order] = np.cumsum(new)
        levels, step = [rank], MODULUS
        while rank.max() + 1 < len(sample):
            # The sample that follows by step has the same remainder; none follows behind the end, and such suffixes differ already.
            after = sample + step
            inside = after < n
            second = np.full(len(sample), -1, dtype=np.int64)
            second[inside] = rank[self.index[after[inside]]]
            rank = _dense(rank * (len(sample) + 1) + second + 1)
            levels.append(rank)
            step *= 2
        by = np.argsort(rank)
        # What neighbours share: the greatest equal blocks first, then words.
        left, right = sample[by[:-1]], sample[by[1:]]
        shared = np.zeros(len(left), dtype=np.int64)
        for level in range(len(levels) - 1, -1, -1):
            size = MODULUS << level
            a, b = left + shared, right + shared
            inside = (a < n) & (b < n)
            same = np.zeros(len(left), dtype=bool)
            same[inside] = levels[level][self.index[a[inside]]] == levels[level][self.index[b[inside]]]
            shared[same] += size
        shared += self._words(left + shared, right + shared, np.full(len(left), MODULUS))
        self.place = np.empty(len(sample), dtype=np.int64)
        self.place[by] = np.arange(len(sample))
        self.table = [shared]
        while 2 << (len(self.table) - 1) <= len(shared):
            half = 1 << (len(self.table) - 1)
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))
        self.ready = True

    def _words(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, up to most."""
        out = np.zeros(len(i), dtype=np.int64)
        codes, n = self.codes, len(self.codes)
        live = np.flatnonzero((most > 0) & (j < n) & (i < n))
        for d in range(int(most.max()) if len(most) else 0):
            live = live[(most[live] > d) & (i[live] + d < n) & (j[live] + d < n)]
            live = live[codes[i[live] + d] == codes[j[live] + d]]
            if not len(live):
                break
            out[live] += 1
        return out

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of every pair of positions, i < j."""
        ahead = _SYNC[i % MODULUS, j % MODULUS]
        out = self._words(i, j, ahead)
        far = np.flatnonzero((out == ahead) & (j + ahead < len(self.codes)))
        if len(far):
            # The samples differ at once in most pairs; the sort is for the others.
            a, b = i[far] + ahead[far], j[far] + ahead[far]
            same = self.codes[a] == self.codes[b]
            far, a, b = far[same], a[same], b[same]
        if len(far):
            if not self.ready:
                self._sort()
            x, y = self.place[self.index[a]], self.place[self.index[b]]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            got = np.empty(len(far), dtype=np.int64)
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                row = self.table[k]
                got[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
            out[far] += got
        return out


def find_runs(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in it, length, period) of all runs of documents in a sequence, by document, start and period.

    Document d is codes[bounds[d]:bounds[d + 1]], and its last element occurs nowhere else.
    """
    size = np.diff(bounds) - 1
    none = (np.zeros(0, dtype=np.int64),) * 4
    most = np.maximum(size // POWER, (size >= LEAST).astype(np.int64))  # the greatest period of each document
    doc = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(LEAST, POWER * period) - period
    edges = np.concatenate([[0], np.cumsum(-(-(size[doc] - period) // step))])
    whole, candidates, lo = Extensions(codes), [], 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + POINTS, side="right")) - 1)
        of = np.repeat(np.arange(lo, hi), np.diff(edges[lo : hi + 1]))
        t, p, d = step[of], period[of], doc[of]
        i = (np.arange(edges[lo], edges[hi]) - edges[of]) * t
        candidates.append(_few_words(whole, bounds, d, i, p, t))
        lo = hi
    if not candidates:
        return none
    d, i, q, t = (np.concatenate(x) for x in zip(*candidates, strict=True))
    if not len(d):
        return none
    # The documents that are left, one after the other.
    left = np.unique(d)
    part = np.concatenate([codes[bounds[x] : bounds[x + 1]] for x in left])
    base = np.zeros(len(size), dtype=np.int64)
    base[left] = np.cumsum(size[left] + 1) - (size[left] + 1)
    e, b = Extensions(part), base[d]
    reach = lambda at, q: e.lce(b + at, b + at + q)
    forward = reach(i, q)
    # The stretch must begin so many positions before the point, or it is too short.
    missing = np.maximum(t - forward, 0)
    probe = np.maximum(i - missing, 0)
    use = (missing <= i) & (reach(probe, q) >= np.minimum(missing, i))
    d, i, q, t, forward, b = (x[use] for x in (d, i, q, t, forward, b))
    # It is reported by its first point: the one before does not reach this one.
    before = np.maximum(i - t, 0)
    use = ~((i >= t) & (reach(before, q) >= t))
    d, i, q, t, forward, b = (x[use] for x in (d, i, q, t, forward, b))
    low, high = np.maximum(i - t + 1, 0), i.copy()  # it begins in between
    while (low < high).any():
        mid = (low + high) // 2
        reaches = reach(mid, q) >= i - mid
        high, low = np.where(reaches, mid, high), np.where(reaches, low, np.minimum(mid + 1, high))
    length = i + forward - low + q
    use = length >= np.maximum(LEAST, POWER * q)
    found = np.stack([x[use] for x in (d, low, length, q)])
    found = found[:, np.lexsort((found[3], found[2], found[1], found[0]))]
    # A stretch of a multiple of its smallest period has the same borders; the smallest comes first.
    first = np.ones(found.shape[1], dtype=bool)
    first[1:] = (found[:3, 1:] != found[:3, :-1]).any(axis=0)
    found = found[:, first]
    return tuple(found[:, np.lexsort((found[3], found[1], found[0]))])


def _few_words(whole: Extensions, bounds: np.ndarray, d: np.ndarray, i: np.ndarray, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """The grid points (document, point, period, step) whose stretch can still be long enough after a look at few words."""
    at = bounds[d] + i
    equal = whole.codes[at] == whole.codes[at + p]
    d, i, p, t, at = (x[equal] for x in (d, i, p, t, at))
    forward = whole._words(at, at + p, np.full(len(at), MODULUS))
    missing = np.maximum(t - forward, 0)
    back = np.minimum(missing, MODULUS)
    probe = np.maximum(at - missing, bounds[d])
    use = (forward == MODULUS) | ((missing <= i) & (whole._words(probe, probe + p, back) == back))
    return d[use], i[use], p[use], t[use]


def _groups(sorted_: np.ndarray) -> tuple[list, list, list]:
    """Values, first rows and end rows of the runs of equal values."""
    if not len(sorted_):
        return [], [], []
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_)]


def rebuilt(ids: list[int | None], sizes: np.ndarray) -> np.ndarray:
    """For every word of every document the number of the original word that stands there."""
    first = np.cumsum(sizes) - sizes
    out = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    for d, (i, n) in enumerate(zip(ids, sizes.tolist(), strict=True)):
        if i is None or not n:
            continue
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[first[d] + a : first[d] + n] = a + np.arange(n - a) % p
    return out


_OUT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _chunk(ids: list[int | None], data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    starts = K.word_starts(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    # A word ends at the next separator or the end of its document.
    gap = np.flatnonzero(K.SEPARATOR[data])
    after = np.searchsorted(gap, starts)
    ends = np.minimum(np.append(gap, len(data))[after], offsets[1:][K.owners(bounds)])
    hashes = K.span_hashes(K._BYTE_WORD, data, starts)
    sizes = np.diff(bounds)
    docs = len(sizes)
    owner = K.owners(bounds)
    word = bounds[owner] + rebuilt(ids, sizes)
    # One more element closes each document; no word has its value by chance, and documents are extended one by one.
    closed = bounds + np.arange(docs + 1)
    codes = np.empty(len(word) + docs, dtype=np.uint64)
    codes[np.arange(len(word)) + owner] = hashes[word] >> np.uint64(1)
    codes[closed[1:] - 1] = np.uint64(1 << 63) + np.arange(docs, dtype=np.uint64)
    doc, start, length, period = find_runs(codes, closed)
    drop = np.zeros(len(word) + 1, dtype=np.int64)
    np.add.at(drop, bounds[doc] + start + period, 1)
    np.add.at(drop, bounds[doc] + start + length, -1)
    kept = np.flatnonzero(np.cumsum(drop)[:-1] == 0)
    # The kept words, each with one space behind it.
    w = word[kept]
    size = ends[w] - starts[w] + 1
    at = np.cumsum(size) - size
    text = np.full(int(size.sum()), 32, dtype=np.uint8)
    within = np.arange(len(text)) - np.repeat(at, size)
    letter = within < np.repeat(size - 1, size)
    text[letter] = data[(np.repeat(starts[w], size) + within)[letter]]
    edge = np.append(at, len(text))[np.searchsorted(owner[kept], np.arange(docs + 1))]
    raw = text.tobytes()
    collapsed = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    columns = {c: np.zeros(docs, dtype=np.int64) for c in ("n_runs", "start", "length", "period", "exponent_milli")}
    shas = [hashlib.sha256(b"").hexdigest()] * docs
    for d, a, b in zip(*_groups(doc), strict=True):
        best = a + int(np.lexsort((period[a:b], start[a:b], -length[a:b]))[0])
        for c, v in (("n_runs", b - a), ("start", start[best]), ("length", length[best]), ("period", period[best]), ("exponent_milli", 1000 * length[best] // period[best])):
            columns[c][d] = v
        shas[d] = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)).encode()).hexdigest()
    none = columns["n_runs"] == 0
    arrays = [pa.array(ids, pa.int64()), pa.array(columns.pop("n_runs")), *(pa.array(v, mask=none) for v in columns.values()), pa.array(shas), pa.array(collapsed)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _OUT.split(", ")])


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256 and collapsed_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, data, offsets in K.chunks(b.column(1)):
                yield _chunk(ids[lo:hi], data, offsets)

    return docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").alias("_text")).mapInArrow(run, _OUT)
