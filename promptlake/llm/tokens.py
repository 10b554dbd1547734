"""Token ids of whole texts with a public tokenizer file, fast enough for large tables.

A tokenizer of the two known kinds encodes each pre-token on its own. Pre-tokens are cut
with array operations on the UTF-8 bytes, and told apart by a 64-bit hash. Their ids come
from a bounded cache in which a hash has one place; only what is not there goes to the
library's model. Texts with characters outside a set for which the cutting is
plainly the same as the library's are encoded whole by the library. Other tokenizers
always take that way.

The library gives an added token's own id where a text spells it out. With ``added``
that is kept, and texts that hold such a spelling are encoded whole by the library;
without it the spelling is ordinary text.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import kernel as K

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

PLACES = 1 << 20  # of the cache: a hash and a span of ids each
IDS = 1 << 22  # ids that the cache holds before it starts anew

LETTER, DIGIT, SPACE, BREAK, MARK, ODD = range(6)


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class by byte (characters below 128), class of U+0080 to U+017F, and these characters' lower-case bytes."""
    low = np.full(256, ODD, dtype=np.uint8)
    for c in range(128):
        x = chr(c)
        low[c] = SPACE if x == " " else BREAK if x in "\t\n\r" else ODD if not x.isprintable() else LETTER if x.isalpha() else DIGIT if x.isdigit() else MARK
    high, lower = np.full(0x180, ODD, dtype=np.uint8), np.zeros((0x180, 2), dtype=np.uint8)
    for c in range(0xA1, 0x17F):
        x = chr(c)
        # Left to the library: the soft hyphen, other numbers, and letters whose lower case takes more bytes.
        if c == 0xAD or x.isnumeric() or len(x.lower().encode()) != 2:
            continue
        high[c] = LETTER if x.isalpha() else MARK
        lower[c] = np.frombuffer(x.lower().encode(), dtype=np.uint8)
    return low, high, lower


_LOW, _HIGH, _LOWER = _classes()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: The character that stands for each byte in byte-level vocabularies; printable ones stand for themselves.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = np.zeros(256, dtype="<u4")
_ALPHABET[_SELF] = _SELF
_ALPHABET[[b for b in range(256) if b not in _SELF]] = 256 + np.arange(256 - len(_SELF))

_loaded: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = False) -> Encoder:
    """One encoder for each path, mode and Python worker."""
    if (path, added) not in _loaded:
        _loaded[path, added] = Encoder(path, added)
    return _loaded[path, added]


def _classify(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The class of every byte's character, and the bytes, in lower case if asked."""
    kind = _LOW[data]
    out = _FOLD[data] if lower else data
    wide = np.flatnonzero(data >= 0x80)
    if len(wide):
        lead = wide[(data[wide] >= 0xC2) & (data[wide] <= 0xC5)]  # followed by one more byte, as Arrow texts are valid
        code = ((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
        kind[lead] = kind[lead + 1] = _HIGH[code]
        if lower:
            ok = kind[lead] != ODD
            out[lead[ok]], out[lead[ok] + 1] = _LOWER[code[ok], 0], _LOWER[code[ok], 1]
    return kind, out


def _contractions(data: np.ndarray, quote: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the quotes at ``quote`` those with 's 't 'm 'd 're 've 'll behind them before ``end``; and the length of that."""
    at = lambda j: np.where(quote + j < end, data[np.minimum(quote + j, len(data) - 1)], 0)
    one, two = at(1), at(2)
    single = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
    double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    size = np.where(single, 2, np.where(double, 3, 0))
    return quote[size > 0], size[size > 0]


class Encoder:
    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Any case and any white space, for tokens that are looked up in normalized texts.
        spelled = [r"\s+".join(map(re.escape, re.split(r"\s+", t["content"]))) for t in spec.get("added_tokens") or () if t["content"]]
        self.added = re.compile("|".join(spelled), re.I) if added and spelled else None
        # How all of them begin, as far as that has neither case nor white space; finding it is cheap.
        lead = os.path.commonprefix([t["content"] for t in spec.get("added_tokens") or () if t["content"]])
        self.lead = "".join(itertools.takewhile(lambda c: c.lower() == c.upper() and not c.isspace(), lead)).encode()
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        inner = [x.get("type") for x in pre.get("pretokenizers", ())]
        self.kind = None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
            self.kind = "byte"
        elif inner == ["Split", "ByteLevel"] and [x.get("type") for x in norm.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "word"
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(PLACES, dtype=np.uint64)
        self.first, self.count = np.zeros(PLACES, dtype=np.int32), np.zeros(PLACES, dtype=np.int32)
        self.held, self.used = np.zeros(IDS, dtype=np.uint32), 0

    # -- the library ---------------------------------------------------------------------

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and how many each has, of pre-tokens in the library's byte alphabet that the cache does not have."""
        split = self.library.model.tokenize
        ids = [[t.id for t in split(w)] for w in words]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum())), size

    # -- pre-tokens ----------------------------------------------------------------------

    def _starts(self, data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens start, and which of them start with white space."""
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        change = edge[:n].copy()
        change[1:] |= kind[1:] != kind[:-1]
        white = (kind == SPACE) | (kind == BREAK)
        start = change & ~white
        fresh = start.copy()
        fresh[1:] &= ~(kind[:-1] == SPACE) | edge[1:n]  # not taken into a pre-token by the space before it
        if self.kind == "byte":
            start = fresh
            before = np.zeros(n, dtype=bool)
            before[1:] = white[:-1]
            after = np.zeros(n, dtype=bool)
            after[:-1] = ~white[1:]
            start |= white & (~before | edge[:n] | (after & ~edge[1:]))
            quote = np.flatnonzero(fresh & (data == ord("'")) & (kind == MARK))
        else:
            start |= (kind == DIGIT) | (white & change)
            quote = np.flatnonzero(change & (data == ord("'")))
        if len(quote):
            end = offsets[np.searchsorted(offsets, quote, side="right")]
            quote, size = _contractions(data, quote, end)
            start[quote + 1] = False
            behind = quote + size
            behind = behind[behind < n]
            start[behind] |= ~white[behind] | (self.kind == "word")
        at = np.flatnonzero(start)
        return at, white[at]

    def _cached(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a chunk of texts, their offsets by text, and which texts the library must encode whole."""
        kind, data = _classify(data, self.kind == "word")
        odd = K.totals(kind == ODD, offsets) > 0
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64), odd
        start, white = self._starts(data, kind, offsets)
        own = np.searchsorted(offsets, start, side="right") - 1
        use = ~odd[own]
        if self.kind == "word":
            use &= ~white
        hashes = K.span_hashes(K.BYTE, data, start)
        end = np.append(start[1:], len(data))
        start, end, own, hashes = start[use], end[use], own[use], hashes[use]
        place = (hashes & np.uint64(PLACES - 1)).astype(np.int64)
        miss = np.flatnonzero(self.keys[place] != hashes)
        first, count = self.first[place].astype(np.int64), self.count[place].astype(np.int64)
        ids = self.held
        if len(miss):
            fresh, example, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            example = miss[example]
            spelled = _ALPHABET[data].tobytes().decode("utf-32-le")
            flat, size = self._new([spelled[a:b] for a, b in zip(start[example].tolist(), end[example].tolist(), strict=True)])
            at = np.cumsum(size) - size
            ids = np.concatenate([self.held[: self.used], flat])  # the chunk's own view; the cache may start anew below
            first[miss], count[miss] = self.used + at[inverse], size[inverse]
            if self.used + len(flat) > IDS:
                self._clear()
            if len(flat) <= IDS:
                to = (fresh & np.uint64(PLACES - 1)).astype(np.int64)
                self.held[self.used : self.used + len(flat)] = flat
                # Where two share a place, all of its fields must come from one of them.
                _, one = np.unique(to, return_index=True)
                self.keys[to[one]], self.first[to[one]], self.count[to[one]] = fresh[one], self.used + at[one], size[one]
                self.used += len(flat)
        total = np.cumsum(count)
        out = ids[np.repeat(first - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        per = np.bincount(own, weights=count, minlength=len(offsets) - 1).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(per)]), odd

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text (null: none), as little-endian unsigned 32-bit integers."""
        return list(self.encoded(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())))

    def encoded(self, texts: pa.Array) -> Iterator[bytes]:
        if self.kind is None:
            for lo in range(0, len(texts), 64):
                yield from (x.astype("<u4").tobytes() for x in self._whole([t or "" for t in texts.slice(lo, 64).to_pylist()]))
            return
        for _, _, data, offsets in K.chunks(texts):
            ids, at, odd = self._cached(data, offsets)
            whole = set(np.flatnonzero(odd).tolist())
            raw = data.tobytes()
            text = lambda i: raw[offsets[i] : offsets[i + 1]].decode()  # noqa: B023, E731
            if self.added and self.lead in raw:
                whole.update(i for i in range(len(odd)) if self.lead in raw[offsets[i] : offsets[i + 1]] and self.added.search(text(i)))
            coded = ids.astype("<u4").tobytes()
            for i in range(len(odd)):
                yield self._whole([text(i)])[0].astype("<u4").tobytes() if i in whole else coded[4 * at[i] : 4 * at[i + 1]]
