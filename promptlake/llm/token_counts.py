"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over word-initial and word-internal pieces. For every node the
automaton stores a failure link (the node of the longest trie path that is left once the
longest pieces at its front are popped) and the number of pieces popped on the way. A
word is then matched in one pass over its characters; when the trie has no transition, the
popped count is added and the failure link followed. No piece is ever built: the count
is all that is kept, and it equals that of greedy longest-match-first tokenisation.

Words are ``[^\\x20\\x09-\\x0D]+``, of any length. A word that cannot be matched to its end is
one unknown piece. Null and empty texts have no pieces. Repeated rows are counted each.
Words longer than ``CACHE_WORD`` code points are matched anew each time, so that the
cache stays bounded.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WORD = math.inf  # no bound; the brute force of the tests reads it
CACHE = 500_000
CACHE_WORD = 200
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_loaded: dict[str, Automaton] = {}


class Automaton:
    """initial: pieces that begin a word; internal: pieces that continue one."""

    def __init__(self, initial: Iterable[str], internal: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # 0: start of a word; 1: inside a word, at a piece border
        self.final = [False, False]
        for root, pieces in ((0, initial), (1, internal)):
            for piece in pieces:
                node = root
                for ch in piece:
                    to = self.next[node].get(ch)
                    if to is None:
                        to = self.next[node][ch] = len(self.next)
                        self.next.append({})
                        self.final.append(False)
                    node = to
                self.final[node] |= bool(piece)
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for ch, v in self.next[u].items():
                if self.final[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and ch not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][ch], n
                queue.append(v)
        self.cache: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of one word; 1 where it is unknown."""
        u, n = 0, 0
        step, fail, popped = self.next, self.fail, self.popped
        for ch in word:
            to = step[u].get(ch)
            while to is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 1
                to = step[u].get(ch)
            u = to
        while u != 1:  # pop what is left; it must end at a piece border
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 1
        return n

    def counts(self, text: str) -> tuple[int, int]:
        """(words, pieces) of a text."""
        words = _WORD.findall(text)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        long = 0
        for w in set(words).difference(cache):
            if len(w) <= CACHE_WORD:
                cache[w] = self.count(w)
            else:
                long += 1
        if long:
            return len(words), sum(cache[w] if len(w) <= CACHE_WORD else self.count(w) for w in words)
        return len(words), sum(map(cache.__getitem__, words))


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Word-initial and word-internal pieces of a SentencePiece file, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in plain]
    return [p[1:] for p in pieces if p.startswith("▁") and len(p) > 1], [p for p in pieces if "▁" not in p]


def automaton(path: str) -> Automaton:
    """One automaton for each path and Python worker."""
    if path not in _loaded:
        _loaded[path] = Automaton(*vocabulary(path))
    return _loaded[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        machine = automaton(path)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                got = [machine.counts(t or "") for t in b.column(1).slice(lo, 1024).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 1024), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint")
