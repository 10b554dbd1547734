"""Words of every length go through the automaton."""

import random

import pytest

from promptlake.llm import token_counts


def greedy(w, initial, internal):
    most = max(map(len, initial | internal))
    i = n = 0
    while i < len(w):
        j = next((j for j in range(min(len(w), i + most), i, -1) if w[i:j] in (internal if i else initial)), None)
        if j is None:
            return 1
        i, n = j, n + 1
    return n


def test_long_words(spark):
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    initial, internal = map(set, token_counts.vocabulary(path))
    draw = random.Random(4)
    pieces = [p for p in sorted(internal) if p.isascii() and p.isalnum()]
    long = ["a" * 200, "a" * 201, "abc" * 5000, "https://a.example/" + "x1=y&" * 300, "b" * 300 + "\U000F0000"]
    long += ["".join(draw.choice(pieces) for _ in range(n)) for n in (90, 400, 3000)]
    texts = [*long, f"one {long[1]} two {long[1]}\n{long[3]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(docs, path).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (len(t.split()), sum(greedy(w, initial, internal) for w in t.split()))
    assert got[2][1] > 1 and got[4][1] == 1
