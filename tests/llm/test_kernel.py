import random
import re
import string

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from promptlake.llm import kernel as K
from promptlake.llm import line_dedup, lm_score, quality_rules, token_files

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
text = st.text(alphabet="aAbÄß 日\n\t\r#|", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), text), max_size=12))
def test_words_and_shingles(texts):
    for k in (2, 5):
        for lo, hi, data, offsets in K.chunks(pa.array(texts, pa.string())):
            h, bounds = K.words(data, offsets, fold=True)
            s, at = K.distinct(*K.windows(h, bounds, k, short=True))
            for i in range(lo, hi):
                w = re.findall(r"[^\x20\x09-\x0D]+", (texts[i] or "").translate(LOW))
                assert bounds[i - lo + 1] - bounds[i - lo] == len(w)
                want = set(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else ({tuple(w)} if w else set())
                assert at[i - lo + 1] - at[i - lo] == len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), text), min_size=1, max_size=8))
def test_quality_counts(texts):
    got = quality_rules.text_counts(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        win = list(zip(w, w[1:], w[2:], strict=False))
        hit = {i + j for i, x in enumerate(win) if win.count(x) > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        assert tuple(int(got[c][i]) for c in quality_rules.COUNTS[:5]) == want


def test_chunks_cover_long_texts():
    texts = ["a b " * 400_000, None, "", "c"]
    n = [0] * 4
    for lo, hi, data, offsets in K.chunks(pa.array(texts)):
        n[lo:hi] = np.diff(K.words(data, offsets)[1]).tolist()
    assert n == [800_000, 0, 0, 1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**60 - 1) | st.integers(0, 50_000) | st.integers(0, 3), max_size=700))
def test_simple8b_round_trip(ids):
    x = np.array(ids, dtype=np.uint64)
    words, offsets = token_files.encode(x)
    assert token_files.decode(words, offsets, len(x)).tolist() == ids
    if len(ids) > 256:
        assert token_files.decode(words, offsets, len(x), 1, 2).tolist() == ids[256:512]


def test_simple8b_rejects_what_it_cannot_hold():
    try:
        token_files.encode(np.array([1 << 60], dtype=np.uint64))
    except ValueError:
        return
    raise AssertionError


def test_minimal_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50, 5000):
        a, b = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 63, n).astype(np.uint64)
        if n > 10:
            a[:5] = a[0]  # one half may be shared
        sizes, bits, where = line_dedup.build_index(a, b)
        assert sorted(where.tolist()) == list(range(n))
        assert (line_dedup.find(a, b, sizes, bits) == where).all()


def test_planes_round_trip():
    x = np.sort(np.array([random.Random(1).randrange(1 << 64) for _ in range(500)], dtype=np.uint64))
    assert (lm_score._unplanes(lm_score._planes(x)) == x).all()
    assert len(lm_score._unplanes(lm_score._planes(x[:0]))) == 0
