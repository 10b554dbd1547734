"""Language identification: held-out accuracy, the filters against plain sets, edge cases."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptlake.llm import kernel as K
from promptlake.llm import language_id as L

D = "/root/testdata/sf0.01"
KIND = "doc_id bigint, text string, lang string, source string, gram int, n int"
SAY = {"en": "the weather is nice and we are going there with them", "de": "das wetter ist schön und wir gehen mit ihnen dorthin", "fr": "le temps est beau et nous allons là avec eux", "tlh": "nuqneH qaStaH nuq tlhIngan maH"}


def rows():
    out = [(i, " ".join(SAY[lang].split()[i % 4 :] * 3), lang, "s", 1, 1) for i in range(80) for lang in [list(SAY)[i % 4]]]
    out += [(100, None, "en", "s", 1, 1), (101, "", "en", "s", 1, 1), (102, "1234 !? 55", "de", "s", 1, 1), (103, "日本", None, "s", 1, 1), (104, SAY["fr"].upper(), None, "s", 1, 1), (105, SAY["de"] + " " * 9 + "und so weiter " * 30_000, None, None, 1, 1)]
    return [*out, out[1], (None, SAY["en"], "tlh", "s", 1, 1), (None, SAY["en"], "tlh", "s", 1, 1)]


def test_rows(spark):
    got = L.identify(spark.createDataFrame(rows(), KIND)).collect()
    assert len(got) == len(rows())
    want = {r[0]: r[2] for r in rows()} | {100: "und", 101: "und", 102: "und", 104: "fr", 105: "de"}
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] is None:
            assert r["lang_pred"] == "en"
        elif r["doc_id"] == 103:
            assert r["lang_pred"] in SAY and r["score"] == 0
        else:
            assert r["lang_pred"] == want[r["doc_id"]]


def test_filters_equal_plain_sets(spark):
    """No false negative, and a chance of false positives near the measured filling."""
    docs = spark.createDataFrame(rows(), KIND)
    model = L.fit(docs)
    sample, languages = L._sample(docs, 10_000)
    assert sorted(languages) == sorted(SAY) == sorted(model.languages)
    counts = {(r["lang"], r["gram"]): r["n"] for r in L.gram_counts(sample).collect()}
    total = {lang: sum(n for (x, _), n in counts.items() if x == lang) for lang in languages}
    rate = {k: n / total[k[0]] for k, n in counts.items()}
    top = {}
    for (_, g), r in rate.items():
        top[g] = max(top.get(g, 0), r)
    sets = {lang: {g for (x, g), n in counts.items() if x == lang and n >= L.LEAST and rate[x, g] >= L.SHARE * top[g]} for lang in languages}
    every = np.array(sorted({g for s in sets.values() for g in s}))
    masks = None
    for at in L._slots(every.view(np.uint64)):
        masks = model.slots[at] if masks is None else masks & model.slots[at]
    for i, lang in enumerate(model.languages):
        bit = (masks[:, 0] >> np.uint64(i)) & np.uint64(1)
        inside = np.array([g in sets[lang] for g in every.tolist()])
        assert bit[inside].all() and bit[~inside].mean() <= model.chance[i] + 0.01


def test_grams():
    text = "Ab, cdé  x"
    data, offsets = np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())])
    codes = np.concatenate([c for c, _ in L.grams(data, offsets)])
    clean = bytes(L._CLEAN[data])
    want = [(n, clean[i : i + n]) for n in L.ORDERS for i in range(len(clean) - n + 1) if b"  " not in clean[i : i + n]]
    assert [(int(c) >> (8 * n), int(c & ((1 << (8 * n)) - 1)).to_bytes(n, "big")) for c, (n, _) in zip(codes.tolist(), want, strict=True)] == want


def test_nothing(spark):
    empty = spark.createDataFrame([], KIND)
    assert L.identify(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None, "s", 1, 1)], KIND)
    assert L.identify(unlabelled).first()["lang_pred"] == "und"


@pytest.mark.skipif(not os.path.isdir(D), reason="driver tables absent")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = L.identify(docs).where("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 150 and right >= 0.97 * n
