"""Language identification by bit-sliced Bloom filters of n-grams.

Texts are lower-cased; ASCII characters that are no letters become spaces. The n-grams are the
windows of 3, 4 and 5 bytes without two spaces in a row. Training counts them by language in a
bounded sample of labelled rows (``TRAIN_ROWS`` a language, chosen by a hash of the text). An
n-gram belongs to a language that uses it at least ``LEAST`` times and at least ``SHARE``
as often as the language that uses it most, so borrowed words and wrong labels do not fill
the filters; each language keeps its ``GRAMS`` most frequent ones.

The filters of all languages lie side by side: slot by slot one bit a language, so the AND of
the ``HASHES`` slots of an n-gram gives all languages that contain it at once. The slots are
a grouping of hashed n-grams with a bitwise OR; only they come to the driver and are
broadcast, ``SLOTS`` words of 64 languages each whatever the corpus. A document's counts of each
language's bit, less the share that a filter's filling gives by chance, decide: the greatest wins
(ties: the language with more training rows, then the name). The score is the winner's part of all counts.

Null texts and texts without a letter (Unicode category L) are ``und`` with score 0. A text
with letters but no known n-gram gets the most frequent language with score 0. Without any labelled
training row all texts are ``und``. Only the ``LANGUAGES`` most frequent languages are learned. Rows
without doc_id are not held out but never train either; repeated rows are trained as often as they stand there. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernel as K
from .cluster import Scratch

FOLDS, ORDERS = 5, (3, 4, 5)
TRAIN_ROWS, GRAMS, LANGUAGES = 5_000, 60_000, 256
LEAST, SHARE = 3, 0.25
SLOTS, HASHES = 1 << 20, 4
#: Entries of n-gram counts that a training task holds before it hands them on.
HELD = 2_000_000
UNKNOWN = "und"

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass
class Model:
    """languages in order of the bits; slots: SLOTS x words of 64 bits; chance: each language's share of false positives."""

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram, document) of every order; an n-gram's number holds its bytes and its order."""
    clean = _CLEAN[data]
    wide = clean.astype(np.uint64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    gap = np.concatenate([[0], np.cumsum((clean[1:] == 32) & (clean[:-1] == 32))]) if len(clean) else np.zeros(0, dtype=np.int64)
    for n in ORDERS:
        m = len(clean) - n + 1
        if m <= 0:
            return
        code = np.full(m, n, dtype=np.uint64)
        for j in range(n):
            code = (code << np.uint64(8)) | wide[j : m + j]
        use = (owner[:m] == owner[n - 1 :]) & (gap[:m] == gap[n - 1 :])
        yield code[use], owner[:m][use]


def _slots(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The slots of every n-gram: two halves of one hash, combined."""
    h = K.mix(codes)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for j in range(HASHES):
        yield ((a + np.uint64(j) * b) % np.uint64(SLOTS)).astype(np.int64)


def _sample(docs: DataFrame, rows: int) -> tuple[DataFrame, list[str]]:
    """(lang, text) of about so many training rows of each language, and the languages, the most frequent first."""
    labelled = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select(F.col("lang").alias("_lang"), F.col("text").alias("_text"))
    sizes = labelled.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(LANGUAGES).collect()
    if not sizes:
        return labelled, []
    share = F.create_map(*(x for r in sizes for x in (F.lit(r["_lang"]), F.lit(min(1.0, rows / r["n"])))))
    drawn = F.pmod(F.xxhash64("_text"), F.lit(1_000_003)) < 1_000_003 * F.coalesce(share[F.col("_lang")], F.lit(0.0))
    return labelled.where(drawn & F.col("_text").isNotNull()), [r["_lang"] for r in sizes]


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) of a training sample (_lang, _text)."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        code, at = np.unique(codes, return_inverse=True)
        return code, np.bincount(at.reshape(-1), counts).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out():
            for lang, parts in held.items():
                code, n = merged(parts)
                for lo in range(0, len(code), 100_000):
                    some = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code[some])), pa.array(code[some].view(np.int64)), pa.array(n[some])], names=["lang", "gram", "n"])
            held.clear()

        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            for lo, _, data, offsets in K.chunks(b.column(1)):
                of = langs[lo : lo + len(offsets) - 1]
                for codes, owner in grams(data, offsets):
                    for lang in set(of):
                        mine = codes[(of == lang)[owner]]
                        if len(mine):
                            held.setdefault(lang, []).append(np.unique(mine, return_counts=True))
            for lang, parts in held.items():
                if len(parts) > 24:
                    held[lang] = [merged(parts)]
            if sum(len(c) for parts in held.values() for c, _ in parts) > HELD:
                yield from out()
        yield from out()

    each = sample.select("_lang", F.lower("_text").alias("_text")).mapInArrow(run, "lang string, gram bigint, n bigint")
    return each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    with Scratch(docs.sparkSession) as scratch:
        return _fit(docs, rows, scratch)


def _fit(docs: DataFrame, rows: int, scratch: Scratch) -> Model:
    sample, languages = _sample(docs, rows)
    words = max(1, -(-len(languages) // 64))
    slots = np.zeros((SLOTS, words), dtype=np.uint64)
    if languages:
        counts = scratch.cut(gram_counts(sample))
        total = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # a row a language
        rated = counts.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
        rated = rated.withColumn("most", F.max("rate").over(Window.partitionBy("gram")))
        chosen = rated.where((F.col("n") >= LEAST) & (F.col("rate") >= SHARE * F.col("most")))
        kept = chosen.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= GRAMS)
        number = F.create_map(*(x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))))

        def hashed(batches):
            for b in batches:
                code, bit = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
                for at in _slots(code):
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bit // 64), pa.array(np.uint64(1) << (bit % 64).astype(np.uint64)).cast(pa.uint64()).view(pa.int64())], names=["slot", "word", "bits"])

        bits = kept.select("gram", number[F.col("lang")].cast("int").alias("bit")).mapInArrow(hashed, "slot bigint, word int, bits bigint").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
        slots[bits.column("slot").to_numpy(), bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    fill = np.array([((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, slots, fill**HASHES)


def _counted(masks: np.ndarray, owner: np.ndarray, languages: int, docs: int) -> np.ndarray:
    """How many n-grams of each document carry each language's bit."""
    out = np.zeros((docs, languages))
    for i in range(languages):
        hit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        out[:, i] = np.bincount(owner, hit, minlength=docs)
    return out


def classify(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(number of the language, score) of each document."""
    docs, k = len(offsets) - 1, len(model.languages)
    found, total = np.zeros((docs, k)), np.zeros((docs, 1))
    for codes, owner in grams(data, offsets):
        masks = None
        for at in _slots(codes):
            masks = model.slots[at] if masks is None else masks & model.slots[at]
        found += _counted(masks, owner, k, docs)
        total += np.bincount(owner, minlength=docs)[:, None]
    corrected = np.maximum(0.0, (found - total * model.chance) / (1 - model.chance))
    best = corrected.argmax(axis=1)
    whole = corrected.sum(axis=1)
    return best, np.where(whole > 0, corrected[np.arange(docs), best] / np.where(whole > 0, whole, 1), 0.0)


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs."""
    model = fit(docs, rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for b in batches:
            letters = b.column(3).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in K.chunks(b.column(2)):
                has = letters[lo:hi].astype(bool)
                if m.languages:
                    best, score = classify(data, offsets, m)
                else:
                    best, score, has = np.zeros(hi - lo, dtype=np.int64), np.zeros(hi - lo), np.zeros(hi - lo, dtype=bool)
                pred = names[np.where(has, best, len(m.languages))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(np.where(has, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    text = F.coalesce("text", F.lit(""))
    rows_ = docs.select(F.col("doc_id").cast("bigint").alias("_id"), held_out().alias("_held"), F.lower(text).alias("_text"), text.rlike(r"\p{L}").alias("_letter"))
    return rows_.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
