"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else that may be learnt from
is unlabelled web text, whatever its label. The class prior of the unlabelled text is
estimated by best-bin estimation: among thresholds of a first classifier, the
least ratio of the unlabelled to the positive share above it, with a confidence margin.
The score model minimises the non-negative unbiased risk

    prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive))

with logistic loss, so its output estimates the chance of label 1. Scores use the text
only: eight statistics, with squares, and the shares of its words and word pairs in hashed
buckets; labels, lang, source and doc_id are no inputs.

Fitting uses a bounded sample: at most ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED``
other rows, picked by a hash of doc_id and features. Every document is scored. Rows with
crc32(doc_id as text) mod 5 = 0 are held out of fitting altogether.

Without positives (or without rows to learn from) every score is 0.5. Null and empty
texts are scored as texts without words; repeated rows are scored each; labels that are
null or conflict count as positive if any of them is 1. Other columns take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .cluster import Scratch, keep
from .quality_rules import text_counts

MAX_POSITIVE, MAX_UNLABELLED = 20_000, 60_000
THRESHOLD = 0.3
STEPS, RATE, DECAY, CLIP = 400, 0.05, 1e-4, 6.0
STATISTICS, BUCKETS = 8, 32
WIDTH = STATISTICS + 2 * BUCKETS


def features(texts: pa.Array) -> np.ndarray:
    """Eight statistics of each text, then roots of the shares of its words and of its word pairs in hashed buckets."""
    c = {k: v.astype(float) for k, v in text_counts(texts).items()}
    n, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    share = lambda k, of: np.sqrt(c[k] / of)
    columns = [np.log(chars / n), share("n_symbols", chars), share("n_dup_lines", lines), share("n_repeat_words", n), share("n_upper", chars), share("n_punct", chars), np.log1p(c["n_words"]), np.exp(-c["n_words"] / 20)]
    hashed = []
    for lo, hi, data, offsets in K.chunks(texts):
        words, bounds = K.words(data, offsets, fold=True)
        parts = []
        for h, at in ((words, bounds), K.windows(words, bounds, 2)):
            bucket = (K.mix(h) >> np.uint64(40)) % np.uint64(BUCKETS)
            held = np.bincount(K.owners(at) * BUCKETS + bucket.astype(np.int64), minlength=(hi - lo) * BUCKETS).reshape(-1, BUCKETS)
            parts.append(np.sqrt(held / np.maximum(np.diff(at), 1)[:, None]))
        hashed.append(np.hstack(parts))
    return np.hstack([np.stack(columns, axis=1), np.vstack(hashed) if hashed else np.zeros((0, 2 * BUCKETS))])


def _basis(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    return np.hstack([np.ones((len(x), 1)), z, np.square(z[:, :STATISTICS])])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def _descend(gradient, width: int) -> np.ndarray:
    """Adam with a falling rate."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, STEPS + 1):
        g = gradient(w) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (1 - t / (STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Best-bin estimate of the share of positives in u, from scores of positives p and of u."""
    edges = np.quantile(p, np.linspace(0, 0.9, 91))
    above_p = np.array([(p >= e).mean() for e in edges])
    above_u = np.array([(u >= e).mean() for e in edges])
    margin = math.sqrt(math.log(40) / (2 * len(u))) + math.sqrt(math.log(40) / (2 * len(p)))
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> dict:
    """Weights of the score model, from two feature matrices."""
    if not len(positive) or not len(unlabelled):
        return {"prior": 0.5, "weights": np.zeros(1 + WIDTH + STATISTICS), "mean": np.zeros(WIDTH), "scale": np.ones(WIDTH)}
    mean, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-3)
    bp, bu = _basis(positive, mean, scale), _basis(unlabelled, mean, scale)

    half_p, half_u = np.arange(len(bp)) % 2 == 0, np.arange(len(bu)) % 2 == 0
    first = _descend(lambda w: (bp[half_p].T @ (_sigmoid(bp[half_p] @ w) - 1) / max(half_p.sum(), 1) + bu[half_u].T @ _sigmoid(bu[half_u] @ w) / max(half_u.sum(), 1)) / 2, bp.shape[1])
    rest_p, rest_u = (bp[~half_p] if len(bp) > 1 else bp) @ first, (bu[~half_u] if len(bu) > 1 else bu) @ first
    prior = estimate_prior(rest_p, rest_u)

    return {"prior": prior, "weights": _descend(lambda w: gradient(w, bp, bu, prior), bp.shape[1]), "mean": mean, "scale": scale}


def risk(w: np.ndarray, bp: np.ndarray, bu: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part of the risk, and the negative part before it is held at zero."""
    sp, su = bp @ w, bu @ w
    return prior * np.logaddexp(0, -sp).mean(), np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()


def gradient(w: np.ndarray, bp: np.ndarray, bu: np.ndarray, prior: float) -> np.ndarray:
    """Of the risk; where the negative part has fallen below zero, a step back from that part alone."""
    sp, su = _sigmoid(bp @ w), _sigmoid(bu @ w)
    positive, negative = prior * (bp.T @ (sp - 1)) / len(bp), bu.T @ su / len(bu) - prior * (bp.T @ sp) / len(bp)
    return positive + negative if risk(w, bp, bu, prior)[1] >= 0 else -negative


def _sample(rows: DataFrame, bound: int) -> np.ndarray:
    """At most bound rows (all, where there are no more), by a hash of the row."""
    share = min(1.0, bound / max(rows.count(), 1))
    picked = rows.where(F.pmod(F.xxhash64("doc_id", "f", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000).limit(bound)
    parts = [b.column(0).flatten().to_numpy().reshape(-1, WIDTH) for b in picked.select("f").toArrow().to_batches()]
    got = np.vstack(parts) if parts else np.zeros((0, WIDTH))
    return got[np.lexsort(got.T)].astype(float) if len(got) else np.zeros((0, WIDTH))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches):
        for b in batches:
            x = features(b.column(1)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, WIDTH, dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "f"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.cut(docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(describe, f"doc_id {kind}, f array<float>").withColumn("held_out", held))
        learn = rows.where("not held_out and doc_id is not null")
        good = labels.where("quality = 1").select(F.col("doc_id").alias("_good")).distinct()
        positive = learn.join(good, F.col("doc_id") == F.col("_good"), "left_semi")
        model = fit(_sample(positive, MAX_POSITIVE), _sample(learn, MAX_UNLABELLED))

        def judge(batches):
            for b in batches:
                x = b.column(1).flatten().to_numpy().astype(float).reshape(-1, WIDTH)
                chance = _sigmoid(_basis(x, model["mean"], model["scale"]) @ model["weights"])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(chance)], names=["doc_id", "held_out", "score"])

        scored = rows.select("doc_id", "f", "held_out").mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double")
        return keep(scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")))
