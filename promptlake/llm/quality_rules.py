"""Quality rules: base word rules, then robust multivariate outliers.

Statistics of every whole text are transformed to a vector per document. For every
language and source a minimum-covariance-determinant (MCD) estimate of location and
scatter is sought: of the subsets that hold the share ``COVER`` of the rows, the one whose
scatter has the least determinant. It is found by concentration steps, in which the rows
nearest to the present estimate give the next one, from three fixed starts (medians, lower
quartiles, and mean with full covariance), each until its determinant stands still; the
least determinant of all wins. The scatter has ``FLOOR`` added to its diagonal, so that
statistics that are constant in a cell do not make every determinant zero. Documents far
away by Mahalanobis distance are rejected.

Every step is a grouped aggregation over all rows; quantiles come from exact counts over
fixed bins, so no group is gathered in a task and no statistic is sampled.

A cell (language, source) with fewer than ``LEAST`` rows takes the estimate of its
language, and that the estimate of all rows; with fewer than ``LEAST`` rows in all,
only the base rules decide. Nulls in lang or source form a cell of their own. Null and
empty texts have no words and fail the base rules. Repeated rows count as often as they
occur. Other columns of the input, whatever their names, take no part; ``kept_documents``
returns them as they were.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .cluster import Scratch, keep

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct")
LEAST = 60
COVER = 0.75
#: A start ends when a step lowers the determinant by less than this share, or after so many steps.
STILL, STEPS = 1e-3, 12
STARTS = ("median", "quartile", "mean")
#: Chance of rejection of a clean document if the statistics were normal; small, as their tails are heavier.
REJECT = 5e-7
#: Least standard deviation of each transformed statistic: what clean short texts show by chance.
FLOOR = (0.07, 0.05, 0.15, 0.15, 0.06, 0.06)
P = len(FLOOR)
PARAM_ROWS_BOUND = 50_000

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of every text of an Arrow column."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in COUNTS}
    for _, _, data, offsets in K.chunks(column):
        solid = ~K.SEPARATOR[data]
        hashes, bounds = K.words(data, offsets)
        out["n_words"].append(np.diff(bounds))
        out["word_chars"].append(K.totals(solid & ((data & 0xC0) != 0x80), offsets))
        out["n_symbols"].append(K.totals(_SYMBOL[data], offsets))
        out["n_upper"].append(K.totals((data >= 65) & (data <= 90), offsets))
        out["n_punct"].append(K.totals(_PUNCT[data], offsets))
        starts, line, at = K.lines(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        run = np.concatenate([[0], np.cumsum(solid)])
        worded = run[ends] > run[starts]
        line_bounds = np.concatenate([[0], np.cumsum(worded)])[at]
        out["n_lines"].append(np.diff(line_bounds))
        out["n_dup_lines"].append(np.diff(line_bounds) - np.diff(K.distinct(line[worded], line_bounds)[1]))
        out["n_repeat_words"].append(_repeat_words(hashes, bounds))
    return {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in out.items()}


def _repeat_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words in 3-word windows that occur twice or more in their text."""
    win, win_bounds = K.windows(hashes, bounds, 3)
    owner = K.owners(win_bounds)
    order = np.lexsort((win, owner))
    same = (win[order][1:] == win[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again = np.zeros(len(win), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = (np.arange(len(win)) - win_bounds[owner] + bounds[owner])[again]
    hit = np.zeros(len(hashes), dtype=bool)
    for j in range(3):
        hit[at + j] = True
    return K.totals(hit, bounds)


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and COUNTS of each text."""
    fields = {f.name: f for f in docs.schema.fields}
    columns = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)] + [F.col("text").alias("_text")]
    picked = docs.select(*columns)
    schema = ", ".join([f"_k{i} {fields[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"{c} bigint" for c in COUNTS])

    def run(batches):
        for b in batches:
            counts = text_counts(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], names=[*(f"_k{i}" for i in range(len(keep))), *COUNTS])

    return picked.mapInArrow(run, schema).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *COUNTS)


def _vector() -> list:
    """The transformed statistics: a log of word length and roots of shares, which have nearly constant variance."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    share = lambda c, of: F.sqrt(F.col(c) / of)
    return [F.log(chars / n), share("n_symbols", chars), share("n_dup_lines", lines), share("n_repeat_words", n), share("n_upper", chars), share("n_punct", chars)]


def _chi2_6(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8)


def _chi2_6_quantile(q: float) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_6(mid) < q else (lo, mid)
    return lo


#: Squared distance of rejection, 39.8.
LIMIT = _chi2_6_quantile(1 - REJECT)


def _consistency() -> float:
    x = _chi2_6_quantile(COVER)
    return COVER / (_chi2_6(x) - math.exp(-x / 2) * (x / 2) ** 3 / 6)  # chi-square with eight degrees at x


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i, P)]


_M = [f"m{i}" for i in range(P)]
_Q = [f"q{i}{j}" for i, j in _pairs()]
_PARAMS = ", ".join(["key string", "start string", "det double", *(f"{c} double" for c in (*_M, *_Q))])
#: Bins of log(1 + squared distance) and of the statistics, for quantiles.
DISTANCE_BINS, VALUE_BINS = 200, 500


def _small(params: DataFrame, rows: int | None = None) -> DataFrame:
    """Estimates are broadcast up to a checked number of rows only; rows: a bound that is known already."""
    return F.broadcast(params) if (params.count() if rows is None else rows) <= PARAM_ROWS_BOUND else params


def _distance(of=F.col):
    d = [F.col(f"x{i}") - of(f"m{i}") for i in range(P)]
    return reduce(lambda a, b: a + b, (d[i] * d[j] * of(f"q{i}{j}") * (1 if i == j else 2) for i, j in _pairs()))


def _bin(distance):
    return F.floor(F.log1p(F.least(distance, F.lit(1e6))) * DISTANCE_BINS).cast("int")


def _quantile_bins(counts: DataFrame, by: list[str], qs: dict[str, float]) -> DataFrame:
    """The bin of each quantile, from rows (by, bin, count); a key has a bounded number of bins."""
    held = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("h"))
    total = F.aggregate("h", F.lit(0).cast("bigint"), lambda a, x: a + x["count"])

    def at(q: float):
        step = lambda a, x: F.struct((a["upto"] + x["count"]).alias("upto"), F.when(a["upto"] < q * F.col("total"), x["bin"]).otherwise(a["bin"]).alias("bin"))
        return F.aggregate("h", F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(0).alias("bin")), step)["bin"]

    return held.withColumn("total", total).select(*by, *(at(q).alias(n) for n, q in qs.items()))


def _estimates(sums: DataFrame) -> DataFrame:
    """Location, inverse scatter and its determinant, from sums by key and start."""
    factor, floor = _consistency(), np.diag(np.square(FLOOR))

    def invert(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                mean = np.array([r[c] for c in _M]) / r["n"]
                cov = np.zeros((P, P))
                for i, j in _pairs():
                    cov[i, j] = cov[j, i] = r[f"q{i}{j}"] / r["n"] - mean[i] * mean[j]
                scatter = cov * factor + floor
                inv = np.linalg.inv(scatter)
                out.append([r["key"], r["start"], float(np.linalg.det(scatter)), *mean, *(inv[i, j] for i, j in _pairs())])
            yield pd.DataFrame(out, columns=["key", "start", "det", *_M, *_Q])

    return sums.mapInPandas(invert, _PARAMS)


def _sums() -> list:
    return [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"m{i}") for i in range(P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _pairs())]


def _starts(rows: DataFrame) -> DataFrame:
    """Three estimates of each key to begin with; the determinant of the first two does not count."""
    tall = rows.select("key", F.posexplode(F.array(*(F.col(f"x{i}") for i in range(P)))).alias("i", "x"))
    counts = tall.groupBy("key", "i", F.floor(F.col("x") * VALUE_BINS).cast("int").alias("bin")).count()
    value = {c: (F.col(c) + 1) / VALUE_BINS for c in ("q1", "q2", "q3")}
    quartiles = _quantile_bins(counts, ["key", "i"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    wide = quartiles.select("key", "i", value["q1"].alias("quartile"), value["q2"].alias("median"), ((value["q3"] - value["q1"]) / 1.349).alias("sd"))
    of = lambda i, c: F.max(F.when(F.col("i") == i, c))
    centred = [
        wide.groupBy("key").agg(
            *(of(i, F.col(start)).alias(f"m{i}") for i in range(P)),
            *((F.lit(1.0) / of(i, F.col("sd") * F.col("sd") + F.lit(FLOOR[i] ** 2)) if i == j else F.lit(0.0)).alias(f"q{i}{j}") for i, j in _pairs()),
        ).select("key", F.lit(start).alias("start"), F.lit(float("inf")).alias("det"), *_M, *_Q)
        for start in STARTS[:2]
    ]
    mean = _estimates(rows.groupBy("key").agg(*_sums()).withColumn("start", F.lit(STARTS[2])))
    return reduce(DataFrame.unionByName, centred).unionByName(mean.withColumn("det", F.lit(float("inf"))))


def _levels():
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("_lang", "_source"))
    return F.array(F.concat(lang, F.lit("\n"), source), lang, F.lit(""))


def fit(stats: DataFrame, scratch: Scratch) -> DataFrame:
    """The MCD estimate of every cell, language and of all rows (key) that rests on LEAST rows or more.

    stats: _lang, _source, n_words and the statistics x0 to x5, one row per document.
    """
    rows = stats.where("n_words > 0").select(F.explode(_levels()).alias("key"), *(f"x{i}" for i in range(P)))
    enough = scratch.cut(rows.groupBy("key").count().where(F.col("count") >= LEAST).select("key"))
    most = len(STARTS) * enough.count()
    one = math.ceil(most / PARAM_ROWS_BOUND) or 1  # parts of the estimates
    # Here each estimate reads a row for every bin.
    binned = max(2 * stats.sparkSession.sparkContext.defaultParallelism, math.ceil(most / 100))
    rows = rows.join(_small(enough, most), "key", "left_semi")
    active = scratch.cut(_starts(rows), one)
    done = []
    for step in range(STEPS):
        near = rows.join(_small(active, most), "key").select("key", "start", _bin(_distance()).alias("bin"))
        edge = _quantile_bins(near.groupBy("key", "start", "bin").count(), ["key", "start"], {"edge": COVER})
        edged = scratch.cut(edge.join(_small(active, most), ["key", "start"]), binned)
        inside = rows.join(_small(edged, most), "key").where(_bin(_distance()) <= F.col("edge"))
        new = _estimates(inside.select("key", "start", *(f"x{i}" for i in range(P))).groupBy("key", "start").agg(*_sums()))
        before = active.select("key", "start", F.col("det").alias("before"))
        both = scratch.cut(new.join(_small(before, most), ["key", "start"]), one)
        falls = F.col("det") < (1 - STILL) * F.col("before")
        done.append(both.where(~falls) if step < STEPS - 1 else both)
        active = both.where(falls).drop("before")
        if active.isEmpty():
            break
    best = reduce(DataFrame.unionByName, done).groupBy("key").agg(F.min(F.struct("det", "start", *_M, *_Q)).alias("p"))
    return best.select("key", "p.*").coalesce(one)


def judge(stats: DataFrame, params: DataFrame, limit: float) -> DataFrame:
    """stats with base_failed, distance and kept; each row by the finest estimate there is."""
    keyed, levels = stats.withColumn("_levels", _levels()), _small(params.select("key", F.struct(*_M, *_Q).alias("p")))
    for i in range(3):
        keyed = keyed.join(levels.select(F.col("key").alias(f"_key{i}"), F.col("p").alias(f"_p{i}")), F.col("_levels")[i] == F.col(f"_key{i}"), "left")
    keyed = keyed.withColumn("_p", F.coalesce("_p0", "_p1", "_p2"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = keyed.withColumn("distance", _distance(lambda c: F.col("_p")[c])).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit))


def _stats(docs: DataFrame, keep: dict) -> DataFrame:
    picked = docs.select(F.col("text").alias("text"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(F.col(c).alias(k) for k, c in keep.items()))
    return with_counts(picked, ["_lang", "_source", *keep]).select("*", *(x.alias(f"x{i}") for i, x in enumerate(_vector())))


def verdicts(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, COUNTS, base_failed, distance (squared; null without an estimate) and kept for every row of docs."""
    with Scratch(docs.sparkSession) as scratch:
        stats = scratch.cut(_stats(docs, {"_id": "doc_id"}))
        return keep(judge(stats, scratch.cut(fit(stats, scratch)), limit).select(F.col("_id").alias("doc_id"), *COUNTS, "base_failed", "distance", "kept"))


def kept_documents(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The documents that pass, with all their columns. Texts are counted twice and never shuffled."""
    with Scratch(docs.sparkSession) as scratch:
        params = keep(fit(scratch.cut(_stats(docs, {})), scratch))
    names = {f"_c{i}": c for i, c in enumerate(docs.columns)}
    return judge(_stats(docs, names), params, limit).where("kept").select(*(F.col(k).alias(c) for k, c in names.items()))
