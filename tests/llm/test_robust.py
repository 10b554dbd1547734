"""The covariance determinant of the quality rules against brute force over all subsets."""

import itertools
import math

import numpy as np
import pytest

from promptlake.llm import quality_rules as Q
from promptlake.llm.cluster import Scratch


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_least_determinant(spark, monkeypatch, seed):
    monkeypatch.setattr(Q, "LEAST", 5)
    rng = np.random.default_rng(seed)
    n = 16
    x = rng.normal(1, 0.05, (n, Q.P))
    x[:3] += rng.uniform(0.8, 1.6, (3, Q.P))  # outliers
    rows = [("en", "s", 10, *map(float, r)) for r in x] + [("de", "t", 10, *map(float, r)) for r in x[3:6]]
    stats = spark.createDataFrame(rows, "_lang string, _source string, n_words int, " + ", ".join(f"x{i} double" for i in range(Q.P)))
    h = math.ceil(Q.COVER * n)
    scatter = lambda s: np.cov(s.T, bias=True) * Q._consistency() + np.diag(np.square(Q.FLOOR))
    least = min(np.linalg.det(scatter(x[list(s)])) for s in itertools.combinations(range(n), h))
    with Scratch(spark) as scratch:
        got = {r["key"]: r for r in Q.fit(stats, scratch).collect()}
    assert set(got) == {"=en\n=s", "=en", ""}  # the other cell has too few rows
    assert got["=en"]["det"] == pytest.approx(least, rel=0.02)
    assert all(abs(got["=en"][f"m{i}"] - 1) < 0.1 for i in range(Q.P))


def test_limit_is_the_quantile():
    assert math.exp(-Q.LIMIT / 2) * (1 + Q.LIMIT / 2 + Q.LIMIT**2 / 8) == pytest.approx(Q.REJECT, rel=1e-6)
