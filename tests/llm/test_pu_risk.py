"""The non-negative risk against a direct computation, conflicting labels, and the sample's bound."""

import numpy as np
import pytest

from promptlake.llm import quality_model as M


def direct(w, p, u, prior):
    loss = lambda x, y: np.log(1 + np.exp(-y * (x @ w)))
    plus, minus = prior * np.mean([loss(x, 1) for x in p]), np.mean([loss(x, -1) for x in u]) - prior * np.mean([loss(x, -1) for x in p])
    return plus, minus


@pytest.mark.parametrize(("seed", "scale"), [(0, 0.3), (1, 0.3), (2, 4.0), (3, 4.0)])
def test_risk_and_gradient(seed, scale):
    rng = np.random.default_rng(seed)
    p, u, w = rng.normal(1, 1, (30, 4)), rng.normal(0.5, 1, (50, 4)), scale * rng.normal(0, 1, 4)
    prior = 0.7
    assert M.risk(w, p, u, prior) == pytest.approx(direct(w, p, u, prior))
    negative = direct(w, p, u, prior)[1] < 0
    # Held at zero, the negative part is climbed back; otherwise the whole risk falls.
    value = (lambda v: -direct(v, p, u, prior)[1]) if negative else (lambda v: sum(direct(v, p, u, prior)))
    numeric = [(value(w + 1e-6 * e) - value(w - 1e-6 * e)) / 2e-6 for e in np.eye(4)]
    assert M.gradient(w, p, u, prior) == pytest.approx(numeric, abs=1e-5)


def test_one_id_on_many_rows_and_conflicting_labels(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_POSITIVE", 20)
    monkeypatch.setattr(M, "MAX_UNLABELLED", 50)
    taken = []
    sample = M._sample
    monkeypatch.setattr(M, "_sample", lambda rows, bound: taken.append(len(x := sample(rows, bound))) or x)
    docs = spark.createDataFrame([(1, "the same words again and again")] * 300 + [(i, f"some words {i} here") for i in range(2, 60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, None), (2, 1), (3, 0)], "doc_id bigint, quality int")
    got = M.score(docs, labels).collect()
    assert len(got) == 358 and taken[0] <= 20 and taken[1] <= 50
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
