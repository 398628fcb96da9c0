"""Rows whose places lie on one line share its counts; sums equal those of each row by itself."""

import math

import numpy as np
import pytest

from quaestor.operators import evaluation

PRIME = 2**31 - 1


def times(k, b):
    """By whole numbers of any length, as the SQL has it."""
    h = (b * 7919 + k % PRIME * 104729 + 12345) % PRIME
    for shift, factor in ((15, 48271), (13, 69621), (16, 16807)):
        h = (h ^ (h >> shift)) * factor % PRIME
    return sum(h > int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(n + 1))) for n in range(10))


def test_rows_share_lines(monkeypatch):
    asked, counts = [], evaluation.poisson_counts
    monkeypatch.setattr(evaluation, "poisson_counts", lambda at: asked.append(len(at)) or counts(at))
    rng = np.random.default_rng(1)
    q, x = np.sort(rng.choice(3000, 500, replace=False)), rng.standard_normal(500)
    weight, total = np.zeros(400), np.zeros(400)
    evaluation._weigh(17, q, np.ones(500), x, 400, weight, total)
    assert sum(asked) <= 3000 + 400  # before: 500 rows by 400 resamples
    line = counts(np.arange(3400, dtype=np.int64) * 7919 + 17).astype(int)
    assert (weight == sum(line[p : p + 400] for p in q)).all()
    assert np.allclose(total, sum(v * line[p : p + 400] for p, v in zip(q, x, strict=True)))


def test_bootstrap_of_any_keys(spark):
    keys = [*range(60), 5, 5, -1, -(2**40), PRIME - 1, PRIME, PRIME + 1, 2**62, *(7919 * PRIME + 13 * k for k in range(20))]
    x = [math.sin(n) for n in range(len(keys))]
    rows = [*zip(keys, x, strict=True), (None, 1.0), (3, None)]
    got = evaluation.bootstrap(spark.createDataFrame(rows, "k long, x double"), 200).first()
    w = np.array([[times(k, b) for k in keys] for b in range(200)])
    m = w @ np.array(x) / w.sum(axis=1)
    assert got.n == len(keys) and got.mean == pytest.approx(np.mean(x))
    assert [got.lo, got.hi] == pytest.approx(np.quantile(m, [0.025, 0.975]), abs=1e-12) and got.p_better == pytest.approx((m > 0).mean())
