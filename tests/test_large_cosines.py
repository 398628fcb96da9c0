"""Sums of cosines in blocks equal the plain way; nulls and other lengths have no cosine."""

import numpy as np

from quaestor.operators import dense


def test_totals(spark, monkeypatch):
    monkeypatch.setattr(dense, "ITEMS", 40)
    monkeypatch.setattr(dense, "QUESTIONS", 5)
    monkeypatch.setattr(dense, "STEP", 2)
    v = np.random.default_rng(1).standard_normal((150, 6))
    rows = [(k, [float(c) for c in r]) for k, r in enumerate(v)] + [(900, None), (901, [1.0]), (902, [None] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = table.where("vec_id % 10 = 0").selectExpr("vec_id AS question_id", "embedding AS q")
    got = {r.question_id: r for r in dense.totals(q, table).collect()}
    norm = np.linalg.norm(v, axis=1) + 1e-8
    s = v @ v.T / (norm[:, None] * norm[None, :])
    assert set(got) == set(range(0, 150, 10)) | {900} and all(r.n == 153 for r in got.values()) and got[900].total is None
    for k in range(0, 150, 10):
        assert np.allclose((got[k].total, got[k].most, got[k].least), (s[k].sum(), s[k].max(), s[k].min()), atol=1e-9)
