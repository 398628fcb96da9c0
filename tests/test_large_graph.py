"""Chunks that questions reach by groups, and the first facts of large neighbourhoods, equal the plain way."""

import random

import numpy as np

from quaestor.operators import engines


def test_best_of_groups(spark, monkeypatch):
    monkeypatch.setattr(engines, "ITEMS", 30)
    monkeypatch.setattr(engines, "QUESTIONS", 3)
    monkeypatch.setattr(engines, "STEP", 2)
    rng, pick = np.random.default_rng(4), random.Random(4)
    v, q = np.round(rng.standard_normal((90, 4)), 1), rng.standard_normal((8, 4))
    groups = [pick.sample(range(9), pick.randint(1, 3)) for _ in v]
    asks = [dict(zip(pick.sample(range(10), 4), (1, 2, 2, 3))) if k != 7 else {} for k in range(8)]
    items = spark.createDataFrame([(f"i{k:02d}", r.tolist(), g) for k, (r, g) in enumerate(zip(v, groups))], "chunk_id string, vec array<double>, groups array<int>")
    asked = spark.createDataFrame([(k, r.tolist(), list(a), list(a.values())) for k, (r, a) in enumerate(zip(q, asks))], "question_id long, q array<double>, groups array<int>, places array<int>")
    s = np.round(q @ v.T / ((np.linalg.norm(q, axis=1) + 1e-8)[:, None] * (np.linalg.norm(v, axis=1) + 1e-8)[None, :]), 9)
    want: dict = {}
    for a in range(8):
        for b in range(90):
            if own := [asks[a][g] for g in groups[b] if g in asks[a]]:
                want.setdefault((a, min(own)), []).append((-s[a, b], f"i{b:02d}"))
    got: dict = {}
    for r in engines.best_of_groups(items, asked, "chunk_id", 3).collect():
        got.setdefault((r.question_id, r.place), []).append((-round(r.score, 9), r.chunk_id))
    assert {k: sorted(x)[:3] for k, x in got.items()} == {k: sorted(x)[:3] for k, x in want.items()}


def test_first_facts(spark, monkeypatch):
    monkeypatch.setattr(engines, "RANGE", 16)
    pick = random.Random(5)
    lines = [(k + (k % 3 << 33), pick.choice("abcd"), pick.choice("abcd")) for k in range(900)]
    near = {0: "ab", 1: "abcd", 2: "d", 3: ""}
    n = spark.createDataFrame([(q, x) for q, own in near.items() for x in own], "question_id int, node string")
    table = spark.createDataFrame(lines, "fact_id long, a string, b string")
    got = engines.facts(n, table, 50)
    want = {(q, f) for q, own in near.items() for f in sorted(f for f, a, b in lines if a in own and b in own)[:50]}
    assert set(map(tuple, got.collect())) == want and len(want) > 100
