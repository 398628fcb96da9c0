"""The inverted index, the vector index and the keyed table: equal to the plain way, over additions, merges and deletions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.operators import dense, engines, ivf, lexical, postings
from quaestor.sources import keyed

DIR = "/root/testdata/sf0.001"


def texts(spark, n, seed, first=0):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows = [(first + k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(200)], k=rng.choice([0, 3, 20, 60, 400])))) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def asked(spark, n=12, seed=5):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(210)]
    return spark.createDataFrame([(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 8])))) for k in range(n)] + [(n, ""), (n + 1, "nothing known")], "question_id long, question string")


def same(a, b):
    key = lambda r: (r.question_id, r["rank"], r.doc_id, round(r.score, 9))
    return sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_postings_equal_the_scan_over_additions_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 64)
    index, q = postings.TextIndex(spark, f"{tmp_path}/i"), asked(spark)
    assert index.search(q).collect() == [] and index.segments() == []
    parts = [texts(spark, 120, 1), texts(spark, 100, 2, 120)]
    every = parts[0].unionByName(parts[1]).cache()
    for n, part in enumerate(parts):
        before = index.segments()
        index.add(part)
        assert len(index.segments()) == n + 1 and set(before) < set(index.segments())  # only a segment more
    assert index.add(every) is None and len(index.segments()) == 2  # known documents are not added again
    assert same(index.search(q, 7), lexical.bm25(q, every, 7))
    got, want = (sorted(map(tuple, d.select("term", "tf", "df").collect())) for d in (index.term_stats(), lexical.term_stats(every)))
    assert got == want
    assert index.merge(2) and [s.docs for s in index.segments()] == [220] and not index.merge(2)
    index.sweep()
    assert same(index.search(q, 1000), lexical.bm25(q, every, 1000))


def test_postings_leave_blocks_unread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 32)
    monkeypatch.setattr(postings, "FIRST", 2)
    index = postings.TextIndex(spark, f"{tmp_path}/i")
    rare = spark.createDataFrame([(1000 + k, "needle needle needle") for k in range(5)], "doc_id long, text string")
    index.add(texts(spark, 600, 6).unionByName(rare))
    q = spark.createDataFrame([(1, "needle waa")], "question_id long, question string")
    seen = []
    whole = postings.TextIndex._scored
    monkeypatch.setattr(postings.TextIndex, "_scored", lambda self, live, *a: seen.append(live.count()) or whole(self, live, *a))
    assert same(index.search(q, 1), lexical.bm25(q, texts(spark, 600, 6).unionByName(rare), 1))
    segments = index.segments()
    terms, blocks = index._terms(q, segments)
    assert sum(seen) < index.bounds(terms, blocks, 50.0, 1.5, 0.75).count() / 2


def cosines(q, v):
    return q @ v.T / ((np.linalg.norm(q, axis=1) + 1e-8)[:, None] * (np.linalg.norm(v, axis=1) + 1e-8)[None, :])


@pytest.mark.parametrize("n", [500, 4000])
def test_vector_index_recall(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(ivf, "SLICE", 40)
    monkeypatch.setattr(ivf, "PACK", 30)
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 64))
    table = spark.createDataFrame([(k, [float(c) for c in row]) for k, row in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    index = ivf.VectorIndex(spark, f"{tmp_path}/v")
    coder = index.train(table)
    index.add(table)
    asked = [k for k in range(0, n, 20)][:100]
    q = table.where(F.col("vec_id").isin(asked)).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q"))
    s = cosines(v[asked], v)
    s[np.arange(len(asked)), asked] = -1
    true = {a: set(np.argsort(-row)[:20].tolist()) for a, row in zip(asked, s)}
    found: dict = {}
    for r in index.search(q, 20, exclude_self=True).collect():
        found.setdefault(r.question_id, {})[r.vec_id] = r.score
    assert sum(len(true[a] & set(found[a])) for a in asked) / (20 * len(asked)) >= 0.9
    assert all(abs(score - s[asked.index(a), b]) < 1e-12 for a, own in found.items() for b, score in own.items())
    whole: dict = {}
    for r in index.search(q, 20, probe=len(coder.centres), exclude_self=True, rerank=200).collect():
        whole.setdefault(r.question_id, set()).add(r.vec_id)
    assert whole == true


def test_vector_index_versions(spark, tmp_path):
    rows = [(f"v{k}", [float(k % 5 + 1), float(k % 7), 1.0]) for k in range(60)] + [("zero", [0.0, 0.0, 0.0]), ("null", None), ("odd", [1.0]), ("nan", [float("nan"), 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    index = ivf.VectorIndex(spark, f"{tmp_path}/v")
    index.train(table)
    index.add(table)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "question_id long, q array<double>")
    all_lists = {"probe": 1000, "rerank": 100}
    ids = lambda k=100: [r.vec_id for r in index.search(q, k, **all_lists).orderBy("rank").collect()]
    assert set(ids()) == {f"v{k}" for k in range(60)}
    index.delete(spark.createDataFrame([("v0",), ("v1",)], "vec_id string"))
    assert set(ids()) == {f"v{k}" for k in range(2, 60)}
    index.add(spark.createDataFrame([("v1", [9.0, 0.0, 0.0]), ("v2", [-1.0, 0.0, 0.0]), ("new", [8.0, 0.1, 0.0])], "vec_id string, embedding array<double>"))
    assert ids(2) == ["v1", "new"] and ids()[-1] == "v2" and len(ids()) == 60
    index.compact()
    assert ids(2) == ["v1", "new"] and len(ids()) == 60 and index.rows().count() == 60


def test_dense_blocks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(dense, "ITEMS", 50)
    monkeypatch.setattr(dense, "QUESTIONS", 7)
    rng = np.random.default_rng(3)
    v = np.round(rng.standard_normal((200, 6)), 1)
    v[100:140] = v[:40]  # ties
    table = spark.createDataFrame([(k, [float(c) for c in row]) for k, row in enumerate(v)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 6)], "vec_id long, embedding array<double>")
    q = table.where("vec_id % 9 = 0 AND vec_id < 200").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q"))
    s = np.round(cosines(v, v), 9)
    for own in (True, False):
        got: dict = {}
        for r in dense.topk(q, table, 5, exclude_self=own).orderBy("question_id", "rank").collect():
            got.setdefault(r.question_id, []).append(r.vec_id)
        assert got == {a: [b for b in np.lexsort((np.arange(200), -s[a])).tolist() if b != a or not own][:5] for a in range(0, 200, 9)}


def test_best_of_own_candidates(spark, monkeypatch):
    monkeypatch.setattr(engines, "ITEMS", 30)
    monkeypatch.setattr(engines, "QUESTIONS", 3)
    rng = np.random.default_rng(4)
    v, q = np.round(rng.standard_normal((90, 4)), 1), rng.standard_normal((8, 4))
    items = spark.createDataFrame([(f"i{k}", [float(c) for c in r]) for k, r in enumerate(v)], "chunk_id string, vec array<double>")
    asked = spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(q)], "question_id long, q array<double>")
    pairs = [(a, b) for a in range(8) for b in range(90) if (a * b) % 3 == 0 and a != 7]
    s = np.round(cosines(q, v), 9)
    got: dict = {}
    best = engines.best_of(spark.createDataFrame([(a, f"i{b}") for a, b in pairs] + [(3, "unknown")], "question_id long, chunk_id string"), items, asked, "chunk_id", 4)
    for r in engines._ranked(best, ["chunk_id"], 4).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.chunk_id)
    want = {a: [f"i{b}" for b in sorted((b for x, b in pairs if x == a), key=lambda b: (-s[a, b], f"i{b}"))[:4]] for a in range(7)}
    assert got == want


def test_keyed_table(spark, tmp_path):
    t = keyed.Keyed(spark, f"{tmp_path}/k", buckets=4, keep=3)
    rows = lambda *r: spark.createDataFrame(list(r), "key string, payload string")
    get = lambda *k: {r.key: r.payload for r in t.get(spark.createDataFrame([(x,) for x in k], "key string")).collect()}
    assert get("a") == {}
    t.put(rows(("a", "1"), ("b", "1")))
    t.put(rows(("a", "2"), ("c", "1")))
    assert get("a", "b", "c", "d") == {"a": "2", "b": "1", "c": "1"}
    t.put(rows(("d", "1")))
    t.compact()
    assert get("a", "b", "c", "d") == {"a": "2", "c": "1", "d": "1"}  # the three latest
    t.put(rows(("b", "3")))
    assert get("b") == {"b": "3"}
