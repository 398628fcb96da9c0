"""Gold that many questions share, and the bandit in slices, equal the plain way."""

import random

from quaestor.operators import evaluation
from quaestor.plans import catalog
from quaestor.streaming import streams

DIR = "/root/testdata/sf0.001"


def test_shared_gold(spark):
    rng = random.Random(3)
    df = lambda rows, s: spark.createDataFrame(rows, s)
    asked = [(q, rng.choice("abc") if q else None) for q in range(20)]
    sets = [(rng.choice("ab"), rng.randint(0, 30)) for _ in range(40)] + [("c", 1)]
    without = [(q, d) for q, g in asked for s, d in sets if s == g and rng.random() < (1 if g == "c" else 0.3)]
    ranked = [(q, r, rng.randint(0, 30)) for q in range(20) for r in range(1, 6)]
    gold = [(q, d) for q, g in asked for s, d in sets if s == g and (q, d) not in without]
    r = df(ranked, "question_id int, rank long, doc_id int")
    got = evaluation.shared_scores(r, df(asked, "question_id int, set string"), df(sets, "set string, doc_id int"), df(without, "question_id int, doc_id int"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, evaluation.ranking_scores(r, df(gold, "question_id int, doc_id int")).collect()))


def test_bandit_in_slices(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, catalog.ALL["online_bandit"][0](spark, DIR).collect()))
    whole = rows()
    monkeypatch.setattr(streams, "OUT", 7)
    assert rows() == whole and len(whole) == 1000
