"""Queries over whole tables, against brute force over every row."""

import tempfile

import numpy as np
import pandas as pd
import pytest

from quaestor.operators import community, resolve
from quaestor.plans import catalog

DIR = "/root/testdata/sf0.001"


def run(spark, name, d=DIR):
    return catalog.queries()[name](spark, str(d)).toPandas()


def read(name):
    return pd.read_parquet(f"{DIR}/{name}.parquet")


def test_orders_of_parts_are_all_counted(spark):
    li = read("lineitem")
    k = li.groupby("l_partkey").l_orderkey.nunique()
    got = run(spark, "shared_entities")
    assert dict(zip(got.node, got.n_docs)) == dict(k[k >= 2])
    f = run(spark, "corpus_features").iloc[0]
    assert (f.n_docs, f.shared) == (li.l_orderkey.nunique(), (k >= 2).sum())
    assert (f.cross_doc_fraction, f.recurrence, f.num_docs) == (round((k >= 2).mean(), 6), min(k.max() / 10, 1), min(li.l_orderkey.nunique() / 10, 1))
    assert all(r.startswith(f"{(k >= 2).sum()} shared entities") for r in run(spark, "corpus_verdict").reason)


def test_bootstraps_weigh_every_row(spark):
    import math

    e = read("events").sort_values("event_id")
    k, prime = e.event_id.to_numpy().astype(np.int64), 2**31 - 1

    def counts(b):
        x = (b * 7919 + k % prime * 104729 + 12345) % prime
        for shift, factor in ((15, 48271), (13, 69621), (16, 16807)):
            x = (x ^ (x >> shift)) * factor % prime
        return sum((x > int(prime * sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)))).astype(int) for i in range(10))

    w = np.stack([counts(b) for b in range(10_000)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.1
    for name, x in (("bootstrap_ci", e.value / 100), ("paired_bootstrap", e.value / 100 - e.user_id % 10 / 10)):
        m = (w @ x.to_numpy()) / w.sum(axis=1)
        got = run(spark, name).iloc[0]
        assert (got.n, got["mean"]) == (len(e), pytest.approx(x.mean(), abs=1e-6))
        assert [got.lo, got.hi] == pytest.approx(np.quantile(m, [0.025, 0.975]), abs=2e-6)
        normal = 2 * 1.96 * x.std() / len(e) ** 0.5
        assert 0.85 * normal < got.hi - got.lo < 1.15 * normal


def test_evidence_of_every_event(spark):
    e, b = read("events"), read("benchmark").set_index("item_id").text
    more = pd.concat([e, e.assign(event_id=e.event_id + len(e))])  # the old cut was at 1,000, the rows of this table
    want = {i: len(b[u % 60]) + 1 + len(b[i % 30]) for i, u in zip(more.event_id, more.user_id, strict=True) if u % 60 in b.index}
    assert max(want) >= 1000
    with tempfile.TemporaryDirectory() as d:
        more.to_parquet(f"{d}/events.parquet")
        read("benchmark").to_parquet(f"{d}/benchmark.parquet")
        got = run(spark, "evidence_resolved", d)
    assert dict(zip(got.question_id, got.chars, strict=True)) == want


def test_filings_of_every_customer(spark):
    o, li = read("orders"), read("lineitem")
    o = pd.concat([o, o.assign(o_custkey=o.o_custkey + 1000)])
    li = li[li.l_linenumber % 3 < 2].assign(other=li.l_linenumber % 3 != 0, url=li.l_orderkey.astype(str) + "/" + li.l_linenumber.astype(str))
    best = li.sort_values(["other", "url"]).groupby("l_orderkey").url.first()
    fit = o[(o.o_orderstatus == "F") & (o.o_orderkey % 2 == 0) & o.o_orderkey.isin(best.index)].sort_values("o_orderkey")
    fit = fit.groupby("o_custkey").head(2)
    want = {(f"T{c}", str(k), best[k]) for c, k in zip(fit.o_custkey, fit.o_orderkey, strict=True)}
    with tempfile.TemporaryDirectory() as d:
        o.to_parquet(f"{d}/orders.parquet")
        read("lineitem").to_parquet(f"{d}/lineitem.parquet")
        got = run(spark, "edgar_selection", d)
    assert set(zip(got.ticker, got.accessionNumber, got.url, strict=True)) == want


def test_every_question_has_evidence_and_an_answer(spark):
    want = set(read("benchmark").item_id)
    got = run(spark, "engine_evidence")
    assert all(set(g.question_id) == want for _, g in got.groupby("engine")) and got.engine.nunique() == 3
    assert set(run(spark, "answers").question_id) == want


def test_every_part_is_resolved(spark):
    import re
    from difflib import SequenceMatcher

    p = read("part")
    p = pd.concat([p, p.assign(p_partkey=p.p_partkey + 1001, p_type=p.p_type + "s")]).sort_values("p_partkey")
    known, canonical, want = {}, [], {}
    for k, kind in zip(p.p_partkey, p.p_type, strict=True):
        name = kind + ("", ", Inc.", " Corp", " q1", " 2025")[k % 5]
        form, numbers = re.sub(resolve._SUFFIX, "", name).lower(), set(re.findall(r"[0-9]+|q[1-4]", name.lower()))
        if name.lower() not in known:
            near = [] if k % 11 == 0 else [(SequenceMatcher(None, f, form).ratio(), -n, c) for n, (f, c, other) in enumerate(canonical) if other == numbers]
            best = max(near, default=(0, 0, None))
            known[name.lower()] = best[2] if best[0] >= 0.92 else name
            if best[0] < 0.92:
                canonical.append((form, name, numbers))
        want[k] = known[name.lower()]
    with tempfile.TemporaryDirectory() as d:
        p.to_parquet(f"{d}/part.parquet")
        got = run(spark, "entity_resolution", d)
    assert len(got) == len(p) and dict(zip(got.ord, got.canonical, strict=True)) == want


def test_all_lines_link_nations(spark):
    e = read("lineitem").merge(read("orders"), left_on="l_orderkey", right_on="o_orderkey").merge(read("customer"), left_on="o_custkey", right_on="c_custkey").merge(read("supplier"), left_on="l_suppkey", right_on="s_suppkey")
    n = e[["c_nationkey", "s_nationkey"]].astype(int)
    w = n.assign(u=n.min(axis=1).astype(str), v=n.max(axis=1).astype(str)).groupby(["u", "v"]).size()
    got = run(spark, "communities")
    where = dict(zip(got.node, got.community, strict=True))
    assert got.modularity.iloc[0] == pytest.approx(community.quality([(u, v, float(x)) for (u, v), x in w.items()], where), abs=1e-9)


def test_phrases_reach_the_end_of_texts(spark):
    import re

    text = "\n".join(f"w{k}a b {k} c 7.5 up q3 fy2024" for k in range(8)) + "\n\nup"
    want, literal = [], 0
    for n, line in enumerate(text.split("\n")):
        w = line.split(" ")
        for k in range(0, len(w), 3):
            s = " ".join(w[k : k + 3])
            want.append((n, ",".join(sorted(set(re.findall(r"[0-9]+(?:\.[0-9]+)?|\b[qh][1-4]\b|\bfy[0-9]*\b", s))))))
            literal += s == "up" or bool(re.search("[0-9]", s))
    with tempfile.TemporaryDirectory() as d:
        spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
        got, counts = run(spark, "number_key", d), run(spark, "literal_filter", d)
    assert sorted(zip(got.line, got.numbers, strict=True)) == sorted(want)
    assert dict(zip(counts.literal, counts.n, strict=True)) == {True: literal, False: len(want) - literal}
