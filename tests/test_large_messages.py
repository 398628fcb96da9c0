"""A source tells a block of nodes one vector for all its links of a kind, and sums equal the network in memory."""

import numpy as np

from quaestor.operators import rgcn


def test_messages_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(rgcn, "BLOCK", 40)
    monkeypatch.setattr(rgcn, "STEP", 50)
    rng = np.random.default_rng(3)
    names = [f"n{k}" for k in range(200)]
    pairs = [(0, k) for k in range(200)] * 2 + [(k, 7) for k in range(200)] + [tuple(x) for x in rng.integers(0, 200, (300, 2))]
    edges = spark.createDataFrame([(names[a], names[b], ("value", "expects", "other")[k % 3]) for k, (a, b) in enumerate(pairs)] + [("n1", "gone", "other"), ("lost", "n2", "other")], "src string, dst string, predicate string")
    nodes = spark.createDataFrame([(n, "T", f"word{k % 9}") for k, n in enumerate(names)], "node string, type string, description string")
    w = rgcn.start(rgcn.models.DIM)
    hub = rgcn.packed(nodes, edges, 5).where("src = 'n0'").collect()
    assert sum(len(r.dsts) for r in hub) > 400 and len(hub) <= 3 * 5 + 1  # not a row for each link
    got = {r.node: r.embedding for r in rgcn.vectors(nodes, edges, rgcn.Model(w, None, 0.0, 0)).collect()}
    x = {r.node: r.x for r in rgcn.features(nodes).collect()}
    e = [(names.index(r.src), r.rel, names.index(r.dst)) for r in rgcn.links(edges).collect() if {r.src, r.dst} <= set(names)]
    want, _ = rgcn.forward(w, np.array([x[n] for n in names]), *np.array(e).T)
    assert set(got) == set(names) and np.allclose([got[n] for n in names], want)
