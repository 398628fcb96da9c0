"""The graph network is fitted on all links, in blocks that give what the network in memory gives."""

import numpy as np
import pytest

from quaestor.operators import rgcn
from quaestor.plans import knowledge


def _some(spark, n=120, m=700):
    rng = np.random.default_rng(5)
    names = [f"n{k}" for k in range(n)]
    pairs = [(0, k) for k in range(n)] + [(k, 7) for k in range(n)] * 2 + [tuple(x) for x in rng.integers(0, n - 10, (m, 2)).tolist()]
    edges = [(names[a], names[b], ("value", "expects", "sells")[k % 3]) for k, (a, b) in enumerate(pairs)]
    nodes = spark.createDataFrame([(x, "T", f"word{k % 9} word{k % 5}") for k, x in enumerate(names)], "node string, type string, description string")
    return nodes, spark.createDataFrame([*edges, ("n1", "gone", "sells"), ("lost", "n2", "sells")], "src string, dst string, predicate string"), len(edges)


def _small(monkeypatch, here):
    for k, v in {"HERE": here, "LINKS": 40, "SHARE": 20, "CHUNK": 61, "PIECE": 50}.items():
        monkeypatch.setattr(rgcn, k, v)


@pytest.mark.parametrize("here", [0, 10_000])
def test_an_epoch_of_blocks_is_one_of_the_whole_graph(spark, monkeypatch, here):
    _small(monkeypatch, here)
    nodes, edges, m = _some(spark)
    made, total = rgcn.graph(nodes, edges)
    n_blocks = made.blocks
    assert total == m and n_blocks > 4 and isinstance(made, rgcn._Spread if not here else rgcn._Here)
    own = {c: v["ids"] for c, v in enumerate(made.take(lambda c, inbox, own, chunks: [(c, own)]))}
    first = np.cumsum([0, *[len(own[c]) for c in range(n_blocks)]])
    ids = np.concatenate([own[c] for c in range(n_blocks)])
    number = lambda x: first[x >> 32] + (x & 0xFFFFFFFF)
    table = {r.node: (r.block, r.place, r.x) for r in rgcn._numbered(nodes, n_blocks).collect()}
    x = np.array([v for _, _, v in sorted(table.values())])
    epoch, shift, links, pos, neg, held = 3, rgcn.met(3, n_blocks, 42), [], [], [], 0
    for c, ch in made.take(lambda c, inbox, own, chunks: [(c, (c, ch)) for ch in chunks]):
        t = np.stack((number(ch["ids"][ch["s"]]), ch["rel"], first[c] + ch["t"]), axis=1)
        fitted, other = t[~ch["held"]], (c + shift) % n_blocks
        swap, k = rgcn.drawn(c, ch["seq"], len(fitted) * 2, len(own[other]), epoch, 42)
        bad = np.tile(fitted, (2, 1))
        bad[swap, 0], bad[~swap, 2] = first[other] + k[swap], first[other] + k[~swap]
        links, pos, neg, held = [*links, t], [*pos, fitted], [*neg, bad], held + int(ch["held"].sum())
    links, all_ = np.concatenate(links), np.concatenate(pos + neg)
    want = sorted((number((np.int64(table[r.src][0]) << 32) + table[r.src][1]), r.rel, number((np.int64(table[r.dst][0]) << 32) + table[r.dst][1])) for r in rgcn.links(edges).collect() if r.src in table and r.dst in table)
    assert sorted(map(tuple, links.tolist())) == [tuple(map(int, r)) for r in want] and held == int(total * rgcn.HELD)
    w = rgcn.start(rgcn.models.DIM)
    w["bias"] = np.random.default_rng(1).standard_normal(rgcn.DIM) / 10
    n = (total - held) * 3
    loss, g = rgcn.step(made, w, epoch, n)
    y = np.repeat([1.0, 0.0], [n // 3, n // 3 * 2])
    s, r, t = links.T
    told, real = rgcn.gradients(w, x, s, r, t, all_[:, 0], all_[:, 1], all_[:, 2], y, [rgcn.kept(ids, epoch, k, 42) for k in range(2)])
    assert loss == pytest.approx(told, rel=1e-4)
    for k in w:
        assert np.abs(g[k] - real[k]).max() <= 1e-3 * max(np.abs(real[k]).max(), 1e-9), k
    made.close()


def test_machines_do_not_decide_the_weights(spark, monkeypatch):
    nodes, edges, m = _some(spark)
    fits = []
    for here in (0, 10_000):
        _small(monkeypatch, here)
        fits.append(rgcn.trained(nodes, edges, epochs=6))
    assert all(np.allclose(fits[0].weights[k], fits[1].weights[k], atol=1e-3) for k in fits[0].weights)
    assert fits[0].held == fits[1].held == int(m * rgcn.HELD) and fits[0].auc == pytest.approx(fits[1].auc, abs=0.02)
    again = rgcn.trained(nodes, edges, epochs=6)
    assert all((again.weights[k] == fits[1].weights[k]).all() for k in again.weights) and again.auc == fits[1].auc


def test_dropout_and_draws():
    mask = rgcn.kept(np.arange(4000), 2, 1, 42)
    assert abs((mask == 0).mean() - rgcn.DROPOUT) < 0.005 and abs(mask.mean() - 1) < 0.01
    assert (mask[7:9] == rgcn.kept(np.array([7, 8]), 2, 1, 42)).all() and (mask != rgcn.kept(np.arange(4000), 3, 1, 42)).any()
    assert {rgcn.met(e, 4, 42) for e in range(1, 40)} == {0, 1, 2, 3}


def test_auc_of_sorted_parts(spark):
    rng = np.random.default_rng(2)
    up, down = rng.integers(2, 12, 300) / 4, rng.integers(0, 9, 200) / 4
    df = spark.createDataFrame([(float(v), True) for v in up] + [(float(v), False) for v in down], "score double, up boolean").repartition(5)
    assert rgcn.ordered_auc(df) == pytest.approx(rgcn.auc(up, down)) and rgcn.ordered_auc(df.where("up")) is None


def test_query_fits_all_links(spark, monkeypatch):
    d, seen, real = "/root/testdata/sf0.01", [], rgcn.vectors
    monkeypatch.setattr(rgcn, "vectors", lambda nodes, edges, model: seen.append(model) or real(nodes, edges, model))
    rows = knowledge.rgcn_vectors(spark, d).count()
    pairs = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct()
    assert seen[0].held == int(pairs.count() * rgcn.HELD) > 2000 * rgcn.HELD and rows > 0
