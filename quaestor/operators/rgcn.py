"""A relational graph network over the knowledge graph: vectors of nodes that stand near each other in it.

Features are the embedded texts of the nodes. Two layers add to a node's own message those of its in-neighbours, summed for
each kind of relation and multiplied by that relation's weights; scores of links are DistMult. Weights are fitted by Adam on
all links, with two corrupted links for each, while all links pass messages; some links are held out for the AUC. Then every
node of the whole graph gets its vector by joins and sums, layer by layer.

Nodes fall into blocks by hash, and a link belongs to the block of its target. The first layer is linear in what is known from
the start, a node's features and their sums over its in-neighbours, so each block has that of its links' sources and computes their
first layer itself. An epoch exchanges the second layer's vectors of heads, and their gradients on the way back. Blocks follow from the
graph's size alone, and dropout and draws from nodes and chunks, so that the weights do not depend on the machines.

Defined results: below 4 nodes or 3 links there is no model (None); the AUC is null below HELD_FROM links; runs agree.
"""

from __future__ import annotations

import itertools
import math
import pickle
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions import models
from quaestor.functions import text as T
from quaestor.sources.tables import written

#: Fixed values of the model and its training.
DIM, LAYERS, EPOCHS, RATE, DROPOUT, CORRUPTED, HELD, HELD_FROM, DECAY = 48, 2, 120, 0.02, 0.1, 2, 0.15, 20, 1e-5
RELATIONS = (*(name for name, _ in T.PREDICATES), "other")
#: Of the fit: nodes and links up to which the driver does the steps of all blocks itself; links of a block over its blocks; nodes of a
#: block at least and at most; links of a chunk; rows that are added up at a time.
HERE, LINKS, SHARE, NODES, CHUNK, PIECE = 100_000, 1 << 14, 1024, 1 << 15, 1 << 16, 1 << 14
#: The kind of a node's link to itself; nodes of a block, whose sums a task holds; links that it adds up at a time.
OWN, BLOCK, STEP = -1, 200_000, 8192


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    auc: float | None
    loss: float
    held: int


def _relation(predicate: Column) -> Column:
    names = F.array(*[F.lit(r) for r in RELATIONS])
    return (F.array_position(names, T.predicate_bucket(F.coalesce(predicate, F.lit("")))) - 1).cast("int")


def features(nodes: DataFrame) -> DataFrame:
    """node, x: embedded `name (type): description`."""
    told = F.concat(F.col("node"), F.lit(" ("), F.coalesce("type", F.lit("Other")), F.lit("): "), F.coalesce("description", F.lit("")))
    return nodes.select("node", models.embed(told).alias("x"))


def links(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", _relation(F.col("predicate")).alias("rel"))


def start(inputs: int, seed: int = 42) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda n, m: rng.uniform(-1, 1, (n, m)) * np.sqrt(6 / (n + m))
    w = {"in": draw(inputs, DIM), "bias": np.zeros(DIM), "rel": draw(len(RELATIONS), DIM)}
    for k in range(LAYERS):
        w[f"self{k}"] = draw(DIM, DIM)
        w[f"by{k}"] = np.stack([draw(DIM, DIM) for _ in RELATIONS])
    return w


def forward(w: dict, x: np.ndarray, s: np.ndarray, r: np.ndarray, t: np.ndarray, masks: list | None = None):
    """All nodes' vectors, and what the way back needs."""
    h, kept = x @ w["in"] + w["bias"], []
    for k in range(LAYERS):
        sums = np.zeros((len(RELATIONS), *h.shape))
        np.add.at(sums, (r, t), h[s])
        z = h @ w[f"self{k}"] + np.einsum("rnd,rde->ne", sums, w[f"by{k}"])
        kept.append((h, sums, z > 0))
        h = np.maximum(z, 0) * (masks[k] if masks else 1)
    return h, kept


def gradients(w: dict, x, s, r, t, heads, rels, tails, y, masks):
    """Loss and gradients of the logistic loss over links (heads, rels, tails) with labels y, in memory: what blocks are held against."""
    h, kept = forward(w, x, s, r, t, masks)
    a, m, b = h[heads], w["rel"][rels], h[tails]
    score = (a * m * b).sum(axis=1)
    loss = np.mean(np.maximum(score, 0) - score * y + np.log1p(np.exp(-np.abs(score))))
    e = ((1 / (1 + np.exp(-np.clip(score, -60, 60))) - y) / len(y))[:, None]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    np.add.at(g["rel"], rels, e * a * b)
    back = np.zeros_like(h)
    np.add.at(back, heads, e * m * b)
    np.add.at(back, tails, e * m * a)
    for k in reversed(range(LAYERS)):
        before, sums, open_ = kept[k]
        z = back * masks[k] * open_
        g[f"self{k}"] = before.T @ z
        g[f"by{k}"] = np.einsum("rnd,ne->rde", sums, z)
        back = z @ w[f"self{k}"].T
        np.add.at(back, s, np.einsum("le,lde->ld", z[t], w[f"by{k}"][r]) if len(s) else np.zeros((0, DIM)))
    g["in"], g["bias"] = x.T @ back, back.sum(axis=0)
    return loss, g


def auc(up: np.ndarray, down: np.ndarray) -> float | None:
    """Share of pairs in order, by sums of ranks."""
    if not len(up) or not len(down):
        return None
    rank = np.argsort(np.argsort(np.concatenate((up, down)), kind="stable"), kind="stable")[: len(up)] + 1
    return float((rank.sum() - len(up) * (len(up) + 1) / 2) / (len(up) * len(down)))


def _runs(kinds: np.ndarray):
    """Each kind of a sorted array and where it stands."""
    for k in np.unique(kinds):
        yield int(k), slice(*np.searchsorted(kinds, (k, k + 1)))


def _add(out: np.ndarray, to: np.ndarray, values: np.ndarray, at: np.ndarray | None = None) -> None:
    """out[to] += values[at], where `to` repeats; a piece of rows at a time. Where few repeat, the first of each, then the second."""
    to = to.astype(np.uint16) if len(out) <= 1 << 16 else to  # is sorted by digits
    for a in range(0, len(to), PIECE):
        order = np.argsort(to[a : a + PIECE], kind="stable") + a
        t, order = to[order], order if at is None else at[order]
        new = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        size, k = np.diff(np.append(new, len(t))), 0
        if len(t) < 8 * len(new):
            rank, first, more = np.arange(len(t)) - np.repeat(new, size), new, size
            while k < 8 and len(first):
                out[t[first]] += values[order[first]]
                k += 1
                first, more = first[more > k] + 1, more[more > k]
            t, order = t[rank >= k], order[rank >= k]
            new = np.flatnonzero(np.concatenate((np.ones(min(len(t), 1), bool), t[1:] != t[:-1])))
        if len(t):
            out[t[new]] += np.add.reduceat(values[order], new, axis=0)


def kept(ids: np.ndarray, epoch: int, layer: int, seed: int) -> np.ndarray:
    """Dropout's factors of nodes. They follow from the node, so that all blocks that compute one agree. None in epoch 0."""
    if not epoch:
        return np.ones((len(ids), DIM), np.float32)
    z = np.asarray(ids).astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(DIM // 4, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    z += np.random.default_rng([seed, epoch, layer]).integers(0, 1 << 63, dtype=np.uint64)
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(by))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return (z.view(np.uint16).reshape(len(ids), DIM) >= int(DROPOUT * 65536)).astype(np.float32) / np.float32(1 - DROPOUT)


def drawn(c: int, seq: int, n: int, others: int, epoch: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For n corrupted links of a chunk: whether the head is swapped, and for which of the other block's nodes."""
    rng = np.random.default_rng([seed, epoch, c, seq])
    return rng.random(n) < 0.5, rng.integers(0, others, n)


def met(epoch: int, blocks: int, seed: int) -> int:
    """How many blocks further the nodes are that an epoch corrupts links with: blocks are dealt by hash, each is as likely."""
    return int(np.random.default_rng([seed, epoch]).integers(0, blocks))


def _first(f: tuple, n: int, p: dict) -> np.ndarray:
    """The first layer before its threshold. It is linear in what is known of a node from the start."""
    place, kind, m = f
    z = np.zeros((n, DIM), np.float32)
    for k, at in _runs(kind):
        z[place[at]] += m[at] @ p[k]
    return z


def _hidden(f: tuple, ids: np.ndarray, p: dict, epoch: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first layer's vectors, and the factors of the way back through its threshold and dropout."""
    z, mask = _first(f, len(ids), p), kept(ids, epoch, 0, seed)
    return np.maximum(z, 0) * mask, (z > 0) * mask


def _asked(c, inbox, own, chunks):
    """To the owners: which of their nodes a block has links from, and from where on it keeps them."""
    for x in chunks:
        at, block, place = x["lo"] + x["again"], x["ids"][x["again"] :] >> 32, x["ids"][x["again"] :] & 0xFFFFFFFF
        for b, part in _runs(block):
            yield b, (c, at + part.start, place[part].astype(np.int32))


def _told(c, inbox, own, chunks):
    yield c, {"x": own["x"], "out": sorted(inbox, key=lambda m: m[:2])}


def _given(c, inbox, own, chunks):
    for to, at, place in own["out"]:
        yield to, (at, own["x"][place])


def _known(c, inbox, own, chunks):
    """What is known of a block's nodes: their features with a one, and the sums of those of in-neighbours by relation."""
    n, sums, linked = len(own["x"]), {}, {}
    x = np.concatenate([v for _, v in sorted(inbox, key=lambda m: m[0])]) if inbox else own["x"][:0]
    wide = lambda v: np.concatenate((v, np.ones((len(v), 1), np.float32)), axis=1)
    for ch in chunks:
        mine = wide(x[ch["lo"] : ch["lo"] + len(ch["ids"])])
        for r, at in _runs(ch["rel"]):
            if r not in sums:
                sums[r], linked[r] = np.zeros((n, mine.shape[1]), np.float32), np.zeros(n, bool)
            _add(sums[r], ch["t"][at], mine, ch["s"][at])
            linked[r][ch["t"][at]] = True
    rows = [(np.arange(n), 0, wide(own["x"]))] + [(np.flatnonzero(linked[r]), r + 1, sums[r][linked[r]]) for r in sorted(sums)]
    f = np.concatenate([p for p, _, _ in rows]).astype(np.int32), np.repeat(np.array([k for _, k, _ in rows], np.int8), [len(p) for p, _, _ in rows]), np.concatenate([m for _, _, m in rows])
    yield c, {"f": f, "out": own["out"], "ids": (np.int64(c) << 32) + np.arange(n)}


def _lent(c, inbox, own, chunks):
    place, kind, m = own["f"]
    for to, at, wanted in own["out"]:
        row = np.full(len(own["ids"]), -1, np.int32)
        row[wanted] = np.arange(len(wanted))
        pick = row[place] >= 0
        yield to, (at, row[place[pick]] + at, kind[pick], m[pick])


def _joined(c, inbox, own, chunks):
    """Chunks of links with what is known of their sources."""
    inbox = sorted(inbox, key=lambda m: m[0])
    place, kind, m = (np.concatenate([x[k] for x in inbox]) for k in (1, 2, 3)) if inbox else (np.zeros(0, np.int32), np.zeros(0, np.int8), np.zeros((0, 1), np.float32))
    order = np.argsort(place, kind="stable")
    place, kind = place[order], kind[order]
    for ch in chunks:
        at = slice(*np.searchsorted(place, (ch["lo"], ch["lo"] + len(ch["ids"]))))
        by = np.argsort(kind[at], kind="stable")
        yield c, {**ch, "f": ((place[at] - ch["lo"])[by], kind[at][by], m[order[at][by]])}


def _layers(w, p, epoch, seed, ahead, blocks, c, inbox, own, chunks):
    """A block's vectors, sent where its nodes are heads of links or swapped in, and what of them is above the threshold."""
    h, _ = _hidden(own["f"], own["ids"], p, epoch, seed)
    z = h @ w["self1"]
    for ch in chunks:
        h, _ = _hidden(ch["f"], ch["ids"], p, epoch, seed)
        for r, at in _runs(ch["rel"]):
            _add(z, ch["t"][at], h @ w["by1"][r], ch["s"][at])
    h = np.maximum(z, 0) * kept(own["ids"], epoch, 1, seed)
    for to, at, place in own["out"]:
        yield to, ("head", c, at, h[place])
    yield c, ("tail", h, np.packbits(z > 0, axis=1))
    yield (c - ahead) % blocks, ("other", c, h)


def _arrived(inbox):
    heads = sorted((m[1:] for m in inbox if m[0] == "head"), key=lambda m: m[1])
    (_, t, above), (_, at, o) = next(m for m in inbox if m[0] == "tail"), next(m for m in inbox if m[0] == "other")
    return heads, np.concatenate([v for _, _, v in heads]) if heads else t[:0], t, o, at, above


def _fitted(a, b, i, j, y, m, total, to_a, to_b):
    """Loss of links from rows i of a to rows j of b, all of one kind and label; the gradients, but for the kind's weights m, are added to."""
    loss = 0.0
    for k in range(0, len(i), PIECE):
        i_, j_ = i[k : k + PIECE], j[k : k + PIECE]
        v, u = a[i_], b[j_]
        score = (v * u) @ m
        loss += float((np.maximum(score, 0) - score * y + np.log1p(np.exp(-np.abs(score)))).sum(dtype=np.float64)) / total
        e = (((1 / (1 + np.exp(-np.clip(score, -60, 60)))) - y) / np.float32(total))[:, None]
        u *= e
        v *= e
        _add(to_a, i_, u)
        _add(to_b, j_, v)
    return loss


def _scored(w, epoch, seed, total, c, inbox, own, chunks):
    """The loss over a block's links and their corrupted ones, and its gradients to where the vectors came from."""
    heads, h, t, o, at, above = _arrived(inbox)
    backs, g, loss = [np.zeros_like(v) for v in (h, t, o)], np.zeros((len(RELATIONS), DIM)), 0.0
    for ch in chunks:
        span, fit = slice(ch["lo"], ch["lo"] + len(ch["ids"])), ~ch["held"]
        src, dst, rel, mine = ch["s"][fit], ch["t"][fit], ch["rel"][fit], h[span]
        swap, other = (x.reshape(CORRUPTED, -1) for x in drawn(c, ch["seq"], len(src) * CORRUPTED, len(o), epoch, seed))
        for r, k in _runs(rel):
            m, (to_h, to_t, to_o) = w["rel"][r], [np.zeros_like(v) for v in (mine, t, o)]
            loss += _fitted(mine, t, src[k], dst[k], 1, m, total, to_h, to_t)
            for x, n in zip(swap[:, k], other[:, k], strict=True):
                loss += _fitted(o, t, n[x], dst[k][x], 0, m, total, to_o, to_t) + _fitted(mine, o, src[k][~x], n[~x], 0, m, total, to_h, to_o)
            for v, to, back in ((mine, to_h, backs[0][span]), (t, to_t, backs[1]), (o, to_o, backs[2])):
                g[r] += (v * to).sum(axis=0, dtype=np.float64) / 2  # both ends of a link have it
                back += to * m
    for b, first, v in heads:
        yield b, ("head", c, first, backs[0][first : first + len(v)])
    yield c, ("tail", backs[1], above, g, loss)
    yield at, ("other", backs[2])


def _learned(w, p, epoch, seed, c, inbox, own, chunks):
    """Loss and gradients of the weights from one block."""
    _, z, above, rel, loss = next(m for m in inbox if m[0] == "tail")
    z = z + next(m for m in inbox if m[0] == "other")[1]
    sent = {m[1:3]: m[3] for m in inbox if m[0] == "head"}
    for to, at, place in own["out"]:
        z[place] += sent[to, at]
    z = z * np.unpackbits(above, axis=1) * kept(own["ids"], epoch, 1, seed)
    g: dict = {"rel": rel}

    def first(f, ids, back, gate):
        place, kind, m = f
        back = back * gate
        for k, at in _runs(kind):
            g["p", k] = g.get(("p", k), 0) + (m[at].T @ back[place[at]]).astype(np.float64)

    h, gate = _hidden(own["f"], own["ids"], p, epoch, seed)
    g["self1"] = (h.T @ z).astype(np.float64)
    first(own["f"], own["ids"], z @ w["self1"].T, gate)
    for ch in chunks:
        h, gate = _hidden(ch["f"], ch["ids"], p, epoch, seed)
        back = np.zeros_like(h)
        for r, at in _runs(ch["rel"]):
            told = np.zeros_like(h)
            _add(told, ch["s"][at], z, ch["t"][at])
            g["by1", r] = g.get(("by1", r), 0) + (h.T @ told).astype(np.float64)
            back += told @ w["by1"][r].T
        first(ch["f"], ch["ids"], back, gate)
    yield c, (loss, g)


def _judged(w, seed, c, inbox, own, chunks):
    """Scores of the links held out, and of each with another tail."""
    _, h, t, o, _, _ = _arrived(inbox)
    for ch in chunks:
        held = np.flatnonzero(ch["held"])
        _, other = drawn(c, ch["seq"], len(held), len(o), 0, seed)
        a = h[ch["lo"] + ch["s"][held]] * w["rel"][ch["rel"][held]]
        yield c, tuple((a * v).sum(axis=1).astype(np.float64) for v in (t[ch["t"][held]], o[other]))


class _Here:
    """Blocks of a small graph, whose steps the driver does itself."""

    def __init__(self, blocks: int, own: DataFrame, chunks: DataFrame):
        self.blocks, self.own, self.chunks = blocks, {}, {}
        for r in own.collect():  # at most HERE nodes
            self.own[r.block] = pickle.loads(r.body)
        for r in chunks.collect():  # at most HERE links
            self.chunks.setdefault(r.block, []).append(pickle.loads(r.body))

    def take(self, f, inbox=None, bare=False) -> list:
        return [x for c in range(self.blocks) for _, x in self._of(f, c, inbox)]

    def _of(self, f, c, inbox):
        return f(c, inbox.get(c, []) if inbox else [], self.own[c], iter(self.chunks.get(c, [])))

    def run(self, f, inbox=None, bare=False) -> dict:
        out: dict = {}
        for c in range(self.blocks):
            for to, m in self._of(f, c, inbox):
                out.setdefault(to, []).append(m)
        return out

    def owned(self, f, inbox) -> None:
        self.own = {c: m[0] for c, m in self.run(f, inbox).items()}

    def chunked(self, f, inbox) -> None:
        self.chunks = self.run(f, inbox)

    def auc(self, f, inbox) -> float | None:
        return auc(*(np.concatenate(x) for x in zip(*self.take(f, inbox), strict=True)))

    def close(self) -> None:
        pass


def _block(c: int) -> int:
    return c


def _task(f):
    """f over a task's rows: messages, then the block's own row, then its chunks."""

    def run(c, rows):
        inbox, own, rows = [], None, iter(rows)
        for _, (tag, value) in rows:
            if tag == "chunk":
                rows = itertools.chain([(c, (tag, value))], rows)
                break
            if tag == "own":
                own = value
            else:
                inbox.append(value)
        if inbox or own:  # else no block's
            yield from f(c, inbox, own, (value for _, (_, value) in rows))

    return run


class _Spread:
    """Blocks of a graph, each a task's; what is fixed stays on the executors' disks, and messages are shuffled."""

    def __init__(self, blocks: int, own: DataFrame, chunks: DataFrame):
        rdd = lambda tag, df: df.rdd.map(lambda r: (r.block, (tag, pickle.loads(r.body)))).partitionBy(blocks, _block).persist(StorageLevel.DISK_ONLY)
        self.blocks, self.own, self.chunks = blocks, rdd("own", own), rdd("chunk", chunks)
        self.bare, self.spark, self.all = self.chunks, own.sparkSession, [self.own, self.chunks]

    def _rows(self, f, inbox, bare, stay=False):
        rows = self.bare if bare else self.own.union(self.chunks)
        rows = inbox.union(rows) if inbox is not None else rows
        assert rows.getNumPartitions() == self.bare.getNumPartitions()  # parts of like places were laid together
        return rows.mapPartitionsWithIndex(_task(f), preservesPartitioning=stay)

    def take(self, f, inbox=None, bare=False) -> list:
        return [x for _, x in self._rows(f, inbox, bare).collect()]  # sums of the weights' size, one for each block

    def run(self, f, inbox=None, bare=False):
        return self._rows(f, inbox, bare).map(lambda m: (m[0], ("message", m[1]))).partitionBy(self.blocks, _block)

    def _kept(self, tag, f, inbox):
        out = self._rows(f, inbox, False, True).mapValues(lambda v: (tag, v)).persist(StorageLevel.DISK_ONLY)
        self.all.append(out)
        return out

    def owned(self, f, inbox) -> None:
        self.own = self._kept("own", f, inbox)

    def chunked(self, f, inbox) -> None:
        self.chunks = self._kept("chunk", f, inbox)

    def auc(self, f, inbox) -> float | None:
        rows = self._rows(f, inbox, True).flatMap(lambda m: [(m[1][0].tolist(), True), (m[1][1].tolist(), False)])
        scores = self.spark.createDataFrame(rows, "scores array<double>, up boolean", verifySchema=False)
        return ordered_auc(written(scores.select(F.explode("scores").alias("score"), "up")))

    def close(self) -> None:
        for rdd in self.all:
            rdd.unpersist()


def _counted(batches):
    """ups, downs and pairs in order of one sorted part of the scores."""
    import pyarrow as pa

    ups, downs, pairs = 0, 0, 0
    for b in batches:
        up = np.asarray(b.column("up").cast("int8"), dtype=np.int64)
        pairs += int((up * (downs + np.cumsum(1 - up))).sum())
        ups, downs = ups + int(up.sum()), downs + int((1 - up).sum())
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), ups, downs, pairs)], ["part", "ups", "downs", "pairs"])


def ordered_auc(scores: DataFrame) -> float | None:
    """`auc` of score and up, by a sort over all executors."""
    parts = scores.orderBy("score", F.desc("up")).mapInArrow(_counted, "part long, ups long, downs long, pairs long").collect()  # a row for each part
    ups, downs, pairs = 0, 0, 0
    for r in sorted(parts):
        ups, pairs, downs = ups + r.ups, pairs + r.pairs + r.ups * downs, downs + r.downs
    return pairs / (ups * downs) if ups and downs else None


def _numbered(nodes: DataFrame, blocks: int) -> DataFrame:
    """node, block, place, x: blocks by hash, places by name."""

    def run(batches):
        import pyarrow as pa

        seen = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("block"), pa.array(np.arange(seen, seen + b.num_rows), pa.int32()), b.column("x").cast(pa.list_(pa.float32()))], ["node", "block", "place", "x"])
            seen += b.num_rows

    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    dealt = nodes.withColumn("block", block).repartitionById(blocks, "block").sortWithinPartitions("node")
    return features(dealt).withColumn("block", block).mapInArrow(run, "node string, block int, place int, x array<float>")


def _owned(numbered: DataFrame, blocks: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        parts = [(b.column("block")[0].as_py(), _matrix(b.column("x"))) for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([parts[0][0]], pa.int32()), pa.array([pickle.dumps({"x": np.concatenate([x for _, x in parts])})], pa.binary())], ["block", "body"])

    return numbered.repartitionById(blocks, "block").sortWithinPartitions("place").select("block", "x").mapInArrow(run, "block int, body binary")


def _chunks(placed: DataFrame, blocks: int, before: dict[int, int], total: int, seed: int) -> DataFrame:
    """block, body: the links of a block of targets by source, CHUNK at a time. Of all links, a share of HELD is held out."""
    size = CHUNK  # as it stands here, also on the executors

    def body(c, seq, at, lo, last, sb, sp, rel, t):
        ids, s = np.unique((sb.astype(np.int64) << 32) + sp, return_inverse=True)
        again, order, held = int(ids[0] == last), np.lexsort((t, rel)), np.zeros(len(t), bool)
        if total >= HELD_FROM:
            n = int((at + len(t)) * HELD) - int(at * HELD)
            held[np.random.default_rng([seed, 0, c, seq, 1]).permutation(len(t))[:n]] = True
        return {"seq": seq, "lo": lo - again, "again": again, "ids": ids, "s": s[order].astype(np.int32), "rel": rel[order].astype(np.int8), "t": t[order].astype(np.int32), "held": held[order]}

    def run(batches):
        import pyarrow as pa

        seq, lo, last, at, c, rest = 0, 0, -1, 0, None, None
        for b in itertools.chain((b for b in batches if b.num_rows), [None]):
            if b is not None:
                c = b.column("tb")[0].as_py()
                new = np.stack([np.asarray(b.column(k)) for k in ("sb", "sp", "rel", "tp")])
                rest = new if rest is None else np.concatenate((rest, new), axis=1)
            while rest is not None and rest.shape[1] >= (size if b is not None else 1):
                x = body(c, seq, before[c] + at, lo, last, *rest[:, :size])
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([pickle.dumps(x)], pa.binary())], ["block", "body"])
                seq, lo, last, at, rest = seq + 1, x["lo"] + len(x["ids"]), x["ids"][-1], at + len(x["t"]), rest[:, size:]

    return placed.repartitionById(blocks, "tb").sortWithinPartitions("sb", "sp", "rel", "tp").mapInArrow(run, "block int, body binary")


def _fixed(w: dict) -> tuple[dict, dict]:
    """Weights as they are sent, and the first layer's by what they meet: a node's own features (0), sums by relation."""
    inputs = np.concatenate((w["in"], w["bias"][None]))
    p = {0: inputs @ w["self0"], **{r + 1: inputs @ m for r, m in enumerate(w["by0"])}}
    return {k: w[k].astype(np.float32) for k in ("self1", "by1", "rel")}, {k: v.astype(np.float32) for k, v in p.items()}


def step(graph: _Here | _Spread, w: dict, epoch: int, total: int, seed: int = 42) -> tuple[float, dict]:
    """Loss and gradients of an epoch over all links; `total` counts those fitted with their corrupted ones."""
    ship, p = _fixed(w)
    said = graph.run(partial(_layers, ship, p, epoch, seed, met(epoch, graph.blocks, seed), graph.blocks))
    said = graph.run(partial(_scored, ship, epoch, seed, total), said, bare=True)
    loss, g = 0.0, {k: np.zeros_like(v) for k, v in w.items()}
    inputs, back = np.concatenate((w["in"], w["bias"][None])), np.zeros((len(w["in"]) + 1, DIM))
    for one, parts in graph.take(partial(_learned, ship, p, epoch, seed), said):
        loss += one
        for k, v in parts.items():
            if k in ("rel", "self1"):
                g[k] += v
            elif k[0] == "by1":
                g["by1"][k[1]] += v
            else:
                to, m = (g["self0"], w["self0"]) if k[1] == 0 else (g["by0"][k[1] - 1], w["by0"][k[1] - 1])
                to += inputs.T @ v
                back += v @ m.T
    g["in"], g["bias"] = back[:-1], back[-1]
    return loss, g


def graph(nodes: DataFrame, edges: DataFrame, seed: int = 42) -> tuple[_Here | _Spread, int] | None:
    """The graph in blocks and the number of its links; links whose ends are not both nodes do not count."""
    n, m = nodes.count(), edges.count()
    if n < 4 or m < 3:
        return None
    blocks = max(1, min(math.ceil(math.sqrt(m / LINKS)), n // SHARE), -(-n // NODES))
    numbered = written(_numbered(nodes, blocks))
    end = lambda a, b, p: numbered.select(F.col("node").alias(a), F.col("block").alias(b), F.col("place").alias(p)).hint("merge")
    placed = written(links(edges).join(end("src", "sb", "sp"), "src").join(end("dst", "tb", "tp"), "dst").select("sb", "sp", "rel", "tb", "tp"))
    counts, before, total = {r.tb: r["count"] for r in placed.groupBy("tb").count().collect()}, {}, 0  # a row for each block
    for c in range(blocks):
        before[c], total = total, total + counts.get(c, 0)
    if total < 3:
        return None
    where = _Here if max(n, total) <= HERE else _Spread
    out = where(blocks, _owned(numbered, blocks), _chunks(placed, blocks, before, total, seed))
    out.owned(_told, out.run(_asked))
    out.owned(_known, out.run(_given))
    out.chunked(_joined, out.run(_lent))
    return out, total


def trained(nodes: DataFrame, edges: DataFrame, epochs: int = EPOCHS, seed: int = 42) -> Model | None:
    """The model of all links. In each epoch every link is fitted once, with all links passing messages."""
    made = graph(nodes, edges, seed)
    if made is None:
        return None
    whole, links_ = made
    n_held = int(links_ * HELD) if links_ >= HELD_FROM else 0
    total = (links_ - n_held) * (1 + CORRUPTED)
    w = start(models.DIM, seed)
    first, second, loss = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0.0
    for epoch in range(1, epochs + 1):
        loss, g = step(whole, w, epoch, total, seed)
        for k in w:
            d = g[k] + DECAY * w[k]
            first[k], second[k] = 0.9 * first[k] + 0.1 * d, 0.999 * second[k] + 0.001 * d * d
            w[k] = w[k] - RATE * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
    area = None
    if n_held:
        ship, p = _fixed(w)
        area = whole.auc(partial(_judged, ship, seed), whole.run(partial(_layers, ship, p, 0, seed, met(0, whole.blocks, seed), whole.blocks)))
    whole.close()
    return Model(w, area, float(loss), n_held)


def packed(nodes: DataFrame, edges: DataFrame, blocks: int) -> DataFrame:
    """src, rel, block, dsts: a source's links of one kind to nodes of one block. Kind OWN is each node's link to itself."""

    def pack(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            if b.num_rows:
                keys = [b.column(c) for c in ("src", "rel", "block")]
                new = np.logical_or.reduce([np.asarray(pc.fill_null(pc.not_equal(c[1:], c[:-1]), True)) for c in keys])
                at = np.concatenate(([0], np.flatnonzero(new) + 1))
                dsts = pa.ListArray.from_arrays(pa.array(np.append(at, b.num_rows), pa.int32()), b.column("dst"))
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in keys], dsts], ["src", "rel", "block", "dsts"])

    own = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(OWN).alias("rel"))
    e = links(edges).unionByName(own).withColumn("block", F.pmod(F.xxhash64("dst"), F.lit(blocks)).cast("int"))
    return e.repartition("src").sortWithinPartitions("src", "rel", "block").mapInArrow(pack, "src string, rel int, block int, dsts array<string>")


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _lists(h: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * h.shape[1]), pa.array(h.ravel()))


def _said(weights: dict[int, np.ndarray]):
    """What a source tells a block's nodes: one vector for all its links of a kind."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                h, rel = _matrix(b.column("h")), np.asarray(b.column("rel"))
                v = np.empty_like(h)
                for r in np.unique(rel):
                    v[rel == r] = h[rel == r] @ weights[r]
                yield pa.RecordBatch.from_arrays([b.column("block"), b.column("rel"), b.column("dsts"), _lists(v)], ["block", "rel", "dsts", "v"])

    return run


def _summed(batches):
    """node, h of one block of nodes: the sums of what they are told, a step of links at a time."""
    import pyarrow as pa

    place: dict[str, int] = {}
    z, own = np.zeros((1024, DIM)), np.zeros(1024, bool)
    for b in batches:
        if not b.num_rows:
            continue
        names, v, rel = b.column("dsts"), _matrix(b.column("v")), np.asarray(b.column("rel"))
        row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(names.offsets)))
        to = np.array([place.setdefault(n, len(place)) for n in names.flatten().to_pylist()])
        if len(place) > len(z):
            more = max(len(place) - len(z), len(z))
            z, own = np.concatenate((z, np.zeros((more, DIM)))), np.concatenate((own, np.zeros(more, bool)))
        own[to[rel[row] == OWN]] = True
        for at in range(0, len(to), STEP):
            order = np.argsort(to[at : at + STEP], kind="stable") + at
            t = to[order]
            first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            z[t[first]] += np.add.reduceat(v[row[order]], first, axis=0)
    names = list(place)
    for at in range(0, len(names), STEP):
        keep = np.flatnonzero(own[: len(names)][at : at + STEP]) + at
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in keep], pa.string()), _lists(np.maximum(z[keep], 0))], ["node", "h"])


def vectors(nodes: DataFrame, edges: DataFrame, model: Model) -> DataFrame:
    """node, embedding of every node (nodes come once each).

    Nodes fall into blocks by hash. A source sends a block one vector for each kind of link, with the names of those it goes to,
    instead of one for each link; the block's task adds them up. Links are packed so once, for all layers.
    Vectors are larger than the files they are estimated by, so they are never broadcast.
    """
    w = model.weights

    def project(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("node"), _lists(_matrix(b.column("x")) @ w["in"] + w["bias"])], ["node", "h"])

    h = features(nodes).mapInArrow(project, "node string, h array<double>")
    blocks = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // BLOCK))
    e = written(packed(nodes, edges, blocks))
    for k in range(LAYERS):
        said = h.withColumnRenamed("node", "src").hint("merge").join(e, "src").select("block", "rel", "dsts", "h")
        said = said.mapInArrow(_said({OWN: w[f"self{k}"], **dict(enumerate(w[f"by{k}"]))}), "block int, rel int, dsts array<string>, v array<double>")
        h = said.repartitionById(blocks, "block").mapInArrow(_summed, "node string, h array<double>")
    return h.select("node", F.col("h").alias("embedding"))
