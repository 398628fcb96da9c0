"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, bands, and verification of the multiset overlap.

A text is the multiset of its five-word shingles (words as in the contracts, A-Z in lower case; a shorter text is one
shingle). The signature follows BagMinHash: weights are discretised to whole numbers; for each shingle there are Poisson
processes over the dyadic weight intervals (0,1], (1,2], (2,4], (4,8], ..., a hierarchy of which a weight opens as many
levels as it reaches; each point has a time, a component and a place in its interval, drawn at once (splitting the interval
in halves step by step has the same law); a weight takes the points below it; a component's value is its earliest point. A
point's time is summed up in the same order whatever else is drawn with it. A process stops where no component can get earlier, so that a text costs its distinct shingles and a constant.

Texts of equal words collapse to one node first. Nodes that share a band (ROWS components) are candidates: first each
with the band's most central node; verified links give components; then candidates in different components. Two exact
bounds come before texts are compared: sizes, and parity sketches (each shingle flips one of 1024 bits, so that two texts'
sketches differ in no more bits than the texts in shingles). A link is a pair whose overlap (sum of the smaller
counts over the sum of the larger) is THRESHOLD or more. BANDS bands miss a pair at the threshold with probability 5e-5.

Texts are read where they lie: rows are known by file and place, and only texts of candidates leave the scan. Buckets,
texts and nodes with very many rows meet what is joined to them by broadcast (`spread_join`) or in pieces of TOGETHER.

Defined results: null texts count as empty; texts without words are one class; rows that repeat are in one class; a null
id is larger than others; an empty table gives an empty result; columns other than doc_id and text are left out. class_id: smallest id of the class; kept: the id is it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACE, cut, discard, give_back, located, mix, only, packs, read, spread, spread_join, with_marks, word_hashes
from .components import components

WORDS, THRESHOLD = 5, 0.8
COMPONENTS, BANDS, ROWS = 128, 25, 5
#: Longs of a parity sketch: 64 bits each.
SKETCH = 16
#: Points that are drawn at a time: what a worker's memory holds.
POINTS = 1 << 17
#: Pairs of one node that are compared in one task.
TOGETHER = 2048
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: np.ndarray, ends: np.ndarray, words: int = WORDS) -> tuple[list[np.ndarray], np.ndarray]:
    """Shingle hashes of each text, with repeats, and two hashes of each text's word sequence."""
    h, n = word_hashes(raw, ends)
    first = np.concatenate(([0], np.cumsum(n)))
    with np.errstate(over="ignore"):
        place = (np.arange(len(h)) - np.repeat(first[:-1], n)).astype(np.uint64)
        sums = np.zeros((2, len(h) + 1), np.uint64)
        np.cumsum(mix(h + place * GOLD), out=sums[0, 1:])
        np.cumsum(mix((h ^ GOLD) - place * np.uint64(0xD6E8FEB86659FD93)), out=sums[1, 1:])
        prints = mix(sums[:, first[1:]] - sums[:, first[:-1]] + n.astype(np.uint64))
        s = h[: max(0, len(h) - words + 1)].copy()
        for k in range(1, words):
            s = s * GOLD + h[k : len(h) - words + 1 + k]
        s = mix(s)
    out = [s[a : b - words + 1] if b - a >= words else prints[0, i : i + 1] if b > a else s[:0] for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True))]
    return out, prints


def _points(seed, size, j):
    """Waiting time (at rate 1 for a component), component and place of the j-th points of processes."""
    with np.errstate(over="ignore"):
        r = mix(seed + (j * np.uint64(2) + np.uint64(1)) * GOLD)
        q = mix(seed + (j * np.uint64(2) + np.uint64(2)) * GOLD)
    wait = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / size
    return wait, (q >> np.uint64(57)).astype(np.int64), (q & np.uint64((1 << 57) - 1)).astype(np.float64) * 2.0**-57


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """COMPONENTS earliest times of each bag (distinct shingles, counts); infinite for empty bags."""
    m = COMPONENTS
    out = np.full((len(bags), m), np.inf)
    todo = [i for i, (d, _) in enumerate(bags) if len(d)]
    reach = np.array([(math.log(m) + 5) / max(1, int(w.sum())) for _, w in bags])
    while todo:
        doc = np.repeat(np.arange(len(todo)), [len(bags[i][0]) for i in todo])
        d, w = np.concatenate([bags[i][0] for i in todo]), np.concatenate([bags[i][1] for i in todo]).astype(np.float64)
        until = reach[todo]
        h = np.full(len(todo) * m, np.inf)
        level, lower, size = 0, 0.0, 1.0
        while len(d):
            with np.errstate(over="ignore"):
                seed = mix(d + np.uint64(level) * np.uint64(0xD6E8FEB86659FD93))
            _run(h, doc, seed, w, until, lower, size)
            lower = lower + size if level == 0 else lower * 2
            size, level = lower, level + 1
            more = w > lower
            doc, d, w = doc[more], d[more], w[more]
        h = h.reshape(-1, m)
        done = h.max(axis=1) <= until
        for k in np.flatnonzero(done):
            out[todo[k]] = h[k]
        todo = [todo[k] for k in np.flatnonzero(~done)]
        reach[todo] *= 2
    return out


def _run(h, doc, seed, w, until, lower, size) -> None:
    """All points of the processes up to their texts' reach."""
    m = COMPONENTS
    t, j = np.zeros(len(seed)), 0
    while len(seed):
        step = 1 if j < 3 else max(1, min(64, POINTS // len(seed)))
        wait, component, u = _points(seed[:, None], size * m, np.arange(j, j + step, dtype=np.uint64)[None, :])
        at = np.cumsum(np.concatenate((t[:, None], wait), axis=1), axis=1)[:, 1:]  # in order: no chunk changes a sum
        ok = (at <= until[doc][:, None]) & (lower + np.floor(u * size) < w[:, None])
        row, col = np.nonzero(ok)
        np.minimum.at(h, doc[row] * m + component[row, col], at[row, col])
        alive = at[:, -1] <= until[doc]
        doc, seed, w, t, j = doc[alive], seed[alive], w[alive], at[alive, -1], j + step


def parities(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Parity sketch of each bag: a bit for each of 64 * SKETCH cells, flipped by each occurrence of each shingle."""
    n = 64 * SKETCH
    counts = np.concatenate([w for _, w in bags]) if bags else np.empty(0, np.int64)
    d = np.repeat(np.concatenate([d for d, _ in bags]) if bags else np.empty(0, np.uint64), counts)
    nth = np.arange(len(d)) - np.repeat(np.cumsum(counts) - counts, counts)
    doc = np.repeat(np.arange(len(bags)), [int(w.sum()) for _, w in bags])
    with np.errstate(over="ignore"):
        cell = (mix(d + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) % np.uint64(n)).astype(np.int64)
    odd = np.bincount(doc * n + cell, minlength=len(bags) * n) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, n), axis=1).view(np.int64)


def sketches(texts, keep):
    """Rows of the kept columns and (prints, size, parity sketch, bands) of an Arrow string array, pack by pack."""
    import pyarrow as pa

    for a, b, raw, ends in packs(texts, 2048, 1 << 19):
        lists, prints = shingles(raw, ends)
        bags = [np.unique(s, return_counts=True) for s in lists]
        h = bag_minhash(bags).view(np.uint64)
        with np.errstate(over="ignore"):
            key = np.zeros((len(lists), BANDS), np.uint64)
            for r in range(ROWS):
                key = mix(key * GOLD + h[:, r : BANDS * ROWS : ROWS])
            key = mix(key + np.arange(BANDS, dtype=np.uint64) * GOLD)
        sizes = [len(s) for s in lists]
        bands = [k if n else [] for k, n in zip(key.view(np.int64).tolist(), sizes, strict=True)]
        p, bits = prints.view(np.int64), parities(bags)
        yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in keep.values()], pa.array(p[0]), pa.array(p[1]), pa.array(sizes, pa.int64()), *[pa.array(bits[:, k]) for k in range(SKETCH)], pa.array(bands, pa.list_(pa.int64()))], [*keep, "p0", "p1", "n", *BITS, "bands"])


BITS = tuple(f"s{k}" for k in range(SKETCH))


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def signed(docs: DataFrame) -> DataFrame:
    """docs: located."""

    def run(batches):
        only("minhash", give_back)
        for b in batches:
            yield from sketches(b.column("text"), {k: b.column(k) for k in ("doc_id", *PLACE)})
        give_back()

    return spread(docs.select("doc_id", "text", *PLACE)).mapInArrow(run, f"doc_id {_id_type(docs)}, _file string, _row long, p0 long, p1 long, n long, {', '.join(f'{k} long' for k in BITS)}, bands array<long>")


def _bags(docs: DataFrame) -> DataFrame:
    """Each row's place, its text's distinct shingles and their counts, packed."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for x, y, raw, ends in packs(b.column("text"), 512):
                lists, _ = shingles(raw, ends)
                bags = [np.unique(s, return_counts=True) for s in lists]
                place = [b.column(k).slice(x, y - x) for k in PLACE]
                yield pa.RecordBatch.from_arrays([*place, pa.array([d.tobytes() for d, _ in bags], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in bags], pa.binary())], [*PLACE, "d", "c"])
        give_back()

    return docs.select("text", *PLACE).mapInArrow(run, "_file string, _row long, d binary, c binary")


def overlap(d0: bytes, c0: bytes, d1: bytes, c1: bytes) -> float:
    """Weighted Jaccard similarity of two packed bags."""
    x, y = np.frombuffer(d0, np.uint64), np.frombuffer(d1, np.uint64)
    m, n = np.frombuffer(c0, np.uint32).astype(np.int64), np.frombuffer(c1, np.uint32).astype(np.int64)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    common = int(np.minimum(m[same], n[at[same]]).sum())
    return common / (int(m.sum() + n.sum()) - common)


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose texts overlap enough."""
    need = cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes, "node").select("node", *PLACE))
    own = with_marks(docs, need.select(*PLACE, F.lit(1).alias("_mark"))).where("_mark > 0")
    bags = cut(_bags(own).join(need, list(PLACE)).select("node", "d", "c"))
    # A node of very many pairs is compared in pieces, each with a copy of its bag.
    sides = {}
    for side, other in ("ab", "ba"):
        n = cut(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")))
        pieces = F.ceil(F.col("n") / TOGETHER).cast("int")
        pairs = cut(spread_join(pairs, n, [side]).withColumn(f"piece_{side}", F.pmod(F.xxhash64(other), pieces).cast("int")).drop("n"))
        copies = n.select(F.col(side).alias("node"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias(f"piece_{side}"))
        k = 0 if side == "a" else 1
        sides[side] = bags.join(copies, "node").select(F.col("node").alias(side), f"piece_{side}", F.col("d").alias(f"d{k}"), F.col("c").alias(f"c{k}"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = [b.column(k) for k in ("d0", "c0", "d1", "c1")]
            keep = [overlap(*(v[i].as_py() for v in x)) >= threshold for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    p = pairs.join(sides["b"], ["b", "piece_b"]).join(sides["a"], ["a", "piece_a"])
    out = cut(p.select("a", "b", "d0", "c0", "d1", "c1").mapInArrow(run, "a long, b long"))
    discard(bags)
    return out


def _possible(a: str, b: str, threshold: float):
    """What every pair of similarity `threshold` fulfils: bounds by sizes and by parity sketches, both exact."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in BITS[1:]), F.bit_count(F.col(f"{a}.{BITS[0]}").bitwiseXOR(F.col(f"{b}.{BITS[0]}"))))
    return (x >= threshold * y) & (y >= threshold * x) & (apart <= (1 - threshold) / (1 + threshold) * (x + y) + 1e-6)


def _class(threshold: float):
    """Size classes: texts of possible pairs are in the same class or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("int")


def links(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (docs: located) with their prints; nodes; verified links between nodes, which connect all that candidates connect."""
    rows = cut(signed(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("noid"), "doc_id", *PLACE)).alias("r")
    one = rows.groupBy("p0", "p1").agg(first, F.count(F.lit(1)).alias("copies"), *[F.first(k).alias(k) for k in ("n", *BITS)])
    one = cut(one.select("p0", "p1", "copies", "n", *BITS, F.col("r.doc_id").alias("rep"), F.col("r._file").alias("_file"), F.col("r._row").alias("_row")).withColumn("node", F.monotonically_increasing_id()))
    in_band = cut(rows.where("size(bands) > 0").select(*PLACE, "bands").join(one.select(*PLACE, "node"), list(PLACE)).select("node", F.explode("bands").alias("bucket")))
    # A bucket's leader is its most central node: the one whose buckets are largest, as an original's among its copies.
    sizes = cut(in_band.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    in_band = cut(spread_join(in_band, sizes, ["bucket"], "k"))
    central = cut(in_band.groupBy("node").agg(F.sum("k").alias("central")))
    in_band = cut(in_band.drop("k").join(central, "node"))
    shared = in_band.groupBy("bucket").agg(F.max(F.struct("central", (-F.col("node")).alias("n"))).alias("m"), F.count(F.lit(1)).alias("k"))
    shared = cut(shared.select("bucket", (-F.col("m.n")).alias("leader"), "k"))
    in_band = cut(spread_join(in_band.drop("central"), shared, ["bucket"], "k").drop("k"))
    led = in_band.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    of = one.select("node", "n", *BITS)
    x, y = of.alias("x"), of.alias("y")
    # Leaders with very many members meet their sketches by broadcast.
    led = cut(led)
    n = led.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    lead = cut(n.join(of, n.a == of.node).drop("node").select("a", "members", F.struct("n", *BITS).alias("x")))
    led = spread_join(led, lead, ["a"], "members").join(y, F.col("b") == F.col("y.node"))
    led = cut(led.where(_possible("x", "y", threshold)).select("a", "b"))
    sure = verified(docs, one, led, threshold)
    # What is still apart in a bucket: rows that are not in its leading component, against the rest of the bucket.
    label = components(sure)
    now = cut(in_band.drop("leader").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    lead = cut(now.groupBy("bucket").agg(F.min("label").alias("lead"), F.max("label").alias("last"), F.count(F.lit(1)).alias("k")).where("lead <> last").drop("last"))
    mixed = cut(spread_join(now, lead, ["bucket"], "k").drop("k").join(of, "node").withColumn("class", _class(threshold)))
    x = mixed.where("label <> lead").withColumn("class", F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1))).alias("x")
    y = mixed.alias("y")
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.label") != F.col("y.label"))
    apart &= ((F.col("y.label") == F.col("y.lead")) | (F.col("x.node") < F.col("y.node"))) & _possible("x", "y", threshold)
    second = x.join(y, apart).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    second = cut(second.join(led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    if not second.isEmpty():
        sure = sure.unionByName(verified(docs, one, second, threshold))
    return rows.select("doc_id", *PLACE, "p0", "p1"), one.select("node", "p0", "p1", "copies", "rep", *PLACE), sure


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, class_id, class_size, kept.

    keep: of `_file`, `_row`, `stays`; where rows repeat an id, `kept` holds for all with the class's id, `stays` for one.
    """
    rows, nodes, sure = links(located(docs, "doc_id", "text"), threshold)
    label = components(sure)
    n = cut(nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    first = F.min(F.struct(F.col("rep").isNull().alias("noid"), F.col("rep").alias("class_id"), *PLACE)).alias("best")
    whole = cut(n.groupBy("label").agg(first, F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("members")))
    n = cut(spread_join(n, whole, ["label"], "members").select("p0", "p1", "copies", "best", "class_size"))
    out = spread_join(rows, n, ["p0", "p1"], "copies")
    stays = (F.col("_file") == F.col("best._file")) & (F.col("_row") == F.col("best._row"))
    out = out.select("doc_id", F.col("best.class_id").alias("class_id"), "class_size", F.col("doc_id").eqNullSafe(F.col("best.class_id")).alias("kept"), *PLACE, stays.alias("stays"))
    return out.select("doc_id", "class_id", "class_size", "kept", *keep)


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))
