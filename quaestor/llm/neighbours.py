"""Nearest neighbours along shifted space-filling curves.

Vectors are projected to AXES random directions and quantised; each of CURVES curves shifts the cells and orders them by
their Hilbert key. Spark range-partitions and sorts the keys; a vector's place in the order gives its block. A query is
held against its own block and the blocks beside it on each curve, and the windows' results are merged and reranked on
the original vectors.

On vectors without low-dimensional structure neighbours on a curve are few of the true ones, so an exact check follows:
the query set against all rows, in blocks of the first curve. A block's centre, radius and the query's worst result so far
tell whether it can hold anything better; where it can, it is searched. The result is exact whatever the windows found.

Defined results: ids are whole numbers of any width (others are refused); vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids
or vectors of another than the most frequent length; rows that repeat an id count once (the smallest vector); ties go to
the smaller id; queries without candidates have no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, own_columns, read

AXES, BITS, CURVES = 8, 7, 3
BLOCK, GROUP, QUERIES, TILE = 1024, 8192, 8192, 1024


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of integer coordinates below 2**bits; dimensions * bits must fit 63 bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    # From axes to the transposed index: undo the excess rotations from the top bit down, then Gray decode.
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(flip, x[0] ^ (q - 1), x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, seed: int = 5) -> np.ndarray:
    """CURVES keys for each vector."""
    dim = vectors.shape[1]
    rng = np.random.default_rng(seed)
    axes, shifts = rng.standard_normal((dim, AXES)), rng.random((CURVES, AXES))
    z = vectors @ axes / np.linalg.norm(vectors, axis=1, keepdims=True)  # about standard normal
    u = 1 / (1 + np.exp(-1.7 * z))
    return np.stack([hilbert_keys(((u + s) * (1 << (BITS - 1))).astype(np.int64)) for s in shifts], axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>): one row for each id."""
    if vectors.schema["vec_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("vec_id must be whole numbers: the queries are those divisible by 20")
    d = own_columns(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    d = d.where(fine)
    d = d.groupBy("vec_id").agg(F.min("v").alias("v"))
    return cut(d)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def best(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
    """The k best rows for each query, at least as good as `floor`: index of the query, id, score."""
    out_q, out_id, out_s = [], [], []
    for a in range(0, len(queries), TILE):
        q, own = queries[a : a + TILE], ids[a : a + TILE]
        s = q @ rows.T
        s[own[:, None] == row_ids[None, :]] = -np.inf
        # Products of a block can differ in the last bits from those of single rows: take a little more, then be exact.
        slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(rows, axis=1).max()
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(q), -np.inf)
        if floor is not None:
            least = np.maximum(least, floor[a : a + TILE])
        hit = (s >= (least - slack)[:, None]) & (s > -np.inf)
        for i in np.flatnonzero(hit.any(axis=1)):
            j = np.flatnonzero(hit[i])
            exact = (rows[j] * q[i]).sum(axis=1)
            o = np.lexsort((row_ids[j], -exact))[:k]
            out_q.append(np.full(len(o), a + i))
            out_id.append(row_ids[j][o])
            out_s.append(exact[o])
    cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return cat(out_q, np.int64), cat(out_id, np.int64), cat(out_s, np.float64)


FOUND = "query_id long, vec_id long, score double"


def _table(query_ids, ids, scores):
    import pyarrow as pa

    return pa.table({"query_id": pa.array(query_ids, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})


def ordered(vectors: DataFrame) -> DataFrame:
    """vec_id, v, curve, place, block: each vector once for each curve, with its place in the curves' order."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            keys = curve_keys(_matrix(b.column("v")))
            for c in range(CURVES):
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(np.full(b.num_rows, c), pa.int32()), pa.array(keys[:, c], pa.int64())], ["vec_id", "v", "curve", "key"])

    keyed = vectors.mapInArrow(run, "vec_id long, v array<double>, curve int, key long").withColumn("tie", F.xxhash64("vec_id"))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.repartitionByRange(n, "curve", "key", "tie").sortWithinPartitions("curve", "key", "tie")
    keyed = cut(keyed.withColumn("at", F.monotonically_increasing_id()).drop("key", "tie"))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = keyed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = cut(sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before")))
    out = keyed.withColumn("part", part).join(before, "part").withColumn("place", row + F.col("before"))
    return cut(out.select("vec_id", "v", "curve", "place", F.expr(f"place div {BLOCK}").alias("block")))


def in_windows(curves: DataFrame, k: int) -> DataFrame:
    """The best of each query's windows: query_id, vec_id, score."""

    def run(table):
        q = np.asarray(table.column("q"))
        v, ids, curve = _matrix(table.column("v")), np.asarray(table.column("vec_id")), np.asarray(table.column("curve"))
        parts = []
        for c in np.unique(curve):  # a block may hold the end of one curve and the start of the next
            x, y = q & (curve == c), ~q & (curve == c)
            if x.any() and y.any():
                i, found, s = best(v[x], ids[x], v[y], ids[y], k)
                parts.append((ids[x][i], found, s))
        return _table(*(np.concatenate([p[n] for p in parts]) if parts else [] for n in range(3)))

    rows = curves.select("block", F.lit(False).alias("q"), "vec_id", "curve", "v")
    asked = curves.where("vec_id % 20 = 0").select(F.explode(F.sequence(F.col("block") - 1, F.col("block") + 1)).alias("block"), F.lit(True).alias("q"), "vec_id", "curve", "v")
    return rows.unionByName(asked).groupBy("block").applyInArrow(run, FOUND)


def merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def completed(curves: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """What beats or joins a query's results so far: all queries against all rows, in groups of blocks."""
    base = curves.where("curve = 0")
    floor = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    asked = base.where("vec_id % 20 = 0").join(floor, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    asked = cut(asked)
    groups = base.agg(F.max("block")).first()[0]
    groups = 0 if groups is None else groups // (GROUP // BLOCK) + 1
    packs = max(1, -(-asked.count() // QUERIES))
    rows = base.select(F.expr(f"block div {GROUP // BLOCK}").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("p"), F.lit(False).alias("q"), "vec_id", "v", "block", F.lit(0.0).alias("floor"))
    each = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, groups - 1)).cast("long"))).alias("g"), F.pmod(F.xxhash64("vec_id"), F.lit(packs)).cast("int").alias("p"), F.lit(True).alias("q"), "vec_id", "v", F.lit(0).cast("long").alias("block"), "floor")

    def run(table):
        q = np.asarray(table.column("q"))
        v, ids, block, floor = _matrix(table.column("v")), np.asarray(table.column("vec_id")), np.asarray(table.column("block")), np.asarray(table.column("floor"))
        qv, qi, qf = v[q], ids[q], floor[q]
        parts = []
        for b in np.unique(block[~q]):
            y = ~q & (block == b)
            rows = v[y]
            centre = rows.mean(axis=0)
            radius = np.linalg.norm(rows - centre, axis=1).max()
            hope = (qv @ centre + np.linalg.norm(qv, axis=1) * radius) * (1 + 1e-9) + 1e-9 >= qf
            if hope.any():
                i, found, s = best(qv[hope], qi[hope], rows, ids[y], k, qf[hope])
                parts.append((qi[hope][i], found, s))
        return _table(*(np.concatenate([p[n] for p in parts]) if parts else [] for n in range(3)))

    return rows.unionByName(each).groupBy("g", "p").applyInArrow(run, FOUND)


def neighbours(vectors: DataFrame, k: int = 20, exact: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score; exact=False stops at the windows' results."""
    one = usable(vectors)
    length = one.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    one = one.where(F.size("v") == (length.n if length else 0))
    curves = ordered(one)
    found = cut(merged(in_windows(curves, k), k).select("query_id", "vec_id", "score"))
    if exact:
        found = found.unionByName(completed(curves, found, k))
    return merged(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_hilbert_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "embeddings"))
