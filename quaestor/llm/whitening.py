"""Whitening of vectors by a randomised range finder and Rayleigh-Ritz.

A random matrix of a few more columns than components (OVERSAMPLE) is multiplied by the covariance in passes over all centred
rows: each task sums its rows' share, Spark adds the shares, and the driver, which sees matrices of the vectors' dimension
only, makes the columns orthonormal again. After each pass Rayleigh-Ritz on the columns' span gives eigenvalues and vectors,
and the same products give their residuals. Where these are not small after PASSES passes (vectors without low rank), the
span becomes the full dimension, on which Rayleigh-Ritz is exact to rounding.

Entries are whole numbers, floor(1024 c) + 100000, so sums, centres times n, and deviations are exact; only the products are
rounded.

Defined results: vectors that are null, empty, or hold null or non-finite entries take no part, nor do vectors of another than
the most frequent length (of equally frequent ones the longest), as no covariance has them; repeated rows and null ids count and
stay; entries beyond 2**62 are cut there; a deviation beyond 64 bits is null; components without variance (eigenvalue at most
1e-13 of the trace) have null whitened values and are left out of identity_error; where nothing varies explained is null; with
fewer than eight dimensions there are fewer components; an empty table gives an empty result; columns other than vec_id
and embedding are left out, whatever their names. A component's sign makes its largest entry positive.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, own_columns, read

COMPONENTS = 8
OVERSAMPLE, PASSES, SEED = 10, 3, 12
#: A residual is small below this share of the largest eigenvalue; a component has no variance below this share of the trace.
SMALL, NOTHING = 1e-13, 1e-13
SCALE, SHIFT, MOST = 1024, 100_000, 1 << 62
#: Rows that a task multiplies at a time.
BLOCK = 8192


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array<long>): the rows that take part, all of one length."""
    d = own_columns(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("size(v) > 0")
    d = d.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    length = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    d = d.where(F.size("v") == (length.n if length else 0))
    top = float(MOST)
    entry = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(top)), F.lit(-top))).cast("long") + SHIFT
    return cut(d.select("vec_id", F.transform("v", entry).alias("x")))


def _rows(batch) -> np.ndarray:
    x = batch.column("x")
    return np.asarray(x.flatten(), np.int64).reshape(len(x), -1)


@dataclass(frozen=True)
class Centre:
    """n rows with sums S by dimension."""

    n: int
    sums: tuple[int, ...]

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: 64-bit numbers where they suffice, else Python's."""
        if self.n * int(np.abs(x).max(initial=0)) < 1 << 61:  # so are the sums below n times the largest
            if max(map(abs, self.sums)) < 1 << 62:
                return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        a = self.apart(x)
        if a.dtype == object or len(x) and (a.astype(np.float64) ** 2).sum(axis=1).max() > 2.0**62:
            return [d if d < 1 << 63 else None for d in (sum(int(c) ** 2 for c in row) for row in a)]
        return (a * a).sum(axis=1).tolist()


def centre(rows: DataFrame) -> Centre:
    def run(batches):
        import pyarrow as pa

        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = _rows(b)
                exact = x.sum(axis=0) if int(np.abs(x).max()) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
                part = [int(v) for v in exact]
                n, total = n + len(x), part if total is None else [a + c for a, c in zip(total, part, strict=True)]
        if n:
            values = [Decimal(v) for v in (n, *total)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["dim", "value"])

    got = rows.mapInArrow(run, "dim int, value decimal(38,0)").groupBy("dim").agg(F.sum("value").cast("decimal(38,0)").alias("value")).orderBy("dim").collect()
    return Centre(int(got[0].value), tuple(int(r.value) for r in got[1:])) if got else Centre(0, ())


def summed(rows: DataFrame, at: Centre, share) -> np.ndarray:
    """Sum over blocks of centred rows of share(block), a matrix: tasks sum theirs, Spark adds those, row by row of the matrix."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = None
        for b in batches:
            x = _rows(b)
            for a in range(0, len(x), BLOCK):
                s = share(at.centred(x[a : a + BLOCK]))
                total = s if total is None else total + s
        if total is not None:
            k = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(np.full(k, TaskContext.get().partitionId()), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "part", "value"])

    def add(table):
        import pyarrow as pa

        table = table.sort_by("part")  # always in one order
        value = np.asarray(table.column("value").combine_chunks().flatten()).reshape(table.num_rows, -1)
        return pa.table({"row": table.column("row").slice(0, 1), "value": pa.array([value.sum(axis=0)], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(run, "row int, part int, value array<double>")
    return np.array([r.value for r in parts.groupBy("row").applyInArrow(add, "row int, value array<double>").orderBy("row").collect()])


@dataclass(frozen=True)
class Components:
    """values: the largest eigenvalues, falling; vectors: their unit eigenvectors as columns; trace; rank of the span used."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    span: int


def components(rows: DataFrame, at: Centre, k: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = SEED) -> Components:
    dim = len(at.sums)
    k = min(k, dim)
    width = min(dim, k + oversample)
    q = np.eye(dim) if width == dim else np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    for turn in range(passes + 1):
        if turn == passes and q.shape[1] < dim:
            q = np.eye(dim)  # residuals fail: the full dimension
        got = summed(rows, at, lambda x, q=q: np.vstack([x.T @ (x @ q), np.full((1, q.shape[1]), (x * x).sum())])) / at.n
        y, trace = got[:-1], float(got[-1, 0])
        small = q.T @ y
        e, w = np.linalg.eigh((small + small.T) / 2)
        e, w = e[::-1][:k], w[:, ::-1][:, :k]
        u = q @ w
        if q.shape[1] == dim or np.linalg.norm(y @ w - u * e, axis=0).max() <= SMALL * e[0]:
            break
        q = np.linalg.qr(y)[0]
    u = u / np.linalg.norm(u, axis=0)
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    return Components(np.maximum(e, 0), u, trace, q.shape[1])


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id and RESULT: one row for each vector that takes part and component."""
    rows = whole(vectors)
    kind = rows.schema["vec_id"].dataType.simpleString()
    at = centre(rows)
    if not at.n:
        discard(rows)
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {RESULT}")
    found = components(rows, at, k)
    live = found.values > NOTHING * found.trace
    scaled = found.vectors / np.sqrt(np.where(live, found.values, 1))
    error = 0.0
    if live.any():
        own = scaled[:, live]
        got = summed(rows, at, lambda x: np.vstack([(w := x @ own).T @ w, w.sum(axis=0)[None, :]])) / at.n
        error = float(np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(own.shape[1])).max())
    explained = [float(e / found.trace) if found.trace > 0 else None for e in found.values]
    c = len(explained)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                part = b.slice(start, BLOCK)
                x, m = _rows(part), part.num_rows
                w = np.where(live, at.centred(x) @ scaled, np.nan).ravel()
                fields = [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(m), c))), pa.array(np.tile(np.arange(1, c + 1), m), pa.int32()), pa.array(np.full(m * c, at.n), pa.int64()),
                    pa.array(at.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), c))), pa.array(w, pa.float64(), mask=np.tile(~live, m)), pa.array(explained * m, pa.float64()), pa.array(np.full(m * c, error), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(fields, ["vec_id", *(f.split()[0] for f in RESULT.split(", "))])

    return rows.mapInArrow(run, f"vec_id {kind}, {RESULT}")


def op12_range_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
