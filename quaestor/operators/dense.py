"""Exact cosine search: stated questions against all vectors, in blocks of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are broadcast at most where a few are held against many.
SMALL = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


#: Vectors and questions of a block: a task multiplies one block of each, STEP questions at a time.
ITEMS, QUESTIONS, STEP = 8192, 4096, 256


def matrix(column, dim: int = -1):
    """A list column of Arrow as rows of numbers; nulls are NaN."""
    import numpy as np

    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), dim)


def _blocks(questions: DataFrame, vectors: DataFrame):
    """Vectors (vec_id, v, dim) and questions (question_id, q, d), each in every pair of their blocks: grouped alike, and the number of vectors."""
    n = vectors.count()
    blocks, packs = max(1, -(-n // ITEMS)), max(1, -(-questions.count() // QUESTIONS))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select("vec_id", F.col("embedding").alias("v"), part("vec_id", blocks).alias("block"), all_of(packs).alias("pack"), F.size("embedding").alias("dim"))
    q = questions.select("question_id", "q", part("question_id", packs).alias("p"), all_of(blocks).alias("b"), F.size("q").alias("d"))
    return v, q, n


def topk(questions: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """question_id, rank, vec_id, score. questions: question_id, q (vector); vectors: vec_id, embedding.

    Exact: every question meets every vector, in blocks of both that one task multiplies; what could be among a question's k
    best of its block leaves it. Vectors of other lengths than the question's, and scores that are no numbers, do not count.
    """
    v, q, _ = _blocks(questions, vectors)
    v, q = v.where("dim > 0"), q.where("d > 0")

    def run(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        picked_q, picked_v, picked = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if left.num_rows and right.num_rows:
            x, whole = matrix(left.column("v")), matrix(right.column("q"))
            nx, at = np.linalg.norm(x, axis=1) + 1e-8, None
            if exclude_self and right.column("question_id").type == left.column("vec_id").type:
                at = pc.index_in(right.column("question_id"), left.column("vec_id").combine_chunks()).to_numpy(zero_copy_only=False).astype(float)
            for a in range(0, len(whole), STEP):
                y = whole[a : a + STEP]
                ny = np.linalg.norm(y, axis=1) + 1e-8
                s = y @ x.T / (ny[:, None] * nx[None, :])
                s[~np.isfinite(s)] = -np.inf
                if at is not None:
                    own = np.flatnonzero(~np.isnan(at[a : a + STEP]))
                    s[own, at[a : a + STEP][own].astype(np.int64)] = -np.inf
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                i, j = np.nonzero((s >= (least - 1e-8)[:, None]) & (s > -np.inf))
                picked_q.append(i + a)
                picked_v.append(j)
                # A product of blocks can differ from that of single rows in the last bits: the few that are picked are made again.
                picked.append((y[i] * x[j]).sum(axis=1) / (ny[i] * nx[j]))
        take = lambda c, at: c.take(pa.array(np.concatenate(at)))
        return pa.table({"question_id": take(right.column("question_id"), picked_q), "vec_id": take(left.column("vec_id"), picked_v), "score": pa.array(np.concatenate(picked))})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    found = v.groupBy("block", "pack", "dim").cogroup(q.groupBy("b", "p", "d")).applyInArrow(run, f"question_id {kind(questions, 'question_id')}, vec_id {kind(vectors, 'vec_id')}, score double")
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.where(F.col("rank") <= k).select("question_id", "rank", "vec_id", "score")


def totals(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """question_id, n, total, most, least of the cosines with all vectors, in the blocks of `topk`. questions: question_id, q; vectors: vec_id, embedding.

    n counts all vectors; pairs with a null, or of different lengths, have no cosine.
    """
    v, q, n = _blocks(questions, vectors)
    v, q = v.where(F.forall("v", lambda x: x.isNotNull())), q.where(F.forall("q", lambda x: x.isNotNull()))

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        total, most, least = [np.empty(0)], [np.empty(0)], [np.empty(0)]
        if left.num_rows and right.num_rows:
            dim = right.column("d")[0].as_py()
            x, whole = matrix(left.column("v"), dim), matrix(right.column("q"), dim)
            nx = np.linalg.norm(x, axis=1) + 1e-8
            for a in range(0, len(whole), STEP):
                y = whole[a : a + STEP]
                with np.errstate(all="ignore"):
                    s = y @ x.T / ((np.linalg.norm(y, axis=1) + 1e-8)[:, None] * nx[None, :])
                total.append(s.sum(axis=1))
                most.append(s.max(axis=1))  # NaN is the largest number in Spark, and never the least beside others
                least.append(np.fmin.reduce(s, axis=1))
        ids = right.column("question_id").slice(0, sum(map(len, total)))
        return pa.table({"question_id": ids, "total": np.concatenate(total), "most": np.concatenate(most), "least": np.concatenate(least)})

    kind = questions.schema["question_id"].dataType.simpleString()
    found = v.groupBy("block", "pack", "dim").cogroup(q.groupBy("b", "p", "d")).applyInArrow(run, f"question_id {kind}, total double, most double, least double")
    asked = questions.where(F.lit(n > 0)).select("question_id", F.lit(n).cast("long").alias("n"))
    g = asked.unionByName(found, allowMissingColumns=True).groupBy("question_id")
    return g.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"), F.min("least").alias("least"))


def mean_vector(vectors: DataFrame, of: str = "embedding") -> DataFrame:
    """One row: the mean vector."""
    long = vectors.select(F.posexplode(of)).groupBy("pos").agg(F.avg(F.col("col").cast("double")).alias("x"))
    return long.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("q"))  # one entry for each dimension


def seed_neighbours(vectors: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The k vectors nearest to the mean of the seeds, seeds left out."""
    mean = mean_vector(vectors.join(seeds, "vec_id", "left_semi")).select(F.lit(0).cast("long").alias("question_id"), "q")
    return topk(mean, vectors.join(seeds, "vec_id", "left_anti"), k, exclude_self=False)
