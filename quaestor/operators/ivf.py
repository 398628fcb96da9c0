"""A vector index in Parquet: inverted lists around trained centres, residual product codes, exact reranking.

Training takes a bounded sample of vectors, by hash of their ids, and makes centres of lists and, for parts of the dimensions,
codebooks of what remains of a vector beside its centre. An addition assigns each vector to its nearest centre and writes
its code, a byte for each part, sorted by list in folders; a deletion writes ids. Both are versions: a row counts if no later
version deletes its id, and adding an id again deletes its earlier rows.

A search finds each question's nearest lists, estimates scores from the codes (a table for each part, no vectors are read), and
reranks the best estimates on the vectors themselves. Long lists are cut in slices and
many questions in packs, so that no task holds a list or all questions.
How many lists a search asks is measured when the index is made: sample vectors are held against all of the
sample, and the least number that finds the share WANTED of their neighbours is kept.

Vectors count by direction (cosine); null and zero vectors and those of other lengths take no part.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.operators import dense
from quaestor.sources.tables import exists, written

#: Vectors of the training sample at most, lists at most, codes of a part, and rounds of training.
SAMPLE, LISTS, CODES, ROUNDS = 20_000, 1024, 256, 8
#: Dimensions of a part; lists of a folder; rows of a slice; estimates that are reranked for each result that is asked for; questions of a pack.
PART, FOLDER, SLICE, RERANK, PACK = 4, 16, 65_536, 10, 4096
#: Share of the sample's neighbours that a search is to find, neighbours and vectors of that measurement.
WANTED, NEAREST, MEASURED = 0.97, 20, 300


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(((c := x[a : a + 4096]) @ centres.T) * 2 - (centres * centres).sum(axis=1)).argmax(axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def clusters(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of k clusters by Lloyd's rounds; empty ones start again at random rows."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, d], k) for d in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


class Coder:
    """Centres, codebooks, and what a search asks. Small: it goes to the tasks whole."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray], probe: int):
        self.centres, self.books, self.probe = centres, books, probe
        self.cuts = np.cumsum([0, *[b.shape[1] for b in books]])

    @classmethod
    def trained(cls, sample: np.ndarray, seed: int = 7) -> Coder:
        rng, x = np.random.default_rng(seed), _unit(sample)
        centres = clusters(x, int(min(LISTS, max(1, round(len(x) ** 0.5)))), rng)
        rest = x - centres[_nearest(x, centres)]
        books = [clusters(rest[:, a : a + PART], CODES, rng) for a in range(0, x.shape[1], PART)]
        own = cls(centres, books, len(centres))
        own.probe = own._measured(x, rng)
        return own

    def _measured(self, x: np.ndarray, rng: np.random.Generator) -> int:
        """The least number of lists with which the sample's own search finds WANTED."""
        lists, codes = self.coded(x)
        asked = rng.choice(len(x), min(MEASURED, len(x)), replace=False)
        k = min(NEAREST, len(x))
        order = np.argsort(-(x[asked] @ self.centres.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        true = np.argpartition(-(x[asked] @ x.T), k - 1, axis=1)[:, :k]
        needs = np.sort(place[np.arange(len(asked))[:, None], lists[true]].ravel())  # of each true neighbour: lists until its own
        return int(needs[min(len(needs) - 1, int(np.ceil(WANTED * len(needs))) - 1)]) + 1

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists and codes of unit vectors."""
        lists = _nearest(x, self.centres)
        rest = x - self.centres[lists]
        return lists, np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)

    def lists(self, q: np.ndarray, probe: int) -> np.ndarray:
        s = q @ self.centres.T
        probe = min(probe, s.shape[1])
        return np.argpartition(-s, probe - 1, axis=1)[:, :probe]

    def estimates(self, q: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Scores of coded vectors for each query: its product with the centre, and for each part with the code's entry."""
        s = q @ self.centres[lists].T
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            s += (q[:, a:b] @ book.T)[:, codes[:, m]]
        return s

    def rows(self) -> list[tuple]:
        flat = [("centres", 0, len(self.centres), self.centres), *[("book", k, len(b), b) for k, b in enumerate(self.books)]]
        return [(kind, k, n, [float(v) for v in m.ravel()]) for kind, k, n, m in flat] + [("probe", 0, self.probe, [])]

    @classmethod
    def of(cls, rows) -> Coder:
        centres = next(np.array(r.v).reshape(r.n, -1) for r in rows if r.kind == "centres")
        books = [np.array(r.v).reshape(r.n, -1) for r in sorted((r for r in rows if r.kind == "book"), key=lambda r: r.k)]
        return cls(centres, books, next(r.n for r in rows if r.kind == "probe"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- training

    def train(self, vectors: DataFrame, sample: int = SAMPLE) -> Coder:
        """Centres, codebooks and the number of lists to ask, from at most `sample` vectors (vec_id, embedding), by hash of ids."""
        v = self._usable(vectors)
        n = v.count()
        if n > sample:
            v = v.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n) + 1).limit(2 * sample)
        rows = v.select("v").collect()  # the sample: bounded
        lengths = [len(r.v) for r in rows]
        dim = max(set(lengths), key=lambda m: (lengths.count(m), m), default=0)
        if not dim:
            raise ValueError("no vectors to train on")
        coder = Coder.trained(np.array([r.v for r in rows if len(r.v) == dim]))
        self.spark.createDataFrame(coder.rows(), "kind string, k int, n int, v array<double>").coalesce(1).write.parquet(f"{self.path}/coder")
        return coder

    def coder(self) -> Coder:
        return Coder.of(self.spark.read.parquet(f"{self.path}/coder").collect())  # bounded by LISTS and CODES

    @staticmethod
    def _usable(vectors: DataFrame) -> DataFrame:
        v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
        return v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))

    # -- versions

    def _version(self) -> int:
        return self.spark.read.parquet(f"{self.path}/versions").agg(F.max("n")).first()[0] if exists(self.spark, f"{self.path}/versions") else 0

    def _publish(self, n: int, rows: str | None, deletes: str | None) -> None:
        self.spark.createDataFrame([(rows, deletes)], "rows string, deletes string").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/n={n}")

    def add(self, vectors: DataFrame) -> None:
        """Adds vectors (vec_id, embedding); earlier rows of the same ids count no more."""
        coder, n, name = self.coder(), self._version() + 1, uuid.uuid4().hex
        v = self._usable(vectors).where(F.size("v") == coder.centres.shape[1])

        def run(batches):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    lists, codes = coder.coded(_unit(_matrix(b.column("v"))))
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "v", "list", "code"])

        kind = v.schema["vec_id"].dataType.simpleString()
        coded = v.mapInArrow(run, f"vec_id {kind}, v array<double>, list int, code binary").withColumn("folder", F.expr(f"list div {FOLDER}").cast("int"))
        coded.repartitionByRange("folder", "list", "vec_id").sortWithinPartitions("folder", "list", "vec_id").write.partitionBy("folder").parquet(f"{self.path}/rows/{name}")
        if n > 1:
            self.spark.read.parquet(f"{self.path}/rows/{name}").select("vec_id").write.parquet(f"{self.path}/deletes/{name}")
        self._publish(n, name, name if n > 1 else None)

    def delete(self, ids: DataFrame) -> None:
        """From now on rows of these ids (vec_id) count no more."""
        n, name = self._version() + 1, uuid.uuid4().hex
        ids.select("vec_id").distinct().write.parquet(f"{self.path}/deletes/{name}")
        self._publish(n, None, name)

    def rows(self) -> DataFrame:
        """vec_id, v, list, code, folder of the rows that count."""
        versions = self.spark.read.parquet(f"{self.path}/versions").orderBy("n").collect()  # a row for each addition and deletion
        out = dead = None
        for r in versions:
            if r.rows:
                rows = self.spark.read.parquet(f"{self.path}/rows/{r.rows}").withColumn("n", F.lit(r.n))
                out = rows if out is None else out.unionByName(rows)
            if r.deletes:
                ids = self.spark.read.parquet(f"{self.path}/deletes/{r.deletes}").select("vec_id", F.lit(r.n).alias("until"))
                dead = ids if dead is None else dead.unionByName(ids)
        if dead is not None:
            dead = dead.groupBy("vec_id").agg(F.max("until").alias("until"))
            out = out.join(dead, "vec_id", "left").where("until IS NULL OR n >= until").drop("until")
        return out.drop("n")

    def compact(self) -> None:
        """Writes the rows that count as one new version that replaces all before."""
        n, name = self._version() + 1, uuid.uuid4().hex
        self.rows().repartitionByRange("folder", "list", "vec_id").sortWithinPartitions("folder", "list", "vec_id").write.partitionBy("folder").parquet(f"{self.path}/rows/{name}")
        before = self.rows().select("vec_id").distinct()
        before.write.parquet(f"{self.path}/deletes/{name}")
        self._publish(n, name, name)

    # -- search

    def search(self, questions: DataFrame, k: int = 20, probe: int | None = None, exclude_self: bool = False, rerank: int = RERANK) -> DataFrame:
        """question_id, rank, vec_id, score (cosine as dense.topk has it). questions: question_id, q."""
        coder = self.coder()
        probe, rows = probe or coder.probe, self.rows()
        q = questions.select("question_id", F.col("q").cast("array<double>").alias("q")).where(F.size("q") == coder.centres.shape[1])
        kind, other = q.schema["question_id"].dataType.simpleString(), rows.schema["vec_id"].dataType.simpleString()

        def asks(batches):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    lists = coder.lists(_unit(_matrix(b.column("q"))), probe)
                    m = lists.shape[1]
                    at = pa.array(np.repeat(np.arange(b.num_rows), m))
                    yield pa.RecordBatch.from_arrays([b.column("question_id").take(at), b.column("q").take(at), pa.array(lists.ravel(), pa.int32())], ["question_id", "q", "list"])

        asked = q.mapInArrow(asks, f"question_id {kind}, q array<double>, list int")
        lists = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).select("list", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
        of = F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int").alias("slice")
        packs = max(1, -(-q.count() // PACK))
        coded = rows.select("list", "vec_id", "code").join(F.broadcast(lists), "list").select("list", of, "vec_id", "code")  # a row for each of at most LISTS lists
        coded = coded.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
        pack = F.pmod(F.xxhash64("question_id"), F.lit(packs)).cast("int").alias("p")
        asked = asked.join(F.broadcast(lists), "list").select(F.col("list").alias("l"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s"), pack, "question_id", "q")
        most = rerank * k

        def estimate(left, right):
            import pyarrow as pa

            out_q, out_v, out_s = [], [], []
            if left.num_rows and right.num_rows:
                codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, -1)
                lists = np.full(left.num_rows, left.column("list")[0].as_py())
                for a in range(0, right.num_rows, 256):
                    part = right.slice(a, 256)
                    s = coder.estimates(_unit(_matrix(part.column("q"))), lists, codes)
                    m = min(most, s.shape[1])
                    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    out_q.append(np.repeat(np.arange(a, a + len(s)), m))
                    out_v.append(top.ravel())
                    out_s.append(np.take_along_axis(s, top, axis=1).ravel())
            cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
            return pa.table({"question_id": right.column("question_id").take(pa.array(cat(out_q, np.int64))), "vec_id": left.column("vec_id").take(pa.array(cat(out_v, np.int64))), "about": pa.array(cat(out_s, np.float64))})

        near = coded.groupBy("list", "slice", "pack").cogroup(asked.groupBy("l", "s", "p")).applyInArrow(estimate, f"question_id {kind}, vec_id {other}, about double")
        if exclude_self:
            near = near.where(F.col("vec_id") != F.col("question_id"))
        w = Window.partitionBy("question_id").orderBy(F.desc("about"), "vec_id")
        near = written(near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("question_id", "vec_id"))
        found = near.join(rows.select("vec_id", "v"), "vec_id").join(q, "question_id")
        scored = found.select("question_id", "vec_id", dense.cosine(F.col("v"), F.col("q")).alias("score"))
        w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
        return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("question_id", "rank", "vec_id", "score")
