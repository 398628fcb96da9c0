"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1; a letter's place in an n-gram permutes (rolls) its vector, the n-gram's
vector is the product of its letters' vectors (binding), and a text's vector is the sum over its n-grams (bundling). A
language's prototype is the sum of its training texts' vectors, each text weighing the same. The prediction is the
prototype of largest cosine; the score is that cosine, 0 at least.

Texts are lower-cased; what is no letter becomes a single space. a-z have symbols of their own, other letters share the
remaining symbols by a hash of their code point.

Defined results: null texts, empty texts and texts without letters get `und`, score 0; ties go to the smaller language
code; without any training row every text gets `und`; null ids are kept; repeated rows count and come out as often as they
stand there; an empty table gives an empty result; other columns than the kept ones are left out. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, only, own_columns, read, remainder, spread

DIM, N, SYMBOLS = 1024, 3, 128
#: Languages whose prototypes a task holds at a time; more of them take more passes over the texts.
LANGUAGES = 2000
ROWS, CHARS = 256, 1 << 20
#: Counts (texts times n-grams) and n-gram vectors that are held at a time.
CELLS, BLOCK = 1 << 22, 2048


class Space:
    """Letter vectors and the texts' n-gram counts over them."""

    def __init__(self, dim: int = DIM, seed: int = 11):
        letters = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dim)).astype(np.float32) * 2 - 1
        self.dim, self.rolled = dim, [np.roll(letters, N - 1 - k, axis=1) for k in range(N)]
        cp = np.arange(0x110000, dtype=np.uint64)
        self.symbol = np.zeros(0x110000, np.uint8)
        alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.symbol[alpha] = (27 + (cp * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(SYMBOLS - 27)).astype(np.uint8)[alpha]
        self.symbol[97:123] = np.arange(1, 27)
        self.place = np.zeros(SYMBOLS**N, np.int32)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bound n-gram vectors, one row each."""
        out = self.rolled[0][grams // SYMBOLS**2]
        out *= self.rolled[1][grams // SYMBOLS % SYMBOLS]
        out *= self.rolled[2][grams % SYMBOLS]
        return out

    def bundle(self, grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each row of weights the weighted sum of the n-grams' vectors."""
        out = np.zeros((len(weights), self.dim), np.float32)
        for at in range(0, len(grams), BLOCK):
            out += weights[:, at : at + BLOCK] @ self.vectors(grams[at : at + BLOCK])
        return out

    def keys(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """n-grams of each text with repeats, distinct n-grams of all, and whether a text has a letter."""
        keys, letters = [], np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            s = self.symbol[np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32)]
            letters[i] = s.any()
            s = np.concatenate(([0], s, [0])).astype(np.int32)
            s = s[np.concatenate(([True], (s[1:] > 0) | (s[:-1] > 0)))]  # runs of spaces become one
            keys.append((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:] if len(s) >= N else np.empty(0, np.int32))
        seen = np.zeros(SYMBOLS**N, bool)
        for k in keys:
            seen[k] = True
        return keys, np.flatnonzero(seen), letters

    def table(self, keys: list[np.ndarray], grams: np.ndarray) -> np.ndarray:
        """Counts, texts x n-grams."""
        self.place[grams] = np.arange(len(grams))
        return np.stack([np.bincount(self.place[k], minlength=len(grams)).astype(np.float32) for k in keys]) if keys else np.zeros((0, len(grams)), np.float32)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n-grams of the texts, their counts (texts x n-grams), and whether a text has a letter."""
        keys, grams, letters = self.keys(texts)
        return grams, self.table(keys, grams), letters


_space: dict[int, Space] = {}


def space(dim: int) -> Space:
    if dim not in _space:
        _space[dim] = Space(dim)
    return _space[dim]


def _parts(batch, column: str = "text") -> Iterator[tuple[int, list[str]]]:
    texts = [t or "" for t in batch.column(column).to_pylist()]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < ROWS and (size < CHARS or end == at):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _profiles(sp: Space, batch, column: str = "text") -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, n-grams, counts and letters of few texts at a time: CELLS counts, or one text."""
    for at, texts in _parts(batch, column):
        keys, grams, letters = sp.keys(texts)
        step = max(1, CELLS // max(1, len(grams)))
        for k in range(0, len(texts), step):
            yield at + k, grams, sp.table(keys[k : k + step], grams), letters[k : k + step]


def prototypes(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes of length 1. docs: text, lang of the training rows."""

    def bundle(batches):
        import pyarrow as pa

        only("language", _space.clear)
        sp, total = space(dim), {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for at, grams, c, letters in _profiles(sp, b):
                if not len(grams):
                    continue
                c /= np.maximum(c.sum(axis=1, keepdims=True), 1)
                own = langs[at : at + len(c)]
                codes = sorted({x for x, y in zip(own, letters, strict=True) if y})
                sums = np.stack([c[[x == k and bool(y) for x, y in zip(own, letters, strict=True)]].sum(axis=0) for k in codes]) if codes else np.empty((0, len(grams)))
                for k, v in zip(codes, sp.bundle(grams, sums.astype(np.float32)), strict=True):
                    total[k] = total.get(k, 0) + v.astype(np.float64)
        for k, v in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [k], "salt": [hash(tuple(v[:4])) % 64], "v": [v.tobytes()]}, schema=pa.schema([("lang", pa.string()), ("salt", pa.int32()), ("v", pa.binary())]))

    def add(key, table):
        import pyarrow as pa

        v = sum(np.frombuffer(x.as_py()) for x in table.column("v"))
        return pa.table({"lang": [key[0].as_py()], "v": [v.tobytes()]})

    # A row for each task and language, summed up in two steps, so that no task gets a row from every other.
    parts = spread(docs.select("text", "lang")).mapInArrow(bundle, "lang string, salt int, v binary")
    parts = parts.groupBy("lang", "salt").applyInArrow(add, "lang string, v binary").groupBy("lang").applyInArrow(add, "lang string, v binary")
    rows = sorted((r.lang, np.frombuffer(r.v)) for r in parts.collect())  # a row for each language
    p = np.stack([v / max(np.linalg.norm(v), 1e-12) for _, v in rows]) if rows else np.empty((0, dim))
    return [k for k, _ in rows], p.astype(np.float32)


def predict(docs: DataFrame, languages: list[str], protos: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of each row, lang_pred and score."""
    column = "text" if "text" in keep else "_text"
    d = spread(docs).select(*[F.col(k) for k in keep], *([] if "text" in keep else [F.col("text").alias(column)]))
    out = d.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(-2.0))
    for at in range(0, max(1, len(languages)), LANGUAGES):
        out = _pass(out, column, languages[at : at + LANGUAGES], protos[at : at + LANGUAGES])
    return out.select(*keep, "lang_pred", F.when(F.col("lang_pred") == "und", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))).alias("score"))


def _pass(rows: DataFrame, column: str, languages: list[str], protos: np.ndarray) -> DataFrame:
    """rows with lang_pred and score (cosine) where one of these languages is nearer than what they hold."""
    dim, rest = protos.shape[1], [c for c in rows.columns if c not in ("lang_pred", "score")]

    def run(batches):
        import pyarrow as pa

        only("language", _space.clear)
        sp = space(dim)
        for b in batches:
            langs, scores = b.column("lang_pred").to_pylist(), b.column("score").to_numpy().copy()
            for at, grams, c, letters in _profiles(sp, b, column):
                if not languages or not len(grams):
                    continue
                v = sp.bundle(grams, c)
                cos = (v @ protos.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for i, k in enumerate(cos.argmax(axis=1)):
                    if letters[i] and cos[i, k] > scores[at + i]:
                        langs[at + i], scores[at + i] = languages[k], cos[i, k]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in rest], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*rest, "lang_pred", "score"])
        give_back()

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in rest)
    return rows.select(*rest, "lang_pred", "score").mapInArrow(run, f"{types}, lang_pred string, score double")


def op5_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(read(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    learn = docs.where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull())
    out = predict(docs, *prototypes(learn))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
