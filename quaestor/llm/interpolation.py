"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

p(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket (a power of two) of the context's
count c(v). The weights are learned by expectation-maximisation on deleted training texts (remainder 9) whose estimates
come from the other training texts; then all training texts give the counts.

Counts grow with the corpus and are never gathered in one place. Texts become packets of tokens, each with a dictionary of
its words. A packet asks for its distinct words and bigrams once, by 64-bit hash, in arrays that are split by hash range
over buckets; a bucket sums up all packets' counts and answers each packet in the order it asked. So what is shuffled are
arrays of distinct keys, a frequent word is one entry for each packet, and buckets are even whatever the text.

Defined results: null counts as empty; an empty text is its end token; rows that repeat count as often as they come; with
no training text the estimates are uniform; null ids go by the remainder of empty text; an empty table gives an empty
result; columns other than doc_id and text are left out, whatever their names. Texts are read whole; a text is one packet at least.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix, own_columns, packs, read, remainder, spread, word_hashes

#: Bytes of text of a packet, tokens of the corpus for each bucket.
PACKET, PER_BUCKET = 8 << 20, 2_000_000
END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
CONTEXTS, ROUNDS = 48, 40
GOLD = np.uint64(0x9E3779B97F4A7C15)
SCORED, BASE, DELETED = 0, 1, 2


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal place together: what compresses well."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(b: bytes, t) -> np.ndarray:
    n = np.dtype(t).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(n, -1).T).view(t).ravel()


def packets(docs: DataFrame) -> DataFrame:
    """packet, role, ids, ends, words, stream: texts of one role as token numbers over the packet's sorted word hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = remainder("doc_id", 10)
    d = spread(own_columns(docs, "doc_id", "text")).withColumn("role", F.when(held == 0, SCORED).when(held == 9, DELETED).otherwise(BASE))

    def run(batches):
        import pyarrow as pa

        open_: dict[int, list] = {}

        def row(role: int):
            tokens, numbers, ids = (open_[role][k] for k in range(3))
            words, stream = np.unique(np.concatenate(tokens), return_inverse=True)
            ends = np.cumsum(np.concatenate(numbers)).astype(np.int64)
            open_.pop(role)
            joined = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(joined)], pa.int32()), joined)
            return pa.RecordBatch.from_arrays([pa.array([role], pa.int32()), lists, pa.array([ends.tobytes()]), pa.array([words.tobytes()]), pa.array([_planes(stream.astype(np.uint32))])], ["role", "ids", "ends", "words", "stream"])

        for b in batches:
            for role in (SCORED, BASE, DELETED):
                part = b.filter(pa.array(np.asarray(b.column("role")) == role))
                for x, y, raw, ends in packs(part.column("text")):
                    h, n = word_hashes(raw, ends)
                    tokens = np.insert(h, np.cumsum(n), END)
                    slot = open_.setdefault(role, [[], [], [], 0])
                    slot[0].append(tokens)
                    slot[1].append(n + 1)
                    slot[2].append(part.column("doc_id").slice(x, y - x))
                    slot[3] += len(raw)
                    if slot[3] >= PACKET:
                        yield row(role)
        for role in list(open_):
            yield row(role)

    out = d.mapInArrow(run, f"role int, ids array<{kind}>, ends binary, words binary, stream binary")
    return cut(out.withColumn("packet", F.monotonically_increasing_id()).withColumn("tokens", F.octet_length("stream") / 4), codec="zstd")


class Packet:
    """A packet's tokens, and its distinct words and bigrams in the order of their keys."""

    def __init__(self, ends: bytes, words: bytes, stream: bytes):
        self.ends = np.frombuffer(ends, np.int64)
        self.words, self.now = np.frombuffer(words, np.uint64), _unplanes(stream, np.uint32).astype(np.int64)
        first = np.concatenate(([0], self.ends[:-1]))
        self.before = np.empty_like(self.now)
        self.before[1:] = self.now[:-1]
        self.before[first] = len(self.words)  # the start's number
        pair, of_token = np.unique(self.before * (len(self.words) + 1) + self.now, return_inverse=True)
        hashes = np.append(self.words, START)
        with np.errstate(over="ignore"):
            bigrams = mix(hashes[pair // (len(self.words) + 1)] * GOLD + hashes[pair % (len(self.words) + 1)])
        order = np.argsort(bigrams)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys = (self.words, bigrams[order])  # words are sorted already
        self.of_token = (self.now, place[of_token])

    def asked(self, buckets: int):
        """(kind, bucket, slice) of the keys: a bucket is a range of hashes."""
        for kind, keys in enumerate(self.keys):
            cut_at = np.searchsorted(keys, (np.arange(buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64))
            cut_at = np.append(cut_at, len(keys))
            for k in range(buckets):
                if cut_at[k] < cut_at[k + 1]:
                    yield kind, k, slice(cut_at[k], cut_at[k + 1])


def requests(table: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        names = ["kind", "bucket", "packet", "keys", "n", "role"]
        for b in batches:
            for r in b.to_pylist():
                p = Packet(r["ends"], r["words"], r["stream"])
                counts = [np.bincount(t, minlength=len(k)).astype(np.uint32) for t, k in zip(p.of_token, p.keys, strict=True)]
                rows = [(kind, k, r["packet"], _planes(np.diff(p.keys[kind][s], prepend=np.uint64(0))), _planes(counts[kind][s]), r["role"]) for kind, k, s in p.asked(buckets)]
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x) if i > 2 and i < 5 else pa.array(x, pa.int64() if i == 2 else pa.int32()) for i, x in enumerate(zip(*rows[at : at + 64], strict=True))], names)

    return table.select("packet", "role", "ends", "words", "stream").mapInArrow(run, "kind int, bucket int, packet long, keys binary, n binary, role int")


def answers(asked: DataFrame) -> DataFrame:
    """Counts of the keys a packet asked for, in base and in deleted texts; and for packet -1 the number of words seen."""

    def run(key, table):
        import pyarrow as pa

        # By packet, so that the answers are the same in every run.
        table = table.sort_by("packet")
        keys = [np.cumsum(_unplanes(k.as_py(), np.uint64), dtype=np.uint64) for k in table.column("keys")]
        numbers = [_unplanes(n.as_py(), np.uint32).astype(np.int64) for n in table.column("n")]
        role = np.repeat(np.asarray(table.column("role")), [len(k) for k in keys])
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate(numbers)
        total = [np.bincount(place[role == r], n[role == r], len(every)).astype(np.uint32) for r in (BASE, DELETED)]
        out, at = [], 0
        for packet, k in zip(table.column("packet").to_pylist(), keys, strict=True):
            own = place[at : at + len(k)]
            at += len(k)
            out.append((packet, key[0].as_py(), key[1].as_py(), _planes(total[0][own]), _planes(total[1][own]), 0))
        seen = int(((total[0] + total[1]) > 0).sum()) if key[0].as_py() == 0 else 0
        out.append((-1, key[0].as_py(), key[1].as_py(), b"", b"", seen))
        x = list(zip(*out, strict=True))
        return pa.table({"packet": pa.array(x[0], pa.int64()), "kind": pa.array(x[1], pa.int32()), "bucket": pa.array(x[2], pa.int32()), "base": pa.array(x[3], pa.binary()), "deleted": pa.array(x[4], pa.binary()), "seen": pa.array(x[5], pa.int64())})

    return cut(asked.groupBy("kind", "bucket").applyInArrow(run, "packet long, kind int, bucket int, base binary, deleted binary, seen long"), codec="zstd")


def _counted(left, right):
    """The packet, and for words and bigrams the counts in base and deleted texts."""
    r = left.to_pylist()[0]
    p = Packet(r["ends"], r["words"], r["stream"])
    rows = sorted(right.to_pylist(), key=lambda x: (x["kind"], x["bucket"]))
    got = [[np.concatenate([_unplanes(x[c], np.uint32) for x in rows if x["kind"] == kind]).astype(np.float64) for c in ("base", "deleted")] for kind in (0, 1)]
    assert all(len(got[k][0]) == len(p.keys[k]) for k in (0, 1))
    return r, p, got


def _estimates(p: Packet, words: np.ndarray, bigrams: np.ndarray, texts: int, total: int):
    """For each token the context's bucket, and the bigram's and the word's relative frequency."""
    context = np.append(words, texts)[p.before]
    p2 = np.divide(bigrams[p.of_token[1]], context, out=np.zeros(len(context)), where=context > 0)
    bucket = np.minimum(np.frexp(context)[1], CONTEXTS - 1)  # 0: never seen; k: 2**(k-1) to 2**k - 1
    return bucket, p2, words[p.now] / max(total, 1)


def weights(cells: list[tuple[int, int, float, float]], uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bigram, word, uniform) of each context bucket, by expectation-maximisation over (bucket, n, p2, p1)."""
    out = np.tile([0.5, 0.4, 0.1], (CONTEXTS, 1))
    for b in range(CONTEXTS):
        own = np.array([(n, x, y) for k, n, x, y in cells if k == b], np.float64).reshape(-1, 3)
        if len(own):
            p = np.column_stack([own[:, 1], own[:, 2], np.full(len(own), uniform)])
            for _ in range(rounds):
                share = p * out[b]
                out[b] = ((share / share.sum(axis=1, keepdims=True)) * own[:, :1]).sum(axis=0) / own[:, 0].sum()
            out[b] = (out[b] + 1e-6) / (out[b] + 1e-6).sum()
    out[0] = [0, *(out[0, 1:] / out[0, 1:].sum())]
    return out


def _cells(table: DataFrame, answered: DataFrame, texts: int, total: int) -> list[tuple[int, int, float, float]]:
    """The deleted tokens as a histogram over (bucket, p2, p1) in quarter octaves: its size is bounded by the grid."""

    def run(left, right):
        import pyarrow as pa

        _, p, got = _counted(left, right)
        bucket, p2, p1 = _estimates(p, got[0][0], got[1][0], texts, total)
        level = lambda x: np.where(x > 0, np.minimum(250, 1 + np.floor(-4 * np.log2(np.maximum(x, 1e-18)))), 0).astype(np.int64)
        cell, of = np.unique((bucket * 256 + level(p2)) * 256 + level(p1), return_inverse=True)
        return pa.table({"cell": cell, "n": np.bincount(of), "s2": np.bincount(of, p2), "s1": np.bincount(of, p1)})

    held = table.where(f"role = {DELETED}").drop("ids")
    found = held.groupBy("packet").cogroup(answered.join(held.select("packet"), "packet", "left_semi").groupBy("packet")).applyInArrow(run, "cell long, n long, s2 double, s1 double")
    rows = found.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")).orderBy("cell").collect()
    return [(r.cell >> 16, r.n, r.s2 / r.n, r.s1 / r.n) for r in rows]


def interpolated(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row for each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = packets(docs)
    sums = {r.role: (r.tokens, r.texts) for r in table.groupBy("role").agg(F.sum("tokens").cast("long").alias("tokens"), F.sum(F.size("ids")).alias("texts")).collect()}
    n_base, t_base = sums.get(BASE, (0, 0))
    n_all, t_all = n_base + sums.get(DELETED, (0, 0))[0], t_base + sums.get(DELETED, (0, 0))[1]
    buckets = 1 << max(3, (sum(n for n, _ in sums.values()) // PER_BUCKET).bit_length())
    answered = answers(requests(table, buckets))
    distinct = answered.where("packet = -1").agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    answered = answered.where("packet >= 0").drop("seen")
    uniform = 1 / (distinct + 1)
    mixture = weights(_cells(table, answered, t_base, n_base), uniform)

    def run(left, right):
        import pyarrow as pa

        r, p, got = _counted(left, right)
        words = got[0][0] + got[0][1]
        bucket, p2, p1 = _estimates(p, words, got[1][0] + got[1][1], t_all, n_all)
        w = mixture[bucket]
        score = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * uniform)
        count = words[p.now]
        base = np.log10((count + 0.1) / (n_all + 0.1 * (distinct + 1)))
        first = np.concatenate(([0], p.ends[:-1]))
        sums = [np.add.reduceat(x, first) for x in (count > 0, base, score)] if len(p.ends) else [np.empty(0)] * 3
        return pa.table({"doc_id": left.column("ids").combine_chunks().flatten(), "held_out": np.full(len(p.ends), r["role"] == SCORED), "n_tokens": p.ends - first, "n_known": sums[0].astype(np.int64), "base_score": sums[1].astype(np.float64), "score": sums[2].astype(np.float64)})

    out = table.groupBy("packet").cogroup(answered.groupBy("packet")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated(read(spark, sf_dir, "documents"))
