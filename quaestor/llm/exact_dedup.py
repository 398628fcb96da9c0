"""Exact dedup with a log-structured merge index over text digests.

Memtables: every input task gathers entries, and at MEMTABLE of them, or at its end, sorts them and flushes a run: the
smallest entry of each digest and the number of its rows. A batch's runs form level 0; FAN batches of a level are merged into
one of the next, and compaction merges all. A manifest of versions says which runs are live. Each run has a filter of its
digests (blocked Bloom: 512 bits for 32 digests, eight of them set for each), which look-ups probe before they read the run.

Documents that a batch shares a digest with are hits. Hits are verified: their texts, and no others, leave the scan and are
compared byte by byte with the text of the entry that won; texts that only share the digest are split off.

Hot digests: memtables sum them up before anything is shuffled, look-ups of digests with more than one in 1,024 of all rows
go by broadcast, and their texts are compared in pieces of TOGETHER rows, each with a copy of the winner's text.

Defined results: null texts count as empty; texts are equal when identical without `[\\x20\\x09-\\x0D]`; of equal texts
the one with the most code points stays, then the smallest id (a null id is largest), then the first place. Ids are of any
type that can be ordered. Repeated rows stay separate rows of the result. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACE, SPACES, cut, discard, give_back, located, read, scratch, spread, spread_join, text_of, with_marks

MEMTABLE, FAN, TOGETHER = 1 << 18, 4, 4096
#: Digests and bits of a block, and blocks of a filter at most: what is broadcast, some 25 MB.
PER_BLOCK, BLOCKS = 32, 1 << 18
ENTRY = ("doc_id", "len", "sha", *PLACE, "digest")
BITS = tuple(f"w{k}" for k in range(8))


def normalised(text: Column) -> Column:
    """The text without white space; the space by itself, as replacing is faster than translating."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(plain.rlike(r"[\x09-\x0D]"), F.translate(plain, SPACES, "")).otherwise(plain)


def _digest(digest_bytes: int) -> Column:
    return F.substring("sha", 1, digest_bytes)


def digests(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """An entry for each row of `docs` (located): id, code points of the original text, digest, place. Texts stay."""
    sha = F.unhex(F.sha2(normalised(text_of()).cast("binary"), 256))
    return spread(docs).select("doc_id", F.length(text_of()).alias("len"), sha.alias("sha"), *PLACE).withColumn("digest", _digest(digest_bytes))


def _best() -> Column:
    """Least is best: most code points, then smallest id (null last), then first place."""
    return F.struct((-F.col("len")).alias("neg"), F.col("doc_id").isNull().alias("noid"), "doc_id", *PLACE, "sha")


def memtables(entries: DataFrame) -> DataFrame:
    """Sorted runs of the smallest entry and the number of rows, n, of each digest in a memtable."""
    kind = entries.schema["doc_id"].dataType.simpleString()

    def flush(held):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        t = pa.Table.from_batches(held).combine_chunks().sort_by([("digest", "ascending"), ("len", "descending"), ("doc_id", "ascending"), ("_file", "ascending"), ("_row", "ascending")])
        d = t.column("digest")
        first = np.concatenate(([0], 1 + np.flatnonzero(np.asarray(pc.not_equal(d.slice(1), d.slice(0, len(d) - 1))))))
        out = t.take(pa.array(first)).append_column("n", pa.array(np.diff(first, append=len(d)), pa.int64()))
        return out.combine_chunks().to_batches()

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= MEMTABLE:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)
        held = None
        give_back()

    return entries.select(*ENTRY).mapInArrow(run, f"doc_id {kind}, len int, sha binary, _file string, _row long, digest binary, n long")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(blocks))


def _bit(k: int) -> str:
    """The bit of a digest in word k of its block."""
    return f"cast(shiftright(xxhash64(digest, 1), {6 * k}) & 63 as int)"


class Filter:
    """A blocked Bloom filter over a table's digests, written beside it."""

    def __init__(self, keys: DataFrame, n: int):
        self.blocks = n // PER_BLOCK + 1
        self.table = None
        if self.blocks <= BLOCKS:  # else it would not fit its bound: look-ups read the run
            words = [F.bit_or(F.expr(f"shiftleft(1L, {_bit(k)})")).alias(w) for k, w in enumerate(BITS)]
            self.table = cut(keys.groupBy(_block(self.blocks).alias("_block")).agg(*words))

    def probe(self, rows: DataFrame) -> DataFrame:
        """rows with `maybe`: false if the digest is certainly not in the table."""
        if self.table is None:
            return rows.withColumn("maybe", F.lit(True))
        hit = F.expr(" & ".join(f"getbit({w}, {_bit(k)})" for k, w in enumerate(BITS)))
        out = rows.withColumn("_block", _block(self.blocks)).join(F.broadcast(self.table), "_block", "left")
        return out.withColumn("maybe", F.coalesce(hit == 1, F.lit(False))).drop("_block", *BITS)


class DigestIndex:
    """Runs in a folder that all executors share, and the manifest of those that are live."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.version = spark, folder or scratch(spark), 0
        self.live: list[tuple[int, str]] = []
        self._filters: dict[str, Filter] = {}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> DigestIndex:
        """The index that an earlier job left: its last version."""
        out = cls(spark, folder)
        rows = spark.read.parquet(f"{folder}/manifest").orderBy("version", "n").collect()  # a few rows for each version
        out.version = max((r.version for r in rows), default=0)
        out.live = [(r.level, r.path) for r in rows if r.version == out.version]
        return out

    def _publish(self) -> None:
        self.version += 1
        rows = [(self.version, n, level, path) for n, (level, path) in enumerate(self.live)]
        self.spark.createDataFrame(rows, "version int, n int, level int, path string").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def run(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def _write(self, table: DataFrame, level: int) -> tuple[int, str]:
        path = f"{self.folder}/level-{level}/{self.version + 1}-{len(self.live)}"
        table.write.option("compression", "snappy").parquet(path)
        return level, path

    def _merged(self, runs: list[str]) -> DataFrame:
        rows = None
        for p in runs:
            rows = self.run(p) if rows is None else rows.unionByName(self.run(p))
        out = rows.groupBy("digest").agg(F.min(_best()).alias("best"), F.sum("n").alias("n"))
        flat = out.select("best.doc_id", (-F.col("best.neg")).alias("len"), "best.sha", "best._file", "best._row", "digest", "n")
        return flat.sortWithinPartitions("digest")

    def add(self, entries: DataFrame) -> None:
        """A batch's memtables become a run of level 0; levels of FAN runs are merged into the next."""
        self.live.append(self._write(memtables(entries), 0))
        level = 0
        while len(full := [p for k, p in self.live if k == level]) >= FAN:
            run = self._write(self._merged(full), level + 1)
            self.live = [(k, p) for k, p in self.live if k != level] + [run]
            level += 1
        self._publish()

    def compact(self) -> DataFrame:
        """All runs merged into one: a row for each digest."""
        if len(self.live) != 1 or self.live[0][0] == 0:
            top = max((k for k, _ in self.live), default=0) + 1
            self.live = [self._write(self._merged([p for _, p in self.live]), top)]
            self._publish()
        return self.run(self.live[0][1])

    def lookup(self, entries: DataFrame) -> DataFrame:
        """Entries whose digest the index has, with the row that holds it: columns of the run with `held_` before them."""
        nothing = entries.where("false")
        out = nothing.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("held_id", entries.schema["doc_id"].dataType), ("held_len", "int"), ("held_n", "long"))])
        if not self.live:
            return out
        out = None
        for _, path in self.live:
            run = self.run(path).groupBy("digest").agg(F.min(_best()).alias("best"), F.sum("n").alias("held_n"))
            if path not in self._filters:
                self._filters[path] = Filter(self.run(path), self.run(path).count())
            found = self._filters[path].probe(entries).where("maybe").drop("maybe").join(run, "digest")
            out = found if out is None else out.unionByName(found)
        key = entries.columns
        found = out.groupBy(*key).agg(F.min("best").alias("best"), F.sum("held_n").alias("held_n"))
        return found.select(*key, F.col("best.doc_id").alias("held_id"), (-F.col("best.neg")).alias("held_len"), "held_n")


def _found(entries: DataFrame, shared: DataFrame) -> DataFrame:
    """Each entry with its digest's best entry and number of rows; entries that the filter turns away are alone."""
    n = shared.count()
    own = F.struct((-F.col("len")).alias("neg"), "doc_id", *PLACE)
    asked = Filter(shared, n).probe(entries)
    groups = shared.select("digest", F.struct((-F.col("len")).alias("neg"), "doc_id", *PLACE).alias("best"), "n")
    alone = asked.where("NOT maybe").select(*ENTRY, own.alias("best"), F.lit(1).cast("long").alias("n"))
    hits = spread_join(asked.where("maybe").drop("maybe"), groups, ["digest"], how="left")
    return alone.unionByName(hits.select(*ENTRY, F.coalesce("best", own).alias("best"), F.coalesce("n", F.lit(1)).alias("n")))


def _unequal(docs: DataFrame, shared: DataFrame, found: DataFrame, digest_bytes: int) -> DataFrame:
    """Entries of shared digests whose text is not, byte by byte, that of the best entry; with the text."""
    first = (F.col("_file") == F.col("best._file")) & (F.col("_row") == F.col("best._row"))
    marks = found.where("n > 1").select(*PLACE, F.when(first, 2).when(F.col("n") > TOGETHER, 3).otherwise(1).alias("_mark"))
    norm = normalised(text_of())
    texts = with_marks(docs, marks).where("_mark > 0").select("doc_id", F.length(text_of()).alias("len"), norm.alias("norm"), *PLACE, "_mark")
    texts = cut(texts.withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256))).withColumn("digest", _digest(digest_bytes)))
    # Members of large groups learn by their place how large, and are compared in pieces.
    pieces = F.ceil(F.col("n") / TOGETHER).cast("int")
    large = texts.where("_mark = 3").join(found.where(F.col("n") > TOGETHER).select(*PLACE, "n"), list(PLACE))
    members = texts.where("_mark = 1").withColumn("piece", F.lit(0)).unionByName(large.withColumn("piece", F.pmod(F.xxhash64(*PLACE), pieces).cast("int")).drop("n"))
    held = texts.where("_mark = 2").join(shared.select("digest", "n"), "digest").select("digest", F.col("norm").alias("held"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    out = cut(members.join(held, ["digest", "piece"]).where("norm <> held").select(*ENTRY, "norm"))
    discard(texts)
    return out


def exact_dedup(docs: DataFrame, digest_bytes: int = 32, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    keep: of `_file`, `_row`, `stays`; where rows repeat an id, `kept` holds for all that equal the best row, `stays` for one.
    """
    docs = located(docs, "doc_id", "text")
    entries = cut(digests(docs, digest_bytes))
    index = DigestIndex(docs.sparkSession)
    index.add(entries)
    shared = cut(index.compact().where("n > 1"))
    found = cut(_found(entries, shared))
    apart = _unequal(docs, shared, found, digest_bytes)
    if not apart.isEmpty():
        found = _split(found, apart)
    best = F.col("best")
    kept = F.col("doc_id").eqNullSafe(best["doc_id"]) & (F.col("len") == -best["neg"])
    stays = (F.col("_file") == best["_file"]) & (F.col("_row") == best["_row"])
    out = found.select("doc_id", best["doc_id"].alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *PLACE, stays.alias("stays"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *keep)


def _split(found: DataFrame, apart: DataFrame) -> DataFrame:
    """Entries that only share a digest form groups of their own, by whole text."""
    best = F.struct((-F.col("len")).alias("neg"), F.col("doc_id").isNull().alias("noid"), "doc_id", *PLACE)
    groups = apart.groupBy("digest", "sha", "norm").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("best", F.struct("best.neg", "best.doc_id", "best._file", "best._row"))
    moved = cut(apart.join(groups, ["digest", "sha", "norm"]).select(*PLACE, F.col("best").alias("_best"), F.col("n").alias("_n")))
    fewer = cut(apart.groupBy("digest").agg(F.count(F.lit(1)).alias("_less")))
    out = found.join(moved, list(PLACE), "left").join(fewer, "digest", "left")
    n = F.coalesce("_n", F.col("n") - F.coalesce("_less", F.lit(0)))
    return cut(out.select(*ENTRY, F.coalesce("_best", "best").alias("best"), n.alias("n")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
"""
