"""Helpers shared by the training-data operators: table reading, scratch tables, byte-level hashing."""

from __future__ import annotations

import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract, `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once, unless they find it by the path they inherit."""
    package = Path(__file__).resolve().parent.parent
    inherited = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(package.parent) in inherited or spark.conf.get("spark.quaestor.shipped", None) == spark.sparkContext.applicationId:
        return
    folder = tempfile.mkdtemp()
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
    spark.conf.set("spark.quaestor.shipped", spark.sparkContext.applicationId)


#: Bytes of an Arrow batch on its way to a Python worker. Texts are long: Spark's own limits would have a partition in one batch.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batch limit, where it stands at Spark's default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(BATCH))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo `divisor`; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % divisor


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share: the session names it; a default serves runs on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{tempfile.gettempdir()}/quaestor-scratch-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/q-{uuid.uuid4().hex}"


def cut(df: DataFrame, *, partition_by: tuple[str, ...] = (), codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and read again: later plans start from files that survive lost executors.

    snappy, as each open file of zstd holds megabytes outside the heap.
    """
    path = scratch(df.sparkSession)
    df.write.option("compression", codec).partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote and no plan reads any more; the rest is for the owner of the folder."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_scratch", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller can never clash with ours."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(n) for n in names])


# ---- rows by their place: decisions travel, texts stay -------------------------------------------------------------

PLACE = ("_file", "_row")
#: Words of 64 marks in one broadcast: about 40 MB at the executors.
WORDS = 1 << 18


def _in_files(df: DataFrame) -> bool:
    """Whether the rows come straight from Parquet files, at most filtered and projected."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "Relation") and "parquet" in plan.simpleString(25)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a few files dealt to all cores; where the files fill them, and after any other step, nothing changes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _in_files(df) and df._jdf.rdd().getNumPartitions() < cores else df


def located(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and each row's file and place in it; rows that are not in Parquet files are written first."""
    docs = own_columns(docs, *names)
    docs = docs if _in_files(docs) else cut(docs)
    return docs.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def with_marks(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """docs (located) with `_mark`: what `marked` (_file, _row, _mark of 1 to 3) says of the row, else 0.

    No row of docs is shuffled. Marks are gathered to words of 64 rows of a file, and the words are broadcast to where the
    rows are, at most WORDS at a time: beyond that, files are divided over several broadcasts, each for its own files. Where
    a single file has more words than one broadcast may hold, its rows meet their marks by shuffle.
    """
    at = (F.col("_row") % 64).cast("int")
    plane = lambda k: F.bit_or(F.when(F.col("_mark").bitwiseAND(k) > 0, F.expr("shiftleft(1L, cast(_row % 64 as int))")).otherwise(F.lit(0).cast("long")))
    words = cut(marked.groupBy("_file", F.expr("_row div 64").alias("_word")).agg(plane(1).alias("_m1"), plane(2).alias("_m2")))
    docs = docs.withColumn("_word", F.expr("_row div 64"))
    mark = lambda d: d.withColumn("_mark", F.coalesce(F.getbit("_m1", at) + 2 * F.getbit("_m2", at), F.lit(0))).drop("_m1", "_m2", "_word")
    n = words.count()
    parts = 1 if n <= WORDS else 2 * n // WORDS + 1
    share = F.pmod(F.xxhash64("_file"), F.lit(parts))
    if parts > 1 and words.groupBy(share.alias("share")).count().agg(F.max("count")).first()[0] > WORDS:
        return mark(docs.join(words.hint("merge"), ["_file", "_word"], "left"))
    out = None
    for k in range(parts):
        own, its = (docs, words) if parts == 1 else (docs.where(share == k), words.where(share == k))
        own = mark(own.join(F.broadcast(its), ["_file", "_word"], "left"))
        out = own if out is None else out.unionByName(own)
    return out


#: A key is a head if it has more than one in HEADS of all rows, so that there are fewer heads than HEADS.
HEADS = 1024


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with groups (one row for each key; column n: how many of `rows` have it, or had) on keys.

    Heads' rows, which may be a third of all, stay where they are and meet a broadcast of fewer than HEADS rows; the others
    meet by shuffle. Where there is no head there is no broadcast.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    head = F.col(n) * HEADS > total
    heads = groups.where(head)
    if heads.isEmpty():
        return rows.join(groups, keys, how)
    more = [c for c in groups.columns if c not in keys]
    met = rows.join(F.broadcast(heads.withColumn("_head", F.lit(True))), keys, "left")
    light = met.where("_head IS NULL").drop("_head", *more).join(groups.where(~head), keys, how)
    return met.where("_head").drop("_head").unionByName(light)


# ---- what a Python worker keeps between tasks ----------------------------------------------------------------------

_remembered: dict[str, Callable[[], None]] = {}


def only(operator: str, forget: Callable[[], None]) -> None:
    """A worker, which serves many tasks, keeps what one operator remembers: at another's first task the rest goes."""
    others = [name for name in _remembered if name != operator]
    for name in others:
        _remembered.pop(name)()
    _remembered[operator] = forget
    if others:
        give_back()


def give_back() -> None:
    """Returns freed memory and the tables of powers to the system; where the C library can't, it stays with the worker."""
    import pyarrow as pa

    for table in (_powers, _inverse_powers):
        table[0] = np.ones(1, dtype=np.uint64)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# ---- vectorised hashing of words over UTF-8 bytes ------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, dtype=np.uint64)]


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


_INV = np.uint64(_inverse(int(_P)))
_inverse_powers = [np.ones(1, dtype=np.uint64)]


def _table(cache: list, base: np.uint64, n: int) -> np.ndarray:
    while len(cache[0]) < n:
        t = cache[0]
        with np.errstate(over="ignore"):
            cache[0] = np.concatenate([t, t * (t[-1] * base)])
    return cache[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of several texts, and the number of words of each text.

    raw: the texts' UTF-8 bytes, each text followed by one space; ends: index of that space for each text.
    """
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    space = _SPACE[raw]
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    last = space.copy()
    last[0] = False
    last[1:] &= word[:-1]
    stops = np.flatnonzero(last)
    b = (_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(b * _table(_powers, _P, len(raw))[: len(raw)], out=total[1:])
        h = (total[stops] - total[starts]) * _table(_inverse_powers, _INV, len(raw))[starts]
        h = mix(h + (stops - starts).astype(np.uint64))
    upto = np.searchsorted(starts, ends)
    return h, np.diff(upto, prepend=0)


def packs(texts, rows: int = 4096, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string array of Arrow into packs of about `size` bytes: first row, end row, bytes, ends. Nulls are empty."""
    import pyarrow as pa

    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    length = np.diff(offsets)
    if texts.null_count:
        length = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, length)
    at = 0
    while at < n:
        upto = min(n, at + rows)
        sizes = np.cumsum(length[at:upto] + 1)
        upto = at + max(1, int(np.searchsorted(sizes, size, side="right")))
        sizes = sizes[: upto - at]
        ends = sizes - 1
        raw = np.full(int(sizes[-1]), 32, np.uint8)
        if not texts.null_count:  # the texts lie side by side: one copy around the gaps
            keep = np.ones(len(raw), bool)
            keep[ends] = False
            raw[keep] = data[offsets[at] : offsets[upto]]
        else:
            for k in range(at, upto):
                raw[ends[k - at] - length[k] : ends[k - at]] = data[offsets[k] : offsets[k] + length[k]]
        yield at, upto, raw, ends
        at = upto
