"""Sharding by fixed virtual slots.

Records hash into thousands of virtual slots; each slot's bytes are summed up; a versioned map says which shard holds a
slot, and rebalancing edits the map: the next version differs from the last in the slots that moved, and in no other.
Versions are stored as a table of slots and shards, and a later run starts from the last one.

Defined results: a null text has size 8; rows with equal ids and texts share a slot; an empty table gives an empty
result; a null id is hashed like a value. `slot` is the row's place in its shard, gapless from 0, in the order of
(virtual slot, id, checksum, size); `vslot` is the virtual slot.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, own_columns, read, scratch, spread, text_of

SLOTS = 8192


@dataclass
class SlotMap:
    """A version of the slot-to-shard map, and the edits that made it."""

    shards: list[int]
    n_shards: int
    version: int = 1
    edits: list[tuple[int, int, int]] = field(default_factory=list)  # slot, from, to

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table of maps, in one commit."""
        moved = {s for s, _, _ in self.edits}
        rows = [(self.version, self.n_shards, s, k, s in moved) for s, k in enumerate(self.shards)]
        spark.createDataFrame(rows, "version int, n_shards int, slot int, shard int, moved boolean").coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """The stored map of this version, or the last; None where none is stored."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return None
        maps = spark.read.parquet(path)
        last = version or maps.agg(F.max("version")).first()[0]
        rows = maps.where(F.col("version") == last).orderBy("slot").collect()  # a row for each slot
        return cls([r.shard for r in rows], rows[0].n_shards, last)

    @classmethod
    def even(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls([s % n_shards for s in range(n_slots)], n_shards)

    def rebalance(self, size: dict[int, int], n_shards: int | None = None) -> SlotMap:
        """The next version: the heaviest shard gives the slot that evens it out best to the lightest, until none helps.

        size has one entry for each slot at most, so it is bounded by the number of slots.
        """
        n = n_shards or self.n_shards
        to, load, held = list(self.shards), [0] * n, [set() for _ in range(n)]
        for s, k in enumerate(to):
            load[k] += size.get(s, 0)
            held[k].add(s)
        moved: dict[int, int] = {}
        while True:
            high, low = max(range(n), key=lambda k: (load[k], -k)), min(range(n), key=lambda k: (load[k], k))
            gap = load[high] - load[low]
            best = min((s for s in held[high] if 0 < size.get(s, 0) < gap), key=lambda s: (abs(2 * size[s] - gap), s), default=None)
            if best is None:
                break
            held[high].discard(best)
            held[low].add(best)
            load[high] -= size[best]
            load[low] += size[best]
            moved[best] = low
        edits = [(s, self.shards[s], k) for s, k in sorted(moved.items()) if self.shards[s] != k]
        for s, _, k in edits:
            to[s] = k
        return SlotMap(to, n, self.version + 1, edits)


def lightest_first(size: dict[int, int], n: int) -> int:
    """Bytes of the heaviest shard when slots go, largest first, to the lightest: what tests hold a map against."""
    heap = [0] * n
    for v in sorted(size.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + v)
    return max(heap)


def to_slots(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot: the text is read once and goes no further."""
    d = spread(own_columns(docs, "doc_id", "text")).select("doc_id", (F.octet_length(text_of()) + 8).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"))
    return d.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def place(docs: DataFrame, n_shards: int = 24, n_slots: int = SLOTS, at: SlotMap | None = None, maps: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Rows with their shard and place, and the map's new version: the edited map `at`, or the last of the table `maps`.

    The new version, and the even map where it is the first, go to `maps`. Rows of a slot are ordered in one task, so a slot
    is SLOTS-th of all rows; equal ids and texts share one.
    """
    spark = docs.sparkSession
    if maps and at is None and (at := SlotMap.load(spark, maps)) is None:
        at = SlotMap.even(n_slots, n_shards)
        at.save(spark, maps)
    n_slots = len(at.shards) if at else n_slots
    rows = cut(to_slots(docs, n_slots))
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # n_slots rows at most
    slot_map = (at or SlotMap.even(n_slots, n_shards)).rebalance({r.vslot: r.bytes for r in sums}, n_shards)
    if maps:
        slot_map.save(spark, maps)
    count, before, table = {r.vslot: r.n for r in sums}, [0] * n_shards, []
    for s, k in enumerate(slot_map.shards):
        table.append((s, k, before[k]))
        before[k] += count.get(s, 0)
    placed = spark.createDataFrame(table, "vslot int, shard int, before long")  # n_slots rows: small enough to broadcast
    w = Window.partitionBy("vslot").orderBy(F.asc_nulls_last("doc_id"), "text_crc32", "size")
    out = rows.withColumn("nth", F.row_number().over(w)).join(F.broadcast(placed), "vslot")
    return out.withColumn("slot", F.col("before") + F.col("nth") - 1), slot_map


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, slot_map = place(read(spark, sf_dir, "documents"), maps=scratch(spark))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(slot_map.version).alias("map_version"))
