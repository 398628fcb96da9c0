"""A table of rows by key: writes append, reads take a key's latest row, compaction keeps the latest rows.

Rows lie in folders by hash of the key, so that a read of a few keys opens few files. A write is one commit of new files.
Compaction writes the rows that count to a new folder and then names it; readers see the old folder or the new one. One
writer at a time; readers are many.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators import service
from quaestor.sources.tables import exists, remove

ROW = "key string, ts timestamp, tie string, payload string"
#: Files of the table beyond which a write compacts it.
FILES = 256


class Keyed:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, keep: int = 5000):
        self.spark, self.path, self.buckets, self.keep = spark, path.rstrip("/"), buckets, keep

    def _folder(self) -> tuple[int, str | None]:
        if not exists(self.spark, f"{self.path}/folders"):
            return 0, None
        last = self.spark.read.parquet(f"{self.path}/folders").orderBy(F.desc("n")).first()
        return last.n, last.folder

    def _rows(self, folder: str | None) -> DataFrame:
        if folder is None or not exists(self.spark, f"{self.path}/{folder}"):
            return self.spark.createDataFrame([], f"{ROW}, bucket int")
        return self.spark.read.schema(f"{ROW}, bucket int").parquet(f"{self.path}/{folder}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.select(*[c.split()[0] for c in ROW.split(", ")], self._bucket()).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def _publish(self, n: int, folder: str) -> None:
        self.spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/folders/n={n}")

    def put(self, rows: DataFrame) -> None:
        """Adds key, payload; earlier rows of the keys count no more."""
        n, folder = self._folder()
        if folder is None:
            folder = uuid.uuid4().hex
            self._publish(n + 1, folder)
        self._write(rows.select("key", F.current_timestamp().alias("ts"), F.uuid().alias("tie"), "payload"), folder)
        if len(self._rows(folder).inputFiles()) > FILES:
            self.compact()

    def get(self, keys: DataFrame) -> DataFrame:
        """key, payload of the keys that the table has: only their buckets are read."""
        asked = keys.select("key").distinct()
        buckets = [r.bucket for r in asked.select(self._bucket()).distinct().collect()]  # at most `buckets`
        rows = self._rows(self._folder()[1]).where(F.col("bucket").isin(buckets)).join(asked, "key", "left_semi")
        return rows.groupBy("key").agg(F.max_by("payload", F.struct("ts", "tie")).alias("payload"))

    def compact(self) -> None:
        """Of each key the latest row, and of those the `keep` latest."""
        n, folder = self._folder()
        if folder is None:
            return
        fresh = uuid.uuid4().hex
        self._write(service.latest(self._rows(folder).drop("bucket"), "key", "ts", "tie", self.keep), fresh)
        self._publish(n + 1, fresh)
        remove(self.spark, f"{self.path}/{folder}")
