"""Keeping operators of a service: picks per group, caches, workspaces, ingestion, splits and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.sources.tables import written


def round_robin(rows: DataFrame, group: str, order: list[Column | str], limit: int) -> DataFrame:
    """`limit` rows taken from the groups in turn, each group in its order; adds round."""
    w = Window.partitionBy(group).orderBy(*order)
    turn = rows.withColumn("round", F.row_number().over(w).cast("long")).where(F.col("round") <= limit)
    return turn.orderBy("round", group).limit(limit)


def top_per_group(rows: DataFrame, group: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group; adds rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def latest(rows: DataFrame, key: str, ts: str, tie: str, keep: int) -> DataFrame:
    """A keyed cache after its writes: the latest row of each key, and of those the `keep` latest."""
    best = rows.groupBy(key).agg(F.max(F.struct(ts, tie, *[c for c in rows.columns if c not in (key, ts, tie)])).alias("r")).select(key, "r.*")
    return best.orderBy(F.desc(ts), F.desc(tie)).limit(keep)


def evict(workspaces: DataFrame, now: Column, ttl: str, keep: int) -> DataFrame:
    """Workspaces with a verdict: expired (idle longer than ttl), evicted (beyond the `keep` latest), kept.

    How many are newer is counted in steps: a running sum over the counts of equal times.
    """
    alive = workspaces.withColumn("expired", F.col("last_used") < now - F.expr(f"INTERVAL {ttl}"))
    live = alive.where("NOT expired")
    n = live.groupBy("last_used").agg(F.count(F.lit(1)).alias("k"))
    newer = n.withColumn("newer", F.coalesce(F.sum("k").over(Window.orderBy(F.desc("last_used")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    ranked = live.join(newer, "last_used").withColumn("place", F.col("newer") + F.row_number().over(Window.partitionBy("last_used").orderBy("workspace_id")))
    verdict = F.when(F.col("place") > keep, "evicted").otherwise("kept")
    return alive.where("expired").select("workspace_id", "last_used", F.lit("expired").alias("verdict")).unionByName(ranked.select("workspace_id", "last_used", verdict.alias("verdict")))


def ingest(new: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is not known yet, one for each key."""
    return new.join(known.select(key), key, "left_anti").dropDuplicates([key])


def quota(docs: DataFrame, by: str, most_docs: int = 10, most_chars: int = 400_000) -> DataFrame:
    """Documents and characters of each workspace, and whether they are within its quota."""
    s = docs.groupBy(by).agg(F.countDistinct("doc_id").alias("docs"), F.sum(F.length("text")).alias("chars"))
    return s.withColumn("ok", (F.col("docs") <= most_docs) & (F.col("chars") <= most_chars))


def disjoint_splits(rows: DataFrame, splits: tuple[str, ...], report: str) -> DataFrame:
    """Rows without those whose report is in an earlier split: an anti-join by the report's first split."""
    order = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split"))
    first = rows.groupBy(report).agg(F.min(order).alias("first"))
    return rows.withColumn("_o", order).join(first, report).where("_o = first").drop("_o", "first")


def numbered(rows: DataFrame, by: str, key: str) -> DataFrame:
    """Adds n: the row's number (from 0) within `by` in the key's order. Ranges of keys are counted, so that no task orders a group."""
    keys = rows.groupBy(F.col(by).alias("_by"), F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_k"))
    keys = written(keys.repartitionByRange("_by", "_key").withColumn("_part", F.spark_partition_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = keys.groupBy("_by", "_part").agg(F.sum("_k").alias("_k"))  # a row for each range
    parts = parts.select("_by", "_part", F.coalesce(F.sum("_k").over(before.partitionBy("_by").orderBy("_part")), F.lit(0)).alias("_first"))
    inner = F.coalesce(F.sum("_k").over(before.partitionBy("_by", "_part").orderBy("_key")), F.lit(0)).alias("_inner")
    keys, own = keys.select("_by", "_key", "_part", inner), parts.withColumnRenamed("_by", "_b").withColumnRenamed("_part", "_p")
    keys = keys.join(own, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p"))).select("_by", "_key", (F.col("_first") + F.col("_inner")).alias("_first"))
    out = rows.join(keys, F.col(by).eqNullSafe(F.col("_by")) & F.col(key).eqNullSafe(F.col("_key")))
    return out.withColumn("n", F.col("_first") + F.row_number().over(Window.partitionBy(by, key).orderBy(F.lit(0))) - 1).drop("_by", "_key", "_first")


def bundles(docs: DataFrame, by: str, key: str, size: int = 8) -> DataFrame:
    """bundle of each document: runs of `size` in the key's order, for each split; numbers of four digits at least."""
    n = F.floor(F.col("n") / size).cast("long")
    return numbered(docs, by, key).withColumn("bundle", F.concat(F.col(by), F.format_string("_%04d", n))).drop("n")


def quality_gate(checks: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Failures of a release against its baseline. checks: name, baseline, current, n, expected_hash, actual_hash."""
    fails = F.array_compact(F.array(
        F.when(F.col("current").isNull(), F.lit("missing metric")),
        F.when(F.col("current") < F.col("baseline") - tolerance, F.lit("below tolerance")),
        F.when(F.col("n") <= 0, F.lit("no rows")),
        F.when(F.col("actual_hash").isNull(), F.lit("missing file")),
        F.when(F.col("actual_hash") != F.col("expected_hash"), F.lit("changed file")),
    ))
    return checks.select("name", F.explode(fails).alias("failure"))
