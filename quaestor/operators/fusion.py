"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse(lists: DataFrame, k: int = 60, limit: int | None = None, group: str = "question_id", key: str = "doc_id") -> DataFrame:
    """group, rank, key, score. lists: group, list, rank (from 1), key.

    Each list counts a key once, at its first rank; later ranks are not renumbered. Ties go to the smaller key.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    first = lists.groupBy(group, "list", key).agg(F.min("rank").alias("rank"))
    scored = first.groupBy(group, key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    w = Window.partitionBy(group).orderBy(F.desc(F.round("score", 12)), key)
    out = scored.withColumn("rank", F.row_number().over(w).cast("long"))
    out = out.where(F.col("rank") <= limit) if limit else out
    return out.select(group, "rank", key, "score")
