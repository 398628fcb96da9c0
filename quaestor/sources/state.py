"""State in Parquet: workspaces as partitions, checkpoints by fingerprint, validated reward files, digests of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REWARDS = "question_id string, dataset string, split string, task string, category string, context array<double>, reward_graph double, reward_vector double, reward_hybrid double, signature string"


def check_workspace(workspace: str) -> None:
    if not 16 <= len(workspace) <= 32 or set(workspace) - set("abcdef0123456789"):
        raise ValueError("a workspace id is 16 to 32 characters of a-f and 0-9")


def save(df: DataFrame, path: str, workspace: str) -> None:
    """Replaces one workspace's rows, and no other's."""
    check_workspace(workspace)
    df.withColumn("workspace_id", F.lit(workspace)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace_id").parquet(path)


def load(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("workspace_id") == workspace).drop("workspace_id")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over the parts as JSON, in their order."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"c{k}") for k, p in enumerate(parts)])).cast("binary"), 256)


def pending(work: DataFrame, done: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Work without a checkpoint."""
    return work.join(done.select(key), key, "left_anti")


def extracted(spark: SparkSession, chunks: DataFrame, path: str, extract, version: str = "1") -> DataFrame:
    """doc_id, chunk_id, res, response of all chunks: kept responses for those whose text was asked about before, new ones for the rest.

    A response counts only if it holds both lists; new ones are appended in one commit. chunks: doc_id, chunk_id, res, text.
    """
    work = chunks.withColumn("fingerprint", fingerprint(F.lit(version), F.col("text")))
    whole = F.get_json_object("response", "$.entities").isNotNull() & F.get_json_object("response", "$.triples").isNotNull()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = spark.createDataFrame([], "fingerprint string, response string")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        done = spark.read.schema(done.schema).parquet(path).where(whole)
    new = pending(work, done).dropDuplicates(["fingerprint"])
    found = extract(new).join(new.select("chunk_id", "fingerprint"), "chunk_id")
    found.where(whole).select("fingerprint", "response").write.mode("append").parquet(path)
    kept = spark.read.schema(done.schema).parquet(path).where(whole).dropDuplicates(["fingerprint"])
    return work.join(kept, "fingerprint").select("doc_id", "chunk_id", "res", "response")


def rewards(spark: SparkSession, path: str) -> DataFrame:
    """Reward records of a JSON-lines file; raises if any is invalid, or if runs of different settings are mixed."""
    df = spark.read.schema(REWARDS).json(path)
    bad = invalid(df).first()
    if bad.invalid or bad.signatures > 1:
        raise ValueError(f"{bad.invalid} invalid records, {bad.signatures} signatures")
    return df


def invalid(df: DataFrame) -> DataFrame:
    """One row: number of invalid reward records, and of signatures."""
    r = [F.col(c) for c in df.columns if c.startswith("reward_")]
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1)
    ok = F.lit(True)
    for x in r:
        ok = ok & fine(x)
    ok = ok & (F.col("split") == "train") & (F.size("context") == 8) & F.forall("context", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid"), F.countDistinct("signature").alias("signatures"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of each file of a folder."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
