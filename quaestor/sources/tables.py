"""Reading the engine's tables, and sending the package to the executors."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are long texts.
LONG = ("documents", "pages")
#: Bytes of an Arrow batch of such rows on its way to a Python worker.
BATCH = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once, unless they find it by the path they inherit."""
    package = Path(__file__).resolve().parent.parent
    inherited = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(package.parent) in inherited or spark.conf.get("spark.quaestor.shipped", None) == spark.sparkContext.applicationId:
        return
    folder = tempfile.mkdtemp()
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
    spark.conf.set("spark.quaestor.shipped", spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; those of long texts are dealt to all cores if their files are fewer."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name in LONG and spark.conf.get(key).rstrip("b") == str(64 << 20):  # Spark's default
        spark.conf.set(key, str(BATCH))
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in LONG and df._jdf.rdd().getNumPartitions() < cores else df


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, with a local default where all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{tempfile.gettempdir()}/quaestor-{spark.sparkContext.applicationId}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: what follows starts from files that survive lost executors."""
    path = f"{shared(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def derived(spark: SparkSession, sf_dir: str, source: str, name: str, make: Callable[[str], None]) -> str:
    """The folder of something made from a table, such as an index: made once in a session for each state of the table's files.

    make writes it to a fresh folder; only whole ones are remembered.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{source}.parquet")
    state = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    key = f"spark.quaestor.derived.{uuid.uuid5(uuid.NAMESPACE_URL, f'{spark.sparkContext.applicationId} {sf_dir} {source} {name} {state.getModificationTime()} {state.getLen()}').hex}"
    path = spark.conf.get(key, None)
    if path is None or not exists(spark, path):
        path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
        make(path)
        spark.conf.set(key, path)
    return path
