"""Streams over files: windowed metrics, sessions, duplicates within a watermark, a sliding-log rate limiter, an online
bandit, incremental ingestion. Each takes a streaming DataFrame and works on a batch one where Spark allows it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quaestor.sources import tables


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's as a stream of files."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    if batch.inputFiles()[0].endswith(f"/{name}.parquet"):  # a single file: the folder holds other tables too
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def fresh(spark: SparkSession) -> str:
    return f"{tables.shared(spark)}/s-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream writes until its sources are read to the end, as a table in the shared folder."""
    spark, path = stream.sparkSession, fresh(stream.sparkSession)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")  # each batch has the whole result

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _stamped(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp"))


def window_metrics(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Requests, errors and mean latency of each window and type; complete output, so late rows within `late` count."""
    g = _stamped(events).withWatermark("at", late).groupBy(F.window("at", length).alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("mean")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user: start, end and number of events."""
    g = _stamped(events).withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id")
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "40 days") -> DataFrame:
    """The first event of each user and type that comes, within the watermark."""
    return _stamped(events).withWatermark("at", late).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def limited(events: DataFrame, limit: int = 1, window_s: float = 3600.0, late: str = "1 day") -> DataFrame:
    """Each event with allowed and retry_after (seconds, when rejected). A rejected event does not count later.

    The state of a key is the times of its allowed events within the window: `limit` at most. It goes when the watermark has
    passed the window of the last one, so that keys that fell silent hold nothing.
    """

    def run(key, chunks, state):
        import math

        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(chunks)).sort_values(["t", "event_id"])
        out = []
        for i, t in zip(rows.event_id, rows.t, strict=True):
            log = [x for x in log if t - x < window_s]
            if len(log) >= limit:
                out.append((int(i), key[0], False, max(1, math.ceil(window_s - (t - log[0])))))
            else:
                log.append(float(t))
                out.append((int(i), key[0], True, 0))
        state.update((log,))
        state.setTimeoutTimestamp(max(int((log[-1] + window_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "allowed", "retry_after"])

    rows = _stamped(events).withWatermark("at", late).select("event_id", "user_id", "at", (F.unix_micros("at") / 1e6).alias("t"))
    return rows.groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, allowed boolean, retry_after long", "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


#: Results that the bandit's worker holds at a time.
OUT = 4096


def online_bandit(events: DataFrame, alpha: float = 0.5, dim: int = 3) -> DataFrame:
    """Per key (event type) a bandit that picks one of two arms for each event, sees its reward, and learns from it.

    State: for each arm A and b, dim * dim + dim numbers. Rewards are the event's value for arm 0, its complement for arm 1.
    """

    def run(key, chunks, state):
        import numpy as np
        import pandas as pd

        n = dim * dim + dim
        s = np.array(state.get[0]).reshape(2, n) if state.exists else np.tile(np.append(np.eye(dim).ravel(), np.zeros(dim)), (2, 1))
        columns = list(zip(*([c[k].to_numpy() for k in ("t", "event_id", "x1", "x2", "reward")] for c in chunks)))  # numbers only: a key can have many events
        t, ids, x1, x2, reward = (np.concatenate(columns.pop(0)) for _ in range(5))
        order = np.lexsort((ids, t))
        del t
        for at in range(0, len(order), OUT):
            out = []
            for k in order[at : at + OUT]:
                x = np.array([x1[k], x2[k], 1.0])
                inverse = [np.linalg.inv(a[: dim * dim].reshape(dim, dim)) for a in s]
                ucb = [x @ (v @ a[dim * dim :]) + alpha * np.sqrt(max(x @ v @ x, 0.0)) for v, a in zip(inverse, s, strict=True)]
                arm = int(ucb[1] > ucb[0])
                got = reward[k] if arm == 0 else 1 - reward[k]
                s[arm, : dim * dim] += np.outer(x, x).ravel()
                s[arm, dim * dim :] += got * x
                out.append((int(ids[k]), arm, float(got)))
            yield pd.DataFrame(out, columns=["event_id", "arm", "reward"])
        state.update((s.ravel().tolist(),))

    rows = events.select("event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.pmod("user_id", F.lit(10)) / 10.0).alias("x1"), (F.hour("ts") / 24.0).alias("x2"), F.least(F.col("value") / 100, F.lit(1.0)).alias("reward"))
    return rows.groupBy("event_type").applyInPandasWithState(run, "event_id long, arm int, reward double", "s array<double>", "append", GroupStateTimeout.NoTimeout)


def ingested(docs: DataFrame, known: DataFrame) -> DataFrame:
    """New documents of a stream: an anti-join with what is known already."""
    return docs.join(known.select("doc_id"), "doc_id", "left_anti")
