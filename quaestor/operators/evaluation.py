"""Ranking metrics, agreement, bootstrap intervals, policy comparison."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_seen(ranked: DataFrame, group: tuple[str, ...], key: str) -> DataFrame:
    """One row for each key of a group, at its first position, ranks renumbered."""
    one = ranked.groupBy(*group, key).agg(F.min("rank").alias("rank"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("rank", key)).cast("long"))


def ranking_scores(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per question: P, R and nDCG at each k, hit and reciprocal rank. Questions without gold have no row.

    ranked: question_id, rank, doc_id (repeats allowed); gold: question_id, doc_id.
    """
    gold = gold.select("question_id", "doc_id").distinct()
    sizes = gold.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_gold"))
    return _scores(sizes, first_seen(ranked, ("question_id",), "doc_id").join(gold, ["question_id", "doc_id"], "left_semi"), ks)


def shared_scores(ranked: DataFrame, asked: DataFrame, sets: DataFrame, without: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """ranking_scores where many questions share their gold, which is not written out for each of them.

    asked: question_id (once), set; sets: set, doc_id; without: question_id, doc_id of its set that is no gold for it.
    """
    sets = sets.select("set", "doc_id").distinct()
    less = without.select("question_id", "doc_id").distinct().join(asked, "question_id").join(sets, ["set", "doc_id"]).select("question_id", "doc_id")
    size = asked.join(sets.groupBy("set").agg(F.count(F.lit(1)).alias("n")), "set").select("question_id", "n")
    sizes = size.unionByName(less.select("question_id", F.lit(-1).cast("long").alias("n"))).groupBy("question_id").agg(F.sum("n").alias("n_gold")).where("n_gold > 0")
    found = first_seen(ranked, ("question_id",), "doc_id").join(asked, "question_id").join(sets, ["set", "doc_id"], "left_semi")
    return _scores(sizes, found.join(less, ["question_id", "doc_id"], "left_anti"), ks)


def _scores(sizes: DataFrame, found: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """sizes: question_id, n_gold; found: question_id, rank of the gold that was ranked."""
    hit = lambda k: F.count_if(F.col("rank") <= k)
    gain = lambda k: F.coalesce(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0))
    got = found.groupBy("question_id").agg(F.min("rank").alias("first"), *[hit(k).alias(f"h{k}") for k in ks], *[gain(k).alias(f"g{k}") for k in ks])
    all_ = sizes.join(got, "question_id", "left")
    h = lambda k: F.coalesce(F.col(f"h{k}"), F.lit(0)).cast("double")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_gold").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    cols = [c for k in ks for c in ((h(k) / k).alias(f"p_at_{k}"), (h(k) / F.col("n_gold")).alias(f"r_at_{k}"), (F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / ideal(k)).alias(f"ndcg_at_{k}"))]
    return all_.select("question_id", *cols, F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def averages(scores: DataFrame, digits: int = 4) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), digits).alias(c) for c in scores.columns if c != "question_id"])


def spearman(pairs: DataFrame) -> DataFrame:
    """One row: rank correlation of a and b, ties sharing their average rank. Ranks come from counts of distinct values."""

    def ranked(c: str) -> DataFrame:
        n = pairs.groupBy(c).agg(F.count(F.lit(1)).alias("k"))
        w = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return n.select(c, (F.sum("k").over(w) - (F.col("k") - 1) / 2.0).alias(f"r{c}"))

    return pairs.join(ranked("a"), "a").join(ranked("b"), "b").agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("spearman"))


def agreement(pairs: DataFrame, cut: float = 3) -> DataFrame:
    """One row over score pairs a, b: exact and within-1 agreement, mean absolute difference, bias, kappa at a >= cut."""
    d, x, y = F.col("b") - F.col("a"), F.col("a") >= cut, F.col("b") >= cut
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    s = pairs.agg(F.count(F.lit(1)).alias("n"), share(d == 0).alias("exact"), share(F.abs(d) <= 1).alias("within_1"), F.avg(F.abs(d)).alias("mad"), F.avg(d).alias("bias"), share(x == y).alias("po"), share(x).alias("px"), share(y).alias("py"))
    pe = F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py"))
    return s.select("n", "exact", "within_1", "mad", "bias", F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).alias("kappa"))


PRIME = 2**31 - 1
#: Above the k-th of these parts of PRIME a Poisson count of mean 1 is more than k.
POISSON = tuple(int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10))


def _below(v):
    """v modulo PRIME, in place, for numbers below 2**61: 2**31 is 1 modulo PRIME, and what is left is below twice PRIME."""
    import numpy as np

    high = v >> np.uint64(31)
    v &= np.uint64(PRIME)
    v += high
    np.minimum(v, v - np.uint64(PRIME), out=v)  # below PRIME the difference wraps around and is the larger
    return v


def poisson_counts(at):
    """How often a row counts in a resample, by place (of `places`): products, shifts and xor that SQL engines share."""
    import numpy as np

    x = _below(at.astype(np.uint64))
    for shift, factor in ((15, 48271), (13, 69621), (16, 16807)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
        x = _below(x)
    x, times = x.astype(np.uint32), np.zeros(len(x), np.uint8)
    for t in POISSON[:4]:
        above = x > np.uint32(t)
        times += above
    far = np.flatnonzero(above)  # one in fifty
    times[far] += np.searchsorted(np.array(POISSON[4:], np.uint32), x[far]).astype(np.uint8)
    return times


#: Numbers that a task mixes at a time, and cells of rows by resamples that it multiplies at a time: what a core's cache holds.
CELLS, WINDOW = 1 << 15, 1 << 17
#: From one resample to the next a row's place goes on by so much.
STRIDE = 7919


def places(k):
    """Columns r, q: the row's place in resample b is STRIDE * (q + b) + r, modulo PRIME."""
    c = F.pmod(F.pmod(k, F.lit(PRIME)) * 104729 + 12345, F.lit(PRIME))
    return [F.pmod(c, F.lit(STRIDE)).cast("int").alias("r"), F.floor(c / STRIDE).cast("int").alias("q")]


def _weigh(r: int, q, n, x, resamples: int, weight, total) -> None:
    """Adds rows of one r, by rising q (once each; n rows, x their sum), to the sums of the resamples.

    Their places lie on one line, row q at q to q + resamples of it, so rows that overlap share the counts of the line.
    """
    import numpy as np

    rows = np.empty((max(1, WINDOW // resamples), resamples))
    opens = np.concatenate(([0], np.flatnonzero(np.diff(q) > resamples) + 1, [len(q)]))
    for a, b in zip(opens[:-1], opens[1:], strict=True):
        first, size = int(q[a]), int(q[b - 1] - q[a]) + resamples
        line = np.empty(size)
        for k in range(0, size, CELLS):
            line[k : k + CELLS] = poisson_counts(np.arange(first + k, first + min(size, k + CELLS), dtype=np.int64) * STRIDE + r)
        for k in range(a, b, len(rows)):
            upto = min(b, k + len(rows))
            for i, p in enumerate((q[k:upto] - first).tolist()):
                rows[i] = line[p : p + resamples]
            sums = np.stack((n[k:upto], x[k:upto])) @ rows[: upto - k]
            weight += sums[0]
            total += sums[1]


def bootstrap(values: DataFrame, resamples: int = 10_000) -> DataFrame:
    """One row: n, mean, and the 2.5 and 97.5 percentiles of resampled means. values: k (row number or id), x.

    Each row counts in a resample as often as a Poisson law of mean 1 says, which for many rows is drawing with replacement:
    no draws, no joins. A task adds its rows to two sums for each resample, and only these leave it. Rows meet by the line that
    their places lie on, so counts are made once for a line (PRIME places in all), not once for a row and resample.
    Rows with a null take no part.
    """
    spark = values.sparkSession
    rows = values.select(F.col("k").cast("long").alias("k"), F.col("x").cast("double").alias("x")).where("k IS NOT NULL AND x IS NOT NULL")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weight, total = np.zeros(resamples), np.zeros(resamples)  # whole numbers below 2**53
        for batch in batches:
            if not batch.num_rows:
                continue
            r, q, x = (np.asarray(batch.column(c)) for c in ("r", "q", "x"))
            one = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (q[1:] != q[:-1]))))
            n, x, r, q = np.diff(np.append(one, len(r))).astype(np.float64), np.add.reduceat(x, one), r[one], q[one].astype(np.int64)
            ends = np.append(np.flatnonzero(r[1:] != r[:-1]) + 1, len(r))
            for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
                _weigh(int(r[a]), q[a:b], n[a:b], x[a:b], resamples, weight, total)
        if weight.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(weight), pa.array(total)], ["b", "w", "wx"])

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = rows.select(*places(F.col("k")), "x").repartition(parts, "r").sortWithinPartitions("r", "q")
    sums = lines.mapInArrow(run, "b long, w double, wx double")
    means = sums.groupBy("b").agg((F.sum("wx") / F.sum("w")).alias("m"))
    ci = means.agg(F.expr("percentile(m, array(0.025, 0.975))").alias("q"), F.avg(F.when(F.col("m") > 0, 1.0).otherwise(0.0)).alias("p_better"))  # resamples values
    return n.crossJoin(F.broadcast(ci)).select("n", "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "p_better", ((F.col("q")[0] > 0) | (F.col("q")[1] < 0)).alias("significant"))  # one row each


ENGINES = ("graph", "vector", "hybrid")


def policies(records: DataFrame) -> DataFrame:
    """policy, task, n, mean: always each engine, random, oracle and router, over all rows and by task.

    records: task, reward_<engine>, router_engine.
    """
    r = [F.col(f"reward_{e}") for e in ENGINES]
    router = F.coalesce(*[F.when(F.col("router_engine") == e, c) for e, c in zip(ENGINES, r, strict=True)])
    values = F.array(*[F.struct(F.lit(f"always_{e}").alias("policy"), c.alias("x")) for e, c in zip(ENGINES, r, strict=True)], F.struct(F.lit("random").alias("policy"), (sum(r[1:], r[0]) / len(r)).alias("x")), F.struct(F.lit("oracle").alias("policy"), F.greatest(*r).alias("x")), F.struct(F.lit("router").alias("policy"), router.alias("x")))
    long = records.select("task", F.explode(values).alias("v")).select("task", "v.*")
    return long.groupingSets([["policy"], ["policy", "task"]], "policy", "task").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))


def outright_wins(records: DataFrame) -> DataFrame:
    """winner (an engine, or tie), n, and how often the router picked a best engine."""
    r = [F.col(f"reward_{e}") for e in ENGINES]
    top = F.greatest(*r)
    best = F.size(F.filter(F.array(*r), lambda x: x == top))
    winner = F.when(best > 1, "tie")
    for e, c in zip(ENGINES, r, strict=True):
        winner = winner.when(c == top, e)
    router = F.coalesce(*[F.when(F.col("router_engine") == e, c) for e, c in zip(ENGINES, r, strict=True)])
    return records.select(winner.alias("winner"), F.when(router == top, 1.0).otherwise(0.0).alias("opt"), (top - router).alias("regret")).groupBy("winner").agg(F.count(F.lit(1)).alias("n"), F.avg("opt").alias("optimal_pick"), F.avg("regret").alias("regret"))
