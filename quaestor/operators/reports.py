"""Reports of evaluation runs: summaries, costs of policies, exports of examples, releases, flat metrics.

Records are rows of (question_id, dataset, split, category, benchmark_category, task, engine, reward, latency_ms, llm_calls,
llm_ms, prompt_tokens, completion_tokens, answer), one for each engine's answer; choices are rows of (question_id,
router_engine).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import text as T

#: Characters of a snippet, citations of an answer, lengths of a showcase's questions and of a hero's.
SNIPPET, CITED, SHOWCASE, HERO = 320, 6, (40, 260), (30, 170)


def run_summary(records: DataFrame) -> DataFrame:
    """part, value, engine, n, reward, latency_ms, llm_calls: means over all, by category of text questions, and by task."""
    r = records.withColumn("text_category", F.when(F.col("task") != "numeric", F.col("benchmark_category")))
    g = r.groupingSets([["engine"], ["engine", "task"], ["engine", "text_category"]], "engine", "task", "text_category")
    s = g.agg(F.grouping("task").alias("no_task"), F.grouping("text_category").alias("no_cat"), F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("reward", "latency_ms", "llm_calls")])
    s = s.where("no_cat = 1 OR text_category IS NOT NULL")
    part = F.when(F.col("no_task") == 0, "task").when(F.col("no_cat") == 0, "category").otherwise("all")
    return s.select(part.alias("part"), F.coalesce("task", "text_category", F.lit("all")).alias("value"), "engine", "n", "reward", "latency_ms", "llm_calls")


def completeness(records: DataFrame, expected: int, failed: int) -> DataFrame:
    """One row: completed questions, expected ones, and whether the run is complete."""
    n = records.agg(F.countDistinct("question_id").alias("completed"))
    return n.select("completed", F.lit(expected).cast("long").alias("expected"), ((F.col("completed") == expected) & F.lit(failed == 0)).alias("complete"))


def policy_latency(records: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """policy, latency_ms: mean latency of always taking each engine, and of the router's choices. Unknown latencies do not count."""
    own = records.select(F.concat(F.lit("always_"), "engine").alias("policy"), "latency_ms")
    if choices is not None:
        routed = records.join(choices, (records["question_id"] == choices["question_id"]) & (records["engine"] == choices["router_engine"]))
        own = own.unionByName(routed.select(F.lit("router").alias("policy"), "latency_ms"))
    return own.groupBy("policy").agg(F.round(F.avg("latency_ms"), 1).alias("latency_ms"))


def selection(records: DataFrame, choices: DataFrame) -> DataFrame:
    """part, value, engine, n, share: how often the router takes each engine, over all and by category, task and dataset."""
    one = records.select("question_id", "dataset", "task", "benchmark_category").distinct().join(choices, "question_id")
    keys = ("benchmark_category", "task", "dataset")
    g = one.groupingSets([["router_engine"], *[["router_engine", k] for k in keys]], "router_engine", *keys)
    s = g.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), *[F.grouping(k).alias(f"no_{k}") for k in keys])
    part = F.coalesce(*[F.when(F.col(f"no_{k}") == 0, name) for k, name in zip(keys, ("category", "task", "dataset"), strict=True)], F.lit("all"))
    s = s.select(part.alias("part"), F.coalesce(*keys, F.lit("all")).alias("value"), F.col("router_engine").alias("engine"), "n")
    return s.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("part", "value")))


def abstentions(records: DataFrame) -> DataFrame:
    """engine, rate of answers that say they cannot answer."""
    return records.groupBy("engine").agg(F.round(F.avg(F.when(T.abstains(F.col("answer")), 1.0).otherwise(0.0)), 4).alias("rate"))


def ingestion_costs(runs: DataFrame) -> DataFrame:
    """Per document: latency, tokens and cost of each ingestion run. runs: run, docs, latency_ms, prompt_tokens, completion_tokens, cost_usd."""
    n = F.greatest("docs", F.lit(1))
    return runs.select("run", (F.col("latency_ms") / n).alias("latency_ms"), ((F.col("prompt_tokens") + F.col("completion_tokens")) / n).alias("tokens"), (F.col("cost_usd") / n).alias("cost_usd"))


def cost(backend: Column, prompt: Column, completion: Column, llm_ms: Column, input_per_m: float, output_per_m: float, per_hour: float) -> Column:
    """Dollars of a call: hosted models bill tokens, local ones the time that the machine works."""
    hosted = (prompt * input_per_m + completion * output_per_m) / 1e6
    return F.when(backend == "api", hosted).otherwise(llm_ms / 3_600_000 * per_hour)


def nearest_ranks(rows: DataFrame, group: list[str], value: str, qs: tuple[float, ...]) -> DataFrame:
    """group, n, p<q>: the value at the rank nearest to q of the way from the first to the last, halves to even ranks.

    No group is gathered: counts of equal values, a running sum over them, and the first that reaches the rank."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*group)
    upto = F.sum("k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = n.withColumn("upto", upto).withColumn("n", F.sum("k").over(w))
    return n.groupBy(*group).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * q), F.col(value))).alias(f"p{int(q * 100)}") for q in qs])


def telemetry(records: DataFrame) -> DataFrame:
    """engine, n, p50, p95 of latency by nearest rank, share of the model in the time, mean tokens of calls that had any."""
    ranks = nearest_ranks(records, ["engine"], "latency_ms", (0.5, 0.95))
    some = lambda c: F.avg(F.when(F.col(c) > 0, F.col(c))).alias(c)
    rest = records.groupBy("engine").agg((F.sum("llm_ms") / F.nullif(F.sum("latency_ms"), F.lit(0.0))).alias("llm_share"), some("prompt_tokens"), some("completion_tokens"))
    return ranks.join(rest, "engine")


def trimmed(citations: Column) -> Column:
    """The first CITED citations with SNIPPET characters each. citations: array<struct<doc_id, chunk_id, snippet>>."""
    return F.transform(F.slice(F.coalesce(citations, F.array()), 1, CITED), lambda c: F.struct(c["doc_id"].alias("doc_id"), c["chunk_id"].alias("chunk_id"), F.substring(F.coalesce(c["snippet"], F.lit("")), 1, SNIPPET).alias("snippet")))


def showcase(questions: DataFrame, per_cell: int) -> DataFrame:
    """Questions on which engines differ most, `per_cell` of each dataset and category; numeric questions are a cell of their own.

    questions: question_id, question, dataset, task, category, rewards (array<double>).
    """
    own = questions.where(F.length("question").between(*SHOWCASE))
    cell = F.when(F.col("task") == "numeric", "numeric").otherwise(F.col("category"))
    zero = F.transform("rewards", lambda x: F.coalesce(x, F.lit(0.0)))
    spread = F.array_max(zero) - F.array_min(zero)
    own = own.withColumn("cell", cell).withColumn("spread", spread)
    w = Window.partitionBy("dataset", "cell").orderBy(F.desc("spread"), F.abs(F.length("question") - 140), "question_id")
    return own.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= per_cell).select("dataset", "cell", "rank", "question_id")


def heroes(questions: DataFrame, limit: int = 12) -> DataFrame:
    """The first questions of readable length with predictions: chosen engine, its reward and the best reward.

    questions: question_id, question, predicted (map engine -> reward), rewards (map engine -> reward), router_engine (or null).
    """
    own = questions.where(F.length("question").between(*HERO) & F.col("predicted").isNotNull())
    best = F.array_max(F.transform(F.map_entries("predicted"), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]
    own = own.withColumn("chosen", F.coalesce("router_engine", best))
    return own.orderBy("question_id").limit(limit).select("question_id", "question", "chosen", F.col("rewards")[F.col("chosen")].alias("router_reward"), F.array_max(F.map_values("rewards")).alias("oracle_reward"))


def flat(metrics: DataFrame, key: str, nested: str) -> DataFrame:
    """key, path, value: the numbers of a nested JSON text, by the path to them. What is no number falls away."""

    @F.pandas_udf("map<string,double>")
    def leaves(texts):
        import json

        def walk(x, path):
            if isinstance(x, dict):
                for k, v in x.items():
                    yield from walk(v, [*path, str(k)])
            elif isinstance(x, (int, float)) and not isinstance(x, bool):
                yield "/".join(path), float(x)

        return texts.map(lambda t: dict(walk(json.loads(t), [])) if t else {})

    return metrics.select(key, F.explode(leaves(F.col(nested))).alias("path", "value"))


def release(files: DataFrame, tag: str, frozen_at: str, commit: str, metrics: DataFrame) -> DataFrame:
    """One row: the manifest of a release. files: name, sha256; metrics: name, value."""
    f = files.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "sha256")))).alias("files"))  # a release's files
    m = metrics.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metrics"))
    return f.crossJoin(m).select(F.lit(tag).alias("tag"), F.lit(frozen_at).alias("frozen_at"), F.lit(commit).alias("commit"), "files", "metrics")  # one row each


def newest(releases: DataFrame) -> DataFrame:
    """The manifest that was frozen last."""
    return releases.orderBy(F.desc("frozen_at"), F.desc("tag")).limit(1)
