"""Request telemetry: latency percentiles, window summaries, shares, token costs, answer quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.text import token_estimate


def from_events(events: DataFrame) -> DataFrame:
    """Events read as a request log: the type is the endpoint, the value the latency."""
    status = F.when(F.col("event_type") == "error", "error").when(F.pmod("user_id", F.lit(10)) == 0, "cached").otherwise("ok")
    engine = F.element_at(F.array(F.lit("graph"), F.lit("vector"), F.lit("hybrid")), (F.pmod("user_id", F.lit(3)) + 1).cast("int"))
    return events.select(
        F.col("event_id").alias("request_id"), "ts", F.col("event_type").alias("endpoint"), status.alias("status"), engine.alias("engine"), (F.col("value") * 10).alias("latency_ms"),
        (F.length("props") * 10).cast("long").alias("prompt_tokens"), F.pmod("user_id", F.lit(50)).alias("completion_tokens"), (F.col("value") * 8).alias("llm_ms"), F.pmod("user_id", F.lit(2)).cast("int").alias("routed"),
    )


def _latency(c: str = "latency_ms") -> list[Column]:
    q = [F.round(F.expr(f"percentile({c}, {p})"), 1).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return [F.count(F.lit(1)).alias("n"), *q, F.round(F.avg(c), 1).alias("mean_ms"), F.round(F.max(c), 1).alias("max_ms")]


def latency(requests: DataFrame, by: list[str]) -> DataFrame:
    """Interpolated percentiles, mean and maximum of each group."""
    return requests.groupBy(*by).agg(*_latency())


def stage_latency(requests: DataFrame) -> DataFrame:
    """The same of each stage; requests carry stages: map<stage, ms>. Only successful ones count."""
    s = requests.where("status = 'ok'").select(F.explode("stages").alias("stage", "latency_ms"))
    return s.groupBy("stage").agg(*_latency())


def recent(requests: DataFrame, now: str, window: str) -> DataFrame:
    """Requests of the last `window` before `now`: a range that reaches the scan."""
    end = F.lit(now).cast("timestamp_ntz")
    return requests.where((F.col("ts") >= end - F.expr(f"INTERVAL {window}")) & (F.col("ts") < end))


def summary(requests: DataFrame) -> DataFrame:
    """One row: counts, rates, throughput over the time seen, tokens, latency of successful requests."""
    ok, cached = F.col("status") == "ok", F.col("status") == "cached"
    of = lambda c: F.when(ok, F.col(c))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    s = requests.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("ok"), F.count_if(cached).alias("cached"), ((us(F.max("ts")) - us(F.min("ts"))) / 1e6).alias("span"),
        F.sum(of("prompt_tokens")).alias("prompt_tokens"), F.sum(of("completion_tokens")).alias("completion_tokens"), F.sum(of("llm_ms")).alias("llm_ms"),
        F.percentile(of("latency_ms"), F.array(F.lit(0.5), F.lit(0.95))).alias("q"),
    )
    errors = F.col("requests") - F.col("ok") - F.col("cached")
    return s.select(
        "requests", errors.alias("errors"), F.round(errors / F.col("requests"), 4).alias("error_rate"), F.round(F.col("cached") / (F.col("ok") + F.col("cached")), 4).alias("cache_hit_rate"),
        F.round(F.col("requests") / F.greatest("span", F.lit(1.0)) * 60, 3).alias("requests_per_min"), "prompt_tokens", "completion_tokens",
        F.round(F.col("completion_tokens") / (F.col("llm_ms") / 1000), 2).alias("tokens_per_s"), F.round(F.col("q")[0], 1).alias("p50"), F.round(F.col("q")[1], 1).alias("p95"),
    )


def shares(requests: DataFrame) -> DataFrame:
    """Successful requests in all, by engine and by endpoint."""
    g = requests.where("status = 'ok'").groupingSets([[], ["engine"], ["endpoint"]], "engine", "endpoint")
    out = g.agg(F.count(F.lit(1)).alias("n"), F.sum("routed").alias("routed"), F.round(F.avg("latency_ms"), 4).alias("mean_ms"))
    return out.select(F.coalesce("engine", F.lit("all")).alias("engine"), F.coalesce("endpoint", F.lit("all")).alias("endpoint"), "n", "routed", "mean_ms")


def token_cost(turns: DataFrame, input_per_m: float, output_per_m: float) -> DataFrame:
    """Estimated tokens and cost of each conversation. turns: conv_id, role, text."""
    n, answer = token_estimate(F.col("text")), F.col("role") == "assistant"
    part = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    t = turns.groupBy("conv_id").agg(part(~answer).alias("prompt_tokens"), part(answer).alias("completion_tokens"))
    return t.withColumn("cost_usd", (F.col("prompt_tokens") * input_per_m + F.col("completion_tokens") * output_per_m) / 1e6)


def answer_quality(turns: DataFrame) -> DataFrame:
    """For each assistant turn the share of what was retrieved (here the first words of earlier turns) that it cites.

    An earlier turn is seen through a window over its conversation, so conversations never meet.
    """
    word = F.when(F.col("role") != "assistant", F.nullif(F.substring_index("text", " ", 1), F.lit("")))
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    t = turns.withColumn("words", F.collect_set(word).over(w)).where("role = 'assistant'")
    cited = F.size(F.filter("words", lambda x: F.col("text").contains(x)))
    n = F.size("words")
    return t.select("conv_id", "turn", n.cast("long").alias("retrieved"), cited.cast("long").alias("cited"), F.when(n > 0, F.round(cited / n, 3)).alias("coverage"), F.length("text").cast("long").alias("answer_chars"))


def report(requests: DataFrame) -> dict:
    """A log's summary: counts and rates, latencies in all, by stage and by engine, tokens, cost and quality of successful requests.

    Only aggregates leave Spark: a row for each stage, engine and endpoint.
    """
    ok = F.col("status") == "ok"
    of = lambda c: F.when(ok, F.col(c))
    one = summary(requests).first().asDict()
    more = requests.agg(
        F.count_if(F.col("status") == "cached").alias("cached"), F.round(F.sum(of("cost_usd")), 6).alias("cost_usd"), F.round(F.avg(of("cost_usd")), 6).alias("mean_cost_usd"), F.round(F.avg(of("abstained")), 4).alias("abstention_rate"),
        F.round(F.avg(of("citation_coverage")), 4).alias("citation_coverage"), F.round(F.sum(of("prompt_tokens") + of("completion_tokens")) / F.count_if(ok), 1).alias("mean_tokens"),
    ).first().asDict()
    detail = requests.select("*", F.from_json("detail", "stage_ms map<string,double>, ttft_ms double").alias("d"))
    stages = stage_latency(detail.select("status", F.col("d.stage_ms").alias("stages")))
    first = detail.where(ok & F.col("d.ttft_ms").isNotNull()).select(F.col("d.ttft_ms").alias("latency_ms")).agg(*_latency())
    cached = requests.where("status = 'cached'").agg(*_latency())
    by = lambda df, key: {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in df.collect()}
    engines = requests.where(ok & F.col("engine").isNotNull()).groupBy("engine").agg(*_latency(), F.round(F.avg("routed"), 3).alias("routed_share"))
    return one | more | {"stages": by(stages, "stage"), "engines": by(engines, "engine"), "endpoints": {r.endpoint: r["count"] for r in requests.groupBy("endpoint").count().collect()}, "first_token": first.first().asDict(), "cached_latency": cached.first().asDict()}
