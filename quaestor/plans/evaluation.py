"""Queries of the evaluation operators: ranking metrics, agreement, bootstrap, policies, request telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.operators import dense, evaluation, graph, telemetry
from quaestor.sources.tables import table


def _ranked(spark, d):
    """Scores of the neighbours of every 20th vector; gold are the nearby ids of its label, without its own."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0")
    ranked = dense.topk(q.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q")), v, 5)
    doc = F.floor(F.col("vec_id") / 2).cast("long").alias("doc_id")
    sets = v.where("vec_id % 3 = 0").groupBy(F.col("label").alias("set"), doc).agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"))
    asked = q.select(F.col("vec_id").alias("question_id"), F.col("label").alias("set"), doc)
    own = asked.join(sets, ["set", "doc_id"]).where("lo = question_id AND hi = question_id")  # it alone has this id in its set
    return evaluation.shared_scores(ranked.select("question_id", "rank", doc), asked.select("question_id", "set"), sets, own)


def ranking_metrics(spark, d):
    s = _ranked(spark, d)
    return s.select("question_id", *[F.round(c, 6).alias(c) for c in s.columns if c != "question_id"])


def retrieval_hit_mrr(spark, d):
    return evaluation.averages(_ranked(spark, d).select("question_id", "hit", "rr", "ndcg_at_5"))


def auc_rank(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") == 1, 1).otherwise(0).alias("label"), F.col("embedding")[0].cast("double").alias("score"))
    return graph.rank_auc(v).select(F.round("auc", 6).alias("auc"))


def spearman(spark, d):
    e = table(spark, d, "events").select(F.floor("value").alias("a"), F.pmod("user_id", F.lit(40)).alias("b"))
    return evaluation.spearman(e).select("n", F.round("spearman", 6).alias("spearman"))


def _scores(spark, d):
    return table(spark, d, "events").select(F.pmod("user_id", F.lit(6)).cast("double").alias("a"), F.pmod(F.col("user_id") + F.when(F.col("event_type") == "error", 1).otherwise(0), F.lit(6)).cast("double").alias("b"))


def agreement(spark, d):
    a = evaluation.agreement(_scores(spark, d))
    return a.select("n", *[F.round(c, 6).alias(c) for c in ("exact", "within_1", "mad", "bias", "kappa")])


def _values(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("k"), (F.col("value") / 100).alias("x"), (F.pmod("user_id", F.lit(10)) / 10.0).alias("y"))


def bootstrap_ci(spark, d):
    return evaluation.bootstrap(_values(spark, d).select("k", "x")).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


def paired_bootstrap(spark, d):
    return evaluation.bootstrap(_values(spark, d).select("k", (F.col("x") - F.col("y")).alias("x"))).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi", "p_better")], "significant")


def _records(spark, d):
    e = table(spark, d, "events")
    r = [F.round(F.pmod(F.col("user_id") * m + F.col("event_id"), F.lit(11)) / 10.0, 2).alias(f"reward_{n}") for m, n in zip((3, 5, 7), evaluation.ENGINES, strict=True)]
    return e.select("event_id", F.col("event_type").alias("task"), *r, F.element_at(F.array(*[F.lit(n) for n in evaluation.ENGINES]), (F.pmod("user_id", F.lit(3)) + 1).cast("int")).alias("router_engine"))


def policy_compare(spark, d):
    return evaluation.policies(_records(spark, d)).select("policy", F.coalesce("task", F.lit("all")).alias("task"), "n", F.round("mean", 6).alias("mean"))


def outright_wins(spark, d):
    return evaluation.outright_wins(_records(spark, d)).select("winner", "n", F.round("optimal_pick", 6).alias("optimal_pick"), F.round("regret", 6).alias("regret"))


def _requests(spark, d):
    return telemetry.from_events(table(spark, d, "events"))


def latency_percentiles(spark, d):
    return telemetry.latency(_requests(spark, d).where("status = 'ok'"), ["endpoint"])


def request_summary(spark, d):
    return telemetry.summary(_requests(spark, d))


def stage_latency(spark, d):
    r = _requests(spark, d).withColumn("stages", F.create_map(F.lit("retrieve"), F.col("latency_ms") / 5, F.lit("generate"), F.col("llm_ms")))
    return telemetry.stage_latency(r)


def engine_share(spark, d):
    return telemetry.shares(_requests(spark, d))


def metrics_window(spark, d):
    return telemetry.recent(_requests(spark, d), "2024-01-20 00:00:00", "10080 minutes").groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))


def recent_requests(spark, d):
    return _requests(spark, d).orderBy(F.desc("ts"), "request_id").limit(50).select("request_id", "endpoint", "status")


def token_cost(spark, d):
    c = telemetry.token_cost(table(spark, d, "conversations"), 1.0, 2.0)
    return c.select("conv_id", "prompt_tokens", "completion_tokens", F.round("cost_usd", 9).alias("cost_usd"))


def answer_quality(spark, d):
    c = table(spark, d, "conversations")
    return telemetry.answer_quality(c.select("conv_id", "turn", "role", "text"))


_REC = "r AS (SELECT event_id, event_type AS task, (user_id * 3 + event_id) % 11 / 10.0::DOUBLE AS a, (user_id * 5 + event_id) % 11 / 10.0::DOUBLE AS b, (user_id * 7 + event_id) % 11 / 10.0::DOUBLE AS c, user_id % 3 AS k FROM events), rr AS (SELECT *, CASE k WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS r, greatest(a, b, c) AS o FROM r)"
_REQ = "req AS (SELECT event_id AS request_id, ts, event_type AS endpoint, CASE WHEN event_type = 'error' THEN 'error' WHEN user_id % 10 = 0 THEN 'cached' ELSE 'ok' END AS status, ['graph', 'vector', 'hybrid'][(user_id % 3 + 1)::INT] AS engine, value * 10 AS latency_ms, (length(props) * 10)::BIGINT AS prompt_tokens, (user_id % 50)::BIGINT AS completion_tokens, value * 8 AS llm_ms, (user_id % 2)::INT AS routed FROM events)"
_LAT = ", ".join(f"round(quantile_cont(latency_ms, {q}), 1) AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99)) + ", round(avg(latency_ms), 1) AS mean_ms, round(max(latency_ms), 1) AS max_ms"
_RANKED = """n AS (SELECT q.vec_id AS question_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / ((sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) + 1e-8) * (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) + 1e-8)), 9) DESC, v.vec_id) AS rank FROM embeddings v JOIN embeddings q ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
u AS (SELECT question_id, vec_id // 2 AS doc_id, min(rank) AS rank FROM n WHERE rank <= 5 GROUP BY ALL), k AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY rank, doc_id) AS rank FROM u),
g AS (SELECT DISTINCT q.vec_id AS question_id, v.vec_id // 2 AS doc_id FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id AND v.vec_id % 3 = 0), gs AS (SELECT question_id, count(*) AS n_gold FROM g GROUP BY 1),
h AS (SELECT k.* FROM k JOIN g USING (question_id, doc_id)),
s AS (SELECT gs.question_id, n_gold, min(rank) AS first, """ + ", ".join(f"count(*) FILTER (rank <= {k})::DOUBLE AS h{k}, coalesce(sum(1 / log2(rank + 1.0)) FILTER (rank <= {k}), 0) AS g{k}" for k in (1, 3, 5)) + """ FROM gs LEFT JOIN h USING (question_id) GROUP BY ALL),
m AS (SELECT question_id, """ + ", ".join(f"h{k} / {k} AS p_at_{k}, h{k} / n_gold AS r_at_{k}, g{k} / list_sum([1 / log2(i + 1.0) FOR i IN range(1, least({k}, n_gold) + 1)]) AS ndcg_at_{k}" for k in (1, 3, 5)) + ", CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END AS hit, coalesce(1.0 / first, 0.0) AS rr FROM s)"  # fmt: skip
_METRICS = [f"{m}_at_{k}" for k in (1, 3, 5) for m in ("p", "r", "ndcg")] + ["hit", "rr"]
_MIX = "(b * 7919 + k % 2147483647 * 104729 + 12345) % 2147483647"
_ROUND = "xor({0}, {0} >> {1}) * {2} % 2147483647"
_TIMES = " + ".join(f"(h > {t})::INT" for t in evaluation.POISSON)
_BOOT = f"""n AS (SELECT count(*) AS n, avg(x) AS mean FROM v), b AS (SELECT unnest(range(0, 10000)) AS b),
h0 AS (SELECT b, x, {_MIX} AS h FROM v, b), h1 AS (SELECT b, x, {_ROUND.format('h', 15, 48271)} AS h FROM h0), h2 AS (SELECT b, x, {_ROUND.format('h', 13, 69621)} AS h FROM h1), h3 AS (SELECT b, x, {_ROUND.format('h', 16, 16807)} AS h FROM h2),
ws AS (SELECT b, x, {_TIMES} AS w FROM h3), ms AS (SELECT b, sum(w * x) / sum(w) AS m FROM ws WHERE w > 0 GROUP BY b),
ci AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END) AS p FROM ms)"""

QUERIES = {
    "ranking_metrics": (ranking_metrics, f"WITH {_RANKED} SELECT question_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _METRICS) + " FROM m"),
    "retrieval_hit_mrr": (retrieval_hit_mrr, f"WITH {_RANKED} SELECT count(*) AS n, round(avg(hit), 4) AS hit, round(avg(rr), 4) AS rr, round(avg(ndcg_at_5), 4) AS ndcg_at_5 FROM m"),
    "auc_rank": (auc_rank, "WITH r AS (SELECT label = 1 AS y, row_number() OVER (ORDER BY embedding[1]::DOUBLE, vec_id) AS r FROM embeddings) SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y)::DOUBLE * count(*) FILTER (NOT y)), 6) AS auc FROM r"),
    "spearman_avg_rank": (spearman, "WITH p AS (SELECT floor(value) AS a, user_id % 40 AS b FROM events), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM p) SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM r"),
    "agreement_kappa": (
        agreement,
        "WITH p AS (SELECT (user_id % 6)::DOUBLE AS a, ((user_id + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) % 6)::DOUBLE AS b FROM events), s AS (SELECT count(*) AS n, avg((a = b)::INT) AS exact, avg((abs(b - a) <= 1)::INT) AS within_1, avg(abs(b - a)) AS mad, avg(b - a) AS bias, avg(((a >= 3) = (b >= 3))::INT) AS po, avg((a >= 3)::INT) AS px, avg((b >= 3)::INT) AS py FROM p) SELECT n, round(exact, 6) AS exact, round(within_1, 6) AS within_1, round(mad, 6) AS mad, round(bias, 6) AS bias, round((po - (px * py + (1 - px) * (1 - py))) / (1 - (px * py + (1 - px) * (1 - py))), 6) AS kappa FROM s",
    ),
    "bootstrap_ci": (bootstrap_ci, f"WITH v AS (SELECT event_id AS k, value / 100 AS x FROM events), {_BOOT} SELECT n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM n, ci"),
    "paired_bootstrap": (paired_bootstrap, f"WITH v AS (SELECT event_id AS k, value / 100 - user_id % 10 / 10.0::DOUBLE AS x FROM events), {_BOOT} SELECT n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 6) AS p_better, lo > 0 OR hi < 0 AS significant FROM n, ci"),
    "policy_compare": (
        policy_compare,
        f"WITH {_REC}, l AS (SELECT task, unnest(['always_graph', 'always_vector', 'always_hybrid', 'random', 'oracle', 'router']) AS policy, unnest([a, b, c, (a + b + c) / 3, o, r]) AS x FROM rr) SELECT policy, coalesce(task, 'all') AS task, count(*) AS n, round(avg(x), 6) AS mean FROM l GROUP BY GROUPING SETS ((policy), (policy, task))",
    ),
    "outright_wins": (
        outright_wins,
        f"WITH {_REC} SELECT CASE WHEN (a = o)::INT + (b = o)::INT + (c = o)::INT > 1 THEN 'tie' WHEN a = o THEN 'graph' WHEN b = o THEN 'vector' ELSE 'hybrid' END AS winner, count(*) AS n, round(avg((r = o)::INT), 6) AS optimal_pick, round(avg(o - r), 6) AS regret FROM rr GROUP BY 1",
    ),
    "latency_percentiles": (latency_percentiles, f"WITH {_REQ} SELECT endpoint, count(*) AS n, {_LAT} FROM req WHERE status = 'ok' GROUP BY endpoint"),
    "request_summary": (
        request_summary,
        f"""WITH {_REQ} SELECT count(*) AS requests, count(*) FILTER (status = 'error') AS errors, round(count(*) FILTER (status = 'error') / count(*), 4) AS error_rate,
round(count(*) FILTER (status = 'cached') / count(*) FILTER (status IN ('ok', 'cached')), 4) AS cache_hit_rate, round(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE, 1.0) * 60, 3) AS requests_per_min,
sum(prompt_tokens) FILTER (status = 'ok')::BIGINT AS prompt_tokens, sum(completion_tokens) FILTER (status = 'ok')::BIGINT AS completion_tokens,
round(sum(completion_tokens) FILTER (status = 'ok') / (sum(llm_ms) FILTER (status = 'ok') / 1000), 2) AS tokens_per_s, round(quantile_cont(latency_ms, 0.5) FILTER (status = 'ok'), 1) AS p50, round(quantile_cont(latency_ms, 0.95) FILTER (status = 'ok'), 1) AS p95 FROM req""",
    ),
    "stage_latency": (stage_latency, f"WITH {_REQ}, s AS (SELECT unnest(['retrieve', 'generate']) AS stage, unnest([latency_ms / 5, llm_ms]) AS latency_ms FROM req WHERE status = 'ok') SELECT stage, count(*) AS n, {_LAT} FROM s GROUP BY stage"),
    "engine_share": (
        engine_share,
        f"WITH {_REQ} SELECT coalesce(engine, 'all') AS engine, coalesce(endpoint, 'all') AS endpoint, count(*) AS n, sum(routed)::BIGINT AS routed, round(avg(latency_ms), 4) AS mean_ms FROM req WHERE status = 'ok' GROUP BY GROUPING SETS ((), (engine), (endpoint))",
    ),
    "metrics_window": (metrics_window, f"WITH {_REQ} SELECT endpoint, count(*) AS n FROM req WHERE ts >= TIMESTAMP '2024-01-13 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY endpoint"),
    "recent_requests": (recent_requests, f"WITH {_REQ} SELECT request_id, endpoint, status FROM req ORDER BY ts DESC, request_id LIMIT 50"),
    "token_cost_estimate": (
        token_cost,
        "WITH t AS (SELECT conv_id, coalesce(sum(greatest(1, length(coalesce(text, '')) // 4)) FILTER (role <> 'assistant'), 0)::BIGINT AS p, coalesce(sum(greatest(1, length(coalesce(text, '')) // 4)) FILTER (role = 'assistant'), 0)::BIGINT AS c FROM conversations GROUP BY conv_id) SELECT conv_id, p AS prompt_tokens, c AS completion_tokens, round((p * 1.0::DOUBLE + c * 2.0::DOUBLE) / 1e6, 9) AS cost_usd FROM t",
    ),
    "answer_quality": (
        answer_quality,
        "WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), c AS (SELECT conv_id, turn, split_part(text, ' ', 1) AS word FROM conversations WHERE role <> 'assistant'), r AS (SELECT a.conv_id, a.turn, a.text, list_distinct(list(word) FILTER (word <> '')) AS words FROM a LEFT JOIN c ON a.conv_id = c.conv_id AND c.turn < a.turn GROUP BY ALL) SELECT conv_id, turn, len(coalesce(words, []))::BIGINT AS retrieved, len(list_filter(coalesce(words, []), lambda w: contains(text, w)))::BIGINT AS cited, CASE WHEN len(coalesce(words, [])) > 0 THEN round(len(list_filter(words, lambda w: contains(text, w))) / len(words)::DOUBLE, 3) END AS coverage, length(text) AS answer_chars FROM r",
    ),
}
