"""Queries of the graph's build, summaries, question rules, blinding, splits and run reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.operators import build, engines, judging, questions, reports, rgcn, summaries
from quaestor.plans import corpora
from quaestor.sources import datasets
from quaestor.sources.tables import table, written

# -- a graph of nations: companies by declaration, their region as segment, their keys as values


def _items(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(F.concat(F.lit("r"), "r_regionkey").alias("doc_id"), F.col("n_nationkey").cast("int").alias("res"), F.lit(False).alias("exact"), "n_name", "r_name", "n_nationkey")
    e = n.select("doc_id", "res", "exact", F.lit(0).alias("pos"), F.col("n_name").alias("name"), F.lit("Company").alias("type"), F.concat(F.lit("nation of "), "r_name").alias("description"))
    t = lambda pos, p, o: n.select("doc_id", "res", "exact", F.lit(pos).alias("pos"), F.col("n_name").alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.concat_ws("::", "doc_id", F.col("n_nationkey").cast("string")).alias("chunk_id"), F.lit("").alias("evidence"))
    return e, t(0, "lies in", F.col("r_name")).unionByName(t(1, "has key", F.concat(F.lit(" $ "), F.col("n_nationkey").cast("string")))).unionByName(t(2, "trend", F.lit("Up")))


def _graph(spark, d):
    return build.build(*_items(spark, d), meaning=False)


def graph_nodes(spark, d):
    return _graph(spark, d).nodes.select("node", "type", "description", F.array_join("source_docs", ",").alias("docs"))


def graph_edges(spark, d):
    return _graph(spark, d).edges.select("src", "dst", "predicate", "doc_id", "chunk_id")


def graph_values(spark, d):
    return _graph(spark, d).values.select("node", "predicate", "value", "doc_id", "chunk_id")


def graph_stats(spark, d):
    return build.stats(_graph(spark, d))


def fact_texts(spark, d):
    g = _graph(spark, d)
    return build.fact_texts(g.edges, g.values).select("node", "fact")


def _trade(spark, d):
    """Nations of one region as a community; an edge for each pair that trades, the first order as its document."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    c, s, n = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "nation")
    name = n.select("n_nationkey", "n_name")
    t = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    t = t.join(F.broadcast(name.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("src"))), "c_nationkey").join(F.broadcast(name.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst"))), "s_nationkey")  # 25 nations
    edges = t.select("src", "dst", F.lit("buys from").alias("predicate"), F.col("l_orderkey").alias("doc_id"))
    members = n.select(F.col("n_name").alias("node"), F.col("n_regionkey").alias("community"))
    nodes = n.select(F.col("n_name").alias("node"), F.lit("Nation").alias("type"), F.lit("a nation").alias("description"))
    values = s.join(F.broadcast(name), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("node"), F.lit("supplier").alias("predicate"), F.col("s_suppkey").cast("string").alias("value"), F.col("s_nationkey").alias("doc_id"))
    return members, nodes, edges, values


def community_prompts(spark, d):
    p = summaries.prompts(summaries.lines(*_trade(spark, d)))
    return p.select("community", F.length("prompt").cast("long").alias("chars"), F.md5(F.col("prompt").cast("binary")).alias("md5"))


class _Lines:
    """A stand-in for a model: the first line is the title, the number of lines the summary."""

    def chat(self, system, user, limit):
        import json

        rows = user.splitlines()
        return json.dumps({"title": rows[0], "summary": f"{len(rows)} lines"}), False


def community_summaries(spark, d):
    s = summaries.summarised(*_trade(spark, d), _Lines())
    return s.select("community", "level", F.array_join("members", ",").alias("members"), "title")


def rgcn_vectors(spark, d):
    """Vectors of suppliers and parts after training on their links."""
    ps = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("sells").alias("predicate"))
    ps = written(ps.distinct())  # read for the fit, the nodes and the vectors
    nodes = ps.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.substring("node", 1, 1).alias("type"), F.lit("").alias("description"))
    nodes = written(nodes)
    model = rgcn.trained(nodes, ps, epochs=20)
    return rgcn.vectors(nodes, ps, model).select("node", F.size("embedding").alias("dim"), F.round(F.col("embedding")[0], 4).alias("first"))


def graph_evidence(spark, d):
    """The graph engine alone, for every benchmark question."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.array(F.concat(F.lit("src"), F.col("item_id").cast("string"))).alias("entities"))
    return engines.evidence(q, corpora._corpus(spark, d), "graph").select("question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


# -- questions


def question_rules(spark, d):
    """A question about each document, most of them with a fault."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.pmod("doc_id", F.lit(6))
    quote = F.substring("text", 1, 40)
    quote = F.when(k == 3, F.concat(quote, F.lit("zzzzzzzzzzzzzzz"))).when(k == 4, F.lit("ab")).otherwise(quote)
    e = F.array(F.struct(F.when(k == 5, F.lit(-1).cast("long")).otherwise(F.col("doc_id")).alias("doc_id"), quote.alias("quote")))
    c = docs.select(
        F.col("doc_id").alias("ord"), F.lit("local").alias("wanted"), F.when(k == 0, "global").otherwise("local").alias("category"), F.format_string("What does  %d say? ", F.pmod("doc_id", F.lit(50))).alias("question"),
        F.lit("r").alias("reference"), F.when(k != 1, "x").alias("reasoning"), e.alias("evidence"),
    )
    return questions.judged(c, docs).select("ord", F.coalesce("refused", F.lit("accepted")).alias("verdict"))


def blinded_labels(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.explode(F.array(*[F.lit(e) for e in engines.ENGINES])).alias("engine"), F.lit("").alias("answer"))
    return judging.blinded(b).select("question_id", "engine", "label")


def _examples(spark, d):
    docs = table(spark, d, "documents")
    split = F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return docs.select(F.col("doc_id").cast("string").alias("id"), split.alias("split"), F.concat_ws("/", "source", F.pmod("doc_id", F.lit(7)).cast("string")).alias("report"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit("h").alias("human"), F.lit("p").alias("program"), F.coalesce("text", F.lit("")).alias("text"), F.array(F.lit("quote")).alias("quotes"))


def split_bundles(spark, d):
    return datasets.prepared(_examples(spark, d), {"train": 40, "dev": 20, "test": 20}, seed=7).select("id", "split", "report", "doc_id", "bundle")


# -- reports


def _answers(spark, d):
    e = table(spark, d, "events")
    per = F.explode(F.array(*[F.struct(F.lit(n).alias("engine"), F.lit(m).alias("m")) for n, m in zip(engines.ENGINES, (3, 5, 7), strict=True)])).alias("x")
    r = e.select("event_id", "user_id", "value", "event_type", per).select("*", "x.*")
    task = F.when(F.pmod("event_id", F.lit(4)) == 0, "numeric").otherwise("text")
    return r.select(
        F.col("event_id").alias("question_id"), F.when(F.pmod("user_id", F.lit(2)) == 0, "one").otherwise("two").alias("dataset"), "engine", task.alias("task"), F.col("event_type").alias("benchmark_category"),
        (F.pmod(F.col("user_id") * F.col("m") + F.col("event_id"), F.lit(11)) / 10.0).alias("reward"), F.when(F.pmod("event_id", F.lit(9)) != 0, F.col("value") * F.col("m")).alias("latency_ms"), F.pmod("user_id", F.col("m")).alias("llm_calls"),
        (F.col("value") * 2).alias("llm_ms"), F.pmod("user_id", F.lit(5)).alias("prompt_tokens"), F.pmod("user_id", F.lit(3)).alias("completion_tokens"), F.when(F.pmod("event_id", F.lit(8)) == 0, "It cannot be determined.").otherwise("42").alias("answer"),
    )


def _choices(spark, d):
    names = F.array(*[F.lit(n) for n in engines.ENGINES])
    return table(spark, d, "events").select(F.col("event_id").alias("question_id"), F.element_at(names, (F.pmod("user_id", F.lit(3)) + 1).cast("int")).alias("router_engine"))


def run_summary(spark, d):
    s = reports.run_summary(_answers(spark, d))
    return s.select("part", "value", "engine", "n", *[F.round(c, 6).alias(c) for c in ("reward", "latency_ms", "llm_calls")])


def run_completeness(spark, d):
    return reports.completeness(_answers(spark, d), 1000, 0)


def policy_latency(spark, d):
    return reports.policy_latency(_answers(spark, d), _choices(spark, d))


def selection_share(spark, d):
    return reports.selection(_answers(spark, d), _choices(spark, d)).select("part", "value", "engine", "n", F.round("share", 6).alias("share"))


def abstention_rate(spark, d):
    return reports.abstentions(_answers(spark, d))


def nearest_rank(spark, d):
    t = reports.telemetry(_answers(spark, d))
    return t.select("engine", "n", "p50", "p95", *[F.round(c, 6).alias(c) for c in ("llm_share", "prompt_tokens", "completion_tokens")])


def ingestion_costs(spark, d):
    e = table(spark, d, "events")
    usd = reports.cost(F.when(F.col("event_type") == "error", "api").otherwise("local"), F.col("user_id"), F.pmod("user_id", F.lit(7)), F.col("value") * 100, 1.37, 6.1, 0.41)
    costs = reports.ingestion_costs(e.select(F.col("event_id").alias("run"), F.pmod("user_id", F.lit(4)).alias("docs"), (F.col("value") * 7.31).alias("latency_ms"), F.col("user_id").alias("prompt_tokens"), F.pmod("user_id", F.lit(7)).alias("completion_tokens"), usd.alias("cost_usd")))
    return costs.select("run", F.round("latency_ms", 6).alias("latency_ms"), F.round("tokens", 6).alias("tokens"), F.round("cost_usd", 12).alias("cost_usd"))


def showcase_disagreement(spark, d):
    a = _answers(spark, d).groupBy("question_id", "dataset", "task", F.col("benchmark_category").alias("category")).agg(F.collect_list("reward").alias("rewards"))  # a reward for each engine
    q = table(spark, d, "events").select(F.col("event_id").alias("question_id"), F.col("props").alias("question"))
    return reports.showcase(a.join(q, "question_id").withColumn("question", F.concat("question", F.lit(" and what then, in this case, of all cases?"))), 3)


_ITEMS = "n AS (SELECT 'r' || r_regionkey AS doc_id, n_nationkey, n_name, r_name, 'r' || r_regionkey || '::' || n_nationkey AS chunk_id FROM nation JOIN region ON n_regionkey = r_regionkey)"
_EDGE = "SELECT n_name AS src, r_name AS dst, 'lies in' AS predicate, doc_id, chunk_id FROM n"
_VALUE = "SELECT n_name AS node, 'has key' AS predicate, '$ ' || n_nationkey AS value, doc_id, chunk_id FROM n UNION ALL SELECT n_name, 'trend', 'Up', doc_id, chunk_id FROM n"
_TRADE = """t AS (SELECT a.n_name AS src, b.n_name AS dst, a.n_regionkey AS ra, b.n_regionkey AS rb, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey),
v AS (SELECT n_name, n_regionkey, s_suppkey::VARCHAR AS value, n_nationkey, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey::VARCHAR) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey),
l AS (SELECT n_regionkey AS community, 0 AS kind, n_name AS a, '' AS b, '- ' || n_name || ' (Nation): a nation' AS line FROM nation
UNION ALL SELECT n_regionkey, 0, n_name, lpad(k::VARCHAR, 4, '0'), '    supplier: ' || value || ' (source: ' || n_nationkey || ')' FROM v WHERE k <= 6
UNION ALL SELECT DISTINCT n_regionkey, 1, '', '', chr(10) || 'Relationships:' FROM nation
UNION ALL SELECT ra, 2, src, dst, '- ' || src || ' --[buys from]--> ' || dst || ' (source: ' || min(l_orderkey) || ')' FROM t WHERE ra = rb GROUP BY ra, src, dst),
p AS (SELECT community, string_agg(line, chr(10) ORDER BY kind, a, b)[1:12000] AS prompt FROM l GROUP BY community)"""
_ANS = "a AS (SELECT event_id AS question_id, CASE WHEN user_id % 2 = 0 THEN 'one' ELSE 'two' END AS dataset, engine, CASE WHEN event_id % 4 = 0 THEN 'numeric' ELSE 'text' END AS task, event_type AS cat, (user_id * m + event_id) % 11 / 10.0::DOUBLE AS reward, CASE WHEN event_id % 9 <> 0 THEN value * m END AS latency_ms, user_id % m AS llm_calls, value * 2 AS llm_ms, user_id % 5 AS pt, user_id % 3 AS ct, user_id, event_id FROM events, (VALUES ('graph', 3), ('vector', 5), ('hybrid', 7)) x(engine, m))"
_PICK = "c AS (SELECT event_id AS question_id, ['graph', 'vector', 'hybrid'][(user_id % 3 + 1)::INT] AS router_engine FROM events)"
_MEANS = "engine, count(*) AS n, round(avg(reward), 6) AS reward, round(avg(latency_ms), 6) AS latency_ms, round(avg(llm_calls), 6) AS llm_calls FROM a"
_CHOSEN = """ex AS (SELECT doc_id::VARCHAR AS id, ['train', 'dev', 'test'][(doc_id % 3 + 1)::INT] AS split, concat_ws('/', source, (doc_id % 7)::VARCHAR) AS report, 'doc_' || sha256(coalesce(text, ''))[1:20] AS doc_id, md5('7:' || doc_id) AS h FROM documents),
tr AS (SELECT * FROM ex WHERE split = 'train' ORDER BY h, id LIMIT 40), dv AS (SELECT * FROM ex WHERE split = 'dev' AND report NOT IN (SELECT report FROM tr) ORDER BY h, id LIMIT 20),
te AS (SELECT * FROM ex WHERE split = 'test' AND report NOT IN (SELECT report FROM tr UNION SELECT report FROM dv) ORDER BY h, id LIMIT 20), ch AS (SELECT * FROM tr UNION ALL SELECT * FROM dv UNION ALL SELECT * FROM te),
bu AS (SELECT split, doc_id, split || '_' || lpad(((row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1) // 8)::VARCHAR, 4, '0') AS bundle FROM (SELECT DISTINCT split, doc_id FROM ch))"""
_NEAR = lambda q: f"list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL))[(round_even((count(latency_ms) - 1) * {q}, 0) + 1)::INT]"

QUERIES = {
    "graph_nodes": (graph_nodes, f"WITH {_ITEMS} SELECT n_name AS node, 'Company' AS type, 'nation of ' || r_name AS description, doc_id AS docs FROM n UNION ALL SELECT r_name, 'Other', '', string_agg(DISTINCT doc_id, ',') FROM n GROUP BY r_name"),
    "graph_edges": (graph_edges, f"WITH {_ITEMS} {_EDGE}"),
    "graph_values": (graph_values, f"WITH {_ITEMS} {_VALUE}"),
    "graph_stats": (graph_stats, "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS nodes, (SELECT count(*) FROM nation) AS edges, (SELECT count(*) FROM region) AS docs"),
    "fact_texts": (fact_texts, f"WITH {_ITEMS}, e AS ({_EDGE}), v AS ({_VALUE}) SELECT src AS node, '- ' || src || ' --[' || predicate || ']--> ' || dst || '  (source: ' || doc_id || '; )' AS fact FROM e UNION ALL SELECT node, '- ' || node || ' | ' || predicate || ': ' || value || '  (source: ' || doc_id || '; )' FROM v"),
    "community_prompts": (community_prompts, f"WITH {_TRADE} SELECT community, length(prompt) AS chars, md5(prompt) AS md5 FROM p"),
    "community_summaries": (
        community_summaries,
        """WITH m AS (SELECT n_regionkey AS community, list(n_name ORDER BY n_name) AS m FROM nation GROUP BY 1), t AS (SELECT community, m, '- ' || m[1] || ' (Nation): a nation' AS title FROM m)
SELECT community::BIGINT AS community, 0 AS level, array_to_string(m, ',') AS members, title FROM t UNION ALL SELECT -1, 1, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation), (SELECT '[' || title || '] (covers: ' || array_to_string(m, ', ') || ')' FROM t ORDER BY community LIMIT 1)""",
    ),
    "rgcn_vectors": (rgcn_vectors, None),
    "graph_evidence": (graph_evidence, None),
    "question_rules": (
        question_rules,
        """WITH c AS (SELECT doc_id, doc_id % 6 AS k, doc_id % 50 AS q, length(trim(coalesce(text, '')[1:40])) AS n FROM documents), r AS (SELECT *, CASE k WHEN 0 THEN 'category' WHEN 1 THEN 'fields' WHEN 5 THEN 'document' WHEN 4 THEN 'short quote' WHEN 3 THEN 'quote' ELSE CASE WHEN n < 15 THEN 'short quote' END END AS rule FROM c),
w AS (SELECT *, count(*) FILTER (rule IS NULL) OVER (PARTITION BY q ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) SELECT doc_id AS ord, CASE WHEN rule IN ('category', 'fields') THEN rule WHEN before > 0 THEN 'repeated' ELSE coalesce(rule, 'accepted') END AS verdict FROM w""",
    ),
    "blinded_labels": (blinded_labels, "SELECT item_id AS question_id, engine, chr(64 + row_number() OVER (PARTITION BY item_id ORDER BY sha256(text || chr(31) || engine), engine)::INT) AS label FROM benchmark, (VALUES ('graph'), ('vector'), ('hybrid')) x(engine)"),
    "split_bundles": (split_bundles, f"WITH {_CHOSEN} SELECT id, ch.split, report, ch.doc_id, bundle FROM ch JOIN bu USING (split, doc_id)"),
    "run_summary": (
        run_summary,
        f"WITH {_ANS} SELECT 'all' AS part, 'all' AS value, {_MEANS} GROUP BY engine UNION ALL SELECT 'task', task, {_MEANS} GROUP BY engine, task UNION ALL SELECT 'category', cat, {_MEANS} WHERE task <> 'numeric' GROUP BY engine, cat",
    ),
    "run_completeness": (run_completeness, "SELECT count(*) AS completed, 1000::BIGINT AS expected, count(*) = 1000 AS complete FROM events"),
    "policy_latency": (policy_latency, f"WITH {_ANS}, {_PICK} SELECT 'always_' || engine AS policy, round(avg(latency_ms), 1) AS latency_ms FROM a GROUP BY engine UNION ALL SELECT 'router', round(avg(latency_ms), 1) FROM a JOIN c USING (question_id) WHERE engine = router_engine"),
    "selection_share": (
        selection_share,
        f"""WITH {_ANS}, {_PICK}, o AS (SELECT DISTINCT question_id, dataset, task, cat, router_engine FROM a JOIN c USING (question_id)), s AS (SELECT 'all' AS part, 'all' AS value, router_engine AS engine, count(*) AS n FROM o GROUP BY 3 UNION ALL SELECT 'category', cat, router_engine, count(*) FROM o GROUP BY 2, 3
UNION ALL SELECT 'task', task, router_engine, count(*) FROM o GROUP BY 2, 3 UNION ALL SELECT 'dataset', dataset, router_engine, count(*) FROM o GROUP BY 2, 3) SELECT *, round(n / sum(n) OVER (PARTITION BY part, value), 6) AS share FROM s""",
    ),
    "abstention_rate": (abstention_rate, f"WITH {_ANS} SELECT engine, round(avg((question_id % 8 = 0)::INT), 4) AS rate FROM a GROUP BY engine"),
    "nearest_rank": (
        nearest_rank,
        f"WITH {_ANS} SELECT engine, count(latency_ms) AS n, {_NEAR(0.5)} AS p50, {_NEAR(0.95)} AS p95, round(sum(llm_ms) / sum(latency_ms), 6) AS llm_share, round(avg(pt) FILTER (pt > 0), 6) AS prompt_tokens, round(avg(ct) FILTER (ct > 0), 6) AS completion_tokens FROM a GROUP BY engine",
    ),
    "ingestion_costs": (
        ingestion_costs,
        "SELECT event_id AS run, round(value * 7.31::DOUBLE / greatest(user_id % 4, 1), 6) AS latency_ms, round((user_id + user_id % 7) / greatest(user_id % 4, 1)::DOUBLE, 6) AS tokens, round(CASE WHEN event_type = 'error' THEN (user_id * 1.37::DOUBLE + user_id % 7 * 6.1::DOUBLE) / 1e6 ELSE value * 100 / 3600000 * 0.41::DOUBLE END / greatest(user_id % 4, 1), 12) AS cost_usd FROM events",
    ),
    "showcase_disagreement": (
        showcase_disagreement,
        f"""WITH {_ANS}, g AS (SELECT question_id, dataset, CASE WHEN task = 'numeric' THEN task ELSE cat END AS cell, max(reward) - min(reward) AS spread FROM a GROUP BY question_id, dataset, task, cat), q AS (SELECT event_id AS question_id, length(props || ' and what then, in this case, of all cases?') AS n FROM events),
r AS (SELECT g.*, row_number() OVER (PARTITION BY dataset, cell ORDER BY spread DESC, abs(n - 140), question_id) AS rank FROM g JOIN q USING (question_id) WHERE n BETWEEN 40 AND 260) SELECT dataset, cell, rank, question_id FROM r WHERE rank <= 3""",
    ),
}
