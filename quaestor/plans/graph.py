"""Queries of the graph operators, over suppliers and parts that order lines link, and of the router over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.operators import graph, router
from quaestor.sources.tables import table


def _edges(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
        F.col("l_returnflag").alias("predicate"), F.col("l_orderkey").alias("doc_id"), F.concat_ws("::", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk_id"),
    )


EDGES = "edges AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_returnflag AS predicate, l_orderkey AS doc_id, l_orderkey || '::' || l_linenumber AS chunk_id FROM lineitem)"


def _seeds(spark):
    return spark.createDataFrame([("s1",), ("p7",)], "node string")


def _values(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.lit("retail price").alias("predicate"), F.col("p_retailprice").cast("string").alias("value"), F.concat(F.col("p_partkey").cast("string"), F.lit("::1")).alias("chunk_id"))


def _members(spark, d):
    """A stand-in partition of the nodes: number modulo 7."""
    e = _edges(spark, d)
    n = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return n.select("node", (F.expr("cast(substring(node, 2) AS long)") % 7).cast("long").alias("community"))


def graph_degree(spark, d):
    return graph.degree(_edges(spark, d))


def edge_weights(spark, d):
    return graph.weights(_edges(spark, d))


def khop_neighbors(spark, d):
    return graph.hops(_edges(spark, d), _seeds(spark), 2).select("node", F.col("hop").cast("long").alias("hop"))


def neighborhood_edges(spark, d):
    e = _edges(spark, d)
    return graph.inside(e, graph.hops(e, _seeds(spark), 1)).select("src", "dst", "predicate", "doc_id", "chunk_id")


def node_values(spark, d):
    near = graph.hops(_edges(spark, d), _seeds(spark), 1)
    return _values(spark, d).join(near.select("node"), "node", "left_semi").select("node", "predicate", "value", "chunk_id")


def grounding_chunks(spark, d):
    chunks = table(spark, d, "lineitem").where("l_linenumber <= 2").select(F.concat_ws("::", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk_id"))
    near = graph.hops(_edges(spark, d), _seeds(spark), 1)
    return graph.grounding(_edges(spark, d), _values(spark, d), chunks).join(near.select("node"), "node", "left_semi").select("node", "chunk_id")


def modularity(spark, d):
    return graph.modularity(graph.weights(_edges(spark, d)), _members(spark, d)).select(F.round("modularity", 6).alias("modularity"), "n")


def community_sizes(spark, d):
    return graph.community_sizes(_members(spark, d), 2, 5)


def node_consolidate(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    m = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("node"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("Other").alias("type"), F.col("p_name").alias("description"), F.pmod("l_orderkey", F.lit(50)).alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    out = graph.consolidate(m)
    return out.select("node", "type", "description", F.concat_ws(",", F.transform("source_docs", lambda x: x.cast("string"))).alias("source_docs"))


def _nodes(spark, d):
    """Parts and the number of orders that have them. Repeated pairs fall away before the counts."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.countDistinct("l_orderkey").alias("k"))


def _features(spark, d):
    return router.counted_features(_nodes(spark, d), table(spark, d, "lineitem").agg(F.countDistinct("l_orderkey").alias("n_docs")))


def corpus_features(spark, d):
    f = _features(spark, d)
    return f.select(*[F.round(c, 6).alias(c) for c in ("cross_doc_fraction", "recurrence", "num_docs")], "shared", "n_docs")


def shared_entities(spark, d):
    return _nodes(spark, d).where("k >= 2").select("node", F.col("k").alias("n_docs"))


def corpus_verdict(spark, d):
    f = _features(spark, d).select("n_docs", "shared")
    cases = spark.createDataFrame([(0, None, None), (1, 0.3, 0.7), (2, 0.05, 0.7), (3, 0.3, 0.5)], "case long, modularity double, auc double")
    return router.verdict(f.crossJoin(cases)).select("case", "engine", "reason")


_CAT = {"click": "local", "view": "global", "purchase": "multi_hop", "signup": "conflict"}


def _contexts(spark, d):
    e = table(spark, d, "events")
    cat = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _CAT.items()], F.lit("unknown"))
    x = router.context(F.col("value") / 200, F.hour("ts") / 24.0, F.lit(0.5), cat)
    return e.select("event_id", F.concat(F.lit("arm"), F.pmod("user_id", F.lit(3)).cast("string")).alias("arm"), cat.alias("category"), x.alias("x"), F.least(F.col("value") / 100, F.lit(1.0)).alias("reward"), F.lit(1.0).alias("weight"))


def context_vectors(spark, d):
    return _contexts(spark, d).select("event_id", *[F.round(F.col("x")[i], 9).alias(f"x{i}") for i in range(router.DIM)])


def linucb_stats(spark, d):
    return router.statistics(_contexts(spark, d)).select("arm", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


def linucb_predict(spark, d):
    c = _contexts(spark, d)
    p = router.predict(c, router.policy(router.statistics(c)))
    return p.select("event_id", "engine", *[F.round(F.col("rewards")[f"arm{k}"], 5).alias(f"reward_{k}") for k in range(3)])


def sample_weights(spark, d):
    e = table(spark, d, "events")
    r = e.select("event_id", F.when(F.pmod("user_id", F.lit(3)) == 0, "finqa").otherwise("edgar").alias("dataset"), F.when((F.pmod("user_id", F.lit(3)) == 0) & (F.col("event_type") == "purchase"), "numeric").otherwise("text").alias("task"), F.col("event_type").alias("category"))
    return router.sample_weights(r).select("event_id", F.round("weight", 9).alias("weight"))


def cost_aware_reward(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(router.effective_reward(F.least(F.col("value") / 100, F.lit(1.0)), F.col("value") * 1000, 0.2), 9).alias("reward"))


_HOP = """r0 AS (SELECT unnest(['s1', 'p7']) AS node), both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
r1 AS (SELECT node, 0 AS hop FROM r0 UNION ALL SELECT DISTINCT dst, 1 FROM both_ways WHERE src IN (SELECT node FROM r0) AND dst NOT IN (SELECT node FROM r0)),
r2 AS (SELECT node, hop FROM r1 UNION ALL SELECT DISTINCT dst, 2 FROM both_ways WHERE src IN (SELECT node FROM r1) AND dst NOT IN (SELECT node FROM r1))"""
_NODES = "nodes AS (SELECT l_partkey AS node, count(DISTINCT l_orderkey) AS k FROM lineitem GROUP BY 1), f AS (SELECT count(*) AS n, count(*) FILTER (k >= 2) AS shared, max(k) AS most, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_docs FROM nodes)"
_CATS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CAT.items()) + " ELSE 'global' END"
_CTX = "c AS (SELECT event_id, 'arm' || (user_id % 3) AS arm, least(value / 100, 1.0) AS reward, [value / 200, hour(ts) / 24.0::DOUBLE, 0.5, " + ", ".join(f"CASE WHEN {_CATS} = '{k}' THEN 1.0 ELSE 0.0 END" for k in router.CATEGORIES) + ", 1.0]::DOUBLE[] AS x FROM events)"

QUERIES = {
    "graph_degree": (graph_degree, f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node"),
    "edge_weights": (edge_weights, f"WITH {EDGES} SELECT least(src, dst) AS u, greatest(src, dst) AS v, count(*) AS weight FROM edges GROUP BY ALL"),
    "khop_neighbors": (khop_neighbors, f"WITH {EDGES}, {_HOP} SELECT node, hop FROM r2"),
    "neighborhood_edges": (neighborhood_edges, f"WITH {EDGES}, {_HOP} SELECT src, dst, predicate, doc_id, chunk_id FROM edges WHERE src IN (SELECT node FROM r1) AND dst IN (SELECT node FROM r1)"),
    "node_values": (node_values, f"WITH {EDGES}, {_HOP} SELECT 'p' || p_partkey AS node, 'retail price' AS predicate, p_retailprice::VARCHAR AS value, p_partkey || '::1' AS chunk_id FROM part WHERE 'p' || p_partkey IN (SELECT node FROM r1)"),
    "grounding_chunks": (
        grounding_chunks,
        f"WITH {EDGES}, {_HOP}, cites AS (SELECT src AS node, chunk_id FROM edges UNION SELECT dst, chunk_id FROM edges UNION SELECT 'p' || p_partkey, p_partkey || '::1' FROM part) SELECT node, chunk_id FROM cites WHERE node IN (SELECT node FROM r1) AND chunk_id IN (SELECT l_orderkey || '::' || l_linenumber FROM lineitem WHERE l_linenumber <= 2)",
    ),
    "modularity": (
        modularity,
        f"""WITH {EDGES}, w AS (SELECT src AS u, dst AS v, count(*)::DOUBLE AS w FROM edges GROUP BY ALL), x AS (SELECT substr(u, 2)::BIGINT % 7 AS cu, substr(v, 2)::BIGINT % 7 AS cv, w FROM w),
p AS (SELECT c, sum(w) AS d, sum(i) AS i FROM (SELECT cu AS c, w, CASE WHEN cu = cv THEN w ELSE 0 END AS i FROM x UNION ALL SELECT cv, w, 0 FROM x) GROUP BY c)
SELECT round(sum(i / m - (d / (2 * m)) ** 2), 6) AS modularity, count(*) AS n FROM p, (SELECT sum(w) AS m FROM w)""",
    ),
    "community_sizes_topn": (community_sizes, f"WITH {EDGES} SELECT substr(node, 2)::BIGINT % 7 AS community, count(*) AS size FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) GROUP BY 1 HAVING count(*) >= 2 ORDER BY size DESC, community LIMIT 5"),
    "node_consolidate": (
        node_consolidate,
        """WITH m AS (SELECT p_brand AS node, CASE WHEN p_size > 25 THEN p_type ELSE 'Other' END AS type, p_name AS description, l_orderkey % 50 AS doc_id, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT node, coalesce(first(type ORDER BY ord, type) FILTER (type <> 'Other'), 'Other') AS type, first(description ORDER BY length(description) DESC, ord) AS description, (SELECT string_agg(x::VARCHAR, ',' ORDER BY x) FROM (SELECT unnest(list_distinct(list(doc_id))) AS x)) AS source_docs FROM m GROUP BY node""",
    ),
    "corpus_features": (corpus_features, f"WITH {_NODES} SELECT round(shared / n, 6) AS cross_doc_fraction, round(least(most / 10, 1.0), 6) AS recurrence, round(least(n_docs / 10, 1.0), 6) AS num_docs, shared, n_docs FROM f"),
    "shared_entities": (shared_entities, f"WITH {_NODES} SELECT node, k AS n_docs FROM nodes WHERE k >= 2"),
    "corpus_verdict": (
        corpus_verdict,
        f"""WITH {_NODES}, s AS (SELECT n_docs, shared, c, m, a FROM f, (VALUES (0, NULL, NULL), (1, 0.3, 0.7), (2, 0.05, 0.7), (3, 0.3, 0.5)) t(c, m, a))
SELECT c::BIGINT AS "case", CASE WHEN n_docs < 2 OR shared < 1 OR coalesce(m < 0.1, false) OR coalesce(a < 0.55, false) THEN 'vector' ELSE 'graph' END AS engine,
concat_ws('; ', CASE WHEN n_docs < 2 THEN 'fewer than two documents' WHEN shared < 1 THEN 'no shared entities' ELSE shared || ' shared entities' END, CASE WHEN m < 0.1 THEN 'low modularity' WHEN m IS NOT NULL THEN 'clear communities' END, CASE WHEN a < 0.55 THEN 'links hard to predict' WHEN a IS NOT NULL THEN 'links predictable' END) AS reason FROM s""",
    ),
    "context_vectors": (context_vectors, f"WITH {_CTX} SELECT event_id, " + ", ".join(f"round(x[{i + 1}], 9) AS x{i}" for i in range(router.DIM)) + " FROM c"),
    "linucb_stats": (
        linucb_stats,
        f"WITH {_CTX}, k AS (SELECT unnest(range(0, 8)) AS k) SELECT arm, i.k AS i, j.k AS j, round(sum(x[i.k + 1] * x[j.k + 1]), 4) AS a, round(sum(CASE WHEN i.k = j.k THEN reward * x[i.k + 1] ELSE 0 END), 4) AS b FROM c, k i, k j GROUP BY ALL",
    ),
    "linucb_predict": (linucb_predict, None),
    "sample_weights": (
        sample_weights,
        """WITH r AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'finqa' ELSE 'edgar' END AS dataset, CASE WHEN user_id % 3 = 0 AND event_type = 'purchase' THEN 'numeric' ELSE event_type END AS bucket FROM events),
n0 AS (SELECT dataset, bucket, count(*) AS n FROM r GROUP BY dataset, bucket), n AS (SELECT *, max(bucket = 'numeric') OVER (PARTITION BY dataset) AS num FROM n0)
SELECT event_id, round((SELECT sum(n) FROM n) * (1.0::DOUBLE / (SELECT count(DISTINCT dataset) FROM n)) * CASE WHEN bucket = 'numeric' THEN 0.5 WHEN num THEN 0.5 / 4 ELSE 1.0 / 4 END / n, 9) AS weight FROM r JOIN n USING (dataset, bucket)""",
    ),
    "cost_aware_reward": (cost_aware_reward, "SELECT event_id, round(least(value / 100, 1.0) - 0.2 * least(value * 1000 / 60000.0::DOUBLE, 1.0), 9) AS reward FROM events"),
}
