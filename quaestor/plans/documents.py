"""Queries of document operators (HTML, tables, names, communities, numeric scores) and of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.operators import community, html, numeric, resolve, tables
from quaestor.sources.tables import table, written
from quaestor.streaming import streams


def html_to_text(spark, d):
    return html.html_to_text(table(spark, d, "pages")).select("page_id", "text")


def html_tables(spark, d):
    """Suppliers of each nation as an HTML table, rendered to lines and parsed back to cells."""
    s = table(spark, d, "supplier")
    row = F.concat(F.lit("<tr><td>"), F.col("s_name"), F.lit("</td><td>$</td><td>"), F.col("s_suppkey").cast("string"), F.lit(".5</td></tr>"))
    page = s.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    page = page.select(F.col("s_nationkey").alias("page_id"), F.concat(F.lit("<p>Balances, in millions</p><table><tr><th>name</th><th colspan=2>FY 2025</th></tr>"), "rows", F.lit("</table>")).alias("html"))
    text = html.html_to_text(page).withColumnRenamed("page_id", "doc_id")
    return tables.cells(text).select("doc_id", "caption", "unit", "label", "col", "value")


_LABELS = ("item", "total", "margin", "other")


def _documents(spark, d):
    """Parts of each brand as a labelled table with a section, general labels, rates and values in per cent."""
    p = table(spark, d, "part")
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    row = F.struct("p_partkey", F.format_string("TABLE ROW %s %d | size: %d ; employees: $ %d ; share %%: %d ; grew: %d %%", label, "p_partkey", "p_size", F.floor("p_retailprice"), "p_size", "p_size").alias("t"))
    docs = p.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), "\n").alias("rows"))
    head = "COMPANY: Acme (ACM)\nItems, in thousands\nTABLE HEADERS: item | size | employees | share % | grew\nTABLE SECTION Parts:\n"
    return docs.select(F.col("p_brand").alias("doc_id"), F.concat(F.lit(head), "rows", F.lit("\nprose after\n")).alias("text"))


def parse_tables(spark, d):
    return tables.cells(_documents(spark, d)).select("doc_id", "company", "caption", "unit", "row_no", "label", "col", "value")


def cell_facts(spark, d):
    cells = written(tables.cells(_documents(spark, d)))  # read for the facts and for what a company reports
    return tables.facts(cells).select("doc_id", "chunk_id", "subject", "predicate", "object", "evidence")


def cell_metrics(spark, d):
    return tables.metrics(tables.cells(_documents(spark, d)))


def table_chunks(spark, d):
    c = tables.table_chunks(tables.table_rows(_documents(spark, d)))
    return c.select("doc_id", "chunk_id", F.md5(F.col("text").cast("binary")).alias("md5"))


def _aligned_documents(spark, d):
    """Nations of each region as columns aligned by spaces, between lines of prose."""
    n = table(spark, d, "nation")
    row = F.struct("n_nationkey", F.concat_ws("   ", "n_name", (F.col("n_nationkey") + 1000).cast("string"), F.concat(F.lit("("), F.col("n_nationkey").cast("string"), F.lit(")"))).alias("t"))
    docs = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), "\n").alias("rows"))
    return docs.select(F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("Before.\n\n  Q1 2025    Q1 2024\n"), "rows", F.lit("\n\n\nAfter  all.")).alias("text"))


def aligned_tables(spark, d):
    return tables.cells(_aligned_documents(spark, d)).select("doc_id", "row_no", "label", "col", "value")


def table_prose(spark, d):
    return tables.prose(_aligned_documents(spark, d).unionByName(_documents(spark, d).select(F.xxhash64("doc_id").alias("doc_id"), "text"))).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def fuzzy_match(spark, d):
    names = spark.createDataFrame([("Customer#00000012",), ("customer 7",), ("Supplier",), ("Customer#000000077 Inc",)], "name string")
    return resolve.best_matches(names, table(spark, d, "customer").select(F.col("c_name").alias("node")))


def entity_resolution(spark, d):
    p = table(spark, d, "part")
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", ", Inc.", " Corp", " q1", " 2025")]), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))
    return resolve.resolve(p.select(F.col("p_partkey").alias("ord"), F.concat("p_type", tail).alias("name"), (F.pmod("p_partkey", F.lit(11)) == 0).alias("exact")))


def communities(spark, d):
    """Communities of nations that trade: customers' nations linked with suppliers' nations by orders."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    w = e.groupBy(F.least("c_nationkey", "s_nationkey").alias("u"), F.greatest("c_nationkey", "s_nationkey").alias("v")).agg(F.count(F.lit(1)).alias("weight"))
    return community.detect(w)


def numeric_score(spark, d):
    e = table(spark, d, "events")
    n, k = F.round("value", 2) + 1, F.pmod("event_id", F.lit(5))
    mark, v = F.lit("so\nFINAL_NUMERIC_ANSWER: "), F.format_string("%.2f", n)
    answer = F.when(k == 0, F.concat(mark, v)).when(k == 1, F.concat(mark, v, F.lit("%"))).when(k == 2, F.concat(mark, v, F.lit(" million"))).when(k == 3, F.concat(F.lit("the value is "), v)).otherwise(F.concat(mark, F.lit("("), v, F.lit(")")))
    gold = F.format_string("%.4f", F.when(k == 1, n / 100).when(k == 4, -n).otherwise(n))
    rows = e.select("event_id", answer.alias("answer"), gold.alias("gold"), F.when(k == 1, F.concat(v, F.lit("%"))).when(k == 2, F.concat(v, F.lit(" million"))).otherwise(v).alias("human"), F.lit("divide(1, 2)").alias("program"), F.lit("what is it?").alias("question"))
    return numeric.scored(rows).select("event_id", "score")


def judge_scores(spark, d):
    e = table(spark, d, "events")
    k = F.pmod("event_id", F.lit(5))
    raw = F.when(k == 0, F.concat(F.pmod("user_id", F.lit(8)).cast("string"), F.lit("/5"))).when(k == 1, "true").when(k == 2, "bad").when(k == 3, " 3.5 ").otherwise(F.pmod("user_id", F.lit(6)).cast("string"))
    return e.select("event_id", numeric.judge_score(raw).alias("score"))


def stream_window_metrics(spark, d):
    return streams.drained(streams.window_metrics(streams.source(spark, d, "events")), "complete")


def stream_sessions(spark, d):
    return streams.drained(streams.sessions(streams.source(spark, d, "events")), "complete")


def stream_dedup(spark, d):
    return streams.drained(streams.deduplicated(streams.source(spark, d, "events"))).select("user_id", "event_type")


def rate_limit_decisions(spark, d):
    return streams.drained(streams.limited(streams.source(spark, d, "events"))).select("event_id", "user_id", "allowed", "retry_after")


def online_bandit(spark, d):
    return streams.drained(streams.online_bandit(streams.source(spark, d, "events")))


def stream_ingest(spark, d):
    docs = streams.source(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    known = table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("doc_id"))
    return streams.drained(streams.ingested(docs, known)).select("doc_id", "c_name")


_CELL = f"""p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row_no, p_partkey % 4 AS k, CASE WHEN p_partkey % 4 IN (1, 3) THEN 'Parts - ' ELSE '' END || ['{"', '".join(_LABELS)}'][(p_partkey % 4 + 1)::INT] || ' ' || p_partkey AS label FROM part),
c AS (SELECT *, unnest(['size', 'employees', 'share %', 'grew']) AS col, unnest([p_size::VARCHAR, '$ ' || floor(p_retailprice)::BIGINT, p_size::VARCHAR, p_size || ' %']) AS value, unnest([0, 1, 2, 3]) AS col_no FROM p)"""

QUERIES = {
    "html_to_text": (html_to_text, None),
    "html_tables": (html_tables, "SELECT s_nationkey AS doc_id, 'Balances, in millions' AS caption, 'millions' AS unit, s_name AS label, 'FY 2025' AS col, '$' || s_suppkey || '.5' AS value FROM supplier"),
    "parse_tables": (parse_tables, f"WITH {_CELL} SELECT p_brand AS doc_id, 'Acme' AS company, 'Items, in thousands' AS caption, 'thousands' AS unit, row_no, label, col, value FROM c"),
    "cell_facts": (
        cell_facts,
        f"""WITH {_CELL} SELECT p_brand AS doc_id, p_brand || '::table' || row_no // 40 AS chunk_id, 'Acme ' || label AS subject, col AS predicate, replace(value, ' ', '') AS object, label || ', ' || col || ': ' || replace(value, ' ', '') || CASE WHEN k = 2 OR col_no >= 2 THEN '' ELSE ' (in thousands)' END AS evidence FROM c
UNION ALL SELECT p_brand, p_brand || '::table' || row_no // 40, 'Acme', 'reports', 'Acme ' || label, 'Acme reports ' || label FROM p""",
    ),
    "cell_metrics": (cell_metrics, f"WITH {_CELL} SELECT p_brand AS doc_id, 'Acme ' || label AS name, 'Metric' AS type, label || ' (in thousands); table: Items, in thousands' AS description FROM p UNION ALL SELECT DISTINCT p_brand, 'Acme', 'Company', 'Reporting company' FROM part"),
    "table_chunks": (
        table_chunks,
        f"""WITH {_CELL}, l AS (SELECT p_brand, row_no, row_no // 40 AS part, label, string_agg(col || ': ' || replace(value, ' ', ''), ' ; ' ORDER BY col_no) AS cells FROM c GROUP BY ALL)
SELECT p_brand AS doc_id, p_brand || '::table' || part AS chunk_id, md5('Items, in thousands' || chr(10) || 'TABLE HEADERS: item | size | employees | share % | grew' || chr(10) || string_agg('TABLE ROW ' || label || ' | ' || cells, chr(10) ORDER BY row_no)) AS md5 FROM l GROUP BY p_brand, part""",
    ),
    "aligned_tables": (aligned_tables, "SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey, col ORDER BY n_nationkey) - 1 AS row_no, n_name AS label, col, value FROM (SELECT *, unnest(['Q1 2025', 'Q1 2024']) AS col, unnest([(n_nationkey + 1000)::VARCHAR, '(' || n_nationkey || ')']) AS value FROM nation)"),
    "table_prose": (table_prose, "SELECT 'Before.' || chr(10) || chr(10) || 'After  all.' AS text, count(DISTINCT n_regionkey) AS n FROM nation UNION ALL SELECT 'COMPANY: Acme (ACM)' || chr(10) || 'Items, in thousands' || chr(10) || 'prose after' || chr(10), count(DISTINCT p_brand) FROM part"),
    "fuzzy_match": (fuzzy_match, None),
    "entity_resolution": (entity_resolution, None),
    "communities": (communities, None),
    "numeric_score": (
        numeric_score,
        # The rule for these forms: the number behind the mark, negative in parentheses; a percentage is its hundredth where the published
        # one is a percentage; a scale that both name cancels; right within a thousandth or half of the last published digit.
        r"""WITH e AS (SELECT event_id, event_id % 5 AS k, round(value, 2) + 1 AS n FROM events), f AS (SELECT *, printf('%.2f', n) AS v FROM e),
r AS (SELECT event_id, CASE k WHEN 0 THEN 'FINAL_NUMERIC_ANSWER: ' || v WHEN 1 THEN 'FINAL_NUMERIC_ANSWER: ' || v || '%' WHEN 2 THEN 'FINAL_NUMERIC_ANSWER: ' || v || ' million' WHEN 3 THEN 'the value is ' || v ELSE 'FINAL_NUMERIC_ANSWER: (' || v || ')' END AS answer,
 printf('%.4f', CASE k WHEN 1 THEN n / 100 WHEN 4 THEN -n ELSE n END)::DOUBLE AS gold, CASE k WHEN 1 THEN v || '%' WHEN 2 THEN v || ' million' ELSE v END AS human FROM f),
p AS (SELECT *, nullif(regexp_extract(answer, 'FINAL_NUMERIC_ANSWER: \(?([0-9.]+)', 1), '')::DOUBLE * CASE WHEN answer LIKE '%(%' THEN -1 ELSE 1 END AS x, human LIKE '%\%' ESCAPE '\' AS ratio, length(regexp_extract(human, '\.([0-9]+)', 1)) AS digits FROM r),
t AS (SELECT *, greatest(1e-5, abs(gold) * 0.001, CASE WHEN human LIKE '%million' THEN 0 ELSE 0.5 * 10.0 ** -digits / CASE WHEN ratio THEN 100 ELSE 1 END END) AS tolerance FROM p)
SELECT event_id, CASE WHEN abs(CASE WHEN ratio THEN x / 100 ELSE x END - gold) <= tolerance THEN 5.0 ELSE 0.0 END::DOUBLE AS score FROM t""",
    ),
    "judge_scores": (judge_scores, "SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN user_id % 8 <= 5 THEN (user_id % 8)::DOUBLE END WHEN 3 THEN 3.5 WHEN 4 THEN (user_id % 6)::DOUBLE END AS score FROM events"),
    "stream_window_metrics": (stream_window_metrics, "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY ALL"),
    "stream_sessions": (
        stream_sessions,
        "WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR, true) AS new FROM events), s AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k",
    ),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT user_id, event_type FROM events"),
    "rate_limit_decisions": (
        rate_limit_decisions,
        """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
n AS (SELECT a.user_id, a.k, min(b.k) AS nxt FROM e a JOIN e b ON a.user_id = b.user_id AND b.us - a.us >= 3600000000 GROUP BY a.user_id, a.k),
a AS (SELECT user_id, 1::BIGINT AS k FROM e WHERE k = 1 UNION ALL SELECT n.user_id, n.nxt FROM a JOIN n ON a.user_id = n.user_id AND a.k = n.k),
t AS (SELECT e.*, a.k IS NOT NULL AS allowed FROM e LEFT JOIN a ON e.user_id = a.user_id AND e.k = a.k),
l AS (SELECT *, max(CASE WHEN allowed THEN us END) OVER (PARTITION BY user_id ORDER BY k) AS last FROM t)
SELECT event_id, user_id, allowed, CASE WHEN allowed THEN 0 ELSE greatest(1, ceil(3600 - (us - last) / 1e6))::BIGINT END AS retry_after FROM l""",
    ),
    "online_bandit": (online_bandit, None),
    "stream_ingest": (stream_ingest, "SELECT c_custkey AS doc_id, c_name FROM customer WHERE c_custkey % 4 <> 0"),
}
