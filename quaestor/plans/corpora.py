"""Queries of contexts, filings, state and the engines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaestor.functions import models
from quaestor.operators import chunking, context, engines, ivf, postings, service
from quaestor.sources import filings, state
from quaestor.sources.tables import derived, table, written


def context_budget(spark, d):
    s = table(spark, d, "documents").select("source", "doc_id", "text")
    return context.bounded(s, "source", "doc_id").select("source", "doc_id", F.length("text").cast("long").alias("n"))


def context_assembled(spark, d):
    s = table(spark, d, "documents").select("lang", "doc_id", "text")
    return context.assembled(s, "lang", "doc_id").select("lang", F.length("context").cast("long").alias("n"))


def source_passages(spark, d):
    return context.passage_rows(table(spark, d, "documents")).select("doc_id", "idx", "text")


def passage_catalog(spark, d):
    """Bundles of eight documents in order of their ids, each with an equal share of the budget."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    placed = service.bundles(docs.select("doc_id", F.lit("all").alias("split")), "split", "doc_id")  # texts stay where they are
    placed = placed.withColumn("doc_no", F.row_number().over(Window.partitionBy("bundle").orderBy("doc_id")).cast("long"))
    return context.catalog(placed.select("bundle", "doc_id", "doc_no").join(context.passage_rows(docs), "doc_id"))


def source_quote(spark, d):
    docs = table(spark, d, "documents")
    k = F.pmod("doc_id", F.lit(3))
    some = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 2, 6), " ")
    rows = docs.select("doc_id", "text", F.when(k == 2, F.concat(some, F.lit(" zzz"))).otherwise(some).alias("quote"))
    return context.quoted(rows).select("doc_id", F.col("found").isNotNull().alias("found"))


def evidence_resolved(spark, d):
    b = table(spark, d, "benchmark").select(F.concat(F.lit("P"), F.col("item_id").cast("string")).alias("ref"), F.col("text").alias("quote"))
    e = table(spark, d, "events").select(F.col("event_id").alias("question_id"), F.array(F.concat(F.lit("P"), F.pmod("user_id", F.lit(60)).cast("string")), F.concat(F.lit("P"), F.pmod("event_id", F.lit(30)).cast("string"))).alias("refs"))
    return context.resolved(e, b).select("question_id", F.length(F.array_join("quotes", "|")).cast("long").alias("chars"))


def edgar_selection(spark, d):
    o = table(spark, d, "orders")
    row = F.struct("o_orderkey", F.when(F.col("o_orderstatus") == "F", "8-K").otherwise("10-Q").alias("form"), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "2.02,9.01").otherwise("8.01").alias("items"))
    g = o.groupBy(F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    feed = g.select("ticker", F.transform("r", lambda x: x["form"]).alias("form"), F.transform("r", lambda x: x["items"]).alias("items"), F.transform("r", lambda x: x["o_orderkey"].cast("string")).alias("accessionNumber"), F.transform("r", lambda x: F.lit("2025-01-01")).alias("filingDate"))
    li = table(spark, d, "lineitem")
    kind = F.element_at(F.array(F.lit("EX-99.1"), F.lit("EX-99"), F.lit("EX-10")), (F.pmod("l_linenumber", F.lit(3)) + 1).cast("int"))
    ex = li.select(F.col("l_orderkey").cast("string").alias("accessionNumber"), kind.alias("kind"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("url"))
    return filings.releases(filings.submissions(feed), ex).select("ticker", "nth", "accessionNumber", "url")


def finqa_render(spark, d):
    p = table(spark, d, "part")
    header = F.array(F.lit("item"), F.lit("size"))
    row = F.array(F.col("p_name"), F.col("p_size").cast("string"), F.col("p_brand"))
    doc = filings.question_document(F.concat(F.lit("AB/2020/p"), F.col("p_partkey").cast("string"), F.lit(".pdf-1")), F.array(F.lit("before")), F.array(header, row), F.array(F.lit("after")))
    return p.select("p_partkey", doc.alias("text"))


def release_render(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.length(filings.rendered(F.col("source"), F.lit("TK"), F.lit("2025-01-01"), F.lit("u"), F.col("text"), 2000)).cast("long").alias("n"))


def checkpoint_resume(spark, d):
    work = table(spark, d, "documents").select("doc_id", state.fingerprint(F.col("doc_id"), F.col("source")).alias("fingerprint"))
    return state.pending(work, work.where("doc_id % 5 < 3")).select("doc_id")


def reward_validity(spark, d):
    e = table(spark, d, "events")
    r = e.select(F.when(F.col("event_id") % 7 == 0, "dev").otherwise("train").alias("split"), F.array_repeat(F.lit(0.5), 8).alias("context"), (F.col("value") / 200).alias("reward_a"), F.when(F.col("event_id") % 11 != 0, F.lit(0.2)).alias("reward_b"), F.lit("s").alias("signature"))
    return state.invalid(r)


def question_classes(spark, d):
    b = table(spark, d, "conversations")
    return b.groupBy(models.classify(F.col("text")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _corpus(spark, d):
    # Made once in a session, when documents come in: chunks with vectors, and the indexes of both.
    def make(path):
        chunking.chunks(table(spark, d, "documents")).select("chunk_id", "doc_id", "text", models.embed(F.col("text")).alias("vec")).write.parquet(f"{path}/chunks")
        chunks = spark.read.parquet(f"{path}/chunks")
        postings.TextIndex(spark, f"{path}/texts", "chunk_id").add(chunks)
        vectors = chunks.select(F.col("chunk_id").alias("vec_id"), F.col("vec").alias("embedding"))
        index = ivf.VectorIndex(spark, f"{path}/vectors")
        index.train(vectors)
        index.add(vectors)

    path = derived(spark, d, "documents", "corpus", make)
    chunks = spark.read.parquet(f"{path}/chunks")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    first = docs.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("::chunk0")))
    edges = first.select(F.col("source").alias("src"), F.concat(F.lit("language "), F.col("lang")).alias("dst"), F.lit("written in").alias("predicate"), "chunk_id")
    values = first.select(F.col("source").alias("node"), F.lit("document").alias("predicate"), F.col("doc_id").cast("string").alias("value"), "chunk_id")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.lit("Other").alias("type"), F.lit("").alias("description"))
    groups = docs.select(F.col("source").alias("node"), F.conv(F.substring(F.md5(F.col("source").cast("binary")), 1, 1), 16, 10).cast("long").alias("community")).distinct()
    communities = groups.groupBy("community").agg(F.array_sort(F.collect_set("node")).alias("members"), F.lit(0).alias("level"), F.array_join(F.array_sort(F.collect_set("node")), " ").alias("summary"))
    return engines.Corpus(chunks, nodes, edges, values, communities, texts=postings.TextIndex(spark, f"{path}/texts", "chunk_id"), near=ivf.VectorIndex(spark, f"{path}/vectors"))


def engine_evidence(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.array(F.concat(F.lit("src"), F.col("item_id").cast("string"))).alias("entities"))
    return engines.evidence(q, _corpus(spark, d)).select("engine", "question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def answers(spark, d):
    """The whole way: hybrid evidence, bounded context, extractive answer."""
    corpus = _corpus(spark, d)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    ev = written(engines.evidence(q, corpus, "hybrid").select("question_id", "rank", "chunk_id"))
    ev = corpus.chunks.select("chunk_id", "text").join(ev, "chunk_id")
    prompts = context.assembled(ev.select("question_id", "rank", "text"), "question_id", "rank").join(q, "question_id")
    return models.answer(prompts, models.Extractive()).select("question_id", "answer", "cut")


_BOUND = "r AS (SELECT {g} AS g, doc_id, length(text) AS n, 14000 - coalesce(sum(length(text)) OVER (PARTITION BY {g} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM documents), k AS (SELECT g, doc_id, least(n, room)::BIGINT AS n FROM r WHERE room > 200)"
_CUES = "CASE " + " ".join(f"WHEN regexp_matches(text, '{c}') THEN '{n}'" for n, c in models.CUES) + " ELSE 'local' END"

def company_titles(spark, d):
    """Names from titles as filers write them."""
    title = F.concat(F.lit(" "), F.upper("p_name"), F.lit("  US "), F.col("p_brand"), F.when(F.pmod("p_partkey", F.lit(3)) == 0, " /NEW").when(F.pmod("p_partkey", F.lit(3)) == 1, " /DE/").otherwise(""))
    return table(spark, d, "part").select("p_partkey", filings.company_name(title).alias("company"))


QUERIES = {
    "company_titles": (
        company_titles,
        r"""WITH t AS (SELECT p_partkey, ' ' || upper(p_name) || '  US ' || p_brand || CASE p_partkey % 3 WHEN 0 THEN ' /NEW' WHEN 1 THEN ' /DE/' ELSE '' END AS t FROM part), w AS (SELECT p_partkey, list_filter(string_split_regex(regexp_replace(trim(t), '\s*/[A-Z]{2,}/?\s*$', ''), '\s+'), lambda w: w <> '') AS w FROM t)
SELECT p_partkey, array_to_string(list_transform(w, lambda w: CASE WHEN length(w) <= 3 AND upper(w) = w AND lower(w) <> w THEN w ELSE upper(w[1:1]) || lower(w[2:]) END), ' ') AS company FROM w""",
    ),
    "context_budget": (context_budget, f"WITH {_BOUND.format(g='source')} SELECT g AS source, doc_id, n FROM k"),
    "context_assembled": (context_assembled, f"WITH {_BOUND.format(g='lang')} SELECT g AS lang, (sum(n) + count(*) - 1)::BIGINT AS n FROM k GROUP BY g"),
    "source_passages": (source_passages, None),
    "passage_catalog": (passage_catalog, None),
    "source_quote": (
        source_quote,
        r"WITH d AS (SELECT doc_id, doc_id % 3 = 2 AS odd, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, NOT (odd AND NOT contains(t, array_to_string(string_split(t, ' ')[2:7], ' ') || ' zzz')) AS found FROM d",
    ),
    "evidence_resolved": (evidence_resolved, "SELECT event_id AS question_id, length(a.text) + 1 + length(b.text) AS chars FROM events JOIN benchmark a ON a.item_id = user_id % 60 JOIN benchmark b ON b.item_id = event_id % 30"),
    "edgar_selection": (
        edgar_selection,
        "WITH o AS (SELECT 'T' || o_custkey AS ticker, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS fit FROM orders), x AS (SELECT l_orderkey, first(l_orderkey || '/' || l_linenumber ORDER BY l_linenumber % 3 <> 0, l_orderkey || '/' || l_linenumber) AS url FROM lineitem WHERE l_linenumber % 3 < 2 GROUP BY 1), r AS (SELECT ticker, o_orderkey, url, row_number() OVER (PARTITION BY ticker ORDER BY place) AS nth FROM o JOIN x ON o_orderkey = l_orderkey WHERE fit) SELECT ticker, nth, o_orderkey::VARCHAR AS \"accessionNumber\", url FROM r WHERE nth <= 2",
    ),
    "finqa_render": (finqa_render, "SELECT p_partkey, 'SOURCE: AB/2020/p' || p_partkey || '.pdf' || chr(10) || chr(10) || 'before' || chr(10) || chr(10) || 'TABLE HEADERS: item | size' || chr(10) || chr(10) || 'TABLE ROW ' || p_name || ' | size: ' || p_size || ' ; column 2: ' || p_brand || chr(10) || chr(10) || 'after' AS text FROM part"),
    "release_render": (
        release_render,
        "WITH h AS (SELECT doc_id, source, text, substr(text, 1, 2000) AS h FROM documents), p AS (SELECT *, strpos(reverse(h), chr(10) || chr(10)) AS k FROM h) SELECT doc_id, length(source) + length('COMPANY:  (TK)') + 1 + length('DOCUMENT: Earnings release, filed 2025-01-01') + 1 + length('SOURCE: u') + 2 + CASE WHEN length(text) <= 2000 THEN length(text) WHEN k > 0 AND length(h) - k - 1 > 1000 THEN length(h) - k - 1 ELSE 2000 END AS n FROM p",
    ),
    "checkpoint_resume": (checkpoint_resume, "SELECT doc_id FROM documents WHERE doc_id % 5 >= 3"),
    "reward_validity": (reward_validity, "SELECT count(*) FILTER (event_id % 7 = 0 OR event_id % 11 = 0 OR value / 200 > 1 OR value < 0) AS invalid, 1::BIGINT AS signatures FROM events"),
    "question_classes": (question_classes, f"SELECT {_CUES} AS category, count(*) AS n FROM conversations GROUP BY 1"),
    "engine_evidence": (engine_evidence, None),
    "answers": (answers, None),
}
