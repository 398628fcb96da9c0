"""Queries of retrieval: tokens, BM25, chunks, cosine search, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.functions import text as T
from quaestor.operators import chunking, dense, fusion, lexical, postings
from quaestor.sources.tables import derived, table

TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[a-z]+|[0-9]+(?:\.[0-9]+)?')"
QUESTION = "the quick rereads of 2025 and 4.0"


def _questions(spark, d, limit=None):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _index(spark, d):
    """The documents' postings: made once in a session, as documents come in once and are asked about often."""
    path = derived(spark, d, "documents", "texts", lambda path: postings.TextIndex(spark, path).add(table(spark, d, "documents")))
    return postings.TextIndex(spark, path)


def bm25_topk(spark, d):
    q = spark.createDataFrame([(0, QUESTION)], "question_id long, question string")
    out = lexical.bm25(q, table(spark, d, "documents").select("doc_id", "text"))  # a single question needs no index
    return out.select("rank", "doc_id", F.round("score", 6).alias("score"))


def bm25_multi(spark, d):
    out = _index(spark, d).search(_questions(spark, d), 20)
    return out.select("question_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def _bm25_sql(questions: str) -> str:
    return f"""
WITH q AS ({questions}), qt AS (SELECT DISTINCT question_id, unnest({TOK.format('question')}) AS term FROM q
), b AS (SELECT doc_id, {TOK.format('text')} AS bag FROM documents
), c AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(bag)) AS avg_len FROM b
), tf AS (SELECT doc_id, len, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(bag) AS len, unnest(bag) AS term FROM b) WHERE term IN (SELECT term FROM qt) GROUP BY ALL
), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term
), s AS (SELECT question_id, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM qt JOIN df USING (term) JOIN tf USING (term), c GROUP BY question_id, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0)
"""


def term_stats(spark, d):
    return _index(spark, d).term_stats()


def doc_lengths(spark, d):
    return lexical.lengths(table(spark, d, "documents"))


def chunk_documents(spark, d):
    c = chunking.chunks(table(spark, d, "documents"))
    return c.select("chunk_id", "doc_id", "idx", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("md5"))


def chunk_stats(spark, d):
    c = chunking.chunks(table(spark, d, "documents"))
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.max(F.length("text")).cast("long").alias("longest"), F.sum(F.length("text")).alias("chars"))


# The windows as a recursion: a separator counts when it lies past the half of the window.
_rf = lambda sep, n: f"CASE WHEN strpos(reverse(w), reverse({sep})) > 0 THEN length(w) - strpos(reverse(w), reverse({sep})) - {n} + 1 ELSE -1 END"
CHUNKS = f"""
WITH RECURSIVE win AS (
  SELECT doc_id, text, 0 AS start, 0 AS n, substr(text, 1, 1800) AS w FROM (SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM documents) WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, nxt, n + 1, substr(text, nxt + 1, 1800) FROM (
    SELECT *, greatest(start + size - 200, start + 1) AS nxt FROM (SELECT *, {{size}} AS size FROM win) WHERE start + size < length(text))
), sized AS (SELECT *, {{size}} AS size FROM win
), cut AS (SELECT doc_id, n, trim(substr(text, start + 1, size), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS piece FROM sized
), chunks AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS idx FROM cut WHERE piece <> '')
"""
_cut = lambda sep, n: f"({_rf(sep, n)})"
CHUNKS = CHUNKS.format(
    size=f"""CASE WHEN start + 1800 >= length(text) THEN length(text) - start
  WHEN {_cut("chr(10) || chr(10)", 2)} > 900 THEN {_cut("chr(10) || chr(10)", 2)} + 2
  WHEN {_cut("'. '", 2)} > 900 THEN {_cut("'. '", 2)} + 2
  WHEN {_cut("chr(10)", 1)} > 900 THEN {_cut("chr(10)", 1)} + 1 ELSE 1800 END"""
)


def boilerplate_filter(spark, d):
    docs = table(spark, d, "documents")
    mark = "(?i)\\bthe\\b.*\\bof\\b"
    kept = F.filter(F.split("text", r"\n\s*\n"), lambda p: ~p.rlike(mark) & ~p.rlike(T.BOILERPLATE))
    return docs.select("doc_id", F.size(F.split("text", r"\n\s*\n")).cast("long").alias("paragraphs"), F.size(kept).cast("long").alias("kept"), F.length(F.array_join(kept, "\n\n")).cast("long").alias("chars"))


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def dense_topk(spark, d):
    v = _vectors(spark, d)
    q = v.where("vec_id = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q"))
    return dense.topk(q, v, 20).select("rank", "vec_id", F.round("score", 6).alias("score"))


def dense_topk_multi(spark, d):
    v = _vectors(spark, d)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q"))
    return dense.topk(q, v, 20).select("question_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def cosine_matrix(spark, d):
    """Similarities of a stated question set (ids divisible by 20) to all vectors, as sums for each."""
    v = _vectors(spark, d)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q"))
    return dense.totals(q, v).select("question_id", "n", F.round("total", 5).alias("total"), F.round("most", 6).alias("most"), F.round("least", 6).alias("least"))


def mean_seed_neighbors(spark, d):
    v = _vectors(spark, d)
    return dense.seed_neighbours(v, v.where("label = 3 AND vec_id < 100").select("vec_id"), 4).select("rank", "vec_id", F.round("score", 6).alias("score"))


_DOT = "list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_NORM = "(sqrt(list_inner_product({0}.embedding::DOUBLE[], {0}.embedding::DOUBLE[])) + 1e-8)"
_COS = f"{_DOT} / ({_NORM.format('v')} * {_NORM.format('q')})"


def _dense_sql(where: str) -> str:
    return f"""
WITH s AS (SELECT q.vec_id AS question_id, v.vec_id, {_COS} AS score FROM embeddings v JOIN embeddings q ON v.vec_id <> q.vec_id WHERE {where}
), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
"""


def _lists(spark, d):
    """BM25 ranking of documents for each question."""
    return _index(spark, d).search(_questions(spark, d), 20).select("question_id", F.lit("lexical").alias("list"), "rank", "doc_id")


def rrf_fusion(spark, d):
    lex = _lists(spark, d)
    v = _vectors(spark, d)
    q = v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q"))
    den = dense.topk(q, v, 20).select("question_id", F.lit("dense").alias("list"), "rank", F.col("vec_id").alias("doc_id"))
    out = fusion.fuse(lex.unionByName(den), 60, 6)
    return out.select("question_id", "rank", "doc_id", F.round("score", 9).alias("score"))


def hybrid_search(spark, d):
    """BM25 over chunk-like documents joined with vectors of the same id, fused: the documents' own texts come back."""
    ranked = rrf_fusion(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "source", F.substring("text", 1, 300).alias("snippet"))
    return ranked.join(docs, "doc_id").select("question_id", "rank", "doc_id", "source", F.length("snippet").cast("long").alias("snippet_chars"))


_FUSED = (
    _bm25_sql("SELECT item_id AS question_id, text AS question FROM benchmark").rstrip()
    + f""", ds AS (SELECT q.vec_id AS question_id, v.vec_id, {_COS} AS score FROM embeddings v JOIN embeddings q ON v.vec_id <> q.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)
), dr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM ds
), ls AS (SELECT question_id, doc_id, rank FROM r WHERE rank <= 20 UNION ALL SELECT question_id, vec_id, rank FROM dr WHERE rank <= 20
), fs AS (SELECT question_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ls GROUP BY ALL
), fr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM fs)
"""
)

QUERIES = {
    "bm25_topk": (bm25_topk, _bm25_sql(f"SELECT 0 AS question_id, '{QUESTION}' AS question") + "SELECT rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 20"),
    "bm25_multi_query": (bm25_multi, _bm25_sql("SELECT item_id AS question_id, text AS question FROM benchmark") + "SELECT question_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 20"),
    "term_stats": (term_stats, f"SELECT term, sum(n)::BIGINT AS tf, count(*) AS df FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term"),
    "doc_lengths": (doc_lengths, f"SELECT doc_id, len({TOK.format('text')}) AS len FROM documents"),
    "chunk_documents": (chunk_documents, CHUNKS + "SELECT doc_id || '::chunk' || idx AS chunk_id, doc_id, idx, length(piece) AS n_chars, md5(piece) AS md5 FROM chunks"),
    "chunk_stats": (chunk_stats, CHUNKS + "SELECT count(*) AS chunks, count(DISTINCT doc_id) AS docs, max(length(piece)) AS longest, sum(length(piece))::BIGINT AS chars FROM chunks"),
    "boilerplate_filter": (
        boilerplate_filter,
        rf"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS p FROM documents),
k AS (SELECT doc_id, p, list_filter(p, lambda x: NOT regexp_matches(x, '(?i)\bthe\b.*\bof\b') AND NOT regexp_matches(x, '{T.BOILERPLATE}')) AS k FROM p)
SELECT doc_id, len(p) AS paragraphs, len(k) AS kept, length(array_to_string(k, chr(10) || chr(10))) AS chars FROM k""",
    ),
    "dense_topk": (dense_topk, _dense_sql("q.vec_id = 0") + "SELECT rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 20"),
    "dense_topk_multi": (dense_topk_multi, _dense_sql("q.vec_id % 20 = 0") + "SELECT question_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 20"),
    "cosine_matrix_sample": (cosine_matrix, f"SELECT q.vec_id AS question_id, count(*) AS n, round(sum({_COS}), 5) AS total, round(max({_COS}), 6) AS most, round(min({_COS}), 6) AS least FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id"),
    "mean_seed_neighbors": (
        mean_seed_neighbors,
        f"""WITH m AS (SELECT list(x ORDER BY i) AS embedding FROM (SELECT i, avg(x::DOUBLE) AS x FROM (SELECT unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE label = 3 AND vec_id < 100) GROUP BY i)),
s AS (SELECT v.vec_id, {_COS} AS score FROM embeddings v, m q WHERE NOT (v.label = 3 AND v.vec_id < 100)), r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
SELECT rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 4""",
    ),
    "rrf_fusion": (rrf_fusion, _FUSED + "SELECT question_id, rank, doc_id, round(score, 9) AS score FROM fr WHERE rank <= 6"),
    "hybrid_search": (hybrid_search, _FUSED + "SELECT question_id, rank, fr.doc_id, source, length(text[1:300]) AS snippet_chars FROM fr JOIN documents d ON fr.doc_id = d.doc_id WHERE rank <= 6"),
}
