"""BM25 over token postings. Only postings of asked terms are counted and moved; lengths and counts come from one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.text import tokens


def term_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, tf (occurrences), df (documents)."""
    one = docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.size(tokens(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("len"))


def bm25(questions: DataFrame, docs: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75, key: str = "doc_id") -> DataFrame:
    """question_id, rank, key, score: the k best documents of each question with a positive score, ties by key.

    questions: question_id, question. docs: key, text. Query terms are a set. The asked terms go to the scan of the
    documents: Spark broadcasts them while they are below its limit and joins by shuffle beyond.
    """
    asked = questions.select("question_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    bags = docs.select(key, tokens(F.coalesce(F.col("text"), F.lit(""))).alias("bag"))
    corpus = bags.agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.avg(F.size("bag")).alias("avg_len"))
    one = bags.select(key, F.size("bag").cast("double").alias("len"), F.explode("bag").alias("term"))
    tf = one.join(asked.select("term").distinct(), "term", "left_semi").groupBy(key, "len", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    hit = asked.join(df, "term").join(tf, "term").crossJoin(F.broadcast(corpus))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = k1 * (1 - b + b * F.col("len") / F.when(F.col("avg_len") > 0, F.col("avg_len")).otherwise(1.0))
    scored = hit.groupBy("question_id", key).agg(F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("score")).where("score > 0")
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("question_id", F.col("rank").cast("long").alias("rank"), key, "score")
