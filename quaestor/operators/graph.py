"""Graph operators over node and edge tables. Edges: src, dst, predicate, ...; duplicates are kept where they count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def degree(edges: DataFrame) -> DataFrame:
    """node, degree: parallel edges count, a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def weights(edges: DataFrame) -> DataFrame:
    """u <= v and the number of edges between them, in either direction."""
    return edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count(F.lit(1)).alias("weight"))


def hops(edges: DataFrame, seeds: DataFrame, n: int = 2) -> DataFrame:
    """node, hop: distance from the seeds, up to n, edges taken both ways. A level is a join and an anti-join."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for k in range(1, n + 1):
        reached = both.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select("node").distinct()
    out = edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi")
    return out.join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def grounding(edges: DataFrame, values: DataFrame, chunks: DataFrame) -> DataFrame:
    """node, chunk_id: chunks that a node's edges and values cite, of those that exist."""
    cites = edges.select(F.col("src").alias("node"), "chunk_id").unionByName(edges.select(F.col("dst").alias("node"), "chunk_id")).unionByName(values.select("node", "chunk_id"))
    return cites.distinct().join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("node", "chunk_id")


def modularity(weighted: DataFrame, members: DataFrame) -> DataFrame:
    """One row: weighted modularity; 0 below two communities. weighted: u, v, weight; members: node, community."""
    w = weighted.select("u", "v", F.col("weight").cast("double").alias("w"))
    cu, cv = members.select(F.col("node").alias("u"), F.col("community").alias("cu")), members.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    e = w.join(cu, "u").join(cv, "v")
    per = e.select(F.explode(F.array(F.struct(F.col("cu").alias("c"), F.col("w").alias("d"), F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0).alias("in")), F.struct(F.col("cv").alias("c"), F.col("w").alias("d"), F.lit(0.0).alias("in")))).alias("x")).select("x.*")
    per = per.groupBy("c").agg(F.sum("d").alias("d"), F.sum("in").alias("inner"))
    total = w.agg(F.sum("w").alias("m"))
    q = per.crossJoin(F.broadcast(total)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("inner") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("q"))  # one row beside
    return q.select(F.when(F.col("n") >= 2, F.col("q")).otherwise(0.0).alias("modularity"), "n")


def consolidate(mentions: DataFrame) -> DataFrame:
    """One row for each node: first type that is not Other, longest description (first of equals), sorted documents.

    mentions: node, type, description, doc_id, ord.
    """
    typed = F.min(F.when(F.col("type") != "Other", F.struct("ord", "type")))["type"]
    longest = F.min(F.when(F.length("description") > 0, F.struct((-F.length("description")).alias("n"), "ord", F.col("description").alias("t"))))["t"]
    return mentions.groupBy("node").agg(F.coalesce(typed, F.lit("Other")).alias("type"), F.coalesce(longest, F.lit("")).alias("description"), F.array_sort(F.collect_set("doc_id")).alias("source_docs"))


def community_sizes(members: DataFrame, least: int = 2, limit: int = 80) -> DataFrame:
    """The largest communities of at least `least` nodes; ties by id."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return sizes.orderBy(F.desc("size"), "community").limit(limit)


def rank_auc(scores: DataFrame) -> DataFrame:
    """One row: AUC of score for label 1, ties by id. scores: id, label, score.

    Ranks come from counts of score ranges first, so that no task sorts everything.
    """
    cells = scores.withColumn("cell", F.floor(F.col("score") * 1024))
    n = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("k"))
    before = n.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    ranked = cells.join(before, "cell").withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("score", "id")))
    one = F.col("label") == 1
    sums = ranked.agg(F.sum(F.when(one, F.col("r"))).cast("double").alias("s"), F.count_if(one).cast("double").alias("p"), F.count_if(~one).cast("double").alias("q"))
    return sums.select(((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))
