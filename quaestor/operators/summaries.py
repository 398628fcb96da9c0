"""Summaries of communities, and one over all of them, by a language model.

A community's prompt lists members with their first values, then the relations among them once each, up to PROMPT characters.
Lines are cut by a running sum before they are gathered, so that no task holds a community's whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import jsontext, models

#: Values a member, characters of a prompt, communities that get a summary, members that the root names.
VALUES, PROMPT, LIMIT, NAMED = 6, 12_000, 80, 6
LEAF, ROOT = "Summarise this community of a knowledge graph as JSON: title, summary.", "Summarise the summaries as one overview, as JSON: title, summary."
OVERVIEW = "Corpus overview"


def eligible(members: DataFrame, least: int = 2, limit: int = LIMIT) -> DataFrame:
    """community, size of the largest communities of at least `least` nodes."""
    n = members.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return n.orderBy(F.desc("size"), "community").limit(limit)


def lines(members: DataFrame, nodes: DataFrame, edges: DataFrame, values: DataFrame) -> DataFrame:
    """community, kind, a, b, c, line: members (0) with their values below them, the head of the relations (1), relations (2)."""
    m = members.join(nodes.select("node", "type", "description"), "node", "left")
    who = m.select("community", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.concat(F.lit("- "), F.col("node"), F.lit(" ("), F.coalesce("type", F.lit("Other")), F.lit("): "), F.coalesce("description", F.lit(""))).alias("line"))
    w = Window.partitionBy("node").orderBy("predicate", "value", "doc_id")
    few = values.withColumn("n", F.row_number().over(w)).where(F.col("n") <= VALUES)
    has = few.join(members, "node").select("community", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lpad(F.col("n").cast("string"), 4, "0").alias("b"), F.lit("").alias("c"), F.concat(F.lit("    "), F.col("predicate"), F.lit(": "), F.col("value"), F.lit(" (source: "), F.col("doc_id").cast("string"), F.lit(")")).alias("line"))
    head = members.select("community").distinct().select("community", F.lit(1).alias("kind"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.lit("\nRelationships:").alias("line"))
    a, b = members.select(F.col("node").alias("src"), "community"), members.select(F.col("node").alias("dst"), "community")
    rel = edges.join(a, "src").join(b, ["dst", "community"]).groupBy("community", "src", "predicate", "dst").agg(F.min("doc_id").alias("doc_id"))
    rel = rel.select("community", F.lit(2).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("predicate").alias("c"), F.concat(F.lit("- "), F.col("src"), F.lit(" --["), F.col("predicate"), F.lit("]--> "), F.col("dst"), F.lit(" (source: "), F.col("doc_id").cast("string"), F.lit(")")).alias("line"))
    return who.unionByName(has).unionByName(head).unionByName(rel)


def prompts(all_lines: DataFrame, most: int = PROMPT) -> DataFrame:
    """community, prompt: the first `most` characters of a community's lines."""
    order = ("kind", "a", "b", "c")
    w = Window.partitionBy("community").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kept = all_lines.withColumn("before", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))).where(F.col("before") < most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda s: s["line"]), "\n")  # `most` characters and a line
    return kept.groupBy("community").agg(F.substring(text, 1, most).alias("prompt"))


def told(rows: DataFrame, model: models.LanguageModel, system: str, limit: int = 500) -> DataFrame:
    """rows (with prompt) and the model's title and summary, null where it gave none."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [jsontext.loaded(model.chat(system, p, limit)[0]) for p in b.column("prompt").to_pylist()]
            text = lambda k: pa.array([g[k] if isinstance(g.get(k), str) else None for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text("title"), text("summary")], [*b.schema.names, "title", "summary"])

    return rows.mapInArrow(run, f"{types}, title string, summary string")


def summarised(members: DataFrame, nodes: DataFrame, edges: DataFrame, values: DataFrame, model: models.LanguageModel) -> DataFrame:
    """community, level, members, title, summary: a leaf for each eligible community, and a root (-1, level 1) above two and more."""
    own = eligible(members)
    inside = members.join(F.broadcast(own.select("community")), "community")  # LIMIT rows
    text = prompts(lines(inside, nodes, edges, values))
    who = inside.groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("members"))
    leaf = told(text.repartition("community"), model, LEAF).drop("prompt").join(who, "community")
    size = F.size("members").cast("string")
    leaf = leaf.select(F.col("community").cast("long").alias("community"), F.lit(0).alias("level"), "members", F.coalesce("title", F.concat(F.lit("Community ("), size, F.lit(" entities)"))).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"))
    leaf = leaf.persist()  # at most LIMIT rows, and each cost a call
    line = F.concat(F.lit("["), F.col("title"), F.lit("] (covers: "), F.array_join(F.slice("members", 1, NAMED), ", "), F.lit(")\n"), F.col("summary"))
    all_ = leaf.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("community", line.alias("t")))), lambda s: s["t"]), "\n\n").alias("prompt"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members")).where("n > 1")
    root = told(all_, model, ROOT, 700).select(F.lit(-1).cast("long").alias("community"), F.lit(1).alias("level"), "members", F.coalesce("title", F.lit(OVERVIEW)).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"))
    return leaf.unionByName(root)
