"""Communities: label spreading as DataFrame rounds, and Louvain moves on a contracted graph; the best modularity wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Resolutions that are tried.
RESOLUTIONS = (0.5, 0.75, 1.0, 1.25, 1.5)
#: Edges that one worker may hold; above, labels spread in DataFrame rounds first and the contracted graph is taken.
LOCAL_EDGES = 2_000_000


def spread(weighted: DataFrame, rounds: int = 5) -> DataFrame:
    """node, community after some rounds of label spreading: a node takes its heaviest neighbouring label, ties to the least.

    Odd rounds move nodes of odd hash and even rounds the others, so that neighbours do not swap labels for ever.
    """
    both = weighted.select("u", "v", "weight").unionByName(weighted.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    labels = both.select(F.col("u").alias("node")).distinct().withColumn("community", F.col("node"))
    for k in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("v"), "community"), "v").groupBy("u", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("u").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("next"))
        moves = F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2
        labels = labels.join(best.withColumnRenamed("u", "node"), "node", "left").select("node", F.when(moves & F.col("next").isNotNull(), F.col("next")).otherwise(F.col("community")).alias("community"))
    return labels


def louvain(edges: list[tuple], resolution: float = 1.0) -> dict:
    """node -> community of a weighted graph in memory, by greedy moves in node order and contraction until nothing moves."""
    adjacent: dict = {}
    for u, v, w in edges:
        adjacent.setdefault(u, {})[v] = adjacent.get(u, {}).get(v, 0.0) + w
        adjacent.setdefault(v, {})[u] = adjacent.get(v, {}).get(u, 0.0) + w  # a self-loop counts twice in its degree
    where = {n: n for n in adjacent}
    while True:
        total = sum(sum(x.values()) for x in adjacent.values()) or 1.0
        strength = {n: sum(x.values()) for n, x in adjacent.items()}
        own = {n: n for n in adjacent}
        held, moved, changed = dict(strength), True, False
        while moved:
            moved = False
            for n in sorted(adjacent):
                links: dict = {}
                for m, w in adjacent[n].items():
                    if m != n:
                        links[own[m]] = links.get(own[m], 0.0) + w
                here = own[n]
                held[here] -= strength[n]
                gain = {c: w - resolution * strength[n] * held[c] / total for c, w in links.items()}
                best = max(sorted(gain), key=lambda c: gain[c], default=here)
                if best != here and gain[best] > gain.get(here, -resolution * strength[n] * held[here] / total) + 1e-12:
                    own[n], moved, changed = best, True, True
                held[own[n]] += strength[n]
        if not changed:
            return where
        where = {n: own[c] for n, c in where.items()}
        merged: dict = {}
        for n, x in adjacent.items():
            row = merged.setdefault(own[n], {})
            for m, w in x.items():
                row[own[m]] = row.get(own[m], 0.0) + w
        adjacent = merged


def quality(edges: list[tuple], where: dict) -> float:
    """Modularity of a partition in memory; 0 below two communities."""
    inner, degree, m = {}, {}, 0.0
    for u, v, w in edges:
        m += w
        degree[where[u]] = degree.get(where[u], 0.0) + w
        degree[where[v]] = degree.get(where[v], 0.0) + w
        if where[u] == where[v]:
            inner[where[u]] = inner.get(where[u], 0.0) + w
    return sum(inner.get(c, 0.0) / m - (d / (2 * m)) ** 2 for c, d in degree.items()) if len(degree) > 1 else 0.0


def detect(weighted: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, community, modularity: the partition of best modularity over the resolutions.

    A graph of more than `local_edges` edges is contracted by label spreading until it is small enough; so one task holds
    at most that many edges.
    """
    labels = None
    graph = weighted.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), F.col("weight").cast("double").alias("weight"))
    while (n := graph.count()) > local_edges:
        step = spread(graph).persist()
        labels = step if labels is None else labels.join(step.select(F.col("node").alias("community"), F.col("community").alias("c2")), "community").select("node", F.col("c2").alias("community"))
        a, b = step.select(F.col("node").alias("u"), F.col("community").alias("cu")), step.select(F.col("node").alias("v"), F.col("community").alias("cv"))
        graph = graph.join(a, "u").join(b, "v").groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("weight").alias("weight")).persist()
        if graph.count() == n:
            raise ValueError("the graph does not contract; raise local_edges")

    def run(table):
        import pyarrow as pa

        edges = sorted(zip(*(table.column(c).to_pylist() for c in ("u", "v", "weight")), strict=True))
        tried = [(w := louvain(edges, r), quality(edges, w)) for r in RESOLUTIONS]
        where, q = max(tried, key=lambda x: x[1])
        first = {}
        for node in sorted(where):
            first.setdefault(where[node], len(first))
        return pa.table({"node": pa.array(sorted(where), pa.string()), "community": pa.array([first[where[n]] for n in sorted(where)], pa.int64()), "modularity": pa.array([q] * len(where), pa.float64())})

    found = graph.withColumn("whole", F.lit(0)).groupBy("whole").applyInArrow(run, "node string, community long, modularity double")
    if labels is None:
        return found
    return labels.join(found.withColumnRenamed("node", "c1").withColumnRenamed("community", "c2"), F.col("community") == F.col("c1")).select("node", F.col("c2").alias("community"), "modularity")


def members(communities: DataFrame) -> DataFrame:
    """community, size, members in order, largest first by rank."""
    c = communities.groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("size"))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "community")))
