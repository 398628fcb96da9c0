"""The three engines as plans over a batch of questions: evidence(question_id, rank, chunk_id, score).

questions: question_id, question, entities. A corpus is a set of tables: chunks(chunk_id, doc_id, text, vec),
nodes(node, type, description, ...), edges(src, dst, predicate, doc_id, chunk_id, evidence), values(node, predicate, value,
doc_id, chunk_id, evidence), communities(community, level, members, title, summary), vectors(node, embedding) of a trained
graph network, and indexes of the chunks' texts and vectors where they were made. Vectors are made when texts come in, once;
what a question reaches is kept as pairs of ids, and scored where the vectors are, in blocks of both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import models
from quaestor.operators import build, context, dense, fusion, graph as graphs, ivf, lexical, postings, resolve
from quaestor.sources.tables import written

#: How many of each the engines take.
VECTOR, CANDIDATES, HYBRID, FACTS, CHUNKS, SUMMARIES, PER_SUMMARY = 6, 20, 6, 40, 4, 4, 2
#: Facts that are ranked at most, nodes that a graph network adds, citations, nodes of a path, characters of a snippet.
RANKED, LEARNED, CITATIONS, PATH, SNIPPET = 8000, 4, 14, 24, 300


@dataclass
class Corpus:
    chunks: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    values: DataFrame | None = None
    communities: DataFrame | None = None
    vectors: DataFrame | None = None
    texts: postings.TextIndex | None = None  # over chunk_id
    near: ivf.VectorIndex | None = None  # vec_id is chunk_id
    facts: DataFrame | None = None  # what told() makes

    def chunk_vectors(self) -> DataFrame:
        """chunk_id, vec."""
        return self.chunks.select("chunk_id", F.col("vec") if "vec" in self.chunks.columns else models.embed(F.col("text")).alias("vec"))


def _asked(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", models.embed(F.col("question")).alias("q"))


def _nearest(questions: DataFrame, items: DataFrame, key: str, k: int) -> DataFrame:
    """Best k items of each question by cosine of `vec`; items are shared by all questions."""
    out = dense.topk(_asked(questions), items.select(F.col(key).alias("vec_id"), F.col("vec").alias("embedding")), k, exclude_self=False)
    return out.withColumnRenamed("vec_id", key)


#: Items and questions of a block: a task scores the pairs of one block of items with one of questions.
ITEMS, QUESTIONS = 8192, 256
#: Questions of a block that are scored at a time.
STEP = 32


def best_of(pairs: DataFrame, items: DataFrame, questions: DataFrame, key: str, k: int) -> DataFrame:
    """question_id, key, score: of each question's own items at least the k of largest cosine, and all that tie with the last of them.

    pairs: question_id, key (none twice); items: key, vec; questions: question_id, q. Vectors go to a block of pairs once,
    not with each pair, and only the best of a block leave it.
    """
    blocks, packs = max(1, -(-items.count() // ITEMS)), max(1, -(-questions.count() // QUESTIONS))
    block, pack = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.pmod(F.xxhash64("question_id"), F.lit(packs)).cast("int").alias("pack")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = items.select(F.col(key).alias("item"), F.col("vec").cast("array<double>").alias("vec"), block, all_of(packs).alias("pack"))
    asked = questions.select("question_id", F.lit(None).cast(items.schema[key].dataType).alias("item"), F.col("q").cast("array<double>").alias("q"), pack, all_of(blocks).alias("block"))
    right = pairs.select("question_id", F.col(key).alias("item"), F.lit(None).cast("array<double>").alias("q"), pack, block).unionByName(asked).select(F.col("block").alias("b"), F.col("pack").alias("p"), "question_id", "item", "q")

    def run(items, rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        is_question = pc.is_valid(rows.column("q"))
        asked, own = rows.filter(is_question), rows.filter(pc.invert(is_question))
        at_q = pc.index_in(own.column("question_id"), asked.column("question_id").combine_chunks()).to_numpy(zero_copy_only=False)
        at_v = pc.index_in(own.column("item"), items.column("item").combine_chunks()).to_numpy(zero_copy_only=False)
        known = ~(np.isnan(at_q.astype(float)) | np.isnan(at_v.astype(float)))
        at_q, at_v = at_q[known].astype(np.int64), at_v[known].astype(np.int64)
        matrix = lambda c: np.asarray(c.combine_chunks().flatten(), np.float64).reshape(len(c), -1)
        scores = np.empty(len(at_q))
        if len(at_q):
            v, q = matrix(items.column("vec")), matrix(asked.column("q"))
            nv, nq = np.linalg.norm(v, axis=1) + 1e-8, np.linalg.norm(q, axis=1) + 1e-8
            for a in range(0, len(at_q), 1 << 16):
                i, j = at_v[a : a + (1 << 16)], at_q[a : a + (1 << 16)]
                scores[a : a + (1 << 16)] = (v[i] * q[j]).sum(axis=1) / (nv[i] * nq[j])
        order = np.lexsort((-scores, at_q))
        sorted_q, sorted_s = at_q[order], scores[order]
        starts = np.searchsorted(sorted_q, np.arange(len(asked)))
        last = np.minimum(starts + k, np.append(starts[1:], len(order))) - 1  # the k-th of each question, or its last
        keep = order[sorted_s >= sorted_s[last[sorted_q]] - 1e-8] if len(order) else order
        ids = asked.column("question_id").take(pa.array(at_q[keep])) if len(asked) else own.column("question_id").slice(0, 0)
        return pa.table({"question_id": ids, key: items.column("item").take(pa.array(at_v[keep])), "score": pa.array(scores[keep])})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return left.groupBy("block", "pack").cogroup(right.groupBy("b", "p")).applyInArrow(run, f"question_id {kind(questions, 'question_id')}, {key} {kind(items, key)}, score double")


def best_of_groups(items: DataFrame, questions: DataFrame, key: str, k: int) -> DataFrame:
    """question_id, place, key, score: of a question's items with their best group at a place, at least the k of largest cosine and their ties.

    items: key, vec, groups (array, not empty); questions: question_id, q, groups, places (of its groups, the least is the best).
    Which items a question has is found in a block of both: the pairs are never written out.
    """
    blocks, packs = max(1, -(-items.count() // ITEMS)), max(1, -(-questions.count() // QUESTIONS))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = items.select(F.col(key).alias("item"), F.col("vec").cast("array<double>").alias("vec"), F.col("groups").cast("array<string>").alias("groups"), part(key, blocks).alias("block"), all_of(packs).alias("pack"))
    right = questions.select("question_id", F.col("q").cast("array<double>").alias("q"), F.col("groups").cast("array<string>").alias("of"), F.col("places").cast("array<int>").alias("places"), part("question_id", packs).alias("p"), all_of(blocks).alias("b"))

    def run(items, asked):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0)]]
        if items.num_rows and asked.num_rows:
            own, of = items.column("groups").combine_chunks(), asked.column("of").combine_chunks()
            names = pc.unique(own.flatten())
            at = pc.index_in(of.flatten(), names).to_numpy(zero_copy_only=False).astype(float)
            row, known = np.repeat(np.arange(len(of)), np.asarray(pc.list_value_length(of))), ~np.isnan(at)
            none = np.iinfo(np.int32).max
            places = np.full((len(of), len(names)), none, np.int32)
            places[row[known], at[known].astype(np.int64)] = np.asarray(asked.column("places").combine_chunks().flatten())[known]
            group, starts = np.asarray(pc.index_in(own.flatten(), names)), np.append(0, np.cumsum(pc.list_value_length(own)))[:-1]
            x, whole = dense.matrix(items.column("vec")), dense.matrix(asked.column("q"))
            nx, ny = np.linalg.norm(x, axis=1) + 1e-8, np.linalg.norm(whole, axis=1) + 1e-8
            for a in range(0, len(whole), STEP):
                y = whole[a : a + STEP]
                best = np.minimum.reduceat(places[a : a + STEP][:, group], starts, axis=1)
                s = y @ x.T / (ny[a : a + STEP, None] * nx[None, :])
                for place in np.unique(best[best < none]):
                    mine = np.where(best == place, s, -np.inf)
                    least = np.partition(mine, -k, axis=1)[:, -k] if mine.shape[1] > k else np.full(len(mine), -np.inf)
                    i, j = np.nonzero((mine >= (least - 1e-8)[:, None]) & (mine > -np.inf))
                    for column, values in zip(out, (i + a, j, np.full(len(i), place), (x[j] * y[i]).sum(axis=1) / (nx[j] * ny[i + a]))):
                        column.append(values)
        q, v, place, score = map(np.concatenate, out)
        return pa.table({"question_id": asked.column("question_id").take(pa.array(q)), "place": pa.array(place, pa.int32()), key: items.column("item").take(pa.array(v)), "score": score})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return left.groupBy("block", "pack").cogroup(right.groupBy("b", "p")).applyInArrow(run, f"question_id {kind(questions, 'question_id')}, place int, {key} {kind(items, key)}, score double")


def _ranked(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), *keys)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _close(questions: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    """question_id, rank, chunk_id, score: the nearest chunks, by the index if there is one, else of all chunks."""
    if corpus.near is not None:
        return corpus.near.search(_asked(questions), k).withColumnRenamed("vec_id", "chunk_id")
    return _nearest(questions, corpus.chunk_vectors(), "chunk_id", k)


def vector(questions: DataFrame, corpus: Corpus) -> DataFrame:
    return _close(questions, corpus, VECTOR).select("question_id", "rank", "chunk_id", "score")


def hybrid(questions: DataFrame, corpus: Corpus) -> DataFrame:
    found = corpus.texts.search(questions, CANDIDATES) if corpus.texts is not None else lexical.bm25(questions, corpus.chunks.select("chunk_id", "text"), CANDIDATES, key="chunk_id")
    lex, den = found.withColumn("list", F.lit("lexical")), _close(questions, corpus, CANDIDATES).withColumn("list", F.lit("dense"))
    lists = lex.select("question_id", "list", "rank", "chunk_id").unionByName(den.select("question_id", "list", "rank", "chunk_id"))
    return fusion.fuse(lists, 60, HYBRID, key="chunk_id")


def seeds(questions: DataFrame, corpus: Corpus) -> DataFrame:
    """question_id, node: the nodes that the questions' entities name."""
    return resolve.linked(questions, corpus.nodes)


def learned(start: DataFrame, near: DataFrame, vectors: DataFrame, k: int = LEARNED) -> DataFrame:
    """question_id, node: the k nodes whose vectors are nearest to the mean of a question's seeds, outside its neighbourhood."""
    v = vectors.select("node", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    parts = start.join(v, "node").select("question_id", F.posexplode("v").alias("i", "x")).groupBy("question_id", "i").agg(F.avg("x").alias("x"))
    mean = parts.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))  # one vector
    scored = resolve._pairs(mean, v).select("question_id", "node", dense.cosine(F.col("v"), F.col("q")).alias("score"))
    scored = scored.join(near, ["question_id", "node"], "left_anti")
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "node")
    return scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("question_id", "node")


def neighbourhood(start: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """question_id, node within `hops` of each question's seeds."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = start
    for _ in range(hops):
        step = near.join(both, near.node == both.src).select("question_id", F.col("dst").alias("node"))
        near = near.unionByName(step).distinct()
    return near


def told(edges: DataFrame, values: DataFrame) -> DataFrame:
    """fact_id, a, b, node, chunk_id, fact, vec: all relations and values as lines; ids rise in the order of kind, node, line, chunk.

    a and b are the nodes that a neighbourhood must hold for the line to count: a relation's ends, a value's node twice.
    """
    plain = lambda df: df.select(*df.columns, *[F.lit("").alias(c) for c in ("doc_id", "evidence") if c not in df.columns])
    e = plain(edges).withColumn("chunk_id", F.struct("chunk_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("kind")))
    v = plain(values).withColumn("chunk_id", F.struct("chunk_id", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1).alias("kind")))
    lines = build.fact_texts(e, v).select("chunk_id.*", "node", "fact").distinct()
    order = ("kind", "node", "fact", "chunk_id")
    lines = lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("fact_id", F.monotonically_increasing_id())
    return written(lines.withColumn("vec", models.embed(F.col("fact"))).drop("kind"))


#: Parts of a question's facts that are cut to the first ones before all of them are; ids of a range whose facts are counted.
PARTS, RANGE = 64, 1024


def facts(near: DataFrame, lines: DataFrame, most: int = RANKED) -> DataFrame:
    """question_id, fact_id: lines whose nodes are all in the neighbourhood, the first `most` of each question.

    Counts by ranges of ids say in which range a question's last fact is; lines beyond it do not meet the question.
    """
    b = near.select("question_id", F.col("node").alias("b"))
    ranged = lines.select("fact_id", "a", "b", F.expr(f"fact_id div {RANGE}").alias("range"))
    counts = ranged.groupBy("a", "b", "range").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(near.withColumnRenamed("node", "a"), "a").join(b, ["question_id", "b"]).groupBy("question_id", "range").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("question_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    last = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most).groupBy("question_id").agg(F.max("range").alias("last"))
    a = written(near.join(last, "question_id").select("question_id", F.col("node").alias("a"), "last"))
    inside = ranged.join(a, (ranged.a == a.a) & (F.col("range") <= F.col("last"))).select("question_id", "b", "fact_id").join(b, ["question_id", "b"]).select("question_id", "fact_id")
    part = Window.partitionBy("question_id", F.pmod("fact_id", F.lit(PARTS))).orderBy("fact_id")
    first = inside.withColumn("n", F.row_number().over(part)).where(F.col("n") <= most)  # so that no task orders a hub's facts alone
    return first.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy("fact_id"))).where(F.col("n") <= most).select("question_id", "fact_id")


@dataclass
class Found:
    """What local search finds: reached nodes, ranked facts, ranked chunks. All by question."""

    start: DataFrame
    near: DataFrame
    facts: DataFrame
    chunks: DataFrame


def searched(questions: DataFrame, corpus: Corpus) -> Found:
    """Around a question's seeds: two hops and learned neighbours, their best facts, and the best of all chunks that ground them."""
    asked = written(_asked(questions))
    start = written(seeds(questions, corpus))
    near = neighbourhood(start, corpus.edges)
    if corpus.vectors is not None:
        near = near.unionByName(learned(start, near, corpus.vectors)).distinct()
    near = written(near)
    lines = corpus.facts if corpus.facts is not None else told(corpus.edges, corpus.values)
    own = written(facts(near, lines))
    best = best_of(own, lines.select("fact_id", "vec").join(own.select("fact_id").distinct(), "fact_id", "left_semi"), asked, "fact_id", FACTS)
    top = written(_ranked(best.join(lines.select("fact_id", "node", "chunk_id", "fact"), "fact_id"), ["fact", "chunk_id"], FACTS))
    ground = graphs.grounding(corpus.edges, corpus.values, corpus.chunks).groupBy("chunk_id").agg(F.collect_set("node").alias("groups"))  # a chunk's nodes
    ground = corpus.chunk_vectors().join(ground, "chunk_id")
    mine = near.join(top.select("question_id").distinct(), "question_id", "left_semi")  # no facts, no answer
    mine = mine.groupBy("question_id").agg(F.collect_set("node").alias("groups")).withColumn("places", F.transform("groups", lambda g: F.lit(1))).join(asked, "question_id")
    chunks = _ranked(best_of_groups(ground, mine, "chunk_id", CHUNKS).drop("place"), ["chunk_id"], CHUNKS)
    return Found(start, near, top, written(chunks.join(corpus.chunks.select("chunk_id", "text"), "chunk_id")))


def local(questions: DataFrame, corpus: Corpus) -> DataFrame:
    """The best chunks around a question's seeds."""
    return searched(questions, corpus).chunks.select("question_id", "rank", "chunk_id", "score")


def citations(found: Found, corpus: Corpus, most: int = CITATIONS) -> DataFrame:
    """question_id, rank, chunk_id, doc_id, snippet: the best chunks, then the other chunks that the best facts cite."""
    cited = found.facts.groupBy("question_id", "chunk_id").agg((F.min("rank") + CHUNKS).alias("rank"))
    both = found.chunks.select("question_id", "chunk_id", "rank").unionByName(cited).groupBy("question_id", "chunk_id").agg(F.min("rank").alias("at"))
    own = both.join(corpus.chunks.select("chunk_id", "doc_id", F.substring("text", 1, SNIPPET).alias("snippet")), "chunk_id")
    w = Window.partitionBy("question_id").orderBy("at", "chunk_id")
    return own.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most).drop("at")


def paths(found: Found, most: int = PATH) -> DataFrame:
    """question_id, nodes: the first nodes that were reached."""
    n = found.near.withColumn("r", F.row_number().over(Window.partitionBy("question_id").orderBy("node"))).where(F.col("r") <= most)
    return n.groupBy("question_id").agg(F.array_sort(F.collect_list("node")).alias("nodes"))


def sections(found: Found, corpus: Corpus) -> DataFrame:
    """question_id, part, text: facts, source texts and entities as the sections of a context."""
    line = lambda rows, order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("t")))), lambda s: s["t"]), rows)
    said = found.facts.groupBy("question_id").agg(F.concat(F.lit("FACTS:\n"), line("\n", ["rank"], F.col("fact"))).alias("text"))  # FACTS rows
    src = found.chunks.join(corpus.chunks.select("chunk_id", "doc_id"), "chunk_id")
    src = src.groupBy("question_id").agg(F.concat(F.lit("\nSOURCE TEXT:\n"), line("\n\n", ["rank"], F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(" | "), F.col("chunk_id"), F.lit("]\n"), F.col("text")))).alias("text"))  # CHUNKS rows
    who = found.facts.select("question_id", "node").unionByName(found.start).distinct()
    added = found.near.join(neighbourhood(found.start, corpus.edges), ["question_id", "node"], "left_anti").withColumn("tag", F.lit(" [via R-GCN]")) if corpus.vectors is not None else None
    who = who.join(added, ["question_id", "node"], "left") if added is not None else who.withColumn("tag", F.lit(None).cast("string"))
    ent = who.join(corpus.nodes.select("node", "type", "description"), "node")
    ent = ent.groupBy("question_id").agg(F.concat(F.lit("\nENTITIES:\n"), line("\n", ["node"], F.concat(F.lit("- "), F.col("node"), F.lit(" ("), F.coalesce("type", F.lit("")), F.lit(")"), F.coalesce("tag", F.lit("")), F.lit(": "), F.coalesce("description", F.lit(""))))).alias("text"))  # nodes of FACTS facts
    return said.withColumn("part", F.lit(0)).unionByName(src.withColumn("part", F.lit(1))).unionByName(ent.withColumn("part", F.lit(2)))


def best_communities(questions: DataFrame, corpus: Corpus) -> DataFrame:
    """question_id, community, place: the summaries nearest to the question."""
    said = F.concat(F.col("title"), F.lit(": "), F.col("summary")) if "title" in corpus.communities.columns else F.col("summary")
    c = corpus.communities.select("community", models.embed(said).alias("vec"))
    return _nearest(questions, c, "community", SUMMARIES).select("question_id", "community", F.col("rank").alias("place"))


def overall(questions: DataFrame, corpus: Corpus, top: DataFrame | None = None) -> DataFrame:
    """For the best community summaries of a question, the best chunks of their members, none twice."""
    top = best_communities(questions, corpus) if top is None else top
    ends = corpus.edges.select(F.explode(F.array("src", "dst")).alias("node"), "chunk_id").unionByName(corpus.values.select("node", "chunk_id")).distinct()
    own = corpus.communities.where("level = 0").select("community", F.explode("members").alias("node")).join(ends, "node").select("community", "chunk_id").distinct()
    items = corpus.chunk_vectors().join(own.groupBy("chunk_id").agg(F.collect_set("community").alias("groups")), "chunk_id")  # a chunk's communities
    # A chunk belongs to the best summary that has it, and each summary has chunks of its own.
    mine = top.groupBy("question_id").agg(F.collect_list(F.struct("community", "place")).alias("t"))  # SUMMARIES
    mine = mine.select("question_id", F.transform("t", lambda x: x["community"]).alias("groups"), F.transform("t", lambda x: x["place"]).alias("places")).join(_asked(questions), "question_id")
    n = F.row_number().over(Window.partitionBy("question_id", "place").orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    s = best_of_groups(items, mine, "chunk_id", PER_SUMMARY).withColumn("n", n).where(F.col("n") <= PER_SUMMARY)
    w = Window.partitionBy("question_id").orderBy("place", "n")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).select("question_id", "rank", "chunk_id", "score")


def _local_and_rest(questions: DataFrame, corpus: Corpus) -> tuple[Found, DataFrame]:
    """Local search for questions that do not ask for the whole, and the questions that are left for global search."""
    found = searched(questions.where(models.classify(F.col("question")) != "global"), corpus)
    return found, questions.join(found.chunks.select("question_id").distinct(), "question_id", "left_anti")


def graph(questions: DataFrame, corpus: Corpus) -> DataFrame:
    """Local search, and global search for the questions that it finds nothing for or that ask for the whole."""
    found, rest = _local_and_rest(questions, corpus)
    return found.chunks.select("question_id", "rank", "chunk_id", "score").unionByName(overall(rest, corpus))


ENGINES: dict[str, Callable[[DataFrame, Corpus], DataFrame]] = {"graph": graph, "vector": vector, "hybrid": hybrid}


def evidence(questions: DataFrame, corpus: Corpus, engine: str | None = None) -> DataFrame:
    """Evidence of one engine, or of all with the column engine."""
    if engine:
        return ENGINES[engine](questions, corpus).withColumn("engine", F.lit(engine))
    out = [evidence(questions, corpus, e).select("engine", "question_id", "rank", "chunk_id", "score") for e in ENGINES]
    return out[0].unionByName(out[1]).unionByName(out[2])


# -- what an answer is made from


def _joined(rows: DataFrame, order: list[str], text, by: str = "\n\n"):
    """question_id, text: a question's rows in order, joined; few rows each."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("t")))), lambda r: r["t"])
    return rows.groupBy("question_id").agg(F.array_join(lines, by).alias("text"))


def _passage():
    return F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(" | "), F.col("chunk_id"), F.lit("]\n"), F.col("text"))


def _cited(rows: DataFrame) -> DataFrame:
    """question_id, citations (array of chunk_id, doc_id, snippet) in order of rank."""
    s = F.struct("rank", "chunk_id", F.col("doc_id").cast("string").alias("doc_id"), F.col("snippet"))
    return rows.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(s)), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["doc_id"].alias("doc_id"), x["snippet"].alias("snippet"))).alias("citations"))  # few each


def prepared(questions: DataFrame, corpus: Corpus, engine: str) -> DataFrame:
    """question_id, mode, context, citations (array of chunk_id, doc_id, snippet), path: what an engine hands to the model.

    Dense and fused search hand on chunks. Graph search hands on facts, source texts and entities around a question's seeds, with
    the nodes it went through; global search hands on summaries of communities and their members' source texts.
    """
    chunks = corpus.chunks.select("chunk_id", "doc_id", "text")
    snippet = F.substring("text", 1, SNIPPET).alias("snippet")
    none = F.array().cast("array<string>").alias("path")
    if engine != "graph":
        ev = ENGINES[engine](questions, corpus).select("question_id", "rank", "chunk_id").join(chunks, "chunk_id")
        ev = written(ev)
        texts = context.assembled(ev.select("question_id", "rank", _passage().alias("text")), "question_id", "rank")
        return texts.join(_cited(ev.select("question_id", "rank", "chunk_id", "doc_id", snippet)), "question_id").select("question_id", F.lit(engine).alias("mode"), "context", "citations", none)
    found, rest = _local_and_rest(questions, corpus)
    texts = context.assembled(sections(found, corpus), "question_id", "part")
    own = texts.join(_cited(citations(found, corpus)), "question_id").join(paths(found), "question_id", "left")
    own = own.select("question_id", F.lit("local").alias("mode"), "context", "citations", F.coalesce(F.col("nodes").cast("array<string>"), F.array().cast("array<string>")).alias("path"))
    if rest.isEmpty():
        return own
    top = written(best_communities(rest, corpus))
    ev = written(overall(rest, corpus, top).join(chunks, "chunk_id"))
    groups = corpus.communities.select("community", F.col("title") if "title" in corpus.communities.columns else F.col("community").cast("string").alias("title"), "summary", "members")
    docs = groups.select("community", F.explode("members").alias("node")).join(corpus.nodes.select("node", F.explode("source_docs").alias("doc")), "node") if "source_docs" in corpus.nodes.columns else None
    docs = docs.groupBy("community").agg(F.array_sort(F.collect_set(F.col("doc").cast("string"))).alias("docs")) if docs is not None else groups.select("community", F.array().cast("array<string>").alias("docs"))
    said = top.join(groups, "community").join(docs, "community", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))
    line = F.concat(F.lit("[Community: "), F.col("title"), F.lit("; source documents: "), F.array_join("docs", ", "), F.lit("]\n"), F.col("summary"))
    parts = _joined(said, ["place"], line).select("question_id", F.lit(0).alias("part"), F.concat(F.lit("COMMUNITY SUMMARIES:\n"), F.col("text")).alias("text"))
    parts = parts.unionByName(_joined(ev, ["rank"], _passage()).select("question_id", F.lit(1).alias("part"), F.concat(F.lit("\nSOURCE TEXT:\n"), F.col("text")).alias("text")))
    more = said.select("question_id", F.posexplode("docs").alias("at", "doc_id"), "place", "community", F.substring("summary", 1, SNIPPET).alias("snippet"))
    more = more.select("question_id", (F.lit(1000) * F.col("place") + F.col("at")).alias("rank"), F.concat(F.lit("community_"), F.col("community").cast("string")).alias("chunk_id"), "doc_id", "snippet")
    cited = _cited(ev.select("question_id", "rank", "chunk_id", F.col("doc_id").cast("string").alias("doc_id"), snippet).unionByName(more))
    whole = context.assembled(parts, "question_id", "part").join(cited, "question_id", "left")
    empty = F.array().cast("array<struct<chunk_id:string,doc_id:string,snippet:string>>")
    return own.unionByName(whole.select("question_id", F.lit("global").alias("mode"), "context", F.coalesce("citations", empty).alias("citations"), none))
