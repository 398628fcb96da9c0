"""Corpus features and verdict, question contexts, and the contextual bandit that picks an engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CATEGORIES = ("local", "global", "multi_hop", "conflict")
#: What the verdict asks for at least.
SHARED, MODULARITY, AUC = 1, 0.10, 0.55
DIM = 8


def features(nodes: DataFrame) -> DataFrame:
    """One row: share of nodes in two documents or more, recurrence, number of documents, each up to 1. nodes: source_docs."""
    docs = nodes.select(F.explode("source_docs").alias("d")).agg(F.countDistinct("d").alias("n_docs"))
    return counted_features(nodes.select(F.size("source_docs").alias("k")), docs)


def counted_features(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """The features from counts, without sets of documents. counts: k, the documents of each node; docs: one row, n_docs."""
    f = counts.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") >= 2).alias("shared"), F.coalesce(F.max("k"), F.lit(0)).alias("most"))
    return f.crossJoin(docs).select((F.col("shared") / F.greatest("n", F.lit(1))).alias("cross_doc_fraction"), F.least(F.col("most") / 10, F.lit(1.0)).alias("recurrence"), F.least(F.col("n_docs") / 10, F.lit(1.0)).alias("num_docs"), "shared", "n_docs")


def verdict(signals: DataFrame) -> DataFrame:
    """engine and reason of each row. signals: n_docs, shared, modularity, auc; unknown (null) signals never veto."""
    few, apart = F.col("n_docs") < 2, F.col("shared") < SHARED
    low, poor = F.col("modularity") < MODULARITY, F.col("auc") < AUC
    no = few | apart | F.coalesce(low, F.lit(False)) | F.coalesce(poor, F.lit(False))
    reason = F.concat_ws(
        "; ",
        F.when(few, F.lit("fewer than two documents")).when(apart, F.lit("no shared entities")).otherwise(F.concat(F.col("shared").cast("string"), F.lit(" shared entities"))),
        F.when(low, F.lit("low modularity")).when(F.col("modularity").isNotNull(), F.lit("clear communities")),
        F.when(poor, F.lit("links hard to predict")).when(F.col("auc").isNotNull(), F.lit("links predictable")),
    )
    return signals.withColumn("engine", F.when(no, "vector").otherwise("graph")).withColumn("reason", reason)


def context(cross: Column, recurrence: Column, docs: Column, category: Column) -> Column:
    """The eight numbers a question is judged by; an unknown category is global."""
    known = F.when(category.isin(*CATEGORIES), category).otherwise("global")
    return F.array(cross, recurrence, docs, *[F.when(known == c, 1.0).otherwise(0.0) for c in CATEGORIES], F.lit(1.0))


def statistics(rows: DataFrame) -> DataFrame:
    """arm, i, j, a, b: sums of w*x_i*x_j (without the identity), and of w*r*x_i on the diagonal. rows: arm, x, reward, weight."""
    i = rows.select("arm", "reward", "weight", "x", F.posexplode("x").alias("i", "xi"))
    ij = i.select("arm", "reward", "weight", "i", "xi", F.posexplode("x").alias("j", "xj"))
    b = F.sum(F.when(F.col("i") == F.col("j"), F.col("weight") * F.col("reward") * F.col("xi")).otherwise(0.0))
    return ij.groupBy("arm", "i", "j").agg(F.sum(F.col("weight") * F.col("xi") * F.col("xj")).alias("a"), b.alias("b"))


def policy(stats: DataFrame, dim: int = DIM) -> dict:
    """arm -> (inverse of A, theta), from statistics: arms * dim * dim numbers at the driver."""
    import numpy as np

    out = {}
    for r in stats.collect():  # arms * dim * dim rows
        a, b = out.setdefault(r.arm, (np.eye(dim), np.zeros(dim)))
        a[r.i, r.j] += r.a
        if r.i == r.j:
            b[r.i] += r.b
    return {arm: (np.linalg.inv(a), np.linalg.solve(a, b)) for arm, (a, b) in sorted(out.items())}


def predict(contexts: DataFrame, arms: dict, alpha: float = 0.0) -> DataFrame:
    """Each row with the rewards predicted for all arms and the chosen arm; alpha > 0 adds the confidence bound.

    The policy is a few dozen numbers, so it becomes literals of a JVM expression. Ties go to the arm that comes first.
    """

    def value(inverse, theta) -> Column:
        mean = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(t)) for t in theta]), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        if not alpha:
            return mean
        flat = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in inverse])
        quad = F.aggregate(F.zip_with("x", flat, lambda p, row: p * F.aggregate(F.zip_with(F.col("x"), row, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)), F.lit(0.0), lambda s, v: s + v)
        return mean + alpha * F.sqrt(F.greatest(quad, F.lit(0.0)))

    scores = [(arm, value(*m)) for arm, m in arms.items()]
    out = contexts.withColumn("rewards", F.create_map(*[c for arm, v in scores for c in (F.lit(arm), v)]))
    top = F.array_max(F.map_values("rewards"))
    choice = F.coalesce(*[F.when(F.col("rewards")[arm] == top, arm) for arm, _ in scores])
    return out.withColumn("engine", choice)


def sample_weights(rows: DataFrame, numeric: float = 0.5) -> DataFrame:
    """Rows with a weight: datasets weigh the same, numeric rows `numeric` of theirs, text categories share the rest. rows: dataset, task, category."""
    bucket = F.when(F.col("task") == "numeric", "numeric").otherwise(F.col("category"))
    r = rows.withColumn("bucket", bucket)
    n = r.groupBy("dataset", "bucket").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("dataset")
    n = n.withColumn("has_numeric", F.max(F.when(F.col("bucket") == "numeric", 1).otherwise(0)).over(one) == 1)
    mass = F.when(F.col("bucket") == "numeric", F.lit(numeric)).otherwise(F.when(F.col("has_numeric"), 1 - numeric).otherwise(1.0) / 4)
    total = n.agg(F.sum("n").alias("total"), F.countDistinct("dataset").alias("datasets"))
    n = n.crossJoin(F.broadcast(total)).select("dataset", "bucket", (F.col("total") * (1.0 / F.col("datasets")) * mass / F.col("n")).alias("weight"))  # a row for each bucket
    return r.join(F.broadcast(n), ["dataset", "bucket"])  # four buckets a dataset


def effective_reward(reward: Column, latency_ms: Column, weight: float) -> Column:
    """Reward less the weight of latency, which counts up to a minute; latency must be known."""
    known = F.when(latency_ms.isNull(), F.raise_error(F.lit("latency is missing"))).otherwise(latency_ms)
    return reward - weight * F.least(known / 60000.0, F.lit(1.0))


#: Settings that a policy and the serving side must share, models being compared by family.
SAME = ("retrieval_version", "answer_model", "extraction_model")


def family(name: str | None) -> str:
    """One name for the same weights, whoever serves them; the column expression is `text.canonical_model`."""
    import re

    return re.sub(r"-(instruct|chat|it)$", "", (name or "").lower().rsplit("/", 1)[-1].replace(":", "-"))


def compatible(meta: dict, settings: dict) -> bool:
    """Whether a policy's rewards were earned under these settings; older policies classified with the extraction model."""
    asked = meta.get("query_model") or meta.get("extraction_model")
    models = all(family(meta.get(k)) == family(settings.get(k)) for k in ("answer_model", "extraction_model"))
    return meta.get("retrieval_version") == settings.get("retrieval_version") and models and family(asked) == family(settings.get("query_model"))


def policy_status(arms: dict | None, meta: dict, settings: dict) -> dict:
    """What is deployed, and whether it fits exactly, by family, or not."""
    if arms is None:
        return {"deployed": False, "compatible": False}
    exact = all(meta.get(k) == settings.get(k) for k in ("answer_model", "backend"))
    return {"deployed": True, "compatible": compatible(meta, settings), "exact_match": exact, "arms": list(arms), "metadata": {k: meta.get(k) for k in ("dataset", "split", "answer_model", "retrieval_version")}}


def validate(arms: dict, meta: dict, manifest: dict, settings: dict, names: tuple[str, ...], dim: int = DIM) -> None:
    """Raises unless the policy may be evaluated on the data set: all arms, trained on train splits, of the same version and settings."""
    if set(arms) != set(names) or any(len(theta) != dim for _, theta in arms.values()):
        raise ValueError("the policy has other arms or dimensions")
    if meta.get("split") != "train":
        raise ValueError("the policy was not trained on train splits alone")
    known = meta.get("datasets") or {meta.get("dataset"): meta.get("dataset_fingerprint")}
    if known.get(manifest["dataset"], manifest["fingerprint"]) != manifest["fingerprint"]:
        raise ValueError("the policy was trained on another version of this data set")
    if wrong := [k for k in (*SAME, "judge_model", "backend") if meta.get(k) != settings.get(k)]:
        raise ValueError(f"the policy was trained with other settings: {', '.join(wrong)}")


def digest(arms: dict) -> str:
    """SHA-256 of a policy's numbers: a frozen one keeps it."""
    import hashlib

    return hashlib.sha256(b"".join(a.encode() + inverse.tobytes() + theta.tobytes() for a, (inverse, theta) in sorted(arms.items()))).hexdigest()


def frozen(records: DataFrame, arms: dict) -> DataFrame:
    """Records with the policy's greedy choice and its reward; nothing is learned. records: question_id, x, reward_<arm>."""
    before = digest(arms)
    out = predict(records, arms)
    reward = F.coalesce(*[F.when(F.col("engine") == a, F.col(f"reward_{a}")) for a in arms])
    assert digest(arms) == before
    return out.withColumn("router_reward", reward).withColumnRenamed("engine", "router_engine")


def replayed(rows: DataFrame, names: tuple[str, ...], alpha: float, dim: int = DIM) -> DataFrame:
    """ord, arm, reward: a bandit that learns from its own choices alone, in the order of `ord`. rows: ord, x, reward_<arm>.

    Each choice depends on the last, so one task folds the sorted rows; it holds a batch and the statistics, never the rows.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        a, b = {n: np.eye(dim) for n in names}, {n: np.zeros(dim) for n in names}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x = np.array(r["x"])
                inverse = {n: np.linalg.inv(a[n]) for n in names}
                bound = {n: x @ inverse[n] @ b[n] + alpha * np.sqrt(max(x @ inverse[n] @ x, 0.0)) for n in names}
                arm = max(names, key=bound.__getitem__)
                reward = r[f"reward_{arm}"]
                a[arm] += np.outer(x, x)
                b[arm] += reward * x
                out.append((r["ord"], arm, reward))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["ord", "arm", "reward"])

    own = rows.select(F.col("ord").cast("long").alias("ord"), "x", *[F.col(f"reward_{n}").cast("double").alias(f"reward_{n}") for n in names])
    return own.orderBy("ord").coalesce(1).mapInArrow(run, "ord long, arm string, reward double")


def routed(questions: DataFrame, corpus_features: DataFrame, arms: dict | None, meta: dict, settings: dict, fallback: tuple[str, str], names: tuple[str, ...]) -> DataFrame:
    """question_id, engine, reason, source, category, rewards: each question's engine.

    With no documents the vector engine (`empty`); without a fitting policy the corpus verdict, `fallback` (engine, reason);
    else the arm of the highest predicted reward, ties to the first. questions: question_id, category; corpus_features: one
    row of cross_doc_fraction, recurrence, num_docs, n_docs.
    """
    q = questions.crossJoin(F.broadcast(corpus_features.select("cross_doc_fraction", "recurrence", "num_docs", "n_docs")))  # one row
    q = q.withColumn("x", context(F.col("cross_doc_fraction"), F.col("recurrence"), F.col("num_docs"), F.col("category")))
    why = "no trained policy" if arms is None else "the policy has other engines" if set(arms) != set(names) else "the policy's settings changed" if not compatible(meta, settings) else ""
    if why:
        none = F.lit(None).cast("map<string,double>")
        out = q.select("question_id", F.lit(fallback[0]).alias("engine"), F.lit(f"[fallback: {why}] {fallback[1]}").alias("reason"), F.lit("corpus_fallback").alias("source"), "category", none.alias("rewards"), "n_docs")
    else:
        told = F.array_join(F.transform(F.map_entries("rewards"), lambda e: F.concat(e["key"], F.lit("="), F.format_number(e["value"], 2))), ", ")
        p = predict(q, arms)
        out = p.select("question_id", "engine", F.concat(F.lit("question classified as '"), "category", F.lit("'; predicted reward "), told).alias("reason"), F.lit("bandit").alias("source"), "category", "rewards", "n_docs")
    empty = F.col("n_docs") == 0
    return out.select("question_id", F.when(empty, "vector").otherwise(F.col("engine")).alias("engine"), F.when(empty, "No documents ingested yet.").otherwise(F.col("reason")).alias("reason"), F.when(empty, "empty").otherwise(F.col("source")).alias("source"), "category", F.when(~empty, F.col("rewards")).alias("rewards"))
