"""Benchmark questions: acceptance rules, source rotation, generation with an audit, report-disjoint splits, shared sets.

Defined results: a question is refused for the first rule that it breaks, in the order of RULES; of questions equal but for
case and white space the first stays; null fields are missing ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.operators import context, service

#: Categories, shortest quote, questions a category at most, attempts.
CATEGORIES = ("local", "global", "multi_hop", "conflict")
QUOTE, MOST = 15, 10
RULES = ("category", "fields", "repeated", "evidence", "document", "short quote", "quote", "too few quotes", "one document")


def normalised(question: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(question, r"\s+", " ")))


def judged(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates with verified evidence and `refused`, the rule that they break, or null.

    candidates: ord, wanted (the category asked for), category, question, reference, reasoning, evidence: array<struct<doc_id,
    quote>>; sources: doc_id, text. Quotes must stand in their document, white space aside; equal ones count once.
    """
    said = candidates.select("ord", F.posexplode("evidence").alias("n", "e")).select("ord", "n", "e.doc_id", F.trim("e.quote").alias("quote"))
    held = context.surrounded(context.quoted(said.join(sources.select("doc_id", "text"), "doc_id", "left")))
    state = F.when(F.col("text").isNull(), 4).when(F.coalesce(F.length("quote"), F.lit(0)) < QUOTE, 5).when(F.col("found").isNull(), 6)
    held = held.select("ord", "n", state.alias("state"), F.struct("doc_id", F.col("found").alias("quote"), "source_context").alias("e"))
    first = F.min(F.when(F.col("state").isNotNull(), F.struct("n", "state")))["state"]
    e = held.groupBy("ord").agg(first.alias("state"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("n", "e"))), lambda s: s["e"])).alias("verified"))  # a question's few quotes
    c = candidates.join(e, "ord", "left")
    w = Window.partitionBy(normalised(F.col("question"))).orderBy("ord")
    blank = lambda k: F.trim(F.coalesce(F.col(k), F.lit(""))) == ""
    fine = (F.col("category") == F.col("wanted")) & ~blank("question") & ~blank("reference") & ~blank("reasoning")
    n, docs = F.size("verified"), F.size(F.array_distinct(F.transform("verified", lambda v: v["doc_id"])))
    many = sources.agg((F.count(F.lit(1)) > 1).alias("many"))
    c = c.crossJoin(F.broadcast(many)).withColumn("fine", F.coalesce(fine, F.lit(False)))  # one row
    least = F.when(F.col("category") == "local", 1).otherwise(2)
    rule = F.when(F.coalesce(F.col("category") != F.col("wanted"), F.lit(True)), 0).when(~F.col("fine"), 1).when(F.col("evidence").isNull(), 3).when(F.col("state").isNotNull(), F.col("state"))
    rule = rule.when(F.coalesce(n, F.lit(0)) < least, 7).when((F.col("category") == "global") & F.col("many") & (docs < 2), 8)
    c = c.withColumn("rule", rule)
    # Only accepted questions make later ones repeats.
    before = F.count_if(F.col("rule").isNull()).over(w.rowsBetween(Window.unboundedPreceding, -1)) > 0
    c = c.withColumn("rule", F.when(F.col("rule").isin(0, 1), F.col("rule")).when(before, 2).otherwise(F.col("rule")))
    names = F.array(*[F.lit(r) for r in RULES])
    return c.withColumn("refused", F.get(names, F.col("rule"))).drop("state", "many", "fine", "rule")


def accepted(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates that break no rule, with fields trimmed."""
    trimmed = [F.trim(k).alias(k) for k in ("question", "reference", "reasoning")]
    return judged(candidates, sources).where("refused IS NULL").select("ord", "category", *trimmed, F.col("verified").alias("evidence"))


def audited(questions: DataFrame, checks: DataFrame) -> DataFrame:
    """Questions whose place `at` has exactly one check, and that one valid. checks: at, valid."""
    fine = checks.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.max("valid").alias("valid")).where("n = 1 AND valid").select("at")
    return questions.join(fine, "at", "left_semi")


def assigned(docs: DataFrame, used: DataFrame, category: str, attempt: int) -> DataFrame:
    """Documents of an attempt: those used least in front, turned by one with each attempt; two where a category needs two.

    docs: doc_no, doc_id; used: doc_id of each piece of accepted evidence. A bundle is a handful of documents.
    """
    n = used.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = docs.join(n, "doc_id", "left").select("doc_no", "doc_id", F.coalesce("n", F.lit(0)).alias("n"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("n", "doc_no")) - 1).withColumn("docs", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    want = 2 if category == "global" or (category == "multi_hop" and attempt % 2) else 1
    turned = F.pmod(F.col("place") - F.lit(attempt) % F.col("docs"), F.col("docs"))
    return rows.withColumn("turn", turned).where(F.col("turn") < want).select("doc_id", F.col("turn").cast("long").alias("turn"))


def generated(sources: DataFrame, ask: Callable[[str, str, int], list[dict]], audit: Callable[[list[dict]], list[bool]], target: int, done: DataFrame | None = None) -> list[dict]:
    """Accepted questions of a bundle, up to `target` a category: asked for, held against the rules, then audited.

    ask: (category, context, attempt) -> candidates; audit: questions -> verdicts; done: questions of an earlier run, which
    count first. The loop is the driver's, as each call to the model depends on the ones before; a bundle is a handful of
    documents. sources: doc_no, doc_id, text.
    """
    if not 1 <= target <= MOST:
        raise ValueError(f"1 to {MOST} questions a category")
    spark = sources.sparkSession
    schema = "ord long, wanted string, category string, question string, reference string, reasoning string, evidence array<struct<doc_id:string,quote:string>>"
    out: list[dict] = [r.asDict(recursive=True) for r in done.collect()] if done is not None else []
    passages = context.catalog(sources.withColumn("bundle", F.lit(0)).select("bundle", "doc_id", "doc_no").join(context.passage_rows(sources), "doc_id")).persist()
    for category in CATEGORIES:
        for attempt in range(max(6, target * (6 if category == "multi_hop" else 4))):
            own = [q for q in out if q["category"] == category]
            if len(own) >= target:
                break
            used = spark.createDataFrame([(e["doc_id"],) for q in own for e in q["evidence"]], "doc_id string")
            turn = assigned(sources.select("doc_no", F.col("doc_id").cast("string").alias("doc_id")), used, category, attempt)
            rows = passages.withColumn("doc_id", F.col("doc_id").cast("string")).join(turn, "doc_id").orderBy("turn", "ref").collect()  # within the budget of a prompt
            quotes = {r.ref: (r.doc_id, r.quote) for r in rows}
            asked = ask(category, "\n\n".join(f"PASSAGE {k}\n{q}" for k, (_, q) in quotes.items()), attempt)
            cited = [c for c in asked if c.get("evidence_ids") and all(i in quotes for i in c["evidence_ids"])]
            cand = [(n, category, c.get("category"), c.get("question"), c.get("reference_answer"), c.get("reasoning"), [quotes[i] for i in c["evidence_ids"]]) for n, c in enumerate(cited)]
            text = sources.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
            fresh = [r.asDict(recursive=True) for r in accepted(spark.createDataFrame(cand, schema), text).orderBy("ord").collect()]
            known = {" ".join(q["question"].lower().split()) for q in out}
            fresh = [q for q in fresh if " ".join(q["question"].lower().split()) not in known]
            verdicts = audit(fresh) if fresh else []
            out += [q for q, ok in zip(fresh, verdicts, strict=True) if ok][: target - len(own)]
    passages.unpersist()
    return out


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """`place`: a seeded order of the rows within each split, the same in every run."""
    w = Window.partitionBy("split").orderBy(F.md5(F.concat_ws(":", F.lit(seed), key).cast("binary")), key)
    return rows.withColumn("place", F.row_number().over(w).cast("long"))


def disjoint(examples: DataFrame, limits: dict[str, int], seed: int = 0) -> DataFrame:
    """The first `limits` examples of each split in a seeded order, of reports that no earlier split has chosen.

    examples: id, split, report, question, answer. Splits go one after another, as each excludes what the ones before chose.
    """
    rows = examples.where("question IS NOT NULL AND answer IS NOT NULL")
    w = Window.partitionBy("split").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "id").cast("binary")), "id")  # a limit of rows, so that tasks cut their own first
    chosen = None
    for split, most in limits.items():
        own = rows.where(F.col("split") == split)
        if chosen is not None:
            own = own.join(chosen.select("report").distinct(), "report", "left_anti").join(chosen.select("id").distinct(), "id", "left_anti").select(*rows.columns)
        own = own.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)
        chosen = own if chosen is None else chosen.unionByName(own)
    return chosen


def bundled(chosen: DataFrame, size: int = 8) -> DataFrame:
    """Adds doc_id, the text's own hash, and bundle: documents in order of doc_id, `size` together. chosen: split, text, ..."""
    named = chosen.withColumn("doc_id", F.concat(F.lit("doc_"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 20)))
    docs = service.bundles(named.select("split", "doc_id").distinct(), "split", "doc_id", size)
    return named.join(docs.select("split", "doc_id", "bundle"), ["split", "doc_id"])


def shared(numeric: DataFrame, texts: DataFrame) -> DataFrame:
    """Numeric and generated questions on the same bundles, told apart by task; generated ids carry their bundle."""
    own = texts.withColumn("id", F.concat_ws(":", "bundle", F.lit("text"), "id")).withColumn("task", F.lit("text"))
    return numeric.withColumn("task", F.lit("numeric")).unionByName(own, allowMissingColumns=True)


def gold(questions: DataFrame) -> DataFrame:
    """question_id, doc_id: documents of the evidence and the source document. questions: id, evidence, source_doc_id."""
    said = questions.select(F.col("id").alias("question_id"), F.explode("evidence.doc_id").alias("doc_id"))
    own = questions.select(F.col("id").alias("question_id"), F.col("source_doc_id").alias("doc_id"))
    return said.unionByName(own).where("doc_id IS NOT NULL").distinct()
