"""The engine as a service's methods: workspaces, ingestion, graph reads, questions, comparisons, streams, metrics.

A workspace is a folder of versions; a version is a set of Parquet tables that is written whole before the list of versions
names it, so that readers see the old one or the new one, and a lost job leaves no half.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor import jobs
from quaestor.functions import models, traces
from quaestor.functions import text as T
from quaestor.operators import build, chunking, community, engines, graph, ivf, postings, rgcn, router, service, summaries, tables, telemetry
from quaestor.sources import keyed, state
from quaestor.sources.tables import written

VERSION = "1"
TABLES = ("docs", "chunks", "nodes", "edges", "values", "aliases", "communities", "vectors", "analysis")
#: Documents and characters of a workspace.
DOCUMENTS, CHARACTERS = 10, 400_000
LOG = "request_id string, ts timestamp, endpoint string, status string, engine string, routed int, latency_ms double, llm_ms double, llm_calls int, prompt_tokens long, completion_tokens long, output_tokens_per_s double, cost_usd double, abstained int, citation_coverage double, detail string"
CITATIONS = "array<struct<chunk_id:string,doc_id:string,snippet:string>>"
#: What an answer is, and is kept as.
ANSWER = f"engine string, answer string, cut boolean, reason string, mode string, citations {CITATIONS}, path array<string>"


def extracted(chunks: DataFrame) -> DataFrame:
    """Responses of a stand-in for an extraction model: names of two capitalised words and more; neighbours appear together.

    chunks: doc_id, chunk_id, res, text.
    """
    name = r"\b([A-Z][A-Za-z0-9&.-]*(?: [A-Z][A-Za-z0-9&.-]*)+)"
    names = F.array_distinct(F.regexp_extract_all(T.strip_boilerplate(F.col("text")), F.lit(name), 1))
    entity = F.transform("n", lambda x: F.struct(x.alias("name"), F.lit("Other").alias("type"), F.lit("").alias("description")))
    pair = lambda a, b: F.struct(a.alias("subject"), F.lit("appears with").alias("predicate"), b.alias("object"), F.lit("").alias("evidence"))
    triple = F.filter(F.zip_with(F.col("n"), F.slice("n", F.lit(2), F.greatest(F.size("n"), F.lit(1))), pair), lambda t: t["object"].isNotNull())
    c = chunks.withColumn("n", names)
    return c.select("doc_id", "chunk_id", "res", F.to_json(F.struct(entity.alias("entities"), triple.alias("triples"))).alias("response"))


@dataclass
class Workbench:
    spark: SparkSession
    root: str
    workspace: str
    model: models.LanguageModel = field(default_factory=models.Extractive)
    extract: Callable[[DataFrame], DataFrame] = extracted
    arms: dict | None = None
    policy: dict = field(default_factory=dict)
    settings: dict = field(default_factory=lambda: {"retrieval_version": VERSION})
    prices: traces.Prices = field(default_factory=traces.Prices)

    def __post_init__(self):
        state.check_workspace(self.workspace)
        self.home = f"{self.root.rstrip('/')}/{self.workspace}"

    # -- versions

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.home)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        return self._fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}"))

    def version(self) -> str | None:
        if not self._has("versions"):
            return None
        last = self.spark.read.parquet(f"{self.home}/versions").agg(F.max_by("path", "n").alias("path")).first()
        return last.path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/{self.version()}/{name}")

    def _publish(self, path: str) -> None:
        n = self.spark.read.parquet(f"{self.home}/versions").count() if self._has("versions") else 0
        self.spark.createDataFrame([(n, path)], "n int, path string").coalesce(1).write.mode("append").parquet(f"{self.home}/versions")

    # -- health and ingestion

    def health(self) -> dict:
        return {"status": "ok", "version": VERSION}

    def status(self) -> dict:
        if not self.version():
            return {"documents": 0, "chunks": 0, "nodes": 0, "edges": 0, "limits": {"documents": DOCUMENTS, "characters": CHARACTERS}, "router": self.router_status()}
        n = {k: self.table(k).count() for k in ("docs", "chunks", "nodes", "edges")}
        return {"documents": n["docs"], "chunks": n["chunks"], "nodes": n["nodes"], "edges": n["edges"], "limits": {"documents": DOCUMENTS, "characters": CHARACTERS}, "router": self.router_status()}

    def router_status(self) -> dict:
        return router.policy_status(self.arms, self.policy, self.settings)

    def ingest(self, docs: DataFrame, mode: str = "replace", quota: bool = True, progress: Callable[[str], None] = lambda _: None) -> dict:
        """Documents (doc_id, text) replace the workspace's, or are added to them; those that are known already are skipped.

        Extraction is kept by fingerprint, so that only new chunks go to the model; all else is made anew from all documents.
        """
        if mode not in ("replace", "add"):
            raise ValueError("mode is replace or add")
        docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").dropDuplicates(["doc_id"])
        if mode == "add" and self.version():
            known = self.table("docs")
            docs = known.unionByName(service.ingest(docs, known))
        path = uuid.uuid4().hex
        put = lambda name, df: df.write.parquet(f"{self.home}/{path}/{name}")
        get = lambda name: self.spark.read.parquet(f"{self.home}/{path}/{name}")
        put("docs", docs)
        docs = get("docs")
        size = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
        if quota and (size.docs > DOCUMENTS or size.chars > CHARACTERS):
            raise ValueError(f"a workspace holds {DOCUMENTS} documents of {CHARACTERS} characters")
        progress("chunks")
        prose = tables.prose(docs)
        narrative = chunking.chunks(prose).withColumn("res", F.col("idx").cast("int"))
        said = state.extracted(self.spark, narrative.select("doc_id", "chunk_id", "res", "text"), f"{self.home}/extraction", self.extract)
        e, t = build.parsed(said)
        te, tt = build.of_tables(docs)
        progress("graph")

        def kept(name: str, df: DataFrame) -> DataFrame:
            put(name, df)
            return get(name)

        g = build.build(kept("entities", te.unionByName(e)), kept("triples", tt.unionByName(t.select(*tt.columns))), kept)
        for name, df in (("nodes", g.nodes), ("edges", g.edges), ("values", g.values)):
            put(name, df)
        whole = build.chunks(narrative, docs)
        put("chunks", whole.withColumn("vec", models.embed(F.col("text"))))
        self._index(get("chunks"), path)
        nodes, edges, values = get("nodes"), get("edges"), get("values")
        put("facts", engines.told(edges, values))
        progress("communities")
        w = graph.weights(edges)
        groups = community.detect(w).persist()
        put("communities", summaries.summarised(groups.select("node", "community"), nodes, edges, values, self.model))
        fitted = rgcn.trained(nodes, edges)
        none = nodes.select("node", F.array().cast("array<double>").alias("embedding")).limit(0)
        put("vectors", rgcn.vectors(nodes, edges, fitted) if fitted else none)
        found = groups.agg(F.max("modularity").alias("modularity")).withColumn("auc", F.lit(fitted.auc if fitted else None).cast("double"))
        put("analysis", router.verdict(router.features(nodes).crossJoin(found)))  # one row each
        groups.unpersist()
        self._publish(path)
        return {"doc_ids": [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").limit(DOCUMENTS).collect()], "chunks": get("chunks").count(), "entities": nodes.count(), "triples": edges.count() + values.count(), "communities": get("communities").count()}

    def _index(self, chunks: DataFrame, path: str) -> None:
        """Postings of the chunks' texts, and lists and codes of their vectors."""
        self.text_index(path).add(chunks)
        vectors = chunks.select(F.col("chunk_id").alias("vec_id"), F.col("vec").alias("embedding"))
        if not vectors.isEmpty():
            index = self.vector_index(path)
            index.train(vectors)
            index.add(vectors)

    def text_index(self, path: str) -> postings.TextIndex:
        return postings.TextIndex(self.spark, f"{self.home}/{path}/texts", "chunk_id")

    def vector_index(self, path: str) -> ivf.VectorIndex:
        return ivf.VectorIndex(self.spark, f"{self.home}/{path}/codes")

    def delete(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.home)
        self._fs().delete(path, True)

    # -- reads

    def corpus(self) -> engines.Corpus:
        vectors, version = self.table("vectors"), self.version()
        near = self.vector_index(version) if self._has(f"{version}/codes") else None
        return engines.Corpus(self.table("chunks"), self.table("nodes"), self.table("edges"), self.table("values"), self.table("communities"), vectors if vectors.head(1) else None, self.text_index(version), near, self.table("facts"))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes with their degree, and edges."""
        e = self.table("edges")
        return self.table("nodes").join(graph.degree(e), "node", "left").fillna(0, ["degree"]), e

    def communities(self) -> DataFrame:
        return self.table("communities")

    def analysis(self) -> DataFrame:
        return self.table("analysis")

    # -- questions

    def _asked(self, questions: DataFrame) -> DataFrame:
        """question_id, question, category, entities. Classified once, for routing and for search."""
        name = r"\b([A-Z][A-Za-z0-9&.-]*(?: [A-Z][A-Za-z0-9&.-]*)*)"
        ents = F.col("entities") if "entities" in questions.columns else F.array_distinct(F.regexp_extract_all("question", F.lit(name), 1))
        return questions.select("question_id", "question", models.classify(F.col("question")).alias("category"), ents.alias("entities"))

    def route(self, questions: DataFrame) -> DataFrame:
        names = tuple(engines.ENGINES)
        if not self.version():
            none = self.spark.createDataFrame([(0.0, 0.0, 0.0, 0)], "cross_doc_fraction double, recurrence double, num_docs double, n_docs long")
            return router.routed(self._asked(questions), none, self.arms, self.policy, self.settings, ("vector", ""), names)
        a = self.analysis().first()
        return router.routed(self._asked(questions), router.features(self.table("nodes")), self.arms, self.policy, self.settings, (a.engine, a.reason), names)

    def cache(self) -> keyed.Keyed:
        return keyed.Keyed(self.spark, f"{self.home}/answers")

    def _checked(self, questions: DataFrame, engine: str) -> None:
        if not 0 < (questions.agg(F.max(F.length("question"))).first()[0] or 0) <= 2000:
            raise ValueError("a question has 1 to 2000 characters")
        if engine != "auto" and engine not in engines.ENGINES:
            raise ValueError(f"engines are {', '.join(engines.ENGINES)}")

    def _prompts(self, questions: DataFrame, engine: str, trace: traces.Trace) -> DataFrame:
        """question_id, question, engine, reason, mode, context, citations, path."""
        with trace.span("routing"):
            asked = written(self._asked(questions))
            route = self.route(questions).select("question_id", "engine", "reason") if engine == "auto" else asked.select("question_id", F.lit(engine).alias("engine"), F.lit("asked for").alias("reason"))
            choice = written(route)
            names = [r.engine for r in choice.select("engine").distinct().collect()]  # engines
        with trace.span("retrieval"):
            corpus, out = self.corpus(), None
            for name in sorted(names):
                one = engines.prepared(asked.join(choice.where(F.col("engine") == name).select("question_id"), "question_id"), corpus, name)
                out = one if out is None else out.unionByName(one)
            return written(asked.select("question_id", "question").join(choice, "question_id").join(out, "question_id", "left").withColumn("context", F.coalesce("context", F.lit(""))))

    def _answered(self, questions: DataFrame, engine: str, trace: traces.Trace) -> DataFrame:
        """question_id, what an answer is, and what its calls took."""
        prompts = self._prompts(questions, engine, trace)
        with trace.span("generation"):
            said = written(models.answer(prompts, self.model))
            t = said.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "prompt_tokens", "completion_tokens", "llm_ms")], F.coalesce(F.max("estimated"), F.lit(False)).alias("estimated")).first()
            trace.model(t.calls, t.prompt_tokens, t.completion_tokens, t.llm_ms / 1000, t.estimated)
        return said.join(prompts.drop("question", "context"), "question_id")

    def query(self, questions: DataFrame, engine: str = "auto", endpoint: str = "query") -> DataFrame:
        """question_id, ANSWER and cached for each question. questions: question_id, question.

        A question that was answered before on the same documents, whatever its case and spaces, is answered from the cache;
        answers that were cut off are not kept. Every answer is logged.
        """
        self._checked(questions, engine)
        if not self.version():
            fixed = {"engine": F.lit("vector"), "answer": F.lit(models.NOTHING), "cut": F.lit(False), "reason": F.lit("No documents ingested yet."), "mode": F.lit("vector"), "citations": F.array().cast(CITATIONS), "path": F.array().cast("array<string>")}
            return questions.select("question_id", *[c.alias(k) for k, c in fixed.items()], F.lit(False).alias("cached"))
        trace = traces.Trace()
        names = [c.split()[0] for c in ANSWER.split(", ")]
        asked = written(questions.select("question_id", "question", self._key(engine).alias("key")))
        kept = asked.join(self.cache().get(asked), "key").select("question_id", "key", F.from_json("payload", ANSWER).alias("a"))
        hits = written(kept.select("question_id", "a.*"))
        hit_trace = trace.summary(self.prices)["latency_ms"]
        rest = asked.join(hits.select("question_id"), "question_id", "left_anti")
        out = hits.select("question_id", *names, F.lit(True).alias("cached"))
        if not rest.isEmpty():
            new = written(self._answered(rest.select("question_id", "question"), engine, trace))
            whole = new.where(F.col("answer") != models.TRUNCATED).join(rest.select("question_id", "key"), "question_id")
            self.cache().put(whole.select("key", F.to_json(F.struct(*names)).alias("payload")))
            out = out.unionByName(new.select("question_id", *names, F.lit(False).alias("cached")))
            self._log(new, endpoint, "ok", trace.summary(self.prices)["latency_ms"], trace.detail(self.prices), engine == "auto")
        if not hits.isEmpty():
            self._log(hits, endpoint, "cached", hit_trace, "{}", engine == "auto")
        return out

    def _key(self, engine: str):
        """The key of a question's answer: the question, what it is asked of, and what answers it."""
        name = getattr(self.model, "model", type(self.model).__name__)
        return T.cache_key(F.col("question"), F.lit(engine), F.lit(self.version()), F.lit(VERSION), F.lit(name))

    def compare(self, questions: DataFrame) -> DataFrame:
        """The same with all engines: a row for each question and engine."""
        out = None
        for name in engines.ENGINES:
            one = self.query(questions, name, "compare").drop("reason")
            out = one if out is None else out.unionByName(one)
        return out

    def stream(self, question: str, engine: str = "auto", piece: int = 40, beat: float = 15.0) -> Iterator[dict]:
        """Events of one answer: meta, tokens as the model says them, then done; or error.

        reset takes back what was sent (the model was cut off and is asked again with more room); alive comes after `beat`
        seconds without another event. A model without `stream` answers at once, in pieces.
        """
        try:
            asked = self.spark.createDataFrame([("q", question)], "question_id string, question string")
            if not self.version() or not hasattr(self.model, "stream"):
                r = self.query(asked, engine, "stream").first()
                yield {"event": "meta", "engine": r.engine, "reason": r.reason, "cached": r.cached}
                for at in range(0, len(r.answer), piece):
                    yield {"event": "token", "text": r.answer[at : at + piece]}
                yield {"event": "done", "answer": r.answer, "citations": [c.chunk_id for c in r.citations], "path": list(r.path)}
                return
            yield from self._streamed(asked, question, engine, beat)
        except ValueError as e:
            yield {"event": "error", "text": str(e)}

    def _streamed(self, asked: DataFrame, question: str, engine: str, beat: float) -> Iterator[dict]:
        self._checked(asked, engine)
        trace = traces.Trace()
        key = asked.select(self._key(engine).alias("key"))
        kept = self.cache().get(key).select(F.from_json("payload", ANSWER).alias("a")).select("a.*").first()
        if kept:
            self._log(self.spark.createDataFrame([kept], ANSWER), "stream", "cached", trace.summary(self.prices)["latency_ms"], "{}", engine == "auto")
            yield {"event": "meta", "engine": kept.engine, "reason": kept.reason, "cached": True}
            yield {"event": "token", "text": kept.answer}
            yield {"event": "done", "answer": kept.answer, "citations": [c.chunk_id for c in kept.citations], "path": list(kept.path)}
            return
        p = self._prompts(asked, engine, trace).first()
        yield {"event": "meta", "engine": p.engine, "reason": p.reason, "cached": False}
        text, cut = "", bool(p.context)
        with trace.span("generation"):
            began, used = trace.clock(), 0
            for budget in (1500, 3000) if p.context else ():
                text, used = "", used + 1
                if used > 1:
                    yield {"event": "reset"}
                cut = False
                for said in jobs.beating(lambda b=budget: self.model.stream(models.SYSTEM, models.prompt(p.context, question), b), beat):
                    if said is None:
                        yield {"event": "alive"}
                    elif said is models.CUT:
                        cut = True
                    else:
                        trace.token()
                        text += said
                        yield {"event": "token", "text": said}
                if not cut:
                    break
            if used:
                trace.model(used, max(1, len(p.context + question) // 4), max(1, len(text) // 4), trace.clock() - began, True)
        answer = models.TRUNCATED if cut else text or models.NOTHING
        row = self.spark.createDataFrame([(p.engine, answer, cut, p.reason, p.mode, p.citations or [], p.path or [])], ANSWER)
        if not cut:
            self.cache().put(row.select(F.to_json(F.struct(*row.columns)).alias("payload")).crossJoin(key))  # one row each
        t = trace.summary(self.prices)
        usage = row.withColumns({"calls": F.lit(t["llm_calls"]), "prompt_tokens": F.lit(t["prompt_tokens"]), "completion_tokens": F.lit(t["completion_tokens"]), "llm_ms": F.lit(float(t["llm_ms"]))})
        self._log(usage, "stream", "ok", t["latency_ms"], trace.detail(self.prices), engine == "auto")
        yield {"event": "done", "answer": answer, "citations": [c.chunk_id for c in p.citations or []], "path": list(p.path or [])}

    # -- requests

    def _log(self, answers: DataFrame, endpoint: str, status: str, latency_ms: float, detail: str, routed: bool) -> None:
        """A row for each answer. A question of a batch waits for the batch, so its latency is the batch's."""
        has = lambda c, kind: F.col(c).cast(kind) if c in answers.columns else F.lit(None).cast(kind)
        calls, ms, asked, said = has("calls", "int"), has("llm_ms", "double"), has("prompt_tokens", "long"), has("completion_tokens", "long")
        cost = F.lit(self.prices.input_per_m) * asked / 1e6 + F.lit(self.prices.output_per_m) * said / 1e6 if self.prices.hosted else ms / 3_600_000 * self.prices.per_hour
        docs = F.array_distinct(F.transform("citations", lambda c: c["doc_id"]))
        cited = F.size(F.filter(docs, lambda x: F.contains("answer", x)))
        rows = answers.select(
            F.uuid().alias("request_id"), F.current_timestamp().alias("ts"), F.lit(endpoint).alias("endpoint"), F.lit(status).alias("status"), "engine", F.lit(int(routed)).alias("routed"), F.lit(float(latency_ms)).alias("latency_ms"),
            ms.alias("llm_ms"), calls.alias("llm_calls"), asked.alias("prompt_tokens"), said.alias("completion_tokens"), F.when(ms > 0, said / (ms / 1000)).alias("output_tokens_per_s"), cost.cast("double").alias("cost_usd"),
            T.abstains(F.col("answer")).cast("int").alias("abstained"), F.when(F.size(docs) > 0, cited / F.size(docs)).cast("double").alias("citation_coverage"), F.lit(detail).alias("detail"),
        )
        rows.coalesce(1).write.mode("append").parquet(f"{self.home}/requests")

    def record(self, endpoint: str, status: str, engine: str | None, latency_ms: float, detail: str = "{}") -> None:
        """A row of the log for a request that is no question, or failed."""
        row = self.spark.createDataFrame([(uuid.uuid4().hex, endpoint, status, engine, float(latency_ms), detail)], "request_id string, endpoint string, status string, engine string, latency_ms double, detail string").withColumn("ts", F.current_timestamp())
        kinds = [c.split() for c in LOG.split(", ")]
        row.select(*[F.col(c) if c in row.columns else F.lit(None).cast(k).alias(c) for c, k in kinds]).coalesce(1).write.mode("append").parquet(f"{self.home}/requests")

    def metrics(self, minutes: int = 60, endpoint: str | None = None) -> dict:
        """What the log of the last minutes adds up to: rates, latencies by stage and engine, tokens, cost, quality."""
        return telemetry.report(self.requests(minutes, endpoint))

    def requests(self, minutes: int | None = None, endpoint: str | None = None) -> DataFrame:
        log = self.spark.read.schema(LOG).parquet(f"{self.home}/requests") if self._has("requests") else self.spark.createDataFrame([], LOG)
        log = log.where(F.col("ts") >= F.current_timestamp() - F.expr(f"INTERVAL {minutes} MINUTES")) if minutes else log
        return log.where(F.col("endpoint") == endpoint) if endpoint else log

    def recent(self, n: int = 50) -> DataFrame:
        return self.requests().orderBy(F.desc("ts"), "request_id").limit(n)
