"""The graph's build, linking, summaries, judging, questions, learning and the service, on cases with known results."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor import jobs
from quaestor.app import Workbench
from quaestor.functions import jsontext, models, traces, transport
from quaestor.operators import build, context, engines, html, judging, questions, reports, resolve, rgcn, router, summaries
from quaestor.plans import catalog
from quaestor.sources import datasets, uploads

DIR = "/root/testdata/sf0.001"


def test_objects_in_answers(spark):
    cases = {'{"a": 1}': {"a": 1}, '```json\n{"a": 2}\n```': {"a": 2}, 'so: {"a": 3} and {"b": 4}': {"a": 3}, "{bad} [1]": {}, "[1]": {}, "": {}, None: {}}
    assert {k: jsontext.loaded(k) for k in cases} == cases
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", jsontext.object_text(F.col("t")).alias("o")).collect()
    assert {r.t: json.loads(r.o) for r in rows} == cases


def test_items_and_graph(spark):
    said = json.dumps({"entities": [{"name": "Acme Robotics, Inc.", "type": "Company"}, {"name": " "}, {"name": "2025", "type": "Segment"}], "triples": [{"subject": "the Acme Robotics", "predicate": "sells to", "object": "2025"}, {"subject": "Acme Robotics", "predicate": "grew", "object": "5 %"}, {"subject": "x", "predicate": "", "object": "y"}]})
    r = spark.createDataFrame([("d1", "d1::chunk0", 0, f"```json\n{said}\n```"), ("d2", "d2::chunk0", 0, "nothing")], "doc_id string, chunk_id string, res int, response string")
    e, t = build.parsed(r)
    assert sorted((x.name, x.type) for x in e.collect()) == [("2025", "Segment"), ("Acme Robotics, Inc.", "Company")] and t.count() == 2
    docs = spark.createDataFrame([("d0", "COMPANY: Acme Robotics\nTABLE HEADERS: m | FY 2025\nTABLE ROW Acme Robotics Corp sales | FY 2025: 7")], "doc_id string, text string")
    te, tt = build.of_tables(docs)
    g = build.build(te.unionByName(e), tt.unionByName(t.select(*tt.columns)), meaning=False)
    assert {x.node for x in g.nodes.collect()} == {"Acme Robotics", "Acme Robotics Acme Robotics Corp sales", "2025"}
    assert sorted((x.src, x.predicate, x.dst) for x in g.edges.collect()) == [("Acme Robotics", "reports", "Acme Robotics Acme Robotics Corp sales"), ("Acme Robotics", "sells to", "2025")]
    assert sorted((x.node, x.predicate, x.value) for x in g.values.collect()) == [("Acme Robotics", "grew", "5 %"), ("Acme Robotics Acme Robotics Corp sales", "FY 2025", "7")]
    node = {x.node: (x.type, list(x.source_docs)) for x in g.nodes.collect()}
    assert node["Acme Robotics"] == ("Company", ["d0", "d1"])


def test_resolution_by_meaning(spark):
    rows = [("a", "alpha beta gamma delta", False, "Segment", "epsilon zeta eta theta iota kappa"), ("b", "gamma delta beta alpha", False, "Segment", "epsilon zeta eta theta iota kappa"), ("c", "beta delta gamma alpha", False, "Person", "epsilon zeta eta theta iota kappa"), ("d", "alpha beta gamma sigma", False, "Segment", "epsilon zeta eta theta iota kappa"), ("e", "delta gamma alpha beta", True, "Segment", "")]
    m = spark.createDataFrame(rows, "ord string, name string, exact boolean, type string, description string")
    got = {r.name: r.canonical for r in resolve.aliases(m).collect()}
    assert got["gamma delta beta alpha"] == "alpha beta gamma delta"  # same words, same type
    assert got["beta delta gamma alpha"] == "beta delta gamma alpha" and got["delta gamma alpha beta"] == "delta gamma alpha beta"
    assert got["alpha beta gamma sigma"] == "alpha beta gamma sigma"  # possible, but nobody confirms
    sure = {r.name: r.canonical for r in resolve.aliases(m, confirm=lambda a, _, b, __: True).collect()}
    assert sure["alpha beta gamma sigma"] == "alpha beta gamma delta"


def test_links_by_letters_meaning_and_text(spark):
    nodes = spark.createDataFrame([("net revenue 2024", "Metric", "sales of robots"), ("net revenue 2025", "Metric", ""), ("Zeta", "Company", "maker of pumps")], "node string, type string, description string")
    q = spark.createDataFrame([(1, "?", ["net revenue 2025", "maker of pumps company"]), (2, "what of ZETA now", []), (3, "nothing", ["qqqq"])], "question_id long, question string, entities array<string>")
    got = sorted((r.question_id, r.node) for r in resolve.linked(q, nodes).collect())
    assert got == [(1, "Zeta"), (1, "net revenue 2025"), (2, "Zeta")]


def test_graph_engine_on_a_small_corpus(spark):
    nodes = spark.createDataFrame([(n, "Company", "") for n in ("Acme", "Beta", "Gamma", "Far")], "node string, type string, description string")
    edges = spark.createDataFrame([("Acme", "Beta", "buys", "d1", "c1", ""), ("Beta", "Gamma", "sells", "d2", "c2", ""), ("Gamma", "Far", "owns", "d3", "c3", "")], "src string, dst string, predicate string, doc_id string, chunk_id string, evidence string")
    values = spark.createDataFrame([("Gamma", "revenue", "5", "d2", "c4", "e")], "node string, predicate string, value string, doc_id string, chunk_id string, evidence string")
    chunks = spark.createDataFrame([(f"c{k}", f"d{k}", f"text {k} acme") for k in range(1, 6)], "chunk_id string, doc_id string, text string")
    corpus = engines.Corpus(chunks, nodes, edges, values)
    q = spark.createDataFrame([(1, "what does acme buy", ["Acme"])], "question_id long, question string, entities array<string>")
    found = engines.searched(q, corpus)
    assert {r.node for r in found.near.collect()} == {"Acme", "Beta", "Gamma"}
    assert {r.fact for r in found.facts.collect()} == {"- Acme --[buys]--> Beta  (source: d1; )", "- Beta --[sells]--> Gamma  (source: d2; )", "- Gamma | revenue: 5  (source: d2; e)"}
    assert {r.chunk_id for r in engines.citations(found, corpus).collect()} == {"c1", "c2", "c3", "c4"}  # grounding of all reached nodes
    parts = {r.part: r.text for r in engines.sections(found, corpus).collect()}
    assert parts[0].startswith("FACTS:\n- ") and "[d1 | c1]\ntext 1 acme" in parts[1] and "- Acme (Company): " in parts[2]
    assert engines.paths(found).first().nodes == ["Acme", "Beta", "Gamma"]
    v = spark.createDataFrame([("Acme", [1.0, 0.0]), ("Beta", [0.0, 1.0]), ("Gamma", [0.0, 1.0]), ("Far", [1.0, 0.1])], "node string, embedding array<double>")
    near = engines.searched(q, engines.Corpus(chunks, nodes, edges, values, None, v)).near
    assert {r.node for r in near.collect()} == {"Acme", "Beta", "Gamma", "Far"}


def test_labels_and_scores_of_a_judge(spark):
    assert [judging.label_of(k) for k in ("A", "candidate_b", "Candidate C", "AB", 1)] == ["A", "B", "C", None, None]
    assert [judging.score_of(v) for v in ("4/5", 3, True, "x", 6, math.nan, None, "2.5")] == [4.0, 3.0, None, None, None, None, None, 2.5]
    assert judging.scores({"scores": [{"label": "A", "score": 4, "reason": "ok"}, {"candidate": "b", "score": "1"}]}, ["A", "B"]) == {"A": (4.0, "ok"), "B": (1.0, judging.SILENT)}
    assert judging.scores({"A": 4}, ["A", "B"]) is None
    rows = spark.createDataFrame([(q, f"question {q}", "ref", ["e"], e, f"{e} says") for q in (1, 2) for e in engines.ENGINES], "question_id long, question string, reference string, evidence array<string>, engine string, answer string")

    def chat(system, user, warm):
        if "question 2" in user or warm < 0.5:
            return "no idea"
        return json.dumps({"scores": {k: {"score": 5 if v.startswith("graph") else 1, "rationale": "r"} for k, v in json.loads(user.split("\n\n")[0])["candidates"].items()}})

    out = judging.judged(rows, chat)
    got = {(r.question_id, r.engine): (r.score, r.failed) for r in out.collect()}
    assert got[1, "graph"] == (5.0, False) and got[1, "vector"] == (1.0, False) and all(got[2, e] == (None, True) for e in engines.ENGINES)
    assert {(r.question_id, r.engine): r.reward for r in judging.rewards(out).collect()} == {(1, e): 1.0 if e == "graph" else 0.2 for e in engines.ENGINES}


def test_rescoring_changes_numbers_alone(spark):
    schema = "question_id string, engine string, task string, answer string, gold string, human string, program string, question string, reward double, metric string"
    rows = [("a", "graph", "numeric", "FINAL_NUMERIC_ANSWER: 5", "5", "5", "", "", 0.0, "old"), ("b", "graph", "text", "x", "5", "", "", "", 0.4, "old"), ("c", "graph", "numeric", "FINAL_NUMERIC_ANSWER: 5", "5", "5", "", "", 0.0, "new")]
    out, flips = judging.rescored(spark.createDataFrame(rows, schema), "new")
    assert {r.question_id: (r.reward, r.metric) for r in out.collect()} == {"a": (1.0, "new"), "b": (0.4, "new"), "c": (0.0, "new")}
    assert [tuple(r) for r in flips.collect()] == [("a", "graph", 0.0, 1.0)]
    sheet = judging.audit_rows(spark.createDataFrame([(k, "graph", "text", "t", 3.0) for k in "abcdef"], "question_id string, engine string, task string, answer string, score double"), 3)
    assert sheet.count() == 3 and "score" not in sheet.columns


def test_questions_are_generated_and_audited(spark):
    text = {k: "\n\n".join(f"Fact {n} of document {k} says that the figure is {n}{k}." for n in range(5)) for k in ("a", "b")}
    sources = spark.createDataFrame([(n, k, t) for n, (k, t) in enumerate(text.items(), 1)], "doc_no long, doc_id string, text string")
    asked = []

    def ask(category, shown, attempt):
        refs = [x.split("\n")[0].removeprefix("PASSAGE ") for x in shown.split("\n\n")]
        docs = {r[:2]: r for r in refs}
        ids = list(docs.values()) if category == "global" else refs[:2]
        asked.append((category, len(docs)))
        return [{"category": category, "question": f"{category} {len(asked)}?", "reference_answer": "r", "reasoning": "x", "evidence_ids": ids}, {"category": category, "question": "bad", "reference_answer": "r", "reasoning": "x", "evidence_ids": ["D9P9"]}]

    out = questions.generated(sources, ask, lambda qs: [True] * len(qs), 1)
    assert [q["category"] for q in out] == list(questions.CATEGORIES) and len({q["question"] for q in out}) == 4
    assert all(q["evidence"][0]["quote"] in text[q["evidence"][0]["doc_id"]] for q in out)
    assert {d for c, d in asked if c == "global"} == {2} and {d for c, d in asked if c == "local"} == {1}
    assert questions.generated(sources, ask, lambda qs: [False] * len(qs), 1) == []
    checks = spark.createDataFrame([(0, True), (1, True), (1, True), (2, False)], "at long, valid boolean")
    assert [r.at for r in questions.audited(spark.range(4).withColumnRenamed("id", "at"), checks).collect()] == [0]


def test_catalog_shares_a_budget(spark):
    rows = [("b", n, f"d{n}", k, f"passage {k} " + "x" * 300) for n in (1, 2) for k in range(40)]
    got = context.catalog(spark.createDataFrame(rows, "bundle string, doc_no long, doc_id string, idx long, text string"), 6000).collect()
    for n in (1, 2):
        own = [r for r in got if r.doc_id == f"d{n}"]
        assert all(r.ref.startswith(f"D{n}P") for r in own) and sum(len(f"PASSAGE {r.ref}\n{r.quote}") + 2 for r in own) <= 3000 - 2 - 25
        refs = {int(r.ref.split("P")[1]) for r in own}
        slots = max(2, (3000 - 27) // 500)
        assert refs >= {round(k * 39 / (slots - 1)) + 1 for k in range(slots)}
    with pytest.raises(Exception, match="too many"):
        context.catalog(spark.createDataFrame(rows, "bundle string, doc_no long, doc_id string, idx long, text string"), 2000).collect()
    assert context.words("aa bb " + "c" * 30, 10) == ["aa bb", "c" * 10, "c" * 10, "c" * 10] and context.words("a b", 10) == ["a b"]


def test_halves():
    assert build.halves("a" * 700 + "\n\n" + "b" * 700) == ("a" * 700, "b" * 700)
    assert build.halves("a" * 700 + ". " + "b" * 700) == ("a" * 700 + ".", "b" * 700)
    assert build.halves("x" * 10) == ("x" * 5, "x" * 5)


def test_prompts_are_cut(spark):
    members = spark.createDataFrame([(f"n{k:03}", 1) for k in range(400)], "node string, community long")
    nodes = members.select("node", F.lit("T").alias("type"), F.lit("y" * 50).alias("description"))
    none = spark.createDataFrame([], "src string, dst string, predicate string, doc_id string")
    values = spark.createDataFrame([("n000", "p", str(k), "d") for k in range(9)], "node string, predicate string, value string, doc_id string")
    p = summaries.prompts(summaries.lines(members, nodes, none, values)).first().prompt
    assert len(p) == 12_000 and p.startswith("- n000 (T): yyy") and p.count("    p: ") == 6


def test_network_gradients_and_vectors(spark):
    rng = np.random.default_rng(0)
    x, triples = rng.standard_normal((6, 5)), np.array([[0, 0, 1], [1, 2, 2], [3, 0, 4], [5, 6, 0], [2, 2, 3]])
    s, r, t = triples.T
    w, masks = rgcn.start(5), [np.ones((6, rgcn.DIM))] * 2
    heads, rels, tails, y = np.array([0, 1, 4]), np.array([0, 2, 0]), np.array([1, 2, 5]), np.array([1.0, 1.0, 0.0])
    _, g = rgcn.gradients(w, x, s, r, t, heads, rels, tails, y, masks)
    for key in w:
        for at in [tuple(rng.integers(0, n) for n in w[key].shape) for _ in range(4)]:
            old, loss = w[key][at], []
            for d in (1e-5, -1e-5):
                w[key][at] = old + d
                loss.append(rgcn.gradients(w, x, s, r, t, heads, rels, tails, y, masks)[0])
            w[key][at] = old
            assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(g[key][at], abs=1e-6)
    names = [f"n{k}" for k in range(30)]
    nodes = spark.createDataFrame([(n, "T", f"word{k % 3}") for k, n in enumerate(names)], "node string, type string, description string")
    edges = spark.createDataFrame([(names[k], names[(k * 7 + 3) % 30], ("value", "expects", "other")[k % 3]) for k in range(30)] * 2, "src string, dst string, predicate string")
    model = rgcn.trained(nodes, edges, epochs=30)
    assert model.held == 9 and 0 <= model.auc <= 1 and model.loss < 0.7
    got = {r.node: np.array(r.embedding) for r in rgcn.vectors(nodes, edges, model).collect()}
    feats = {r.node: r.x for r in rgcn.features(nodes).collect()}
    rel = rgcn.links(edges).collect()
    want, _ = rgcn.forward(model.weights, np.array([feats[n] for n in names]), *np.array([(names.index(e.src), e.rel, names.index(e.dst)) for e in rel]).T)
    assert all(np.allclose(got[n], v) for n, v in zip(names, want, strict=True))
    assert rgcn.trained(nodes, edges.limit(2)) is None
    assert rgcn.auc(np.array([2.0, 3.0]), np.array([1.0, 2.5])) == 0.75


def _arms(rng, names=("graph", "vector")):
    out = {}
    for n in names:
        a = np.eye(8) + sum(np.outer(v, v) for v in rng.random((5, 8)))
        out[n] = (np.linalg.inv(a), rng.random(8))
    return out


def test_policies_are_solved_frozen_and_replayed(spark):
    c = catalog.ALL["linucb_predict"][0](spark, DIR).toPandas()
    x = catalog.ALL["context_vectors"][0](spark, DIR).toPandas().set_index("event_id")
    e = spark.read.parquet(f"{DIR}/events.parquet").toPandas().set_index("event_id").loc[x.index]
    reward, arm, v = np.minimum(e.value / 100, 1), e.user_id % 3, x.to_numpy()
    theta = [np.linalg.solve(np.eye(8) + v[arm == k].T @ v[arm == k], v[arm == k].T @ reward[arm == k]) for k in range(3)]
    want = v @ np.array(theta).T
    c = c.set_index("event_id").loc[x.index]
    assert np.allclose(c[[f"reward_{k}" for k in range(3)]], want, atol=2e-5)
    sure = np.sort(want, axis=1)[:, -1] - np.sort(want, axis=1)[:, -2] > 1e-4
    assert (c.engine[sure] == np.array([f"arm{k}" for k in want.argmax(axis=1)])[sure]).all()
    rng = np.random.default_rng(1)
    arms, rows = _arms(rng), [(k, rng.random(8).tolist(), float(rng.random()), float(rng.random())) for k in range(40)]
    d = spark.createDataFrame(rows, "ord long, x array<double>, reward_graph double, reward_vector double").repartition(4)
    for r in router.frozen(d, arms).collect():
        score = {a: np.dot(r.x, t) for a, (_, t) in arms.items()}
        assert r.router_engine == max(score, key=score.get) and r.router_reward == r[f"reward_{r.router_engine}"]
    a, b, want = {n: np.eye(8) for n in arms}, {n: np.zeros(8) for n in arms}, []
    for k, xs, g, w in rows:
        xs = np.array(xs)
        ucb = {n: xs @ np.linalg.solve(a[n], b[n]) + 0.5 * np.sqrt(xs @ np.linalg.solve(a[n], xs)) for n in arms}
        n = max(arms, key=ucb.get)
        got = g if n == "graph" else w
        a[n] += np.outer(xs, xs)
        b[n] += got * xs
        want.append((k, n, got))
    assert [tuple(r) for r in router.replayed(d, ("graph", "vector"), 0.5).collect()] == want


def test_policy_settings_and_routes(spark):
    arms = _arms(np.random.default_rng(2), tuple(engines.ENGINES))
    meta = {"split": "train", "dataset": "d", "dataset_fingerprint": "f", "retrieval_version": "1", "answer_model": "qwen2.5:14b", "extraction_model": "m", "judge_model": "j", "backend": "b"}
    here = {**meta, "answer_model": "Qwen/Qwen2.5-14B-Instruct", "query_model": "org/M"}
    assert router.compatible(meta, here) and not router.compatible({**meta, "retrieval_version": "2"}, here)
    assert router.policy_status(arms, meta, here)["exact_match"] is False and router.policy_status(None, {}, here) == {"deployed": False, "compatible": False}
    router.validate(arms, meta, {"dataset": "d", "fingerprint": "f"}, meta, tuple(engines.ENGINES))
    for wrong in ({"fingerprint": "g"}, {"split": "dev"}):
        with pytest.raises(ValueError):
            router.validate(arms, meta | {k: v for k, v in wrong.items() if k in meta}, {"dataset": "d", "fingerprint": "f", **wrong}, meta, tuple(engines.ENGINES))
    q = spark.createDataFrame([(1, "local")], "question_id long, category string")
    f = lambda n: spark.createDataFrame([(0.5, 0.5, 0.5, n)], "cross_doc_fraction double, recurrence double, num_docs double, n_docs long")
    route = lambda n, a, m: router.routed(q, f(n), a, m, here, ("hybrid", "why"), tuple(engines.ENGINES)).first()
    assert route(0, arms, meta).source == "empty" and route(0, arms, meta).engine == "vector"
    assert (route(3, None, {}).source, route(3, None, {}).engine) == ("corpus_fallback", "hybrid") and "settings" in route(3, arms, {**meta, "retrieval_version": "9"}).reason
    r = route(3, arms, meta)
    assert r.source == "bandit" and r.engine == max(r.rewards, key=r.rewards.get) and "local" in r.reason


def test_uploads(spark, tmp_path):
    files = [("a b.txt", b"text"), ("../x.md", b"more"), ("c.pdf", b"nope"), ("d.txt", b"  \n"), ("e.txt", b"\xff\xfe"), ("f.exe", b"x"), ("g.txt", b"y" * 2_000_000)]
    f = spark.createDataFrame(files, "name string, content binary")
    got = {r.name: (r.chars, r.refused) for r in uploads.checked(f, megabytes=1).collect()}
    assert got["a_b.txt"] == (4, None) and got["x.md"] == (4, None) and got["c.pdf"][1] == "no PDF" and got["d.txt"][1] == "empty" and got["e.txt"][1] == "no UTF-8" and got["f.exe"][1] == "kind of file" and got["g.txt"][1] == "too large"
    with pytest.raises(ValueError, match="no PDF"):
        uploads.accepted(f.limit(3))
    assert {r.doc_id: r.text for r in uploads.texts(uploads.accepted(f.limit(2))).collect()} == {"a_b": "text", "x": "more"}


def test_paced_pages_and_model_calls(tmp_path):
    calls, slept, now = [], [], [0.0]
    replies = iter([(503, b""), (200, b"one"), (404, b"")])

    def sleep(s):
        slept.append(round(s, 2))
        now[0] += s

    site = datasets.Cached(str(tmp_path), lambda u: calls.append(u) or next(replies), sleep, lambda: now[0])
    assert site.read("u") == b"one" and site.read("u") == b"one" and calls == ["u", "u"] and slept == [2.0]
    with pytest.raises(OSError):
        site.read("v")
    answers = iter([(429, {"Retry-After": "7"}, {}), (500, {}, {}), (200, {}, {"choices": [{"message": {"content": "hi"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}), (200, {}, {"choices": [{"message": {"content": "h"}, "finish_reason": "length"}]}), (200, {}, {"choices": []}), (401, {}, {})])
    waits = []
    c = transport.Client("u", {"answer": "m", "judge": "j"}, lambda *_: next(answers), sleep=waits.append, clock=lambda: 0.0)
    assert c.ask("s", "u") == "hi" and waits == [7.0, 1.0] and (c.usage.calls, c.usage.prompt, c.usage.completion) == (1, 3, 2)
    assert c.chat("s", "u", 5) == ("", True) and c.playing("judge").model == "j" and c.playing("query").model == "m"
    for _ in range(2):
        with pytest.raises(transport.ModelError):
            c.ask("s", "u")
    assert transport.wait({}, 2, 0) == 60 and transport.wait({"retry-after": "Thu, 01 Jan 1970 00:01:00 GMT"}, 0, 20) == 40


def test_jobs():
    import threading

    queue, gate = jobs.Jobs(kept=2), threading.Event()
    first = queue.submit("ingest", "me", lambda note: (note("half"), gate.wait(5), 7)[-1])
    second = queue.submit("ingest", "me", lambda note: 1 / 0)
    assert queue.get(first, "you") is None and queue.get("x", "me") is None
    gate.set()
    queue.pool.shutdown(wait=True)
    assert (queue.get(first, "me")["status"], queue.get(first, "me")["result"], queue.get(first, "me")["progress"]) == ("done", 7, "half")
    assert queue.get(second, "me")["status"] == "failed" and "ZeroDivision" in queue.get(second, "me")["error"]


def test_reports(spark):
    m = spark.createDataFrame([("r", '{"a": {"b": 1, "c": "x"}, "d": 2.5, "e": true}')], "run string, m string")
    assert {r.path: r.value for r in reports.flat(m, "run", "m").collect()} == {"a/b": 1.0, "d": 2.5}
    v = spark.createDataFrame([("g", float(k)) for k in (5, 1, 4, 2, 3, 3)] + [("g", None)], "g string, v double")
    assert reports.nearest_ranks(v, ["g"], "v", (0.5, 0.95)).first()[1:] == (6, 3.0, 5.0)
    c = spark.createDataFrame([([("d", f"c{k}", "s" * 400) for k in range(9)],)], "c array<struct<doc_id:string,chunk_id:string,snippet:string>>").select(reports.trimmed(F.col("c")).alias("c")).first().c
    assert len(c) == 6 and len(c[0].snippet) == 320
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, sha256 string")
    r = reports.release(files, "v1", "2025-01-01", "abc", spark.createDataFrame([("auc", 0.5)], "name string, value double"))
    assert reports.newest(r).first().files == {"a": "1", "b": "2"}


def test_nested_tables_and_fragments():
    page = "<table><tr><td>a<table><tr><td>x</td><td>9</td></tr></table></td></tr></table><div>p<br>q</div><style>z</style>"
    assert html.to_text(page).split("\n\n") == ["TABLE ROW x | value: 9", "a", "p", "q"]
    row = [("Net", 1), ("$", 1), ("(", 1), ("5", 1), (")", 1), ("%", 1), ("", 1), ("€", 1), ("7", 2)]
    assert [(c.start, c.end, c.text) for c in html.placed(row)] == [(0, 1, "Net"), (3, 4, "$(5)%"), (8, 10, "€7")]
    assert [c.text for c in html.placed([(")", 1), ("%", 1), ("$", 1)])] == [")%"]


class Slow:
    """A model that says its answer in pieces, slowly, and is cut off the first time."""

    def stream(self, system, user, limit):
        import time

        time.sleep(0.2)
        yield from ("Gamma ", "Part") if limit == 1500 else ("Gamma ", "Partners.")
        if limit == 1500:
            yield models.CUT


def test_streamed_replies():
    said = ['data: {"choices": [{"delta": {"content": "Net "}}]}', "", ": comment", 'data: {"choices": [{"delta": {"content": "5"}, "finish_reason": "%s"}]}', 'data: {"choices": [], "usage": {"prompt_tokens": 7, "completion_tokens": 2}}', "data: [DONE]"]
    for reason, more in (("stop", []), ("length", [models.CUT])):
        client = transport.Client("u", {"answer": "m"}, None, lines=lambda u, h, p, r=reason: iter([x % r if "%s" in x else x for x in said]))
        assert list(client.stream("s", "q", 10)) == ["Net ", "5", *more]
        assert (client.usage.prompt, client.usage.completion, client.usage.estimated) == (7, 2, False)
    with pytest.raises(transport.ModelError):
        list(transport.Client("u", {"answer": "m"}, None, lines=lambda u, h, p: iter(["data: [DONE]"])).stream("s", "q", 10))


def test_traces_add_up():
    now = iter([0.0, 1.0, 2.0, 4.0, 7.0, 7.5, 9.0, 9.0])
    t = traces.Trace(clock=lambda: next(now))
    with t.span("a"):
        with t.span("b"):
            t.model(1, 120, 30, 1.5, False)
        t.token()
    s = t.summary(traces.Prices(True, 1.0, 2.0))
    assert s["stage_ms"] == {"b": 2000.0, "a": 4500.0, "other": 2500.0} and s["latency_ms"] == 9000.0 and s["ttft_ms"] == 7000.0
    assert (s["output_tokens_per_s"], s["llm_by_stage"]["b"]["calls"]) == (20.0, 1) and s["cost_usd"] == pytest.approx(0.00018)
    assert traces.Prices(per_hour=0.4).of(1, 1, 900) == pytest.approx(0.1)


def test_workbench(spark, tmp_path):
    bench = Workbench(spark, str(tmp_path), "a" * 16)
    q = spark.createDataFrame([("q1", "What did Acme Robotics sell in 2025?")], "question_id string, question string")
    assert bench.status()["documents"] == 0 and bench.query(q).first().answer.startswith("No documents")
    table = "COMPANY: Acme Robotics\nSales, in millions\nTABLE HEADERS: item | FY 2025 | FY 2024\n" + "\n".join(f"TABLE ROW product {chr(97 + k)} | FY 2025: {k} ; FY 2024: {k + 1}" for k in range(12))
    docs = spark.createDataFrame([("one", table + "\n\nAcme Robotics met Beta Holdings in Paris Texas."), ("two", "Beta Holdings bought Gamma Partners. Acme Robotics sold pumps in 2025.")], "doc_id string, text string")
    out = bench.ingest(docs)
    assert out["doc_ids"] == ["one", "two"] and out["entities"] > 12 and out["chunks"] >= 3
    assert bench.ingest(docs.limit(1), mode="add")["doc_ids"] == ["one", "two"]  # known ones are skipped
    nodes, edges = bench.graph()
    assert "Acme Robotics" in {r.node for r in nodes.collect()} and edges.where("predicate = 'reports'").count() == 12
    assert bench.communities().count() >= 1 and bench.analysis().first().engine in engines.ENGINES
    assert bench.route(q).first().source == "corpus_fallback"
    r = bench.query(q, "hybrid").first()
    assert r.engine == "hybrid" and r.answer and r.citations and not r.cached
    logged = bench.requests().count()
    spaced = spark.createDataFrame([("q9", "  what did ACME robotics sell in 2025? ")], "question_id string, question string")
    again = bench.query(spaced, "hybrid").first()
    assert (again.question_id, again.cached, again.answer, again.citations) == ("q9", True, r.answer, r.citations) and not bench.query(q, "vector").first().cached
    assert bench.requests().count() == logged + 2 and bench.requests().where("status = 'cached'").count() == 1

    class Watching(models.Extractive):
        def chat(self, system, user, limit):
            return user, False

    watching = Workbench(spark, str(tmp_path), "a" * 16, Watching())
    g = watching.query(q, "graph").first()
    assert g.mode == "local" and "Acme Robotics" in g.path and g.citations[0].snippet
    assert g.answer.startswith("FACTS:\n- ") and "SOURCE TEXT:" in g.answer and "ENTITIES:\n- " in g.answer
    whole = watching.query(spark.createDataFrame([("q2", "What are the overall themes?")], "question_id string, question string"), "graph").first()
    assert whole.mode == "global" and whole.answer.startswith("COMMUNITY SUMMARIES:\n[Community: ") and any(c.chunk_id.startswith("community_") for c in whole.citations)
    assert watching.query(q, "vector").first().answer.startswith("[")
    m = bench.metrics()
    assert m["cached"] == 1 and m["requests"] == bench.requests().count() and {"routing", "retrieval", "generation", "other"} <= set(m["stages"]) and m["citation_coverage"] is not None and m["completion_tokens"] > 0
    for row in bench.requests().where("status = 'ok'").collect():
        assert sum(json.loads(row.detail)["stage_ms"].values()) == pytest.approx(row.latency_ms, rel=0.02)
    slow = Workbench(spark, str(tmp_path), "a" * 16, Slow())
    events = list(slow.stream("What did Beta Holdings buy?", "vector", beat=0.05))
    kinds = [e["event"] for e in events]
    assert kinds[0] == "meta" and kinds[-1] == "done" and kinds.count("reset") == 1 and "alive" in kinds[: kinds.index("token")]
    after = events[kinds.index("reset") :]
    assert "".join(e["text"] for e in after if e["event"] == "token") == events[-1]["answer"] == "Gamma Partners."
    assert slow.metrics()["first_token"]["n"] == 1
    assert [e["event"] for e in slow.stream("what did beta holdings buy?", "vector")] == ["meta", "token", "done"]
    events = list(bench.stream("What did Acme Robotics sell?", "vector"))
    assert events[0]["event"] == "meta" and events[-1]["event"] == "done" and "".join(e["text"] for e in events if e["event"] == "token") == events[-1]["answer"]
    assert next(iter(bench.stream("x" * 3000)))["event"] == "error"
    bench.record("upload", "ok", "graph", 12.0)
    assert bench.recent().first().engine == "graph" and bench.requests(5, "upload").count() == 1 and bench.requests(5, "other").count() == 0
    with pytest.raises(ValueError):
        Workbench(spark, str(tmp_path), "../x")
    with pytest.raises(ValueError):
        bench.ingest(docs.select("doc_id", F.repeat("text", 100_000).alias("text")))
    bench.delete()
    assert bench.status()["documents"] == 0


def test_limiter_and_bandit_are_folds(spark):
    e = spark.read.parquet(f"{DIR}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    log, want = {}, {}
    for k, u, ts in zip(e.event_id, e.user_id, e.ts.astype("datetime64[us]").astype("int64") / 1e6, strict=True):
        log[u] = [x for x in log.get(u, []) if ts - x < 3600]
        want[k] = (True, 0) if not log[u] else (False, max(1, math.ceil(3600 - (ts - log[u][0]))))
        if not log[u]:
            log[u].append(ts)
    got = catalog.ALL["rate_limit_decisions"][0](spark, DIR).toPandas()
    assert dict(zip(got.event_id, zip(got.allowed, got.retry_after, strict=True), strict=True)) == want
    got = catalog.ALL["online_bandit"][0](spark, DIR).toPandas().set_index("event_id")
    for _, rows in e.groupby("event_type"):
        a, b = [np.eye(3), np.eye(3)], [np.zeros(3), np.zeros(3)]
        for k, u, ts, v in zip(rows.event_id, rows.user_id, rows.ts, rows.value, strict=True):
            x = np.array([u % 10 / 10, ts.hour / 24, 1.0])
            ucb = [x @ np.linalg.solve(a[i], b[i]) + 0.5 * np.sqrt(x @ np.linalg.solve(a[i], x)) for i in (0, 1)]
            arm = int(ucb[1] > ucb[0])
            if abs(ucb[0] - ucb[1]) > 1e-9:
                assert got.arm[k] == arm
            arm = got.arm[k]
            r = min(v / 100, 1.0) if arm == 0 else 1 - min(v / 100, 1.0)
            assert got.reward[k] == pytest.approx(r)
            a[arm] += np.outer(x, x)
            b[arm] += r * x
