"""Cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from quaestor.functions import text as T
from quaestor.operators import chunking, community, dense, evaluation, fusion, graph, html, lexical, numeric, resolve, router, service, tables
from quaestor.streaming import streams


def test_bm25_keeps_periods(spark):
    docs = spark.createDataFrame([(0, "2025 EBITDA was 4.5 million"), (1, "2024 EBITDA fell"), (2, "weather"), (3, None)], "doc_id long, text string")
    ask = lambda q: [r.doc_id for r in lexical.bm25(spark.createDataFrame([(1, q)], "question_id long, question string"), docs).orderBy("rank").collect()]
    assert ask("2025 EBITDA")[0] == 0
    assert ask("unheard") == [] and ask("") == []
    none = lexical.bm25(spark.createDataFrame([(1, "x")], "question_id long, question string"), docs.limit(0))
    assert none.count() == 0


def test_fusion_agreement_and_repeats(spark):
    def order(*lists):
        rows = [(1, str(n), r + 1, k) for n, x in enumerate(lists) for r, k in enumerate(x)]
        return [r.doc_id for r in fusion.fuse(spark.createDataFrame(rows, "question_id long, list string, rank long, doc_id string")).orderBy("rank").collect()]

    assert order("ab", "bc")[0] == "b"
    assert order("aa", "b")[:2] == ["a", "b"]
    with pytest.raises(ValueError):
        fusion.fuse(spark.createDataFrame([], "question_id long, list string, rank long, doc_id string"), k=0)


def test_chunks_overlap_and_advance():
    text = "A sentence. " * 600
    spans = chunking.spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b[0] == max(a[1] - 200, a[0] + 1) for a, b in zip(spans, spans[1:]))
    assert chunking.spans("") == [] and chunking.spans("x" * 10) == [(0, 10)]


def test_cosine_of_empty_sides(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q"))
    got = {(r.question_id, r.vec_id): r.score for r in dense.topk(q, v, 5).collect()}
    assert got == {(1, 2): 0.0, (2, 1): 0.0}
    assert dense.topk(q.limit(0), v, 5).count() == 0


def test_ranking_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", i + 1, d) for i, d in enumerate("xayb")], "question_id string, rank long, doc_id string")
    gold = spark.createDataFrame([("q", "a"), ("q", "b")], "question_id string, doc_id string")
    r = evaluation.ranking_scores(ranked, gold).first()
    assert (r.p_at_3, r.r_at_3, r.p_at_5) == (pytest.approx(1 / 3), 0.5, 0.4)
    assert r.ndcg_at_5 == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    ranked = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("q", 3, "b"), ("z", 1, "a")], "question_id string, rank long, doc_id string")
    r = evaluation.ranking_scores(ranked, spark.createDataFrame([("q", "b")], "question_id string, doc_id string")).collect()
    assert len(r) == 1 and (r[0].rr, r[0].p_at_1, r[0].r_at_3) == (0.5, 0.0, 1.0)


def test_features_and_verdict(spark):
    nodes = spark.createDataFrame([("A", [1, 2]), ("B", [1]), ("C", [2])], "node string, source_docs array<long>")
    f = router.features(nodes).first()
    assert (f.cross_doc_fraction, f.recurrence, f.num_docs) == (pytest.approx(1 / 3), 0.2, 0.2)
    cases = spark.createDataFrame([(1, 5, None, None), (3, 0, None, None), (3, 2, 0.05, None), (3, 2, 0.3, 0.5), (3, 2, 0.3, None)], "n_docs long, shared long, modularity double, auc double")
    assert [r.engine for r in router.verdict(cases).collect()] == ["vector"] * 4 + ["graph"]


def test_bandit_statistics_and_choice(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0], 0.5, 2.0)], "arm string, x array<double>, reward double, weight double")
    s = {(r.i, r.j): (r.a, r.b) for r in router.statistics(rows).collect()}
    assert s[0, 1] == (4.0, 0.0) and s[1, 1] == (8.0, 2.0) and s[0, 0] == (2.0, 1.0)
    rows = [("a" if k % 2 else "b", [float(k % 5 - 2), 1.0], float((k % 5 > 2) == bool(k % 2)), 1.0) for k in range(200)]
    rows = spark.createDataFrame(rows, "arm string, x array<double>, reward double, weight double")
    arms = router.policy(router.statistics(rows), 2)
    assert [r.engine for r in router.predict(spark.createDataFrame([([2.0, 1.0],), ([-2.0, 1.0],)], "x array<double>"), arms).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="latency"):
        spark.createDataFrame([(1.0, None)], "r double, l double").select(router.effective_reward(F.col("r"), F.col("l"), 0.2)).collect()


def test_graph_context_excludes_others(spark):
    e = spark.createDataFrame([("A", "B", "c1"), ("X", "Y", "c2")], "src string, dst string, chunk_id string")
    near = graph.hops(e, spark.createDataFrame([("A",)], "node string"))
    assert [r.chunk_id for r in graph.inside(e, near).collect()] == ["c1"]


def test_filing_html():
    page = "<p>Before</p><table><tr><th></th><th colspan=2>Q2 2025</th><th colspan=2>Q2 2024</th></tr><tr><td>Sales</td><td>9</td><td></td><td>8</td><td></td></tr><tr><td>Costs:</td></tr><tr><td>Total</td><td>$</td><td>108</td><td>(56</td><td>)</td></tr></table><p>After</p>"
    assert html.to_text(page).split("\n") == ["Before", "", "TABLE HEADERS: Q2 2025 | Q2 2024", "TABLE ROW Sales | Q2 2025: 9 ; Q2 2024: 8", "TABLE SECTION Costs:", "TABLE ROW Costs - Total | Q2 2025: $108 ; Q2 2024: (56)", "", "After"]
    assert html.to_text(None) == "" and html.to_text("<script>x</script>a&amp;b") == "a&b"
    assert html.to_text("<table><tr><td>only</td><td>layout</td></tr></table>") == "only layout"


def _rows(spark, text):
    docs = spark.createDataFrame([("d", text), ("empty", ""), ("none", None)], "doc_id string, text string")
    rows = tables.table_rows(docs).where("doc_id = 'd'").orderBy("tab", "row_no").collect()
    return docs, [(r.caption, r.label, [tuple(c) for c in r.cells]) for r in rows]


def test_tables_in_text(spark):
    docs, rows = _rows(spark, "Intro\nTABLE HEADERS: net | 5 | 6\nTABLE ROW total | 5: 7 ; 6: 8\n\n\n\nOutro")
    assert rows == [("Intro", "net", [("value", "5"), ("value", "6")]), ("Intro", "total", [("value", "7"), ("value", "8")])]
    assert {r.doc_id: r.text for r in tables.prose(docs).collect()} == {"d": "Intro\n\nOutro", "empty": "", "none": ""}
    docs, rows = _rows(spark, "x  Q1 2025  Q1 2024\nrevenue  1,234  987\nprose\n2025  2024\nno row")
    assert rows == [("", "revenue", [("x", "1,234"), ("Q1 2025", "987")])]
    assert [r.text for r in tables.prose(docs).where("doc_id = 'd'").collect()] == ["prose\n2025  2024\nno row"]
    _, rows = _rows(spark, "A\nTABLE HEADERS: i | FY 2025\nTABLE HEADERS: i | FY 2024\nTABLE SECTION Costs:\nTABLE ROW Total | FY 2024: 5 ; bad ; x: y: 6\nTABLE ROW none\nTABLE HEADERS: j\nTABLE ROW Other | : 1\nB\nTABLE ROW net | c: 2")
    assert rows == [("A", "Costs - Total", [("FY 2024", "5"), ("x: y", "6")]), ("A", "Other", [("", "1")]), ("B", "net", [("c", "2")])]
    who = lambda t: spark.createDataFrame([(t,)], "t string").select(tables.company(F.col("t"))).first()[0]
    assert who("COMPANY: Acme Inc (ACM)\n") == "Acme Inc" and who("plain") is None and who(None) is None and who("SOURCE: AB/2020/p1") == "AB"
    assert who("Big Co said Small Inc. and Small Inc. did") == "Small Inc."


def test_units_skip_rates(spark):
    docs = spark.createDataFrame([("d", "Figures in millions\nTABLE HEADERS: item | employees | x\nTABLE ROW revenue | employees: 5\nTABLE ROW gross margin | employees: 4\nTABLE ROW costs | 2025: 4 % ; in %: 3")], "doc_id string, text string")
    got = {(r.subject, r.predicate): r.evidence for r in tables.facts(tables.cells(docs)).collect()}
    assert {k for k, e in got.items() if e.endswith("(in millions)")} == {("revenue", "employees")} and len(got) == 4


def test_facts_and_chunks_cite_the_same(spark):
    rows = "\n".join(f"TABLE ROW metric {k} | FY 2025: $ {k}" for k in range(95))
    text = f"COMPANY: Acme\nCaption\nTABLE HEADERS: m | FY 2025\n{rows}\n\nmore prose\nTABLE ROW last | FY 2025: 1"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    chunks = {r.chunk_id: r.text for r in tables.table_chunks(tables.table_rows(docs)).collect()}
    assert sorted(chunks) == [f"d::table{k}" for k in range(4)]
    assert all(chunks[f"d::table{k}"].startswith("Caption\nTABLE HEADERS: m | FY 2025\nTABLE ROW metric") for k in range(3))
    said = tables.facts(tables.cells(docs)).collect()
    for f in said:
        assert (f.predicate != "reports" and f"{f.subject.removeprefix('Acme ')} | FY 2025: {f.object}" in chunks[f.chunk_id]) or f.object.removeprefix("Acme ") in chunks[f.chunk_id]
    assert sum(f.predicate == "reports" for f in said) == 96 and len(said) == 192


def test_names(spark):
    assert resolve.year_aware("revenue Q2 2025", "revenue Q2 2024") < 0.5 < resolve.year_aware("revenue Q2 2025", "revenue Q2 2025")
    rows = [(0, "Acme Robotics, Inc.", False), (1, "the Acme Robotics", False), (2, "net revenue Q2 2025", False), (3, "net revenue Q2 2024", False), (4, "Acme Robotic", True), (5, "acme robotics, inc.", False)]
    got = {r.ord: r.canonical for r in resolve.resolve(spark.createDataFrame(rows, "ord long, name string, exact boolean")).collect()}
    assert got == {0: "Acme Robotics, Inc.", 1: "Acme Robotics, Inc.", 2: "net revenue Q2 2025", 3: "net revenue Q2 2024", 4: "Acme Robotic", 5: "Acme Robotics, Inc."}


def test_literals_and_periods(spark):
    cases = [("$108.8 million", True), ("up", True), ("Acme Inc 2025", False), ("Acme", False), ("one two three four five six 7", False)]
    got = spark.createDataFrame(cases, "s string, want boolean").select(T.is_literal(F.col("s")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    cases = [("Q2 2025", True), ("June 30, 2025", True), ("FY2024", True), ("2025", True), ("Q5 2025", False), ("june 30, 2025", False)]
    got = spark.createDataFrame(cases, "s string, want boolean").select(T.is_period(F.col("s")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


@pytest.mark.parametrize(
    ("answer", "gold", "human", "program", "question", "right"),
    [
        ("FINAL_NUMERIC_ANSWER: 12.5%", "0.125", "12.5%", "divide(1, 8)", "", True),
        ("FINAL_NUMERIC_ANSWER: 12.5", "0.125", "12.5%", "divide(1, 8)", "", True),
        ("FINAL_NUMERIC_ANSWER: 12.5%", "12.5", "12.5%", "multiply(0.125, const_100)", "", True),
        ("FINAL_NUMERIC_ANSWER: 12.5%", "12.5", "12.5", "", "", False),
        ("FINAL_NUMERIC_ANSWER: (56)", "-56", "-56", "", "", True),
        ("FINAL_NUMERIC_ANSWER: (56", "-56", "", "", "", False),
        ("FINAL_NUMERIC_ANSWER: 1\nFINAL_NUMERIC_ANSWER: 1", "1", "", "", "", False),
        ("FINAL_NUMERIC_ANSWER: nan", "1", "", "", "", False),
        ("FINAL_NUMERIC_ANSWER: 71 thousand barrels per day", "71", "", "", "", True),
        ("FINAL_NUMERIC_ANSWER: 1.2 billion", "1200", "", "", "how much, in millions?", True),
        ("FINAL_NUMERIC_ANSWER: 1.2 million", "1200", "", "", "how much, in millions?", False),
        ("FINAL_NUMERIC_ANSWER: yes", "yes", "", "", "", True),
        ("it is about 5", "5", "", "", "", False),
        ("", "5", "", "", "", False),
    ],
)
def test_numeric(answer, gold, human, program, question, right):
    assert numeric.score(answer, gold, human, program, question) == (5.0 if right else 0.0)


def test_communities(spark):
    cliques = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0)]
    got = community.detect(spark.createDataFrame(cliques, "u string, v string, weight double")).collect()
    where = {r.node: r.community for r in got}
    assert len({where[f"a{i}"] for i in range(5)}) == 1 and where["a1"] != where["b1"] and got[0].modularity > 0.4
    spread = {r.node: r.community for r in community.spread(spark.createDataFrame(cliques, "u string, v string, weight double"), 6).collect()}
    assert len(set(spread.values())) < 10


def test_round_robin(spark):
    rows = spark.createDataFrame([(g, k) for g in "abcd" for k in range(3)], "g string, k long")
    assert {r.g for r in service.round_robin(rows, "g", ["k"], 5).collect()} == set("abcd")


def test_limiter_rejections_do_not_count(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, 1L AS user_id, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 25) AS ts FROM range(8)")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = streams.drained(streams.limited(streams.source(spark, str(tmp_path), "events"), 2, 60.0)).orderBy("event_id").collect()
    assert [r.allowed for r in got] == [True, True, False, True, True, False, True, True]
    assert got[2].retry_after == 10


def test_context_budget_and_passages(spark):
    from quaestor.operators import context

    s = spark.createDataFrame([(1, k, "x" * 50) for k in range(6)], "g long, o long, text string")
    assert [len(r.text) for r in context.bounded(s, "g", "o", 310).orderBy("o").collect()] == [50, 50, 50]
    rows = "\n".join(f"TABLE ROW item {k} | 2025: {k}" for k in range(40))
    got = context.passages(rows + "\n\nSafe harbor: forward-looking statements")
    assert "\n".join(got) == rows and all(len(p) <= 450 for p in got)
    assert context.passages("") == [] and all(len(p) <= 450 for p in context.passages("word " * 400))
    q = spark.createDataFrame([("net  revenue\nrose 5%", "The net revenue rose 5% in May"), ("net revenue rose 6%", "net revenue rose 5%"), ("", "x")], "quote string, text string")
    assert [r.found for r in context.quoted(q).collect()][:2] == ["net revenue rose 5%", None]


def test_engines_and_answers(spark):
    from quaestor.functions import models
    from quaestor.operators import engines

    chunks = spark.createDataFrame([("a", "d1", "Acme revenue rose to 5 million in 2025"), ("b", "d1", "Beta hired a chairman"), ("c", "d2", "weather was fine")], "chunk_id string, doc_id string, text string").withColumn("vec", models.embed(F.col("text")))
    edges = spark.createDataFrame([("Acme", "Beta", "owns", "b"), ("X", "Y", "is", "c")], "src string, dst string, predicate string, chunk_id string")
    values = spark.createDataFrame([("Acme", "revenue", "5 million", "a")], "node string, predicate string, value string, chunk_id string")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    communities = spark.createDataFrame([(0, 0, ["X", "Y"], "weather themes"), (1, 0, ["Acme", "Beta"], "companies")], "community long, level int, members array<string>, summary string")
    corpus = engines.Corpus(chunks, nodes, edges, values, communities)
    q = spark.createDataFrame([(1, "What was the revenue of Acme in 2025?", ["Acme"]), (2, "What are the overall weather themes?", [])], "question_id long, question string, entities array<string>")
    got = {}
    for r in engines.evidence(q, corpus).orderBy("engine", "question_id", "rank").collect():
        got.setdefault((r.engine, r.question_id), []).append(r.chunk_id)
    assert got["hybrid", 1][0] == "a" and got["vector", 1][0] == "a" and set(got["graph", 1]) == {"a", "b"}
    assert "c" in got["graph", 2]
    prompts = spark.createDataFrame([(1, "Acme revenue rose. Beta fell.", "what about Beta?"), (2, "", "x")], "question_id long, context string, question string")
    assert {r.question_id: r.answer for r in models.answer(prompts, models.Extractive()).collect()} == {1: "Beta fell.", 2: models.NOTHING}


def test_state(spark, tmp_path):
    from quaestor.sources import state, uploads

    a, b = "a" * 16, "b" * 16
    state.save(spark.createDataFrame([(1,)], "x long"), f"{tmp_path}/t", a)
    state.save(spark.createDataFrame([(2,)], "x long"), f"{tmp_path}/t", b)
    state.save(spark.createDataFrame([(3,)], "x long"), f"{tmp_path}/t", a)
    assert [r.x for r in state.load(spark, f"{tmp_path}/t", a).collect()] == [3] and [r.x for r in state.load(spark, f"{tmp_path}/t", b).collect()] == [2]
    with pytest.raises(ValueError):
        state.save(spark.range(1), f"{tmp_path}/t", "../x")
    good = '{"question_id": "q", "split": "train", "context": [1,1,1,1,1,1,1,1], "reward_graph": 0.5, "reward_vector": 1, "reward_hybrid": 0, "signature": "s"}'
    (tmp_path / "r.jsonl").write_text(good + "\n")
    assert state.rewards(spark, str(tmp_path / "r.jsonl")).count() == 1
    (tmp_path / "r2.jsonl").write_text(good + "\n" + good.replace("0.5", "1.5") + "\n")
    with pytest.raises(ValueError):
        state.rewards(spark, str(tmp_path / "r2.jsonl"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_bytes(b"t\xffwo\xe2\x82 \xef\xbf\xbd")
    (tmp_path / "in" / "a.md").write_text("one")
    (tmp_path / "in" / "c.bin").write_text("no")
    assert [(r.doc_id, r.text) for r in uploads.folder(spark, str(tmp_path / "in")).collect()] == [("a", "one"), ("b", "two \ufffd")]
