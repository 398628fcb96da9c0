"""Readers and report parts that queries use only in pieces, on small cases with known results."""

import json

import pytest
from pyspark.sql import functions as F

from quaestor.functions import text as T
from quaestor.operators import build, judging, questions, reports
from quaestor.sources import datasets, filings


def test_names_and_requests(spark):
    rows = spark.createDataFrame([("  The  Acme  Corp ", "/api/query/stream", "1.2.3.4, 5.6.7.8", "9.9.9.9"), ("this one", "/api/ingest", " ", "9.9.9.9"), ("Theory", "/api/other", None, "9.9.9.9")], "name string, path string, forwarded string, peer string")
    got = rows.select(T.without_article(F.col("name")).alias("n"), T.route_group(F.col("path")).alias("g"), T.client_ip(F.col("forwarded"), F.col("peer")).alias("ip"), T.entity_text(F.col("name"), F.lit("Company"), F.lit(None).cast("string")).alias("t")).collect()
    assert [(r.n, r.g, r.ip) for r in got] == [("Acme Corp", "query", "1.2.3.4"), ("one", "ingest", "9.9.9.9"), ("Theory", "other", "9.9.9.9")]
    assert got[1].t == "this one (Company): "


def test_company_names(spark):
    titles = {"COSTCO WHOLESALE CORP /NEW": "Costco Wholesale Corp", "  3M  CO ": "3M CO", "IBM Global /DE/": "IBM Global", "A/B TESTING": "A/B Testing", "": ""}
    d = spark.createDataFrame([(k,) for k in titles], "t string")
    assert {r.t: r.n for r in d.select("t", filings.company_name(F.col("t")).alias("n")).collect()} == titles


def test_question_files(spark, tmp_path):
    one = {"id": "ACME/2020/page_1.pdf-1", "pre_text": ["before"], "post_text": ["after"], "table": [["", "2020"], ["sales", "5"]], "qa": {"question": "sales?", "exe_ans": 5.0, "answer": "5", "program": "x", "gold_inds": {"table_1": "the sales of 2020 is 5"}}}
    (tmp_path / "train.json").write_text(json.dumps([one]))
    r = datasets.examples(spark, {"train": str(tmp_path / "train.json")}).first()
    assert (r.id, r.split, r.question, r.human, r.program) == (one["id"], "train", "sales?", "5", "x") and float(r.answer) == 5.0
    assert r.quotes == ["the sales of 2020 is 5"] and all(w in r.text for w in ("before", "after", "sales", "2020")) and "ACME" in r.report


def test_shared_questions_and_gold(spark):
    numeric = spark.createDataFrame([("n1", "b1", "how much?")], "id string, bundle string, question string")
    texts = spark.createDataFrame([("t1", "b1", "why?", [("d1",), ("d2",), ("d1",)], "d3"), ("t2", "b2", "who?", [], None)], "id string, bundle string, question string, evidence array<struct<doc_id:string>>, source_doc_id string")
    both = {r.id: (r.task, r.question) for r in questions.shared(numeric, texts).collect()}
    assert both == {"n1": ("numeric", "how much?"), "b1:text:t1": ("text", "why?"), "b2:text:t2": ("text", "who?")}
    assert sorted(map(tuple, questions.gold(texts).collect())) == [("t1", "d1"), ("t1", "d2"), ("t1", "d3")]


def test_heroes_and_human_scores(spark):
    long = "What was the revenue of Acme in the second quarter of 2025, in millions?"
    rows = [(1, "short", {"graph": 0.1}, {"graph": 0.5}, None), (2, long, {"graph": 0.1, "vector": 0.7}, {"graph": 1.0, "vector": 0.4}, None), (3, long, {"graph": 0.1}, {"graph": 0.2, "hybrid": 0.9}, "hybrid"), (4, long, None, {"graph": 1.0}, None)]
    q = spark.createDataFrame(rows, "question_id long, question string, predicted map<string,double>, rewards map<string,double>, router_engine string")
    assert [(r.question_id, r.chosen, r.router_reward, r.oracle_reward) for r in reports.heroes(q).collect()] == [(2, "vector", 0.4, 1.0), (3, "hybrid", 0.9, 0.9)]
    sheet = spark.createDataFrame([(1, "graph", "4"), (1, "vector", ""), (2, "graph", "2")], "question_id long, engine string, human string")
    records = spark.createDataFrame([(1, "graph", 5.0), (1, "vector", 3.0), (2, "graph", None)], "question_id long, engine string, score double")
    assert [(r.question_id, r.engine, r.a, r.b) for r in judging.compared(sheet, records).collect()] == [(1, "graph", 4.0, 5.0)]


class Limited:
    """A model whose answer is cut off above `most` characters of passage and room; it returns the passage's words as names."""

    def __init__(self, most):
        self.most, self.asked = most, []

    def chat(self, system, user, limit):
        self.asked.append((len(user), limit, system))
        if "nolists" in user and build.AGAIN not in system or "never" in user:
            return "{}", False
        if len(user) > self.most or "loop" in user:
            return "", True
        return "```json\n" + json.dumps({"entities": [{"name": w} for w in user.split()], "triples": []}) + "\n```", False


def test_extraction_in_halves(spark):
    words = [f"w{k:03d}" for k in range(400)]  # 1,999 characters
    text = " ".join(words)
    assert [e["name"] for e in build.items(text, Limited(800))["entities"]] == words  # in order, through halves of halves
    m = Limited(150)
    assert build.items(text, m)["entities"] == [] and {r for _, r, _ in m.asked} == {4096, 8192, 16384}  # quarters are too long still
    assert build.items("loop " * 20, Limited(10_000)) == {"entities": [], "triples": []}
    m = Limited(10_000)
    assert [e["name"] for e in build.items("nolists here", m)["entities"]] == ["nolists", "here"] and len(m.asked) == 2
    with pytest.raises(ValueError, match="no lists"):
        build.items("never", Limited(10))
    chunks = spark.createDataFrame([("c1", "Acme buys Beta\n\nforward-looking statements apply")], "chunk_id string, text string")
    r = build.extractor(Limited(100))(chunks).first()
    assert r.chunk_id == "c1" and [e["name"] for e in json.loads(r.response)["entities"]] == ["Acme", "buys", "Beta"]
