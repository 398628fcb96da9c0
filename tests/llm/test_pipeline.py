"""The pipeline's stages, and the queries with SQL."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quaestor.llm import catalog, common, mixing, pieces
from tests.llm.test_ops import WORDS, classes

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, DIR).toPandas()
    cols = sorted(want.columns)
    text = lambda f: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in f[cols].astype(object).values.tolist())
    assert cols == sorted(got.columns) and text(got) == text(want)


def classes_of(rows):
    """Ids repeat, so each row counts by its place."""
    return {c for _, c in classes([(n, t) for n, (_, t, _) in enumerate(rows)])}


def test_stages(spark, docs, empty):
    d = common.read(spark, DIR, "documents").unionByName(docs.select(*pipeline.COLUMNS))
    for n, (name, stage) in enumerate(pipeline.STAGES):
        before = [(r.doc_id, r.text, r.source) for r in d.select("doc_id", "text", "source").collect()]
        out = common.cut(stage(spark, d.withColumn("node", F.lit(1)), DIR))
        rows = out.collect()
        if n == 4:
            c = pieces.codec(pieces.default_model())
            assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted((str(k), len(c.encode(t))) for k, t, _ in before)
            break
        assert tuple(out.columns) == pipeline.COLUMNS
        if n == 0:
            assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str((k, t)) for k, t, _ in before if any(ch.isalpha() for ch in t or ""))
        if n == 1:
            norm = lambda t: "".join((t or "").split())
            assert sorted(norm(r.text) for r in rows) == sorted({norm(t) for _, t, _ in before})
        if n == 2:
            stay = {c for _, c in classes([(k, t) for k, t, _ in before])}
            assert {float("inf") if r.doc_id is None else r.doc_id for r in rows} == stay and len(rows) == len(classes_of(before))
        if n == 3:
            times = collections.Counter((r.doc_id, r.text) for r in rows)
            assert set(times) <= {(k, t) for k, t, _ in before} and max(times.values()) <= 2
            sizes = lambda rows: collections.Counter({s: sum(len(WORDS.findall(t or "")) for _, t, o in rows if o == s) for s in {o for _, _, o in before}})
            got, had, longest = sizes([(r.doc_id, r.text, r.source) for r in rows]), sizes(before), max(len(WORDS.findall(t or "")) for _, t, _ in before)
            for r in mixing.targets(mixing.sized(d)).collect():
                # Rounding moves a source by half of the two documents at the ends of its last pass.
                assert abs(got[r.source] - r.target) <= longest and had[r.source] == r.source_size
        d = out
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0
