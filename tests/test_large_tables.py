"""Lines of one large document meet in one task only as marked lines; state is carried over batches."""

from quaestor.operators import tables


def _windows(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Window [")


def test_rows_of_a_long_document(spark):
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    n = 500
    text = "\n".join(["Sizes, in millions", "TABLE HEADERS: m | FY 2025", "TABLE SECTION Costs:", *[f"TABLE ROW {'total' if k % 2 else 'm'} {k} | FY 2025: {k}" for k in range(n)], "", "x  Q1 2025  Q1 2024", *[f"row{k}  {k}  {k + 1}" for k in range(n)], "", "row  1  2"])
    docs = spark.createDataFrame([("a", text), ("b", text), ("c", "prose")], "doc_id string, text string")
    spark.conf.set(key, "64")
    try:
        df = tables.table_rows(docs)
        assert _windows(df) == 0  # before: nine windows over all columns of a document's lines in one task
        rows = df.orderBy("doc_id", "tab", "row_no").collect()
    finally:
        spark.conf.set(key, old)
    one = [(0, k, k // 40, "Sizes, in millions", "millions", f"Costs - total {k}" if k % 2 else f"m {k}", [("FY 2025", str(k))]) for k in range(n)]
    two = [(1, k, 13 + k // 40, "", "", f"row{k}", [("x", str(k)), ("Q1 2025", str(k + 1))]) for k in range(n)]
    want = [(d, *r) for d in "ab" for r in one + two]
    assert [(r.doc_id, r.tab, r.row_no, r.part, r.caption, r.unit, r.label, [tuple(c) for c in r.cells]) for r in rows] == want
