"""Numbers of bundles and rows in groups of any size, and choices that no task orders whole."""

from quaestor.operators import questions, service


def test_more_bundles_than_four_digits(spark):
    docs = spark.range(80_100).selectExpr("id AS doc_id", "'all' AS split")
    got = service.bundles(docs, "split", "doc_id").groupBy("bundle").count().collect()
    assert {r["count"] for r in got} == {4, 8} and {r.bundle for r in got} == {f"all_{k:04d}" for k in range(10_013)}


def test_numbers_of_repeated_and_null_keys(spark):
    rows = [("a", 3), ("a", 1), ("a", 1), ("a", None), (None, 5), (None, 2)]
    got = service.numbered(spark.createDataFrame(rows, "g string, k int"), "g", "k").collect()
    assert sorted((str(r.g), str(r.k), r.n) for r in got) == [("None", "2", 0), ("None", "5", 1), ("a", "1", 1), ("a", "1", 2), ("a", "3", 3), ("a", "None", 0)]


def test_the_first_of_a_split_are_cut_by_each_task(spark):
    rows = spark.range(50).selectExpr("cast(id AS string) AS id", "'train' AS split", "cast(id % 9 AS string) AS report", "'q' AS question", "'a' AS answer")
    chosen = questions.disjoint(rows, {"train": 7}, 3)
    want = [r.id for r in questions.shuffled(rows, "id", 3).orderBy("place").limit(7).collect()]
    assert [r.id for r in chosen.orderBy("place").collect()] == want
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Limit" in plan
