import pytest

from quaestor.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, size string, digest string, score double, key int, rank int, bucket string"
LONG = "the quick brown fox jumps over the lazy dog and runs far away " * 3000


def rows():
    words = [f"word{k % 17}{'abcdefghij'[k % 10]}" for k in range(400)]
    base = " ".join(words)
    near = " ".join([*words[:200], "changed", *words[201:]])
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, None, "en", "b"), (5, "", "de", None), (6, "  \t\n", None, None), (7, LONG, "en", "a"),
        (8, "Der schnelle braune Fuchs springt", "de", "c"), (9, "short", None, "c"), (10, "BASE " + base, None, "a"), (11, base.replace(" ", "  "), "en", "b"), (12, "12 34 !!", "en", "c"),
        (None, "a text without an id", "en", "c"), (13, "same row", "en", "c"), (13, "same row", "en", "c"), (14, "\x01mark\x02 token: abcdef1", "en", "c"), (15, "Ünïcödé 日本語 😀 text", "fr", "d"),
    ]
    return [(i, t, lang, s, len(t or ""), 7, "x", "y", 0.5, 3, 1, "z") for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)
