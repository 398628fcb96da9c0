"""The corpus pipeline: five training-data operators, each over all that the one before kept.

Decisions are about rows, known by file and place, so that repeated ids and null ids need no care: of equal rows one stays.
Decisions travel as marks of a bit or two; no stage shuffles the texts that it passes on.

Defined results, in all stages: a null text counts as empty; empty texts have no language and go in the first stage; an
empty table gives an empty result; columns other than those of documents are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import exact_dedup, language_id, minhash, mixing, pieces
from quaestor.llm.common import PLACE, cut, located, own_columns, remainder, ship, with_marks

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Segments that a worker remembers in piece encoding: a quarter of op9's, as the stages before have grown the executors' JVMs.
REMEMBER = 80_000


def _of(docs: DataFrame) -> DataFrame:
    return own_columns(docs, *COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; a missing language is filled in."""
    docs = _of(docs)
    learn = docs.select("doc_id", "text", "lang").where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull())
    seen = language_id.predict(docs, *language_id.prototypes(learn), keep=COLUMNS)
    return seen.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return with_marks(docs, gone.select(*PLACE, F.lit(1).alias("_mark"))).where("_mark = 0").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    docs = located(docs, *COLUMNS)
    return _without(docs, exact_dedup.exact_dedup(docs, keep=(*PLACE, "stays")).where("NOT stays"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one stays."""
    docs = located(docs, *COLUMNS)
    return _without(docs, minhash.near_dedup(docs, keep=(*PLACE, "stays")).where("NOT stays"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes its words, rounded: never, once or twice."""
    docs = located(docs, *COLUMNS)
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = mixing.mix(docs, keep=PLACE).where("size > 0").select(*PLACE, times.alias("_mark")).where("_mark > 0")
    return with_marks(docs, taken).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_mark")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: number and digest of the ids, digest of the decoded text."""
    return pieces.digest_column(_of(docs), pieces.default_model(), REMEMBER)


STAGES = [("language identification", language), ("exact dedup", exact), ("near dedup", near), ("source mixture", mixture), ("piece encoding", encoded)]
#: Band hashes and piece encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if n == 0 else cut(docs), sf_dir)
    return docs
