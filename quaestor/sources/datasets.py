"""Question sets and filings from outside: the JSON of a question set, and a paced, cached HTTP source.

Neither reads anything but what its fields name: answers never reach a document's text.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators import questions
from quaestor.sources import filings

EXAMPLE = "id string, pre_text array<string>, post_text array<string>, table array<array<string>>, qa struct<question:string,answer:string,exe_ans:string,program:string,gold_inds:map<string,string>>"
#: Seconds between requests, seconds to wait by attempt when turned away, attempts.
PACE, WAIT, ATTEMPTS = 0.2, 2.0, 5


def examples(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """id, split, report, question, answer, human, program, text, quotes of the examples. paths: split -> JSON file."""
    out = None
    for split, path in paths.items():
        raw = spark.read.schema(EXAMPLE).option("multiLine", True).json(path)
        text = filings.question_document(F.col("id"), F.col("pre_text"), F.col("table"), F.col("post_text"))
        rows = raw.select("id", F.lit(split).alias("split"), filings.report_id(F.col("id")).alias("report"), "qa.question", F.col("qa.exe_ans").alias("answer"), F.col("qa.answer").alias("human"), "qa.program", text.alias("text"), F.map_values("qa.gold_inds").alias("quotes"))
        out = rows if out is None else out.unionByName(rows)
    return out


def prepared(rows: DataFrame, limits: dict[str, int], seed: int = 0, size: int = 8) -> DataFrame:
    """Chosen examples of report-disjoint splits in bundles, with their evidence; raises if a split is left without any."""
    chosen = questions.bundled(questions.disjoint(rows, limits, seed), size)
    have = {r.split for r in chosen.select("split").distinct().collect()}  # three splits
    if missing := set(limits) - have:
        raise ValueError(f"no examples left for {', '.join(sorted(missing))}")
    evidence = F.transform(F.coalesce("quotes", F.array()), lambda q: F.struct(F.col("doc_id").alias("doc_id"), q.alias("quote")))
    return chosen.select("id", "split", "bundle", "report", "doc_id", "text", "question", F.col("answer").alias("reference_answer"), "human", "program", F.col("doc_id").alias("source_doc_id"), evidence.alias("evidence"))


def fingerprint(bundles: DataFrame) -> DataFrame:
    """bundle, fingerprint: SHA-256 over the bundle's documents and questions in order."""
    part = F.sha2(F.to_json(F.struct("doc_id", "text", "id", "question", "reference_answer")).cast("binary"), 256)
    return bundles.groupBy("bundle").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "").cast("binary"), 256).alias("fingerprint"))  # a bundle is a handful of documents


class Cached:
    """Pages of a site: from a folder if they were read before, else by `get`, paced, and again later when turned away.

    get: url -> (status, body). The folder is the driver's: a feed of some hundred small pages goes through here, and what is
    read becomes a table.
    """

    def __init__(self, folder: str, get: Callable[[str], tuple[int, bytes]], sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.folder, self.get, self.sleep, self.clock = Path(folder), get, sleep, clock
        self.next = 0.0

    def read(self, url: str) -> bytes:
        path = self.folder / hashlib.sha256(url.encode()).hexdigest()
        if path.exists():
            return path.read_bytes()
        for attempt in range(ATTEMPTS):
            if (wait := self.next - self.clock()) > 0:
                self.sleep(wait)
            status, body = self.get(url)
            self.next = self.clock() + PACE
            if status == 200:
                self.folder.mkdir(parents=True, exist_ok=True)
                part = path.with_suffix(".part")
                part.write_bytes(body)
                part.replace(path)
                return body
            if status not in (429, 503):
                break
            self.sleep(WAIT * 2**attempt)
        raise OSError(f"{url}: status {status}")


def by_http(agent: str) -> Callable[[str], tuple[int, bytes]]:
    """`get` over the network; the agent names who asks, as public archives want."""

    def get(url: str) -> tuple[int, bytes]:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, headers={"User-Agent": agent}), timeout=60) as r:
                return r.status, r.read()
        except HTTPError as e:
            return e.code, b""

    return get


def pages(spark: SparkSession, source: Cached, urls: list[str]) -> DataFrame:
    """url, content of the pages, as a table."""
    return spark.createDataFrame([(u, bytearray(source.read(u))) for u in urls], "url string, content binary")
