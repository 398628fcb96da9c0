"""Scoring of scalar answers: parsing, units and scales, tolerance by the published precision."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marker, units and their factors, and the form of a scalar answer.
MARKER = "final_numeric_answer:"
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
PERCENT = ("%", "percent", "percentage points")
SCALAR = re.compile(
    r"[$€£]?\s*(?P<open>\()?\s*(?P<number>[+-]?(?:\d[\d,]*(?:\.\d*)?|\.\d+))\s*(?P<close>\))?\s*"
    r"(?P<unit>%|percent|percentage points|ratio|thousand|million|billion|dollars|usd)?(?:\s+[a-z][a-z\s/-]*)?\s*\.?"
)
TIMES_100 = re.compile(r"multiply\([^)]*(?:const_100|\b100)\b")


@dataclass(frozen=True)
class Scalar:
    value: float | str
    unit: str = "number"
    decimals: int = 0


def parse(text: object) -> Scalar | None:
    """The one scalar that a text states, after its marker if it has one; None if there is none or more than one."""
    t = str(text).strip().lower().replace("−", "-")
    marked = t.split(MARKER)
    if len(marked) > 2:
        return None
    if len(marked) == 2 and marked[1].strip():
        t = marked[1].lstrip().split("\n")[0].strip()
    if (word := t.strip(". ")) in ("yes", "no"):
        return Scalar(word, "boolean")
    m = SCALAR.fullmatch(t)
    if not m or bool(m["open"]) != bool(m["close"]):
        return None
    value = float(m["number"].replace(",", ""))
    if not math.isfinite(value):
        return None
    return Scalar(-abs(value) if m["open"] else value, m["unit"] or "number", len(m["number"].partition(".")[2]))


#: What an answer's number is taken by, for its unit and what is expected: a ratio (published as a percentage), points, or neither.
READINGS = {
    "percent": {"ratio": (0.01,), "points": (1.0,), "": ()},
    "number": {"ratio": (1.0, 0.01), "points": (1.0,), "": (1.0,)},
}
MONEY = ("dollars", "usd")


def _readings(got: Scalar, human: Scalar | None, ratio: bool, points: bool, question: str) -> list[float]:
    """What the answer's number may mean in the unit of the expected value."""
    expected = "ratio" if ratio else "points" if points else ""
    own, scale = SCALES.get(got.unit), SCALES.get(human.unit) if human else None
    factors = READINGS["percent" if got.unit in PERCENT else "number"][expected]
    if own:  # a scale goes by the published one, else by the one that the question asks for
        asked = (f for name, f in SCALES.items() if re.search(rf"in (?:\$\s*)?{name}s?\b", question.lower()))
        factors = (own / (scale or next(asked, own)),)
    elif scale and got.unit in MONEY:
        factors = (1 / scale,)
    return [got.value * f for f in factors]


def score(answer: str, gold: str, human: str = "", program: str = "", question: str = "") -> float:
    """5 for a right answer, else 0."""
    got, want, seen = parse(answer), parse(gold), parse(human or "")
    if got is None or want is None or isinstance(got.value, str) != isinstance(want.value, str):
        return 0.0
    if isinstance(want.value, str):
        return 5.0 if got.value == want.value else 0.0
    program = program or ""
    last = program.split(")")[-2] + ")" if ")" in program else program
    points = bool(TIMES_100.search(last))
    ratio = bool(seen) and seen.unit in PERCENT and not points
    tolerance = max(1e-5, abs(want.value) * 0.001)
    if seen and not isinstance(seen.value, str) and (seen.unit == "number" or seen.unit in PERCENT):
        tolerance = max(tolerance, 0.5 * 10**-seen.decimals / (100 if ratio else 1))
    readings = _readings(got, seen, ratio, points, question)
    return 5.0 if any(abs(v - want.value) <= tolerance for v in readings) else 0.0


def scored(rows: DataFrame) -> DataFrame:
    """rows: id, answer, gold, human, program, question; adds score."""

    @F.pandas_udf("double")
    def run(answer, gold, human, program, question):
        import pandas as pd

        return pd.Series([score(*(x if isinstance(x, str) else "" for x in r)) for r in zip(answer, gold, human, program, question, strict=True)], dtype="float64")

    return rows.withColumn("score", run("answer", "gold", "human", "program", "question"))


def judge_score(raw):
    """Column of a judge's score from text such as "4/5": a number from 0 to 5, else null."""
    v = F.split_part(F.trim(raw.cast("string")), F.lit("/"), F.lit(1)).try_cast("double")
    return F.when(F.lower(raw.cast("string")).isin("true", "false"), None).when((v >= 0) & (v <= 5), v)
