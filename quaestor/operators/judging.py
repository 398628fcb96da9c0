"""Answers scored blind: candidates under letters, scores read from the judge's JSON, failures kept apart, numbers re-scored.

Defined results: an answer set that three attempts do not score is a failure and has no score, never 0; scores are 0 to 5,
`4/5` counts as 4; truth values, other words and numbers outside are no scores; a judge that scores some candidates only
scored none.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import jsontext
from quaestor.operators import numeric

#: Temperatures of the attempts, the highest score, what stands for a missing reason.
ATTEMPTS, HIGHEST, SILENT = (0.0, 0.3, 0.6), 5.0, "No rationale provided by judge."
SYSTEM = "Score each candidate answer against the reference and evidence from 0 to 5. Reply with JSON: scores, an object from label to score and rationale."


def blinded(answers: DataFrame) -> DataFrame:
    """Adds label: candidates of a question get letters in an order that only the question decides. answers: question_id, question, engine, answer."""
    w = Window.partitionBy("question_id").orderBy(F.sha2(F.concat_ws("\x1f", "question", "engine").cast("binary"), 256), "engine")
    return answers.withColumn("label", F.chr(F.row_number().over(w) + 64))


def label_of(key: object) -> str | None:
    """A single letter, however it is written: `a`, `Candidate A`, `candidate_a`."""
    text = str(key).strip().upper().replace("_", " ").removeprefix("CANDIDATE").strip()
    return text if len(text) == 1 and text.isalpha() else None


def score_of(value: object) -> float | None:
    if isinstance(value, str):
        try:
            value = float(value.split("/")[0].strip())
        except ValueError:
            return None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return None
    return float(value) if 0 <= value <= HIGHEST else None


def scores(reply: dict, labels: list[str]) -> dict[str, tuple[float, str]] | None:
    """label -> score and reason, if the reply scores all labels; it may be an object, or a list of entries with labels."""
    raw = reply.get("scores", reply)
    pairs = ((x.get("label") or x.get("candidate"), x) for x in raw if isinstance(x, dict)) if isinstance(raw, list) else raw.items() if isinstance(raw, dict) else ()
    told = {label_of(k): v for k, v in pairs}
    out = {}
    for label in labels:
        entry = told.get(label)
        parts = entry if isinstance(entry, dict) else {"score": entry}
        if (value := score_of(parts.get("score"))) is None:
            return None
        reason = next((parts[k] for k in ("rationale", "reason", "explanation") if parts.get(k)), None)
        out[label] = (value, reason if isinstance(reason, str) and reason.strip() else SILENT)
    return out or None


def judged(answers: DataFrame, chat: Callable[[str, str, float], str]) -> DataFrame:
    """question_id, engine, score, rationale, failed of each answer. chat: (system, user, temperature) -> text, on the executors.

    answers: question_id, question, reference, evidence (array of strings), engine, answer.
    """
    g = blinded(answers).groupBy("question_id", "question", "reference", "evidence").agg(F.array_sort(F.collect_list(F.struct("label", "engine", "answer"))).alias("c"))  # a candidate for each engine

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for r in b.to_pylist():
                labels = [c["label"] for c in r["c"]]
                user = json.dumps({"question": r["question"], "reference_answer": r["reference"], "source_evidence": r["evidence"] or [], "candidates": {c["label"]: c["answer"] for c in r["c"]}})
                got = None
                for n, warm in enumerate(ATTEMPTS):
                    again = f"\n\nThe last reply was not valid. Reply with JSON only, scoring each of: {', '.join(labels)}." if n else ""
                    try:
                        got = scores(jsontext.loaded(chat(SYSTEM, user + again, warm)), labels)
                    except (OSError, RuntimeError):
                        got = None
                    if got:
                        break
                out += [(r["question_id"], c["engine"], *(got[c["label"]] if got else (None, None)), not got) for c in r["c"]]
            x = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [b.schema.field("question_id").type, pa.string(), pa.float64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(x, kinds, strict=True)], ["question_id", "engine", "score", "rationale", "failed"])

    return g.mapInArrow(run, f"question_id {answers.schema['question_id'].dataType.simpleString()}, engine string, score double, rationale string, failed boolean")


def rewards(scored: DataFrame) -> DataFrame:
    """question_id, reward of each engine (score over HIGHEST); questions with a failure have no row."""
    whole = scored.groupBy("question_id").agg(F.max("failed").alias("failed")).where("NOT failed").select("question_id")
    one = scored.join(whole, "question_id").withColumn("reward", F.col("score") / HIGHEST)
    return one.select("question_id", "engine", "reward", "rationale")


def rescored(records: DataFrame, metric: str) -> tuple[DataFrame, DataFrame]:
    """Records under another metric, and what changed: (records, flips).

    Numeric answers are scored again, text rewards stay, records already under the metric stay as they are. records: question_id,
    engine, task, answer, gold, human, program, question, reward, metric. flips: question_id, engine, old, new.
    """
    numbers = records.where((F.col("task") == "numeric") & (F.col("metric") != metric))
    keyed = numbers.withColumn("event_id", F.struct("question_id", "engine"))
    new = numeric.scored(keyed).select(F.col("event_id.question_id").alias("question_id"), F.col("event_id.engine").alias("engine"), (F.col("score") / HIGHEST).alias("new"))
    both = records.join(new, ["question_id", "engine"], "left")
    flips = both.where(F.col("new").isNotNull() & (F.col("new") != F.col("reward"))).select("question_id", "engine", F.col("reward").alias("old"), "new")
    out = both.withColumn("reward", F.coalesce("new", "reward")).withColumn("metric", F.lit(metric)).drop("new")
    return out, flips


def audit_rows(records: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A sheet for people: `n` judged text answers by a seeded order, without the judge's score. records: question_id, engine, task, answer, score."""
    own = records.where((F.col("task") == "text") & F.col("score").isNotNull())
    return own.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "question_id", "engine").cast("binary")), "question_id", "engine").limit(n).select("question_id", "engine", "answer")


def compared(sheet: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs a (human), b (judge) of the rows that both scored. sheet: question_id, engine, human."""
    human = F.coalesce(F.col("human").cast("string"), F.lit(""))
    own = sheet.select("question_id", "engine", numeric.judge_score(human).alias("a")).where("a IS NOT NULL")
    return own.join(records.select("question_id", "engine", F.col("score").alias("b")).where("b IS NOT NULL"), ["question_id", "engine"])
