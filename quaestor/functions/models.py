"""Replaceable models: an embedder over hashed tokens, a classifier by cue words, and the interface of language models.

Calls of language models run in `mapInPandas` on the executors, in as many partitions as calls may run at once.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quaestor.functions.text import tokens

DIM = 64
#: What an answer that was cut off twice, and an empty corpus, say.
TRUNCATED = "The answer could not be completed within the output limit."
NOTHING = "No documents have been ingested yet."
CUES = (("conflict", r"(?i)\b(conflict|contradict|inconsisten|disagree)"), ("multi_hop", r"(?i)\b(compare|versus|vs|between|both|and then)\b"), ("global", r"(?i)\b(overall|themes?|across|summar|main|trends?)\b"))


class LanguageModel(Protocol):
    """chat(system, user, limit) -> (text, whether it was cut off)."""

    def chat(self, system: str, user: str, limit: int) -> tuple[str, bool]: ...


class Extractive:
    """A model without a network: the context's sentence that shares most words with the question."""

    def chat(self, system: str, user: str, limit: int) -> tuple[str, bool]:
        import re

        context, _, question = user.rpartition("\nQUESTION: ")
        asked = set(re.findall(r"[a-z]+|\d+(?:\.\d+)?", question.lower()))
        parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n", context) if s.strip()]
        best = max(parts, key=lambda s: len(asked & set(re.findall(r"[a-z]+|\d+(?:\.\d+)?", s.lower()))), default="cannot be established")
        return best[:limit], len(best) > limit


@F.arrow_udf(ArrayType(DoubleType()))
def _scaled(cells, dim):
    """Counts of the cells of each row, scaled to length 1."""
    import numpy as np
    import pyarrow as pa

    n, d = len(cells), dim[0].as_py() if len(dim) else 1
    row = np.repeat(np.arange(n), np.asarray(cells.value_lengths()))
    counts = np.bincount(row * d + np.asarray(cells.flatten()), minlength=n * d).reshape(n, d).astype(np.float64)
    length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return pa.FixedSizeListArray.from_arrays(pa.array((counts / np.where(length > 0, length, 1)).ravel()), d).cast(pa.list_(pa.float64()))


def embed(text: Column, dim: int = DIM) -> Column:
    """Hashed token counts of length 1 (zeros for no tokens)."""
    return _scaled(F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(dim))), F.lit(dim))


def classify(question: Column) -> Column:
    """Category by cue words; anything else is local."""
    out = F.lit("local")
    for name, cue in reversed(CUES):
        out = F.when(question.rlike(cue), name).otherwise(out)
    return out


SAID = "answer string, cut boolean, calls int, prompt_tokens long, completion_tokens long, llm_ms double, estimated boolean"
#: What a model's stream yields last if the answer was cut off.
CUT = object()
SYSTEM = "Answer from the context."


def prompt(context: str, question: str) -> str:
    return f"{context}\nQUESTION: {question}"


def answer(prompts: DataFrame, model: LanguageModel, budgets: tuple[int, ...] = (1500, 3000), at_once: int = 4) -> DataFrame:
    """question_id and SAID: each prompt's answer, asked again with the next budget when it was cut off, and what the calls took.

    Tokens are the model's own count where it keeps one (`usage`), else estimated at four characters each.
    """

    def run(frames):
        import time

        import pandas as pd

        for f in frames:
            out = []
            for i, context, question in zip(f.question_id, f.context, f.question, strict=True):
                text, cut, calls, asked, said, began = NOTHING, False, 0, 0, 0, time.perf_counter()
                usage = getattr(model, "usage", None)
                before = (usage.prompt, usage.completion, usage.estimated) if usage else None
                if context:
                    for b in budgets:
                        text, cut = model.chat(SYSTEM, prompt(context, question), b)
                        calls, asked, said = calls + 1, asked + max(1, len(SYSTEM + prompt(context, question)) // 4), said + max(1, len(text) // 4)
                        if not cut:
                            break
                if before:
                    asked, said = usage.prompt - before[0], usage.completion - before[1]
                out.append((i, TRUNCATED if cut else text, cut, calls, asked, said, (time.perf_counter() - began) * 1000 if calls else 0.0, bool(calls) and (usage.estimated if usage else True)))
            yield pd.DataFrame(out, columns=["question_id", *(c.split()[0] for c in SAID.split(", "))])

    return prompts.select("question_id", "context", "question").repartition(at_once).mapInPandas(run, f"question_id {prompts.schema['question_id'].dataType.simpleString()}, {SAID}")
