"""Traces of a request: spans of the driver by stage, model calls by stage, time to the first token, and what they add up to.

Model calls run on executors; they come back as rows beside the answers (models.answer) and are added to the trace by their sums.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class Prices:
    """Hosted models bill tokens, by the million; local ones the time of their machine, by the hour."""

    hosted: bool = False
    input_per_m: float = 0.0
    output_per_m: float = 0.0
    per_hour: float = 0.0

    def of(self, prompt: int, completion: int, seconds: float) -> float:
        return (prompt * self.input_per_m + completion * self.output_per_m) / 1e6 if self.hosted else seconds / 3600 * self.per_hour


@dataclass
class Trace:
    clock: Callable[[], float] = time.perf_counter
    began: float = 0.0
    stages: dict[str, float] = field(default_factory=dict)
    calls: dict[str, dict] = field(default_factory=dict)
    first_token: float | None = None
    open: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.began = self.clock()

    @contextmanager
    def span(self, stage: str) -> Iterator[None]:
        """Time inside counts for the stage, without that of spans inside it."""
        began, inner = self.clock(), sum(self.stages.values())
        self.open.append(stage)
        try:
            yield
        finally:
            self.open.pop()
            own = self.clock() - began - (sum(self.stages.values()) - inner)
            self.stages[stage] = self.stages.get(stage, 0.0) + own

    def model(self, calls: int, prompt: int, completion: int, seconds: float, estimated: bool) -> None:
        s = self.calls.setdefault(self.open[-1] if self.open else "other", {"calls": 0, "prompt_tokens": 0, "completion_tokens": 0, "ms": 0.0, "estimated": False})
        s["calls"] += calls
        s["prompt_tokens"] += prompt
        s["completion_tokens"] += completion
        s["ms"] += seconds * 1000
        s["estimated"] |= estimated

    def token(self) -> None:
        if self.first_token is None:
            self.first_token = self.clock() - self.began

    def summary(self, prices: Prices) -> dict:
        total = lambda k: sum(s[k] for s in self.calls.values())
        prompt, completion, seconds = total("prompt_tokens"), total("completion_tokens"), total("ms") / 1000
        latency = self.clock() - self.began
        stages = self.stages | {"other": max(0.0, latency - sum(self.stages.values()))}
        out = {"latency_ms": latency * 1000, "stage_ms": {k: v * 1000 for k, v in stages.items()}, "llm_ms": seconds * 1000, "llm_calls": total("calls"), "prompt_tokens": prompt, "completion_tokens": completion}
        out |= {"tokens_estimated": any(s["estimated"] for s in self.calls.values()), "output_tokens_per_s": completion / seconds if seconds > 0 else None, "llm_by_stage": self.calls, "cost_usd": prices.of(prompt, completion, seconds)}
        return out | ({} if self.first_token is None else {"ttft_ms": self.first_token * 1000})

    def detail(self, prices: Prices) -> str:
        s = self.summary(prices)
        return json.dumps({k: s[k] for k in ("stage_ms", "llm_by_stage", "tokens_estimated", "ttft_ms") if k in s}, sort_keys=True)
