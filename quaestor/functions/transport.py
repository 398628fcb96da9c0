"""Calls to a language model over HTTP: retries, waits that the server asks for, cut-off answers, use of tokens.

`post` (url, headers, payload) -> (status, headers, JSON) is given from outside; `over_http` is the one for a network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

from quaestor.functions.models import CUT

#: Attempts in all and when turned away, the longest wait that is kept, the longest own wait.
ATTEMPTS, TURNED_AWAY, LONGEST, OWN = 3, 5, 300.0, 120.0
#: Roles that models play.
ROLES = ("extraction", "query", "answer", "question", "judge")


class ModelError(RuntimeError):
    pass


class Truncated(ModelError):
    pass


def wait(headers: dict[str, str], attempt: int, now: float) -> float:
    """Seconds until the next attempt: as the server says, in seconds or as a date, else doubling from 15 up to OWN."""
    value = headers.get("retry-after", "")
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now)
    except (ValueError, TypeError):
        return min(15.0 * 2**attempt, OWN)


@dataclass
class Usage:
    calls: int = 0
    prompt: int = 0
    completion: int = 0
    seconds: float = 0.0
    estimated: bool = False


@dataclass
class Client:
    """A model behind an endpoint that takes chat messages. models: role -> name, with `answer` for roles that are not named."""

    url: str
    models: dict[str, str]
    post: Callable[[str, dict, dict], tuple[int, dict, dict]]
    key: str = ""
    role: str = "answer"
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.time
    usage: Usage = field(default_factory=Usage)
    lines: Callable[[str, dict, dict], Iterator[str]] | None = None

    def playing(self, role: str) -> Client:
        if role not in ROLES:
            raise ValueError(f"roles are {', '.join(ROLES)}")
        return Client(self.url, self.models, self.post, self.key, role, self.sleep, self.clock, self.usage, self.lines)

    @property
    def model(self) -> str:
        return self.models.get(self.role) or self.models["answer"]

    def ask(self, system: str, user: str, limit: int = 1000, temperature: float = 0.1) -> str:
        """The answer's text. Raises Truncated if it was cut off, ModelError if there is none."""
        payload = {"model": self.model, "stream": False, "max_tokens": limit, "temperature": temperature, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        began, reply = self.clock(), self._sent(payload)
        try:
            choice = reply["choices"][0]
            text = choice["message"]["content"]
        except (KeyError, IndexError, TypeError):
            raise ModelError(f"no valid answer of {self.model}") from None
        if choice.get("finish_reason") == "length":
            raise Truncated(f"{self.model} was cut off at {limit} tokens")
        if not isinstance(text, str) or not text.strip():
            raise ModelError(f"empty answer of {self.model}")
        self._count(reply.get("usage") or {}, self.clock() - began, len(system) + len(user), len(text))
        return text

    def _sent(self, payload: dict) -> dict:
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        failed = away = 0
        while True:
            try:
                status, got, reply = self.post(self.url, headers, payload)
            except OSError as e:
                status, got, reply = 599, {}, {"error": str(e)}
            if status < 400:
                return reply
            if status == 429:
                pause = wait({k.lower(): v for k, v in got.items()}, away, self.clock())
                away += 1
                if away >= TURNED_AWAY or pause > LONGEST:
                    raise ModelError(f"{self.model}: turned away, next in {pause:.0f} s")
            else:
                failed += 1
                if status < 500 or failed >= ATTEMPTS:
                    raise ModelError(f"{self.model}: status {status}")
                pause = min(2.0 ** (failed - 1), 8.0)
            self.sleep(pause)

    def _count(self, usage: dict, seconds: float, asked: int, said: int) -> None:
        u = self.usage
        u.calls += 1
        u.seconds += seconds
        u.estimated |= "prompt_tokens" not in usage
        u.prompt += usage.get("prompt_tokens", max(1, asked // 4))
        u.completion += usage.get("completion_tokens", max(1, said // 4))

    def stream(self, system: str, user: str, limit: int, temperature: float = 0.1) -> Iterator[str | object]:
        """The answer's pieces as they come, and CUT last if it was cut off. `lines` gives the reply's lines (server-sent events)."""
        if self.lines is None:
            text, cut = self.chat(system, user, limit)
            yield from [text] * bool(text) + [CUT] * cut
            return
        payload = {"model": self.model, "stream": True, "max_tokens": limit, "temperature": temperature, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        headers, began, said, usage, ended = {"Authorization": f"Bearer {self.key}"} if self.key else {}, self.clock(), "", {}, ""
        for line in self.lines(self.url, headers, payload):
            if not line.startswith("data:") or line[5:].strip() == "[DONE]":
                continue
            try:
                event = json.loads(line[5:])
            except ValueError:
                raise ModelError(f"no valid answer of {self.model}") from None
            usage = event.get("usage") or usage
            for choice in event.get("choices") or []:
                piece = (choice.get("delta") or {}).get("content") or ""
                ended = choice.get("finish_reason") or ended
                if piece:
                    said += piece
                    yield piece
        if not said.strip() and ended != "length":
            raise ModelError(f"empty answer of {self.model}")
        self._count(usage, self.clock() - began, len(system) + len(user), len(said))
        if ended == "length":
            yield CUT

    def chat(self, system: str, user: str, limit: int) -> tuple[str, bool]:
        """The interface of quaestor.functions.models."""
        try:
            return self.ask(system, user, limit), False
        except Truncated:
            return "", True


def over_http(url: str, headers: dict, payload: dict, timeout: float = 600) -> tuple[int, dict, dict]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers}), timeout=timeout) as r:
            return r.status, dict(r.headers), json.loads(r.read())
    except HTTPError as e:
        return e.code, dict(e.headers), {}


def lines_over_http(url: str, headers: dict, payload: dict, timeout: float = 600) -> Iterator[str]:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers}), timeout=timeout) as r:
        for line in r:
            yield line.decode("utf-8", "replace").rstrip("\r\n")
