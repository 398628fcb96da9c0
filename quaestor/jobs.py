"""Jobs of the driver: one worker that takes them in turn, their states, and who may see them."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

#: Fixed value: jobs that are remembered.
KEPT = 50


class Jobs:
    """States: queued, running, done, failed. A job sees a function that notes its progress."""

    def __init__(self, kept: int = KEPT, clock: Callable[[], float] = time.time):
        self.pool, self.kept, self.clock = ThreadPoolExecutor(1), kept, clock
        self.lock, self.jobs = threading.Lock(), {}

    def submit(self, kind: str, owner: str, work: Callable[[Callable[[str], None]], object]) -> str:
        key = uuid.uuid4().hex
        with self.lock:
            self.jobs[key] = {"id": key, "kind": kind, "owner": owner, "status": "queued", "created": self.clock(), "started": None, "finished": None, "progress": None, "result": None, "error": None}
            over = [k for k, j in self.jobs.items() if j["status"] in ("done", "failed")][: max(0, len(self.jobs) - self.kept)]
            for k in over:
                del self.jobs[k]
        self.pool.submit(self._run, key, work)
        return key

    def _note(self, key: str, **what) -> None:
        with self.lock:
            self.jobs[key] |= what

    def _run(self, key: str, work) -> None:
        self._note(key, status="running", started=self.clock())
        try:
            result = work(lambda p: self._note(key, progress=p))
        except Exception as e:  # whatever a job meets is its result
            self._note(key, status="failed", error=f"{type(e).__name__}: {e}"[:300], finished=self.clock())
        else:
            self._note(key, status="done", result=result, finished=self.clock())

    def get(self, key: str, owner: str) -> dict | None:
        """The job, and how many are ahead of it; None if there is none, or it is another's."""
        with self.lock:
            job = self.jobs.get(key)
            if job is None or job["owner"] != owner:
                return None
            ahead = sum(j["status"] in ("queued", "running") and j["created"] < job["created"] for j in self.jobs.values()) if job["status"] == "queued" else 0
            return {**job, "jobs_ahead": ahead}


def beating(start: Callable[[], Iterator], beat: float) -> Iterator:
    """What start() yields, read in a thread of its own, and None whenever `beat` seconds pass without anything. Its errors are raised here."""
    done, events = object(), queue.Queue()

    def read() -> None:
        try:
            for x in start():
                events.put((x, None))
        except BaseException as e:  # handed over to the reader
            events.put((done, e))
        else:
            events.put((done, None))

    threading.Thread(target=read, daemon=True).start()
    while True:
        try:
            x, error = events.get(timeout=beat)
        except queue.Empty:
            yield None
            continue
        if error is not None:
            raise error
        if x is done:
            return
        yield x
