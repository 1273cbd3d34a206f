"""How a partition calls a service: several requests at once, at a bounded rate, again where that can help, and never twice for one answer.

Answers are kept in a journal, a folder that all executors share, one small file for each request's hash. A task that runs again, because its
executor was lost or its result is read twice, finds there what was answered before and doesn't pay for it again.
"""

from __future__ import annotations

import hashlib
import json
import random
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from .shared import file_system


@dataclass(frozen=True)
class Calls:
    """Bounds for the calls of one partition; ``per_second`` 0: as fast as they are answered. ``journal`` '': none."""

    at_once: int = 4
    per_second: float = 0.0
    burst: int = 1
    attempts: int = 4
    first_wait: float = 0.5
    longest_wait: float = 30.0
    journal: str = ""


class TokenBucket:
    """At most ``burst`` at once and ``per_second`` on the average; threads wait in turn."""

    def __init__(self, per_second: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = per_second, burst, clock, sleep
        self.free, self.at, self.lock = float(burst), clock(), threading.Lock()

    def take(self) -> None:
        if self.rate <= 0:
            return
        with self.lock:
            now = self.clock()
            self.free = min(self.burst, self.free + (now - self.at) * self.rate)
            self.at = now
            self.free -= 1
            wait = -self.free / self.rate
        if wait > 0:  # the place in the queue is taken: others wait longer
            self.sleep(wait)


class Journal:
    def __init__(self, folder: str):
        self.system, self.at = file_system(folder)

    def _place(self, key: str) -> tuple[str, str]:
        return f"{self.at}/{key[:2]}", f"{self.at}/{key[:2]}/{key}"

    def find(self, key: str):
        from pyarrow import fs

        _, path = self._place(key)
        if self.system.get_file_info(path).type != fs.FileType.File:
            return None
        with self.system.open_input_file(path) as f:
            return json.loads(f.read())

    def keep(self, key: str, value) -> None:
        """Written aside and moved, so that what is there is whole."""
        folder, path = self._place(key)
        self.system.create_dir(folder, recursive=True)
        aside = f"{path}.{uuid.uuid4().hex}"
        with self.system.open_output_stream(aside) as out:
            out.write(json.dumps(value).encode())
        self.system.move(aside, path)


@dataclass
class Caller:
    """Clients' calls under the bounds of ``calls``. Each thread has a client of its own, built by ``make``."""

    make: Callable
    calls: Calls = field(default_factory=Calls)
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self):
        self.own, self.bucket = threading.local(), TokenBucket(self.calls.per_second, self.calls.burst, sleep=self.sleep)
        self.journal = Journal(self.calls.journal) if self.calls.journal else None

    @property
    def client(self):
        if not hasattr(self.own, "client"):
            self.own.client = self.make()
        return self.own.client

    def _key(self, what: str, request) -> str:
        fields = [what, request.model, request.prompt, request.temperature, request.image.media_type, request.image.name]
        return hashlib.sha256(json.dumps(fields).encode() + b"\0" + request.image.data).hexdigest()

    def ask(self, request, what: str = "extract", kept: Callable = lambda x: x, again: Callable = lambda x: x):
        """The client's answer; ``kept`` and ``again`` turn one into JSON values and back."""
        key = self._key(what, request) if self.journal else ""
        if key and (found := self.journal.find(key)) is not None:
            return again(found)
        for k in range(self.calls.attempts):
            self.bucket.take()
            try:
                answer = getattr(self.client, what)(request)
                break
            except Exception as e:
                if not getattr(e, "retryable", False) or k + 1 == self.calls.attempts:
                    raise
                # by chance up to half as long, so that tasks turned away together don't come back together
                self.sleep(min(self.calls.longest_wait, self.calls.first_wait * 2**k) * random.uniform(0.5, 1))
        if key:
            self.journal.keep(key, kept(answer))
        return answer

    def extract(self, request):
        from .providers import Answer

        return self.ask(request, "extract", asdict, lambda x: Answer(**x))

    def segment(self, request):
        return self.ask(request, "segment")

    def each(self, fn: Callable, items: Iterable) -> Iterator:
        """``fn`` of all items, in order, at most ``at_once`` at a time."""
        if self.calls.at_once <= 1:
            yield from map(fn, items)
            return
        with ThreadPoolExecutor(self.calls.at_once) as pool:
            yield from pool.map(fn, items)
