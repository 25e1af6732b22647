"""Remote providers of vectors and summaries: retries, pauses, a limit on requests, caches, prompts."""

from __future__ import annotations

import json
import threading
import time
import urllib.request
from collections import OrderedDict
from collections.abc import Callable
from contextlib import contextmanager
from email.utils import parsedate_to_datetime
from urllib.error import HTTPError

# Pauses in milliseconds.
STEP, LIMITED_STEP, LIMITED_MOST, SPACING = 1000, 30_000, 120_000, 1500

PROMPTS = {
    "document": "Summarise the document below in one paragraph of at most 200 words. Leave out its path.\n\n{text}",
    "batch": "Summarise each numbered document below in one paragraph. Answer with a JSON list of texts in the same order.\n\n{text}",
    "directory": "The folder {name} holds what is summarised below. Say in at most 100 words what the folder is about.\n\n{text}",
}


class RateLimited(Exception):
    """The server asks for a pause; ``after`` are the milliseconds that it names, if any."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


def retry_after(value: str | None, now: float | None = None) -> int | None:
    """Milliseconds that a Retry-After header (seconds or a date) asks for; None where it says nothing usable."""
    if not value:
        return None
    try:
        seconds = float(value)
    except ValueError:
        try:
            return max(0, round(1000 * (parsedate_to_datetime(value).timestamp() - (time.time() if now is None else now))))
        except ValueError:
            return None
    return round(seconds * 1000) if 0 <= seconds < float("inf") else None


def retry_delay(attempt: int, error: Exception | None = None) -> float:
    """Milliseconds before the next attempt (from 0): doubling seconds; where the server limits, its own wish or doubling half minutes, two minutes at most."""
    if isinstance(error, RateLimited):
        return min(LIMITED_MOST, LIMITED_STEP * 2**attempt if error.after is None else error.after)
    return STEP * 2**attempt


class Limiter:
    """At most ``limit`` tasks at once, started ``spacing`` milliseconds apart, none before a cooldown ends."""

    def __init__(self, limit: int = 2, spacing: int = SPACING, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.slots, self.spacing, self.clock, self.sleep = threading.BoundedSemaphore(max(1, int(limit))), max(0, int(spacing)), clock, sleep
        self.lock, self.next, self.cool = threading.Lock(), 0.0, 0.0

    def cooldown(self, millis: float) -> None:
        with self.lock:
            self.cool = max(self.cool, self.clock() + max(0.0, millis) / 1000)

    @contextmanager
    def turn(self):
        with self.slots:
            with self.lock:
                start = max(self.clock(), self.next, self.cool)
                self.next = start + self.spacing / 1000
            if (wait := start - self.clock()) > 0:
                self.sleep(wait)
            yield


def attempt(task: Callable, most: int = 3, limiter: Limiter | None = None, sleep: Callable[[float], None] = time.sleep):
    """The task's result; errors are tried again ``most`` - 1 times, after a pause that a limited server's error sets for all."""
    limiter = limiter or Limiter(1, 0)
    for n in range(max(1, most)):
        try:
            with limiter.turn():
                return task()
        except Exception as e:
            if n + 1 >= max(1, most):
                raise
            delay = retry_delay(n, e)
            if isinstance(e, RateLimited):
                limiter.cooldown(delay)
            sleep(delay / 1000)


class Cache:
    """The most recently used values, bounded in number and bytes."""

    def __init__(self, most: int = 10_000, most_bytes: int = 100 << 20, size: Callable = lambda v: 8 * len(v)):
        self.most, self.most_bytes, self.size, self.rows, self.bytes = most, most_bytes, size, OrderedDict(), 0

    def get(self, key):
        if key in self.rows:
            self.rows.move_to_end(key)
        return self.rows.get(key)

    def put(self, key, value) -> None:
        if key in self.rows:
            self.bytes -= self.size(self.rows.pop(key))
        self.rows[key] = value
        self.bytes += self.size(value)
        while self.rows and (len(self.rows) > self.most or self.bytes > self.most_bytes):
            self.bytes -= self.size(self.rows.popitem(last=False)[1])


def post(url: str, body: dict, key: str = "", timeout: float = 60) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except HTTPError as e:
        if e.code == 429:
            raise RateLimited(str(e), retry_after(e.headers.get("Retry-After"))) from e
        raise


class Remote:
    """Vectors and summaries by HTTP.  One object is pickled to every task, where limiter and caches are made anew."""

    def __init__(self, url: str, model: str, key: str = "", retries: int = 3, concurrency: int = 2, spacing: int = SPACING, send: Callable = post):
        self.url, self.model, self.key, self.retries, self.concurrency, self.spacing, self.send = url.rstrip("/"), model, key, retries, concurrency, spacing, send
        self.state: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"state": None}

    def _open(self) -> tuple:
        if self.state is None:
            self.state = Limiter(self.concurrency, self.spacing), Cache(), Cache(5000, size=len)
        return self.state

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector per text; known texts are not sent again."""
        limiter, cache, _ = self._open()
        todo = list(dict.fromkeys(t for t in texts if cache.get(t) is None))
        got = dict.fromkeys(todo)
        if todo:
            answer = attempt(lambda: self.send(f"{self.url}/embeddings", {"model": self.model, "input": todo}, self.key), self.retries, limiter)
            for row in answer["data"]:
                got[todo[row["index"]]] = row["embedding"]
        out = [got[t] if t in got else cache.get(t) for t in texts]
        for t, v in got.items():
            cache.put(t, v)
        return out

    def summarise(self, texts: list[str], kind: str = "document", name: str = "") -> list[str]:
        """A summary per text; blank texts have the empty one, known ones are not sent again, and an error is the empty text."""
        limiter, _, cache = self._open()
        out = []
        for t in texts:
            hit = cache.get((kind, name, t)) if t and t.strip() else ""
            if hit is None:
                body = {"model": self.model, "messages": [{"role": "user", "content": PROMPTS[kind].replace("{name}", name).replace("{text}", t)}], "temperature": 0.3}
                try:
                    hit = attempt(lambda body=body: self.send(f"{self.url}/chat/completions", body, self.key), self.retries, limiter)["choices"][0]["message"]["content"].strip()
                    cache.put((kind, name, t), hit)
                except Exception:
                    hit = ""
            out.append(hit)
        return out


def token_prefix(text: str, most: int, count: Callable[[str], int], first: int = 4096) -> str:
    """The longest prefix of at most ``most`` tokens; only as much of the text is counted as is needed, in windows that double."""
    window = first
    while window < len(text) and count(text[:window]) <= most:
        window *= 2
    low, high = 0, min(window, len(text))
    if count(text[:high]) <= most:
        return text[:high]
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if count(text[:mid]) <= most else (low, mid)
    return text[:low]
