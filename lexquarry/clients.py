"""Embedding and chat services over HTTP, by the common JSON interfaces of such services.

Their address, key and models come from LEXQUARRY_SERVICE_URL, LEXQUARRY_SERVICE_KEY, LEXQUARRY_EMBED_MODEL and
LEXQUARRY_CHAT_MODEL, which executors have to have too (spark.executorEnv.*). A limiter spaces a client's calls.
"""

from __future__ import annotations

import json
import os
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable

import numpy as np

from lexquarry.providers import ChatGenerator, RateLimited

TIMEOUT = 60.0


class Limiter:
    """At most so many calls a second, evenly spaced; None: no limit."""

    def __init__(self, per_second: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = (1 / per_second if per_second else 0.0), clock, sleep
        self.free, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.free)
            self.free = at + self.gap
        if at > now:
            self.sleep(at - now)


class Service:
    """Posts JSON to paths under one address. A service that asks for a pause raises RateLimited."""

    def __init__(self, environ: dict[str, str] | None = None):
        environ = os.environ if environ is None else environ
        self.url, self.key = environ.get("LEXQUARRY_SERVICE_URL", "").rstrip("/"), environ.get("LEXQUARRY_SERVICE_KEY", "")
        if not self.url:
            raise ValueError("LEXQUARRY_SERVICE_URL is not set")
        self.limiter = Limiter(float(environ.get("LEXQUARRY_CALLS_PER_SECOND") or 0) or None)
        self.embed_model, self.chat_model = environ.get("LEXQUARRY_EMBED_MODEL", ""), environ.get("LEXQUARRY_CHAT_MODEL", "")

    def post(self, path: str, body: dict) -> dict:
        self.limiter.wait()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url}{path}", json.dumps(body).encode(), headers, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as e:
            if e.code == 429:
                raise RateLimited(f"{path}: {e.reason}") from e
            raise


class HttpEmbedder:
    """POST /embeddings with model, input, input_type and output_dimension; the reply's data has an index and an embedding each."""

    def __init__(self, dimension: int, environ: dict[str, str] | None = None):
        self.dimension, self.service = dimension, Service(environ)

    def embed(self, texts: list[str], kind: str) -> np.ndarray:
        body = {"model": self.service.embed_model, "input": texts, "input_type": kind, "output_dimension": self.dimension}
        data = self.service.post("/embeddings", body)["data"]
        return np.asarray([x["embedding"] for x in sorted(data, key=lambda x: x.get("index", 0))], np.float32)


class HttpChat(ChatGenerator):
    """POST /chat/completions with model, messages and temperature; the reply is the first choice's message."""

    def __init__(self, environ: dict[str, str] | None = None):
        service = Service(environ)
        super().__init__(lambda messages, temperature: service.post("/chat/completions", {"model": service.chat_model, "messages": messages, "temperature": temperature})["choices"][0]["message"]["content"])

