"""Calls to HTTP services from inside tasks: a bounded number at once, connections kept, failures tried again."""

from __future__ import annotations

import http.client
import json
import random
import threading
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlsplit


class NoAnswer(TimeoutError):
    """A service that gave no usable answer, however often it was asked."""


class Client:
    """POSTs JSON to an endpoint. connections: calls of one task at a time (a stage has as many tasks at a time as cores).

    Lost connections, time-outs, 429 and 5xx are tried again up to `attempts` times, each after twice the pause before (and a random part of it); other
    answers that aren't 200 are not.
    """

    def __init__(self, endpoint: str, bearer: str | None = None, timeout_s: float = 30, connections: int = 4, attempts: int = 5, pause_s: float = 0.2):
        if connections < 1 or attempts < 1:
            raise ValueError("at least one connection and one attempt are needed")
        self.endpoint, self.bearer, self.timeout, self.connections, self.attempts, self.pause = endpoint.rstrip("/"), bearer, timeout_s, connections, attempts, pause_s
        self._own = None

    def __getstate__(self):
        return self.__dict__ | {"_own": None}

    def _connection(self) -> http.client.HTTPConnection:
        if getattr(self._own, "connection", None) is None:
            parts = urlsplit(self.endpoint)
            kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
            self._own.connection = kind(parts.hostname, parts.port, timeout=self.timeout)
        return self._own.connection

    def _once(self, path: str, body: bytes) -> tuple[int, bytes]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.bearer}"} if self.bearer else {})
        try:
            connection = self._connection()
            connection.request("POST", urlsplit(self.endpoint).path + path, body, headers)
            answer = connection.getresponse()
            return answer.status, answer.read()
        except Exception:
            if getattr(self._own, "connection", None) is not None:
                self._own.connection.close()
                self._own.connection = None
            raise

    def _ask(self, path: str, body: dict):
        raw, why = json.dumps(body).encode(), ""
        for attempt in range(self.attempts):
            if attempt:
                time.sleep(self.pause * 2 ** (attempt - 1) * (1 + random.random()))
            try:
                status, answer = self._once(path, raw)
                if status == 200:
                    return json.loads(answer)
                why = f"status {status}"
                if status != 429 and status < 500:
                    break
            except (OSError, http.client.HTTPException, ValueError) as e:
                why = type(e).__name__
        return NoAnswer(f"{self.endpoint}{path}: {why}")  # neither the text nor the answer is named

    def post_all(self, path: str, bodies: Sequence[dict]) -> list:
        """The answers, in order; NoAnswer stands for what failed."""
        if self._own is None:
            self._own = threading.local()
        with ThreadPoolExecutor(min(self.connections, max(1, len(bodies)))) as pool:
            return list(pool.map(lambda body: self._ask(path, body), bodies))
