"""An embedder behind an HTTP service."""

from __future__ import annotations

import json
import time
from dataclasses import replace

from .chat import Config
from .failures import Details
from .http import RETRY_AFTER, RetryPolicy, Target, budget, request

BATCH = 512
RESPONSE_BYTES = 32 << 20
QUERY, DOCUMENT = "query", "document"


class HTTPEmbedder:
    """Texts go in batches; vectors come back in the texts' order. The dimension is that of the first answer, and another one
    later is an error. It travels to executors with its configuration alone."""

    def __init__(self, config: Config, max_batch: int = 0):
        self.config = config if config.timeout != 30.0 else replace(config, timeout=15.0)
        self.max_batch = max_batch if max_batch > 0 else BATCH
        self._dimension = 0
        self.prefixed = "nomic-embed-text" in config.model.lower()

    @property
    def fingerprint(self) -> str:
        return f"http|{self.config.model}|{'search-prefix' if self.prefixed else 'plain'}|{self.dimension()}"

    def dimension(self) -> int:
        if not self._dimension:
            self._embed(DOCUMENT, ["dimension"])
        return self._dimension

    def documents(self, texts: list[str]) -> list[list[float]]:
        return self._embed(DOCUMENT, texts)

    def queries(self, texts: list[str]) -> list[list[float]]:
        return self._embed(QUERY, texts)

    def _embed(self, purpose: str, texts: list[str]) -> list[list[float]]:
        if not self.config.enabled:
            raise RuntimeError("the embedder has no URL or model")
        parts = [texts[i : i + self.max_batch] for i in range(0, len(texts), self.max_batch)]
        end = time.monotonic() + budget(len(parts), max(0, self.config.max_retries), self.config.timeout) if len(parts) > 1 else None
        return [v for p in parts for v in self._batch(purpose, p, end)]

    def _batch(self, purpose: str, texts: list[str], deadline: float | None) -> list[list[float]]:
        c = self.config
        given = [f"search_{purpose}: {x}" for x in texts] if self.prefixed else texts
        details = Details(c.model, c.url, "", 0, int(c.timeout * 1000), c.max_retries, len(texts), len(texts))
        target = Target(f"{c.url}/embeddings", json.dumps({"model": c.model, "input": given}).encode(), c.token)
        policy = RetryPolicy(c.max_retries, RESPONSE_BYTES, RETRY_AFTER)
        return request(target, lambda body: self._vectors(body, len(texts)), details, policy, c.timeout, deadline)

    def _vectors(self, body: bytes, n: int) -> list[list[float]]:
        data = json.loads(body)["data"]
        if len(data) != n:
            raise ValueError(f"{len(data)} embeddings for {n} texts")
        out: list = [None] * n
        for i, x in enumerate(data):
            at = x.get("index", 0)
            vector = x.get("embedding") or []
            if not vector:
                raise ValueError(f"empty embedding for text {i}")
            if self._dimension and len(vector) != self._dimension:
                raise ValueError(f"the dimension changed from {self._dimension} to {len(vector)}")
            self._dimension = len(vector)
            out[at if 0 <= at < n else i] = [float(v) for v in vector]
        if None in out:
            raise ValueError(f"no embedding for text {out.index(None)}")
        return out
