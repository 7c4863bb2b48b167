"""Model hooks: embedders and text generators (inventory S32-S34, F10, G13, G14, G17, I25, F26).

Nothing here talks to a network. An embedder is a batch function run inside Arrow UDFs; a generator
is a driver-side callable used for one prompt at a time.
"""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrove.functions import text as T
from codegrove.functions import vectors as V


class Embedder(Protocol):
    dims: int

    def column(self, text: Column) -> Column: ...

    def query(self, text: str) -> list[float]: ...


class MockEmbedder:
    """hash-based vectors, evaluated entirely in the JVM."""

    def __init__(self, dims: int = 1024):
        self.dims = dims

    def column(self, text: Column) -> Column:
        return V.mock_embedding(text, self.dims)

    def query(self, text: str) -> list[float]:
        return V.mock_embedding_local(text, self.dims)


class BatchEmbedder:
    """Wraps ``fn(list of texts) -> list of vectors`` (any model or service client).

    Batches of ``batch_size`` run inside the executors; a failing batch is retried with growing
    pauses and then fails the task, which Spark retries elsewhere.
    """

    def __init__(
        self, fn: Callable[[Sequence[str]], Sequence[Sequence[float]]], dims: int,
        batch_size: int = 32, attempts: int = 3, pause: float = 2.0,
    ):
        self.fn, self.dims, self.batch_size = fn, dims, batch_size
        self.attempts, self.pause = attempts, pause

    def _call(self, texts: Sequence[str]) -> list[list[float]]:
        return with_retry(lambda: [list(v) for v in self.fn(texts)], self.attempts, self.pause, 2.0)

    def column(self, text: Column) -> Column:
        size, call = self.batch_size, self._call

        @F.pandas_udf("array<double>")
        def embed(texts: pd.Series) -> pd.Series:
            out: list = []
            for start in range(0, len(texts), size):
                out += call(texts.iloc[start:start + size].tolist())
            return pd.Series(out)

        return embed(text)

    def query(self, text: str) -> list[float]:
        return self._call([text])[0]


def embed(df: DataFrame, text: Column, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """Adds the vector and its token count; rows keep their keys, blank texts get no vector."""
    filled = T.strip(text) != ""
    return df.withColumn(out, F.when(filled, embedder.column(text))).withColumn(
        "token_count", F.when(filled, T.word_count(text)).otherwise(0).cast("long")
    )


def with_retry(call: Callable[[], object], attempts: int = 3, pause: float = 1.0, growth: float = 1.0):
    """Repeat a call; the pause grows linearly, or by powers when ``growth`` > 1."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception:
            if attempt == attempts - 1:
                raise
            time.sleep(pause * (growth**attempt if growth > 1 else attempt + 1))


Generator = Callable[[dict[str, str]], str]


def mock_generator(prompt: dict[str, str]) -> str:
    """Deterministic answer for tests: length and digest of the user prompt."""
    user = prompt["user"]
    return f"answer_{hashlib.md5(user.encode()).hexdigest()[:8]} (chars={len(user)})"


class CachedGenerator:
    """First-in-first-out cache of answers, keyed by query, type and context ids."""

    def __init__(self, generator: Generator, size: int = 100):
        self.generator, self.size = generator, size
        self._answers: OrderedDict[str, str] = OrderedDict()

    @staticmethod
    def key(query: str, query_type: str, context_ids: Sequence[str]) -> str:
        return hashlib.md5(":".join([query, query_type, *sorted(context_ids)]).encode()).hexdigest()

    def __call__(self, prompt: dict[str, str], key: str | None = None) -> str:
        if key is not None and key in self._answers:
            return self._answers[key]
        answer = self.generator(prompt)
        if key is not None:
            self._answers[key] = answer
            if len(self._answers) > self.size:
                self._answers.popitem(last=False)
        return answer
