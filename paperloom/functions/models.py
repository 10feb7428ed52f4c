"""Models from outside, behind small interfaces, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    name: str

    def passages(self, texts: list[str]) -> np.ndarray: ...

    def queries(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """The vectors of ``functions.vectors.hashed``, so that batches, streams and queries can be searched by one another."""

    def __init__(self, dim: int = 64) -> None:
        self.dim, self.name = dim, f"hashing-{dim}"

    def passages(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for w in re.findall(r"[^\W_]+", text.lower()):
                h = hashlib.md5(w.encode()).hexdigest()
                row[int(h[:4], 16) % self.dim] += 1 if h[4] < "8" else -1
            row /= np.linalg.norm(row) or 1
        return out.astype(np.float32)

    queries = passages


class ServiceEmbedder:
    """An embedding service: texts go out in lists of at most ``size``, with a pause after each call."""

    def __init__(self, name: str, call: Callable[[list[str]], list[list[float]]], size: int = 2048, pause: float = 0.05, sleep: Callable[[float], None] = time.sleep) -> None:
        self.name, self.call, self.size, self.pause, self.sleep = name, call, size, pause, sleep

    def passages(self, texts: list[str]) -> np.ndarray:
        out: list[list[float]] = []
        for a in range(0, len(texts), self.size):
            out += self.call(texts[a : a + self.size])
            self.sleep(self.pause)
        return np.array(out, dtype=np.float32)

    queries = passages


def embed(column: Column, make: Callable[[], Embedder], as_query: bool = False) -> Column:
    """array<float> of a text column; the model is made once in each Python worker.  Null texts count as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            own = texts.fillna("").tolist()
            yield pd.Series(list(model.queries(own) if as_query else model.passages(own)), dtype=object)

    return run(column)


class ServiceBusy(Exception):
    """The service asks for a pause; ``delay`` in seconds, if it says how long."""

    def __init__(self, delay: float | None = None) -> None:
        super().__init__("busy")
        self.delay = delay


def with_retries(call: Callable[[str], str], prompt: str, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The answer, or None after ``tries`` failures.  Busy services are asked again later than broken ones."""
    for n in range(tries):
        try:
            return call(prompt)
        except ServiceBusy as e:
            pause = e.delay + 3 if e.delay is not None else 5 * 2**n + 3
        except Exception:  # a client's own errors
            pause = 3 * 2**n
        if n + 1 < tries:
            sleep(pause)
    return None


class Chat:
    """A conversation with a text model: every call gets what was said before.  A message that is never answered is not kept."""

    def __init__(self, call: Callable[[str], str], sleep: Callable[[float], None] = time.sleep) -> None:
        self.call, self.sleep, self.history = call, sleep, []

    def say(self, message: str, tries: int = 3) -> str | None:
        said = "\n".join(f"{role}: {text}" for role, text in [*self.history, ("user", message)])
        answer = with_retries(self.call, said, tries, self.sleep)
        if answer is not None:
            self.history += [("user", message), ("model", answer)]
        return answer


def generate(df: DataFrame, prompt: str, make: Callable[[], Callable[[str], str]], out: str = "answer") -> DataFrame:
    """``df`` with the answers of a text model; one client in each task, null where all tries failed."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = make()
        for prompts in batches:
            yield prompts.map(lambda p: None if p is None else with_retries(call, p))

    return df.withColumn(out, run(F.col(prompt)))


def convert(files: DataFrame, make: Callable[[], Callable[[bytes], str | None]]) -> DataFrame:
    """binaryFile rows (path, content) -> (path, markdown); null where the converter fails."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = make()

        def safe(content: bytes) -> str | None:
            try:
                return one(content)
            except Exception:
                return None

        for contents in batches:
            yield contents.map(safe)

    return files.select("path", run(F.col("content")).alias("markdown"))
