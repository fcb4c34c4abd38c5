"""Where models plug in. Real ones are passed by the caller; the defaults are deterministic and carry no meaning."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomloom.config import EMBEDDING_SIZES
from atomloom.operators.vector import hashed_embedding


class Embedder(Protocol):
    """Batches of texts to vectors; called on executors."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Completer(Protocol):
    """Batches of prompts to answers; called on executors."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def embedding_size(modality: Column) -> Column:
    out = F.lit(1024)
    for name, size in EMBEDDING_SIZES.items():
        out = F.when(modality == name, size).otherwise(out)
    return out


def embed(rows: DataFrame, text: str, column: str = "embedding", model: Callable[[], Embedder] | None = None, size: int = 64) -> DataFrame:
    """``rows`` with vectors of ``text``; ``model`` makes an embedder once a task. Without one, hashed words."""
    if model is None:
        return rows.withColumn(column, hashed_embedding(F.col(text), size))
    return _applied(rows, text, column, "array<float>", pa.list_(pa.float32()), model)


def complete(rows: DataFrame, prompt: str, column: str = "answer", model: Callable[[], Completer] | None = None) -> DataFrame:
    """``rows`` with answers to ``prompt``; without a model a canned one."""
    if model is None:
        return rows.withColumn(column, F.concat(F.lit("[no model] "), F.substring(prompt, 1, 80)))
    return _applied(rows, prompt, column, "string", pa.string(), model)


def _applied(rows: DataFrame, text: str, column: str, kind: str, arrow: pa.DataType, model) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(f"`{column}` {kind}").fields])

    def run(batches: Iterator[pa.RecordBatch]):
        call = model()
        for b in batches:
            out = pa.array(call([x or "" for x in b.column(text).to_pylist()]), arrow)
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, column])

    return rows.mapInArrow(run, schema)


#: What an error of a model says when the prompt is too long.
TOO_LONG = ("context_length", "too long", "too large", "request too large", "413", "maximum context", "context window", "exceeds", "token limit")


class Failover:
    """A completer over providers in order, each with its keys in order: the first that answers a prompt is taken.

    ``keys``: (provider, name of the key, its completer); ``preferred`` goes first. An error leads to the provider's next
    key; one that says the prompt is too long leads to the next provider, but for ``roomy`` ones, whose other keys are
    still asked. If none answers, the last error is raised. ``requests`` and ``errors`` count by (provider, key).
    """

    def __init__(self, keys: list[tuple[str, str, Completer]], preferred: str | None = None, roomy: tuple[str, ...] = ()):
        providers = list(dict.fromkeys(p for p, _, _ in keys))
        order = sorted(providers, key=lambda p: p != preferred)  # stable
        self.keys = [[k for k in keys if k[0] == p] for p in order]
        self.roomy, self.requests, self.errors = roomy, Counter(), Counter()

    def _one(self, prompt: str) -> str:
        last: Exception | None = None
        for own in self.keys:
            for provider, name, call in own:
                try:
                    answer = call([prompt])[0]
                except Exception as e:  # the next key or provider is asked
                    last = e
                    self.errors[provider, name] += 1
                    if provider not in self.roomy and any(t in str(e).lower() for t in TOO_LONG):
                        break
                else:
                    self.requests[provider, name] += 1
                    return answer
        raise RuntimeError(f"no provider answered; last error: {last}")

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]


def retrying(call: Completer, accept: Callable[[str], bool] = lambda answer: True, retries: int = 2, base: float = 1.5, pause: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[str | None]]:
    """``call`` for each prompt, again after ``base`` ** n seconds on an error and half a second on a refused answer.

    A prompt that ``retries`` further attempts don't answer gives None, so that one bad prompt doesn't end the job.
    """

    def one(prompt: str) -> str | None:
        for n in range(retries + 1):
            try:
                answer = call([prompt])[0]
                if accept(answer):
                    return answer
                wait = 0.5
            except Exception:  # tried again, then a null
                wait = base**n
            if n < retries:
                pause(wait)
        return None

    return lambda prompts: [one(p) for p in prompts]
