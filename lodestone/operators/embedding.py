"""Embeddings of chunks through a provider, in batches on the executors."""

from __future__ import annotations

import json
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import NoProvider

BATCH = 32


class Provider(Protocol):
    """Anything that turns texts into vectors; it is sent to the executors, so it must be picklable."""

    model_id: str

    def get_embeddings(self, texts: list[str], task: str) -> list[list[float]]: ...


class HttpProvider:
    """Posts texts to ``{url}/v1/embeddings``; answers may come in any order if they carry an index."""

    def __init__(self, url: str, model: str, timeout: float = 60.0, **_: object):
        self.url, self.model_id, self.timeout = url.rstrip("/"), model, timeout

    def get_embeddings(self, texts: list[str], task: str = "document") -> list[list[float]]:
        body = json.dumps({"input": texts, "model": self.model_id}).encode()
        request = urllib.request.Request(f"{self.url}/v1/embeddings", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            data = json.load(answer)["data"]
        data.sort(key=lambda d: d.get("index", 0))
        if len(data) != len(texts):
            raise ValueError(f"{len(texts)} texts sent, {len(data)} vectors received")
        return [d["embedding"] for d in data]


class StaticProvider:
    """A local model without inference: a text's vector is the unit mean of the vectors of its tokens.

    ``model`` is a folder with ``tokenizer.json`` and ``embeddings.npy`` (float, a row for each token id), which is
    read once in each process. A text without tokens has a vector of zeros.
    """

    def __init__(self, model: str, **_: object):
        for name in ("tokenizer.json", "embeddings.npy"):
            if not os.path.exists(os.path.join(model, name)):
                raise FileNotFoundError(f"no {name} in {model}")
        self.model_id = os.path.abspath(model)
        self._loaded: tuple | None = None

    def __getstate__(self) -> dict:
        return {"model_id": self.model_id, "_loaded": None}

    def get_embeddings(self, texts: list[str], task: str = "document") -> list[list[float]]:
        if self._loaded is None:
            from tokenizers import Tokenizer

            table = np.load(os.path.join(self.model_id, "embeddings.npy"), mmap_mode="r")
            self._loaded = Tokenizer.from_file(os.path.join(self.model_id, "tokenizer.json")), table
        tokenizer, table = self._loaded
        out = np.zeros((len(texts), table.shape[1]), np.float32)
        for row, found in zip(out, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            if found.ids:
                row[:] = table[found.ids].mean(axis=0)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


#: Answers of a server that may be otherwise a moment later.
PASSING = {408, 425, 429, 500, 502, 503, 504}


class Retrying:
    """A provider that asks again, after ``first``, twice ``first``, ... seconds (at most ``longest``, and as long as the server says).

    Only what may pass is tried again: no connection, a timeout, and the answers in PASSING.
    """

    def __init__(self, provider: Provider, tries: int = 5, first: float = 0.5, longest: float = 30.0):
        self.provider, self.tries, self.first, self.longest = provider, tries, first, longest
        self.model_id = provider.model_id

    def wait(self, n: int, error: Exception) -> float:
        headers = getattr(error, "headers", None)
        asked = headers.get("Retry-After") if headers else None
        said = float(asked) if asked and asked.isdigit() else 0.0
        return min(self.longest, max(said, self.first * 2**n * (0.5 + random.random() / 2)))

    def get_embeddings(self, texts: list[str], task: str = "document") -> list[list[float]]:
        for n in range(self.tries):
            try:
                return self.provider.get_embeddings(texts, task)
            except OSError as error:  # of which all errors of a connection are
                if n + 1 == self.tries or (isinstance(error, urllib.error.HTTPError) and error.code not in PASSING):
                    raise
                time.sleep(self.wait(n, error))
        raise ValueError("tries must be at least 1")


def answers(provider: Provider) -> None:
    """The usual probe: raise unless a short text gets a vector."""
    if not vectors_of(provider, ["probe"], "query")[0]:
        raise ValueError("an empty vector")


_providers: dict[str, tuple[Callable[..., Provider], Callable[[Provider], None]]] = {"local": (StaticProvider, answers), "http": (HttpProvider, answers)}
#: The local model first, then the server.
CHAIN = ("local", "http")


def register_provider(name: str, make: Callable[..., Provider], probe: Callable[[Provider], None] = answers) -> None:
    """``make(**options)`` builds it; ``probe`` raises where it cannot be used."""
    _providers[name] = make, probe


def load_provider(name: str, **options) -> Provider:
    if name not in _providers:
        raise ValueError(f"no provider {name!r}; known: {', '.join(sorted(_providers))}")
    return _providers[name][0](**options)


def first_provider(names: Sequence[str] = CHAIN, **options) -> Provider:
    """The first provider of ``names`` that can be built and passes its probe.

    It is chosen once, on the driver: vectors of two models do not belong in one index.
    """
    failed = []
    for name in names:
        try:
            provider = load_provider(name, **options)
            _providers[name][1](provider)
            return provider
        except Exception as error:
            if name not in _providers:
                raise
            failed.append(f"{name}: {error}")
    raise NoProvider("; ".join(failed) or "none named")


def vectors_of(provider: Provider, texts: list[str], task: str) -> list[list[float]]:
    """The provider's vectors, one for each text."""
    vectors = provider.get_embeddings(texts, task)
    if len(vectors) != len(texts):
        raise ValueError(f"{len(texts)} texts sent, {len(vectors)} vectors received")
    return vectors


def embed(df: DataFrame, provider: Provider, text_col: str = "content", vec_col: str = "vec", batch: int = BATCH) -> DataFrame:
    """Add ``vec_col``; each task calls the provider with up to ``batch`` texts at a time."""
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(vec_col, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, batch):
                part = whole.slice(begin, batch)
                vectors = vectors_of(provider, [t or "" for t in part.column(at).to_pylist()], "document")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*part.schema.names, vec_col])

    return df.mapInArrow(run, schema)


def embed_query(text: str, provider: Provider) -> list[float]:
    return provider.get_embeddings([text], "query")[0]


def embed_local(texts: list[str], provider: Provider, batch: int = BATCH, on_progress: Callable[[int, int], None] | None = None) -> list[list[float]]:
    """The same on the driver for a short list, with progress (done, total) after each batch."""
    out: list[list[float]] = []
    for begin in range(0, len(texts), batch):
        out += provider.get_embeddings(texts[begin : begin + batch], "document")
        if on_progress:
            on_progress(len(out), len(texts))
    return out
