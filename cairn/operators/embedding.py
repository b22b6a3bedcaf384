"""Vectors of texts from an injected model: one model per Python worker, texts in batches, failures row by row."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """A model: its name and dimension, and vectors of texts in their order."""

    model: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """The deterministic embedder: bytes of a text's SHA-256, read round and round in steps of seven, brought to length 1."""

    def __init__(self, dim: int = 64):
        self.model, self.dim = f"hash:{dim}", dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            digest = hashlib.sha256(text.encode()).digest()
            raw = [digest[i * 7 % 32] / 255 - 0.5 for i in range(self.dim)]
            norm = math.sqrt(sum(x * x for x in raw))
            out.append([x / norm for x in raw])
        return out


#: Models that this Python worker has made, by the key of their factory; workers serve many tasks.
_MODELS: dict[str, Embedder] = {}


def _model(key: str, factory: Callable[[], Embedder]) -> Embedder:
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def _checked(model: Embedder, texts: list[str]) -> list[list[float]]:
    got = [list(map(float, v)) for v in model.embed(texts)]
    if len(got) != len(texts):
        raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
    for v in got:
        if len(v) != model.dim or not all(map(math.isfinite, v)):
            raise ValueError(f"not a vector of {model.dim} finite numbers")
    return got


def _tried(model: Embedder, texts: list[str], retries: int, wait: float) -> list[tuple[list[float] | None, str | None]]:
    """A vector or an error for each text: the whole batch is tried again, then each text by itself, so that one failing text costs no other."""
    for attempt in range(retries + 1):
        try:
            return [(v, None) for v in _checked(model, texts)]
        except Exception as e:  # a model may fail in any way
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                time.sleep(wait * 2**attempt)
    return [(None, error)] if len(texts) == 1 else [x for t in texts for x in _tried(model, [t], retries, wait)]


def embedded(rows: DataFrame, key: str, factory: Callable[[], Embedder], text: str = "text", batch: int = 64, retries: int = 2, wait: float = 0.5) -> DataFrame:
    """``rows`` with embedder, dim, vec and error added, one row each, in their order within a partition.

    ``factory`` makes the model, once for each Python worker and ``key``. A text that fails ``retries`` times more, and a null
    text, has a null vec and says why; a factory that fails fails the job. The added columns replace any of their names.
    """
    rows = rows.drop("embedder", "dim", "vec", "error")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            model = _model(key, factory)
            for at in range(0, part.num_rows, batch):
                some = part.slice(at, batch)
                texts = some.column(text).to_pylist()
                given = [i for i, t in enumerate(texts) if t is not None]
                found: list[tuple[list[float] | None, str | None]] = [(None, "null text")] * len(texts)
                for i, x in zip(given, _tried(model, [texts[i] for i in given], retries, wait) if given else []):
                    found[i] = x
                n = len(texts)
                added = [pa.array([model.model] * n), pa.array([model.dim] * n, pa.int32()), pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array([e for _, e in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*some.columns, *added], [*some.schema.names, "embedder", "dim", "vec", "error"])

    return rows.mapInArrow(run, f"{kinds}, embedder string, dim int, vec array<float>, error string")


def one_embedder(vectors: DataFrame, model: str) -> DataFrame:
    """The vectors of a model; an error if there are others' but none of its own, as they are of another space."""
    mine = vectors.where(F.col("embedder") == model)
    if mine.isEmpty() and not vectors.isEmpty():
        raise ValueError(f"no vectors of {model}: index the chunks with it first")
    return mine
