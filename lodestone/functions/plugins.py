"""Tokenizers and encoders that an index carries from its build to its queries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T


@dataclass(frozen=True)
class Tokenizer:
    """A name, and what makes an array of terms of a text column."""

    name: str
    terms: Callable[[Column], Column]

    def __call__(self, c: Column) -> Column:
        return self.terms(c)


#: What set-ups have given in this worker, by name.
_READY: dict[str, Callable[[list[str]], np.ndarray]] = {}


@dataclass(frozen=True)
class Encoder:
    """Vectors of texts. setup() runs once in each worker, where it may load a model, and gives a function from a list of
    texts to an array of a row for each and `dim` columns; texts come in Arrow batches, null ones as empty."""

    name: str
    dim: int
    setup: Callable[[], Callable[[list[str]], np.ndarray]]

    def embed(self, rows: DataFrame, key: list[str]) -> DataFrame:
        """rows with `embedding`. Narrow: no shuffle."""
        name, dim, setup = self.name, self.dim, self.setup
        columns = [c for c in rows.columns if c != "embedding"]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _READY:
                _READY[name] = setup()
            for b in batches:
                made = np.asarray(_READY[name]([t or "" for t in b["text"].to_pylist()]), dtype=float).reshape(-1, dim) if b.num_rows else np.zeros((0, dim))
                if len(made) != b.num_rows:
                    raise ValueError(f"encoder {name!r} gave {len(made)} vectors for {b.num_rows} texts")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * dim, pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*(b[c] for c in columns), vectors], [*columns, "embedding"])

        return rows.select(*columns).mapInArrow(add, T.schema_text(rows.select(*columns), "embedding array<double>"))


@dataclass(frozen=True)
class HashedTerms(Encoder):
    """Unit-length counts of terms by a hash; all zero without terms. Spark makes the terms; a batch's distinct ones are hashed, its rows summed at once."""

    tokenizer: Tokenizer = Tokenizer("terms", T.terms)

    def embed(self, rows: DataFrame, key: list[str]) -> DataFrame:
        dim = self.dim
        columns = [c for c in rows.columns if c != "embedding"]
        with_terms = rows.select(*columns, self.tokenizer(F.coalesce("text", F.lit(""))).alias("embedding"))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b["embedding"]
                coded = lists.flatten().dictionary_encode()
                hashed = np.array([int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % dim for t in coded.dictionary.to_pylist()], dtype=np.int64)
                row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths(), dtype=np.int64))
                v = np.bincount(row * dim + (hashed[np.asarray(coded.indices, dtype=np.int64)] if len(hashed) else 0), minlength=b.num_rows * dim).reshape(b.num_rows, dim).astype(float)
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dim, pa.int32()), pa.array((v / np.where(norm > 0, norm, 1.0)).ravel()))
                yield pa.RecordBatch.from_arrays([*(b[c] for c in columns), vectors], [*columns, "embedding"])

        return with_terms.mapInArrow(add, T.schema_text(rows.select(*columns), "embedding array<double>"))


TERMS = Tokenizer("terms", T.terms)
HASHED = HashedTerms("hashed-terms", 64, lambda: None)


def named(tokenizer: Tokenizer, encoder: Encoder) -> dict[str, str | int]:
    """What an index says about its plug-ins."""
    return {"tokenizer": tokenizer.name, "encoder": encoder.name, "dim": encoder.dim}


def check(meta: DataFrame | None, tokenizer: Tokenizer, encoder: Encoder) -> None:
    """Raises where an index (its table `meta`) was built with other plug-ins than queries meet it with."""
    row = meta.first() if meta is not None else None
    if row is not None and row.asDict() != named(tokenizer, encoder):
        raise ValueError(f"the index was built with {row.asDict()}, queries come with {named(tokenizer, encoder)}")
