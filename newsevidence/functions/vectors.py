"""Vector scalars: the deterministic embedding, cosine, mean, and the embedder hook."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col

# Fixed values.
DEFAULT_DIM = 3072
EMBED_BATCH = 100
_DIGEST_BYTES = 32


def hash_embedding(c, dim: int = DEFAULT_DIM) -> Column:
    """SHA-256 bytes over 255, repeated up to ``dim``; empty or null text gives zeros."""
    text = col(c)
    # One-element arrays bind the digest and the base vector, so each is computed once.
    byte_at = lambda h, j: F.conv(F.substr(h, j * 2 + 1, F.lit(2)), 16, 10).cast("double") / F.lit(255.0)
    base = F.get(
        F.transform(
            F.array(F.sha2(text, 256)),
            lambda h: F.transform(F.sequence(F.lit(0), F.lit(_DIGEST_BYTES - 1)), lambda j: byte_at(h, j)),
        ),
        F.lit(0),
    )
    repeats = -(-dim // _DIGEST_BYTES)
    tiled = base if repeats == 1 else F.flatten(F.array_repeat(base, repeats))
    if dim % _DIGEST_BYTES:
        tiled = F.slice(tiled, 1, dim)
    zeros = F.array_repeat(F.lit(0.0), dim)
    return F.when(F.coalesce(text, F.lit("")) == "", zeros).otherwise(tiled)


def digest_matrix(texts, dim: int) -> np.ndarray:
    """The same vectors as :func:`hash_embedding`, one row per text, for use inside tasks."""
    raw = b"".join(hashlib.sha256(t.encode("utf-8")).digest() if t else bytes(_DIGEST_BYTES) for t in texts)
    base = np.frombuffer(raw, dtype=np.uint8).reshape(-1, _DIGEST_BYTES) / 255.0
    return np.tile(base, (1, -(-dim // _DIGEST_BYTES)))[:, :dim]


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine similarity; a zero vector gives 0.0, null or unequal sizes raise."""
    a, b = col(a), col(b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0.0, F.lit(0.0)).otherwise(dot(a, b) / norms)
    fits = F.coalesce(F.size(a) == F.size(b), F.lit(False))
    return F.when(fits, value).otherwise(F.raise_error(F.lit("vector dimensions must match")).cast("double"))


def mean_vector(vectors) -> Column:
    """Element-wise mean of an array of equally long vectors; empty or ragged input raises."""
    vectors = col(vectors)
    total = F.aggregate(
        F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))),
        F.get(vectors, F.lit(0)),
        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y),
    )
    mean = F.transform(total, lambda x: x / F.size(vectors))
    even = F.size(F.array_distinct(F.transform(vectors, F.size))) == 1
    return F.when(even, mean).otherwise(
        F.raise_error(F.lit("vectors must be present and equally long")).cast("array<double>")
    )


Embedder = Callable[[list[str]], np.ndarray]


def embed(df: DataFrame, text_col: str, embedder: Embedder | None = None, *, out: str = "vector",
          dim: int = DEFAULT_DIM, batch: int = EMBED_BATCH) -> DataFrame:
    """Attach a vector to every row.

    Without an embedder the deterministic hash runs as a native expression. An embedder takes a
    list of texts and returns one vector per text; it is called on slices of at most ``batch`` rows
    and must return as many vectors as it was given texts. A size other than ``dim`` is let through.
    """
    if embedder is None:
        return df.withColumn(out, hash_embedding(text_col, dim))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            vectors: list = []
            for at in range(0, len(part), batch):
                texts = part.iloc[at : at + batch].tolist()
                got = embedder(texts)
                if len(got) != len(texts):
                    raise ValueError(f"embedding count mismatch: expected {len(texts)} got {len(got)}")
                vectors.extend(np.asarray(v, dtype=np.float32) for v in got)
            yield pd.Series(vectors, index=part.index, dtype=object)

    # Marked so that a pushed-down filter never calls a costly model twice for a row.
    return df.withColumn(out, run.asNondeterministic()(F.col(text_col)))
