"""Embedding models for texts.

Models plug in through :class:`EmbeddingModel`, whose ``column`` is usually a vectorised Python
function.  The hashing model's sparse form, :func:`embed_sparse`, stays in the JVM; its dense column
is an Arrow function that hashes each distinct token once per worker.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillvec.functions import text as T


KNOWN_TOKENS = 1_000_000  # hashes that a worker keeps
_PLAIN = str.maketrans(T.UPPER, T.LOWER) | {ord(c): " " for c in "\t\n\v\f\r"}


class EmbeddingModel(ABC):
    """A text embedding: its dimension, and the embedding of a text column."""

    @property
    @abstractmethod
    def dim(self) -> int: ...

    @abstractmethod
    def column(self, text: Column) -> Column:
        """``array<float>`` of ``dim`` elements, never null."""


class HashingModel(EmbeddingModel):
    """Signed feature hashing of tokens of 3 bytes or more, scaled to length 1.

    A text without such tokens is the zero vector.
    """

    def __init__(self, dim: int = 128):
        if dim <= 0:
            raise ValueError("dim must be positive")
        self._dim = dim

    @property
    def dim(self) -> int:
        return self._dim

    def column(self, text: Column) -> Column:
        dim = self._dim

        known: dict[str, tuple[int, int]] = {}  # a worker's own copy, kept between batches

        @F.pandas_udf("array<float>")
        def embed(texts: pd.Series) -> pd.Series:
            if len(known) > KNOWN_TOKENS:
                known.clear()
            return pd.Series([hashed(t, dim, known) for t in texts])

        return embed(text)


def hashed(text: str | None, dim: int, known: dict[str, tuple[int, int]]) -> np.ndarray:
    """The hashing model for one text; ``known`` caches (index, sign) of tokens."""
    tokens = (text or "").translate(_PLAIN).split(" ")
    for token in set(tokens).difference(known):
        data = token.encode("utf-8", "surrogatepass")
        h = T.FNV_BASIS
        for b in data:
            h = ((h ^ b) * T.FNV_PRIME) % (1 << 64)
        known[token] = (h % dim, (1 if h >> 63 else -1) if len(data) >= 3 else 0)
    pairs = [known[t] for t in tokens]
    out = np.bincount([i for i, _ in pairs], [s for _, s in pairs], dim)
    length = np.sqrt((out * out).sum())
    return (out / length if length else out).astype(np.float32)


class FunctionModel(EmbeddingModel):
    """Any function from a batch of texts to a matrix of ``dim`` columns."""

    def __init__(self, dim: int, function: Callable[[list[str]], np.ndarray]):
        self._dim, self._function = dim, function

    @property
    def dim(self) -> int:
        return self._dim

    def column(self, text: Column) -> Column:
        function = self._function

        @F.pandas_udf("array<float>")
        def embed(texts: pd.Series) -> pd.Series:
            return pd.Series(list(np.asarray(function([t or "" for t in texts]), np.float32)))

        return embed(text)


def embed_sparse(texts: DataFrame, keys: list[str], text: str = "text", dim: int = 128) -> DataFrame:
    """``(keys, idx, weight)``: the hashing model's non-zero elements, without Python.

    Tokens are counted per text before anything is hashed; every distinct token is hashed once.
    A key stands for one text.
    """
    counted = (
        texts.select(*keys, F.explode(T.tokens(F.col(text))).alias("token"))
        .where(F.octet_length("token") >= 3)
        .groupBy(*keys, "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    halves = T.fnv_halves(F.col("token"))
    vocabulary = (
        counted.select("token").distinct()
        .select("token", halves.alias("h"))
        .select("token", T.fnv_bucket(F.col("h"), dim).alias("idx"), T.fnv_sign(F.col("h")).alias("sign"))
    )
    sums = (
        counted.join(vocabulary, "token").groupBy(*keys, "idx")
        .agg(F.sum(F.col("sign") * F.col("n")).cast("double").alias("s")).where("s <> 0")
    )
    whole = Window.partitionBy(*keys)
    return sums.withColumn("_norm", F.sqrt(F.sum(F.col("s") * F.col("s")).over(whole))).select(
        *keys, F.col("idx").cast("int").alias("idx"), (F.col("s") / F.col("_norm")).alias("weight")
    )
