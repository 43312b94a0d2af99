"""A deterministic embedder: hashed character n-grams and words, as a vectorised UDF and in SQL form.

Any object with ``dim`` and ``embed(texts) -> array of unit rows`` can take its place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnesis.functions import text as tx

_WORD = re.compile(r"[a-z0-9_]{3,}")
_PRIME, _MASK = np.uint64(tx.PRIME), np.uint64(tx.MASK)
_IDENTITY = np.uint64(0x9E3779B97F4A7C15)


class Embedder(Protocol):
    """What the store and recall need of an embedder."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@lru_cache(maxsize=200_000)
def _hash(gram: str) -> int:
    raw = gram.encode("utf-16-le", "surrogatepass")
    h = tx.SEED
    for i in range(0, len(raw), 2):
        h = (h ^ (raw[i] | raw[i + 1] << 8)) * tx.PRIME & tx.MASK
    return h


class HashedNGramEmbedder:
    """Signed hashing of n-grams of 1 to 4 code points, words and word pairs, damped counts, unit length."""

    def __init__(self, dim: int = 512):
        self.dim = dim

    def _one(self, text: str) -> np.ndarray:
        text = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        hashes, counts = [], []
        h, key = np.full(len(points), tx.SEED, np.uint64), np.zeros(len(points), np.uint64)
        for n in range(min(4, len(points))):
            # the hash of an n-gram extends that of the (n-1)-gram at the same place
            h, key, c = h[: len(points) - n], key[: len(points) - n], points[n:]
            wide = c > 0xFFFF
            first = np.where(wide, 0xD800 + ((c - np.where(wide, np.uint64(0x10000), np.uint64(0))) >> np.uint64(10)), c)
            h = (h ^ first) * _PRIME & _MASK
            if wide.any():
                second = np.uint64(0xDC00) + ((c - np.where(wide, np.uint64(0x10000), np.uint64(0))) & np.uint64(0x3FF))
                h = np.where(wide, (h ^ second) * _PRIME & _MASK, h)
            key = key * _IDENTITY + c + np.uint64(1)
            _, at, k = np.unique(key, return_index=True, return_counts=True)
            hashes.append(h[at])
            counts.append(k)
        words = _WORD.findall(text)
        bag: dict[str, int] = {}
        for w in words:
            bag["w:" + w] = bag.get("w:" + w, 0) + 2
        for a, b in zip(words, words[1:]):
            bag[f"wb:{a} {b}"] = bag.get(f"wb:{a} {b}", 0) + 3
        hashes.append(np.array([_hash(g) for g in bag], np.uint64))
        counts.append(np.array(list(bag.values()), np.int64))
        h, k = np.concatenate(hashes), np.concatenate(counts)
        sign = np.where(h & np.uint64(1), -1.0, 1.0)
        return np.bincount((h % np.uint64(self.dim)).astype(np.int64), sign * (1 + 0.5 * np.log1p(k)), self.dim)

    def embed(self, texts: list[str]) -> np.ndarray:
        """Unit rows (zero for an empty text), in single precision."""
        rows = np.stack([self._one(t or "") for t in texts]) if texts else np.zeros((0, self.dim))
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        return (rows / np.where(norm > 0, norm, 1)).astype(np.float32)


def embed_column(text: Column, embedder: Embedder) -> Column:
    """The embedding of ``text`` as ``array<float>``."""

    @F.pandas_udf("array<float>")
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embedder.embed([t or "" for t in batch])))

    return embedded(text)


def features(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Weighted feature counts ``(key, gram, count)`` of short texts, in built-in functions only."""
    clean = rows.select(key, tx.normalize_text(F.col(text)).alias("t")).where("t is not null").withColumn("words", tx.word_tokens(F.col("t")))

    def weighted(grams: Column, prefix: str, weight: int) -> DataFrame:
        return clean.select(key, F.explode(grams).alias("gram")).select(key, F.concat(F.lit(prefix), "gram").alias("gram"), F.lit(weight).alias("w"))

    parts = (
        weighted(tx.char_ngrams(F.col("t")), "", 1)
        .unionByName(weighted(F.col("words"), "w:", 2))
        .unionByName(weighted(tx.word_bigrams(F.col("words")), "wb:", 3))
    )
    return parts.groupBy(key, "gram").agg(F.sum("w").alias("count"))


def sparse(features: DataFrame, key: str, dim: int = 512) -> DataFrame:
    """Feature counts to bucket weights ``(key, bucket, weight)``, not yet of unit length."""
    h = tx.fnv1a(F.col("gram"))
    hashed = features.withColumn("h", h)
    weight = F.when(F.col("h") % 2 == 0, 1.0).otherwise(-1.0) * (F.lit(1.0) + F.lit(0.5) * F.log1p("count"))
    return hashed.groupBy(key, (F.col("h") % dim).alias("bucket")).agg(F.sum(weight).alias("weight"))
