"""Combining documents of several sources so that each has a target share of all tokens.

Tokens of every document are counted once with a public tokenizer and summed by source (partial sums
before the shuffle, so a source with a third of all rows is no hot spot). The rates of repetition
follow from the sums; every document is then emitted floor(rate) times, and once more with the
probability of the fraction, decided by a hash of its id and a seed. That step is a scan with a
broadcast of one row for each source (``MAX_SOURCES`` at most, checked).

Edge cases. Sources are compared in a canonical spelling (trimmed, lower case, ``_`` for spaces and
hyphens). Documents without source, of a source without target, or with a null or blank text have no
part in the mix. A source without documents keeps share 0 in the report. Weights are relative; null
or negative ones count as 0, a null cap as 1. Targets repeated in several spellings are summed (the
largest cap holds). Repeated documents are documents of their own, yet equal ids get equal draws.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnesis.workspace import materialize, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits a text before byte-pair merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_SOURCES = 10_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def canonical_source(source: Column) -> Column:
    """One spelling for each source."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s\-]+", "_"), F.lit(""))


def count_tokens(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of ``text``; 0 of a null text."""

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(tokenizer)
        for batch in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in batch])

    return tokens(text)


def repetition_rates(sources: list[tuple[str, float, int, int]], total: float | None = None) -> dict[str, float]:
    """Copies of each source's documents, from ``(source, weight, cap, tokens)``.

    ``total`` tokens (by default all that there are) are shared out by weight; what a source can't
    fill with ``cap`` copies goes to the others by their weights.
    """
    have = {s: (max(w or 0.0, 0.0), max(cap or 1, 0) * n, n) for s, w, cap, n in sources}
    rest = float(total if total is not None else sum(n for *_, n in have.values()))
    rates = {s: 0.0 for s in have}
    open_ = {s for s, (w, most, n) in have.items() if w > 0 and most > 0}
    while open_:
        weight = sum(have[s][0] for s in open_)
        full = {s for s in open_ if rest * have[s][0] / weight >= have[s][1]}
        for s in full or open_:
            rates[s] = (have[s][1] if full else rest * have[s][0] / weight) / have[s][2]
        rest -= sum(have[s][1] for s in full)
        open_ = open_ - full if full else set()
    return rates


class Mix:
    """A mix of ``documents`` (doc_id, text, source) by ``targets`` (source, weight, max_repeats)."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, tokenizer: str = TOKENIZER):
        self.seed = seed
        self.documents = documents.withColumn("source", canonical_source(F.col("source"))).where(F.col("source").isNotNull() & F.col("text").rlike(r"\S"))
        goals = (
            targets.select(canonical_source(F.col("source")).alias("source"), "weight", "max_repeats")
            .where("source is not null")
            .groupBy("source")
            .agg(F.sum(F.when(F.col("weight") > 0, F.nanvl("weight", F.lit(0.0)))).alias("weight"), F.max("max_repeats").alias("max_repeats"))
        )
        self.counted = materialize(spread(self.documents.select("doc_id", "source", "text")).select("doc_id", "source", count_tokens(F.col("text"), tokenizer).alias("tokens")), "mix-tokens")
        held = self.counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
        rows = goals.join(held, "source", "left").limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        rates = repetition_rates([(r.source, r.weight, r.max_repeats, r.tokens or 0) for r in rows], total)
        self.rates = documents.sparkSession.createDataFrame(
            [(r.source, r.weight or 0.0, r.max_repeats if r.max_repeats is not None else 1, r.tokens or 0, rates[r.source]) for r in rows],
            "source string, weight double, max_repeats int, available_tokens bigint, rate double",
        )

    def _copies(self, rows: DataFrame) -> DataFrame:
        """Each row floor(rate) times, and once more by a hash-seeded draw."""
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), "doc_id"), 11) / F.lit(float(2**53))
        whole = F.floor("rate")
        copies = (whole + (draw < F.col("rate") - whole).cast("int")).cast("int")
        return (
            rows.join(F.broadcast(self.rates.select("source", "rate")), "source")
            .withColumn("copies", copies)
            .where("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        )

    def emit(self) -> DataFrame:
        """The mix: ``(doc_id, source, copy, text)``, one row for each copy."""
        return self._copies(self.documents.select("doc_id", "source", "text")).select("doc_id", "source", "copy", "text")

    def shares(self) -> DataFrame:
        """Target and actual share of each source, in tokens of the mix as emitted."""
        emitted = self._copies(self.counted).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
        total = emitted.agg(F.sum("tokens")).first()[0] or 0
        return self.rates.join(emitted, "source", "left").select(
            "source",
            "weight",
            "max_repeats",
            "available_tokens",
            "rate",
            F.coalesce("documents", F.lit(0)).alias("emitted_documents"),
            F.coalesce("tokens", F.lit(0)).alias("emitted_tokens"),
            (F.coalesce("tokens", F.lit(0)) / F.lit(float(max(total, 1)))).alias("actual_share"),
        )
