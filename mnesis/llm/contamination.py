"""Documents that contain passages of evaluation items, by a generalised suffix automaton.

The words of all passages go into one automaton (in shards of bounded size, each a broadcast of its
own). Every document is streamed through it word by word; the longest match that ends at each word is
known in constant time, and a state knows which items contain its words.

Scale. Documents are only scanned: no shuffle but the small one that makes found pairs distinct. The
passages are read shard by shard, ``SHARD_CHARS`` characters at most besides one passage, so the
broadcast is bounded however many items there are; more shards mean more scans.

Edge cases. Null or blank texts and passages, and passages shorter than the limit, leak nothing. Very
long texts are streamed as a whole. Repeated items and documents give one row for each pair of ids.
Null ids take part like other values. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.llm.words import word_spans, words
from mnesis.workspace import spread

#: Characters of passages in one automaton (at most some 300 bytes of memory each).
SHARD_CHARS = 500_000
#: Consecutive words that make a leak.
MIN_WORDS = 10


class PassageAutomaton:
    """A generalised suffix automaton over words: every run of words of any passage is a path."""

    def __init__(self, passages: list[tuple[int, list[str]]], min_words: int = MIN_WORDS):
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.min_words = min_words
        ends: list[set[int]] = [set()]
        for item, ws in passages:
            last = 0
            for w in ws:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)), ends)
                ends[last].add(item)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in order:  # what ends in a state also ends in its suffixes
            ends[self.link[v]] |= ends[v]
        # of each state, the suffix state that holds exactly the last min_words words
        self.short = [0] * len(self.length)
        for v in reversed(order):
            if self.length[v] >= min_words:
                up = self.link[v]
                self.short[v] = v if self.length[up] < min_words else self.short[up]
        self.items = [frozenset(e) if s == v and s else frozenset() for v, (e, s) in enumerate(zip(ends, self.short))]

    def _extend(self, last: int, c: int, ends: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q, ends)
        new = self._state(length[last] + 1, {}, ends)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q, ends)
        return new

    def _state(self, length: int, nxt: dict[int, int], ends: list[set[int]]) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.length) - 1

    def _clone(self, p: int, c: int, q: int, ends: list[set[int]]) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), ends)
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def matches(self, ws: list[str]) -> list[tuple[int, int, int]]:
        """(position of the last word, length of the longest match there, state) where at least
        ``min_words`` words match."""
        nxt, link, length, least = self.next, self.link, self.length, self.min_words
        known = self.vocabulary.get
        out, v, n = [], 0, 0
        for i, w in enumerate(ws):
            c = known(w)
            if c is None:
                v = n = 0
                continue
            while c not in nxt[v]:
                v = link[v]
                if v < 0:
                    break
                n = length[v]
            if v < 0:
                v = n = 0
                continue
            v = nxt[v][c]
            n += 1
            if n >= least:
                out.append((i, n, self.short[v]))
        return out


def _shards(items: DataFrame, min_words: int) -> Iterator[PassageAutomaton]:
    """Automata over the passages, one after the other, each over a bounded share."""
    ready = items.select("item_id", "passage").where("passage is not null").distinct()
    chars = ready.agg(F.sum(F.length("passage"))).first()[0] or 0
    shards = max(1, math.ceil(chars / SHARD_CHARS))
    for k in range(shards):
        share = ready.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(shards)) == k).collect()
        found = [(r.item_id, ws) for r in share if len(ws := words(r.passage)) >= min_words]
        if found:
            yield PassageAutomaton(found, min_words)


LEAK_SCHEMA = "doc_id bigint, item_id bigint, longest int, words int"


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Pairs of document and leaked item: ``(doc_id, item_id, longest, words)``, where ``longest`` is
    the longest run of the document's words in any passage around a leak of this item, and ``words``
    the number of word positions at which a leaking run ends."""
    spark = documents.sparkSession
    texts = spread(documents.select(F.col("doc_id").cast("bigint"), "text").where("text is not null"))
    found = spark.createDataFrame([], LEAK_SCHEMA)
    for automaton in _shards(items, min_words):
        shared = spark.sparkContext.broadcast(automaton)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            a = shared.value
            for batch in batches:
                rows = []
                for doc, text in zip(batch["doc_id"], batch["text"]):
                    hits: dict[int, list[int]] = {}
                    for _, n, state in a.matches(words(text)):
                        for item in a.items[state]:
                            best = hits.setdefault(item, [0, 0])
                            best[0] = max(best[0], n)
                            best[1] += 1
                    rows += [(doc, item, n, k) for item, (n, k) in hits.items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "longest", "words"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        found = found.unionByName(texts.mapInPandas(scan, LEAK_SCHEMA))
    return found.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("words").alias("words"))


def remove_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_coverage: float = 0.5) -> DataFrame:
    """Documents without the leaking spans: ``(doc_id, text, removed, coverage, dropped)``.

    A span is cut where a run of at least ``min_words`` words stands in a passage; the places of all shards
    are gathered on the whole text and cut once. A document of
    which such spans cover more than ``max_coverage`` of the words is dropped as a whole (its text
    becomes null). Every document comes out once for each of its rows.
    """
    spark = documents.sparkSession
    marked = documents.select(F.col("doc_id").cast("bigint"), "text", F.array().cast("array<int>").alias("leaked"))
    for automaton in _shards(items, min_words):
        shared = spark.sparkContext.broadcast(automaton)

        # every shard reads the whole text and adds to the places of leaking words; nothing is cut yet
        def mark(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            a = shared.value
            for batch in batches:
                places = []
                for text, before in zip(batch["text"], batch["leaked"]):
                    found = set(before)
                    for end, n, _ in a.matches(words(text)):
                        found.update(range(end - n + 1, end + 1))
                    places.append(sorted(found))
                yield pd.DataFrame({"doc_id": batch["doc_id"].array, "text": batch["text"], "leaked": places}).astype({"doc_id": "Int64"})

        marked = marked.mapInPandas(mark, "doc_id bigint, text string, leaked array<int>")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, sizes = [], []
            for text, places in zip(batch["text"], batch["leaked"]):
                sizes.append(len(words(text)))
                leaked = set(map(int, places))
                if leaked:
                    spans, kept, at = word_spans(text), [], 0
                    for k in sorted(leaked):
                        if k < len(spans):
                            kept.append(text[at : spans[k][1]] if k - 1 not in leaked else "")
                            at = spans[k][2]
                    text = "".join(kept) + text[at:]
                texts.append(text)
            removed = [len(x) for x in batch["leaked"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "text": texts, "removed": removed, "words": sizes}).astype({"doc_id": "Int64"})

    out = marked.mapInPandas(cut, "doc_id bigint, text string, removed int, words int")
    coverage = F.when(F.coalesce("words", F.lit(0)) > 0, F.col("removed") / F.col("words")).otherwise(F.lit(0.0))
    return (
        out.withColumn("coverage", coverage)
        .withColumn("dropped", F.col("coverage") > max_coverage)
        .select("doc_id", F.when(~F.col("dropped"), F.col("text")).alias("text"), "removed", "coverage", "dropped")
    )
