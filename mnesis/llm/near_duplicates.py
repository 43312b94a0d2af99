"""Records that share most of their words, by partition and one-deletion neighbourhoods.

Every record is a set of word hashes. Sets of equal content are one *class*. Classes are joined by a
pigeonhole over a partition of the universe of words:

* Sizes are cut into bands. A band has ``m`` segments; a hash sends each word to one of them. Two sets
  of Jaccard similarity t or more differ in at most H = (1-t)/(1+t) * (|r|+|s|) words, so if the
  segments together tolerate H + 1 "units", at least one segment differs by less than its share.
* The index holds of each segment the *subset* of words (tolerates no difference: one unit) and its
  *one-deletion neighbourhood* (tolerates one: two units).
* The larger set of a pair probes the bands of its possible partners and chooses, segment by segment,
  whether to skip it, to look the subset up, or to look up its neighbourhood too, so that the units
  suffice at least cost. Costs are counts of signatures over all records, in a sketch.
* A probe whose signature nobody has but itself is dropped at once, by the same counts; an index
  signature that nobody probes is dropped by a bitmap of the probes that are left.
* Candidates are thinned by a bound on the difference from 128-bit parity signatures, made distinct,
  and verified exactly on the word sets.

Scale. One shuffle of the signatures that may meet (16 bytes and 24 of payload each, no texts or sets),
one of the few candidates, none of pairs within a class before the result is spelled out. Sketch and
bitmap are the only broadcasts. Their size follows the number of signatures up to ``MOST_SLOTS`` bytes
each (64 MB); beyond some 300,000 classes they fill up, drop fewer signatures and tell costs less
well, which costs shuffle and never a link. Frequent signatures are avoided by cost, and what remains of
a hot key is split by the adaptive join; no list is capped.

Edge cases. A null text or tag has no words, a null array no tags; rows without id take no part, rows
of one id are one record with all their words. Sets of fewer than ``min_words`` words are left out.
Very long texts are used whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnesis.llm.words import words
from mnesis.workspace import materialize, spread

#: Counters of the sketch of signature counts, and bytes of the bitmap of probes: at least, and at most.
SLOTS, MOST_SLOTS = 1 << 20, 1 << 26
#: The counters are kept as rounded logarithms, so many steps for each doubling.
STEPS = 8
COUNTS = np.exp2(np.arange(256) / STEPS) - 1
#: Pieces in which a sketch or bitmap travels.
PARTS = 256
#: A band's largest size over its smallest; segments beyond the least that suffice.
BAND_WIDTH, SPARE = 1.2, 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _ODD


class Bands:
    """Bands of set sizes for a threshold."""

    def __init__(self, threshold: float, least: int):
        self.t, self.least = threshold, least
        self.slack = (1 - threshold) / (1 + threshold)

    @lru_cache(maxsize=None)  # noqa: B019
    def edges(self, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Smallest size, largest size and segments of each band up to ``largest``."""
        low, high = [], []
        at = max(1, self.least)
        while at <= largest:
            low.append(at)
            high.append(max(at, int(at * BAND_WIDTH)))
            at = high[-1] + 1
        high_ = np.array(high, dtype=np.int64)
        most = self.differences(np.floor(high_ / self.t + 1e-9), high_)
        return np.array(low, dtype=np.int64), high_, (most + 2) // 2 + SPARE

    def differences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most words in which similar sets of these sizes differ."""
        return np.floor(self.slack * (a + b) + 1e-9).astype(np.int64)


def _flat(sets: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets).astype(np.int64) if len(sets) else np.zeros(0, np.int64)
    return flat.view(np.uint64), sizes


class Segments:
    """Signatures of the segments of some sets, each cut for one band."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, band: np.ndarray, m: np.ndarray):
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        base = np.concatenate([[0], np.cumsum(m)])
        self.slot = base[self.row] + ((flat >> np.uint64(20)) % m[self.row].astype(np.uint64)).astype(np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), m)
        mixed = mix(flat)
        self.sums = np.zeros(base[-1], np.uint64)
        np.add.at(self.sums, self.slot, mixed)
        segment = np.arange(base[-1]) - base[self.owner]
        self.salt = mix(((band[self.owner] << 20) + segment).astype(np.uint64) * _ODD + np.uint64(1))
        self.subset = self.sign(self.sums, self.salt, 0)
        self.less = self.sums[self.slot] - mixed  # each word's segment without it

    @staticmethod
    def sign(sums: np.ndarray, salt: np.ndarray, space: int) -> np.ndarray:
        return mix(sums ^ salt) + np.uint64(space) * _MIX


def index_signatures(sets: list, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row): subsets in space 0, one-deletion neighbourhoods in space 1."""
    flat, sizes = _flat(sets)
    low, _, m = bands.edges(int(sizes.max(initial=0)))
    band = np.searchsorted(low, sizes, side="right") - 1
    s = Segments(flat, sizes, band, m[band] if len(sizes) else sizes)
    return np.concatenate([s.subset, s.sign(s.less, s.salt[s.slot], 1)]), np.concatenate([s.owner, s.row])


def probe_signatures(sets: list, bands: Bands, counts: np.ndarray, drop: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) that find every similar set that is not larger, at least cost; with ``drop``,
    without those that meet nothing, where ``counts`` has all index signatures."""
    flat, sizes = _flat(sets)
    low, high, m = bands.edges(int(sizes.max(initial=0)))
    first = np.searchsorted(high, np.ceil(bands.t * sizes - 1e-9), side="left")
    last = np.searchsorted(low, sizes, side="right") - 1
    spread = last - first + 1  # a row for each set and each band it probes
    row = np.repeat(np.arange(len(sizes)), spread)
    band = np.repeat(first, spread) + np.arange(len(row)) - np.repeat(np.cumsum(spread) - spread, spread)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = sizes[row]
    take = np.repeat(starts[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    s = Segments(flat[take], n, band, m[band])
    need = bands.differences(n, np.minimum(high[band], n)) + 1
    shorter = s.sign(s.less, s.salt[s.slot], 0)
    wider = s.sign(s.sums, s.salt, 1)

    def code(signature: np.ndarray) -> np.ndarray:
        return counts[(signature % np.uint64(len(counts))).astype(np.int64)]

    def cost(signature: np.ndarray) -> np.ndarray:
        return COUNTS[code(signature)]

    one = cost(s.subset)
    two = one + cost(wider) + np.bincount(s.slot, cost(shorter), len(one))
    joint = two < 2 * one  # then both units are bought together
    price = np.concatenate([np.where(joint, two / 2, one), np.where(joint, two / 2, two - one)])
    slot = np.tile(np.arange(len(one)), 2)
    owner = s.owner[slot]
    order = np.lexsort((np.repeat([0, 1], len(one)), slot, price, owner))
    place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order], side="left")
    bought = order[place < need[owner[order]]]
    units = np.bincount(slot[bought], minlength=len(one))
    units[joint & (units == 1)] = 2
    short = units[s.slot] == 2
    subset, wide, some = units >= 1, units == 2, short
    if drop:  # what nobody has; in its own band, a set meets its own subsets
        own = band == np.repeat(last, spread)
        subset = subset & (code(s.subset) > np.where(own[s.owner], STEPS, 0))
        wide, some = wide & (code(wider) > 0), some & (code(shorter) > 0)
    return (
        np.concatenate([s.subset[subset], wider[wide], shorter[some]]),
        row[np.concatenate([s.owner[subset], s.owner[wide], s.row[some]])],
    )


def gather(rows: DataFrame, width: int, add: Callable, combine: Callable, finish: Callable) -> np.ndarray:
    """An array of ``width`` bytes over all rows: each task makes its own by ``add(array, batch)``, pieces
    are combined by place in parallel, and the whole comes to the driver."""
    import zstandard

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width, np.uint8)
        for batch in batches:
            add(total, batch)
        pack = zstandard.ZstdCompressor(1)
        yield pd.DataFrame({"part": range(PARTS), "piece": [pack.compress(x.tobytes()) for x in np.split(total, PARTS)]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(1)
        for batch in batches:
            for part, piece in zip(batch["part"], batch["piece"]):
                held[part] = combine(held.get(part, 0), np.frombuffer(unpack.decompress(piece), np.uint8))
        yield pd.DataFrame({"part": list(held), "piece": [pack.compress(finish(x).tobytes()) for x in held.values()]}).astype({"part": "int32"})

    form = "part int, piece binary"
    out, unpack = np.zeros(width, np.uint8), zstandard.ZstdDecompressor()
    for r in rows.mapInPandas(local, form).repartition("part").mapInPandas(merge, form).collect():
        size = width // PARTS
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(unpack.decompress(r.piece), np.uint8)
    return out


def slots(signatures: int) -> int:
    """Four slots a signature, as a power of two within the limits."""
    return min(MOST_SLOTS, max(SLOTS, 1 << (max(1, 4 * signatures) - 1).bit_length()))


def marked(bits: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Which signatures are in a bitmap."""
    at = (sig >> np.uint64(20)) % np.uint64(8 * len(bits))
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def parity(sets: list) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits of each set; two sets differ in at least as many words as bits."""
    flat, sizes = _flat(sets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    bit = np.uint64(1) << (flat & np.uint64(63))
    upper = (flat >> np.uint64(6)) & np.uint64(1) == 1
    halves = []
    for part in (upper, ~upper):
        out = np.zeros(len(sizes), np.uint64)
        np.bitwise_xor.at(out, row[part], bit[part])
        halves.append(out.view(np.int64))
    return halves[0], halves[1]


def word_sets(records: DataFrame) -> DataFrame:
    """``(id, words)``: the sorted distinct word hashes of the text and tags of each id."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > 1_000_000:
                known.clear()
            out = []
            for text, tags in zip(batch["text"], batch["tags"]):
                found = words(text)
                for tag in tags if tags is not None else ():
                    found += words(tag)
                for w in found:
                    if w not in known:
                        known[w] = xxhash.xxh64_intdigest(w) - (1 << 63)
                out.append(np.unique(np.fromiter((known[w] for w in found), np.int64, len(found))))
            yield pd.DataFrame({"id": batch["id"], "words": out})

    rows = spread(records.select(F.col("id").cast("string"), "text", "tags").where("id is not null"))
    return (
        rows.mapInPandas(hashed, "id string, words array<bigint>")
        .groupBy("id")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("words")))).alias("words"))
    )


SIGNED = "sig bigint, class bigint, n int, low bigint, high bigint"


class NearDuplicates:
    """Classes of equal word sets of ``records`` (id, text, tags), and the links between them."""

    def __init__(self, records: DataFrame, threshold: float = 0.70, min_words: int = 12):
        self.threshold = threshold
        self.bands = Bands(threshold, min_words)
        sets = word_sets(records).where(F.size("words") >= min_words).withColumn("class", F.xxhash64("words"))
        sets = materialize(sets, "word-sets")
        self.members = sets.select("class", "id")
        self.classes = materialize(sets.groupBy("class").agg(F.first("words").alias("words")), "word-classes")
        self._links: DataFrame | None = None

    def _counts(self) -> np.ndarray:
        """Counts of all index signatures, by slot of the sketch, as logarithms."""
        bands = self.bands
        total = self.classes.agg(F.sum(F.size("words")), F.count("*")).first()

        def add(counts: np.ndarray, batch: pd.DataFrame) -> None:
            sig, _ = index_signatures(list(batch["words"]), bands)
            at, n = np.unique((sig % np.uint64(len(counts))).astype(np.int64), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, 255)

        def finish(n: np.ndarray) -> np.ndarray:
            return np.minimum(np.rint(STEPS * np.log2(1 + n)), 255).astype(np.uint8)

        # a set has a signature for each word and each segment
        return gather(self.classes.select("words"), slots((total[0] or 0) * 5 // 4), add, lambda a, x: a + x.astype(np.uint32), finish)

    def _probed(self, probes: DataFrame) -> np.ndarray:
        """A bitmap of the signatures that are probed."""

        def add(bits: np.ndarray, batch: pd.DataFrame) -> None:
            at = (batch["sig"].to_numpy(dtype=np.int64).view(np.uint64) >> np.uint64(20)) % np.uint64(8 * len(bits))
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

        return gather(probes.select("sig"), slots(2 * probes.count()), add, lambda a, x: a | x, lambda x: x)

    def _signed(self, counts=None, probed=None) -> DataFrame:
        """Signatures of all classes: with ``counts`` of the probes, else those of the index that are ``probed``."""
        bands = self.bands

        def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 2000):
                    some = batch.iloc[at : at + 2000]
                    sets = list(some["words"])
                    if counts is not None:
                        sig, row = probe_signatures(sets, bands, counts.value, drop=True)
                    else:
                        sig, row = index_signatures(sets, bands)
                        met = marked(probed.value, sig)
                        sig, row = sig[met], row[met]
                    low, high = parity(sets)
                    size = np.fromiter(map(len, sets), np.int32, len(sets))
                    yield pd.DataFrame({"sig": sig.view(np.int64), "class": some["class"].to_numpy()[row], "n": size[row], "low": low[row], "high": high[row]})

        return self.classes.mapInPandas(signed, SIGNED)

    def links(self) -> DataFrame:
        """``(a, b, similarity)``: all pairs of different classes at the threshold, once."""
        if self._links is not None:
            return self._links
        context = self.classes.sparkSession.sparkContext
        probes = materialize(self._signed(context.broadcast(self._counts())), "probes")
        r, s = probes.alias("r"), self._signed(probed=context.broadcast(self._probed(probes))).alias("s")

        def column(name: str) -> tuple[Column, Column]:
            return F.col(f"r.{name}"), F.col(f"s.{name}")

        (rn, sn), (rc, sc) = column("n"), column("class")
        differ = sum(F.bit_count(x.bitwiseXOR(y)) for x, y in (column("low"), column("high")))
        close = (
            ((sn < rn) | ((sn == rn) & (sc < rc)))
            & (sn >= F.lit(self.threshold) * rn - F.lit(1e-9))
            & (differ <= F.lit(self.bands.slack) * (rn + sn) + F.lit(1e-9))
        )
        found = r.join(s, (F.col("r.sig") == F.col("s.sig")) & close).select(rc.alias("a"), sc.alias("b")).distinct()
        a = self.classes.select(F.col("class").alias("a"), F.col("words").alias("wa"))
        b = self.classes.select(F.col("class").alias("b"), F.col("words").alias("wb"))
        shared = F.size(F.array_intersect("wa", "wb"))
        self._links = materialize(
            found.join(a, "a")
            .join(b, "b")
            .select("a", "b", (shared / (F.size("wa") + F.size("wb") - shared)).alias("similarity"))
            .where(F.col("similarity") >= self.threshold - 1e-9),
            "class-links",
        )
        return self._links

    def representatives(self) -> DataFrame:
        """``(id, class, copies, links)``: one row for each record, with the size of its class and the
        number of other classes that are near-duplicates of it."""
        ends = self.links().select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
        sizes = self.members.groupBy("class").agg(F.count("*").alias("copies")).join(ends, "class", "left")
        return self.members.join(sizes, "class").select("id", "class", "copies", F.coalesce("links", F.lit(0)).alias("links"))

    def pairs(self) -> DataFrame:
        """``(id_a, id_b)``: all pairs of different records, id_a < id_b, within and between classes."""
        a = self.members.select(F.col("class").alias("a"), F.col("id").alias("x"))
        b = self.members.select(F.col("class").alias("b"), F.col("id").alias("y"))
        between = self.links().select("a", "b").join(a, "a").join(b, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        several = self.members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
        copies = self.members.join(several, "class")
        within = copies.alias("p").join(copies.alias("q"), (F.col("p.class") == F.col("q.class")) & (F.col("p.id") < F.col("q.id")))
        return between.unionByName(within.select(F.col("p.id").alias("id_a"), F.col("q.id").alias("id_b")))
