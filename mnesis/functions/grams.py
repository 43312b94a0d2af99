"""Features of whole documents: counted where the document lies, many documents in one sort, without an exchange.

The same as :func:`mnesis.functions.embed.features` and :func:`~mnesis.functions.embed.sparse`, which explode every
n-gram and group them again. Here the code points of some documents are numbered by their alphabet, four of them and the
document make one integer, and one sort of these gives the counts of all n-grams of 1 to 4. What is counted leaves
Python as lists, because the JVM takes lists apart faster than it takes rows. Rows without text give nothing. Rows that share a key (null is one, too) count as one document; only these are grouped by an exchange.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.functions import text as tx

#: Code points of the documents of one sort (one document may have more), and numbers of a list, at most.
POINTS, LIST = 1 << 16, 1 << 14
LONGEST = 4
_WORD = re.compile(r"[a-z0-9_]{3,}")
_PRIME = np.uint32(tx.PRIME)  # products of 32 bits wrap around by themselves

#: Of n-grams of one length: documents' places, places in the alphabet of each gram's code points (a column for each), counts.
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def normalize(t: str) -> str:
    """NFKC, then lower case."""
    return t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).lower()


def parts_of(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts to count together: those in ASCII apart from others, about ``POINTS`` code points at a time."""
    for plain in (True, False):
        some, n = [], 0
        for i, t in enumerate(texts):
            if t and t.isascii() == plain:
                if some and n + len(t) > POINTS:
                    yield some
                    some, n = [], 0
                some.append(i)
                n += len(t)
        if some:
            yield some


def count_grams(texts: list[str]) -> tuple[np.ndarray, list[Counts]]:
    """The code points that occur, and the counts of the n-grams of each length."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(0x110000 if len(points) and points.max() > 127 else 128, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(len(seen), np.uint32)
    number[alphabet] = np.arange(1, len(alphabet) + 1)  # 0 stands beyond the end of a text
    bits = len(alphabet).bit_length()
    lengths = np.array([len(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(points)) + (LONGEST - 1) * doc
    padded = np.zeros(len(points) + (LONGEST - 1) * len(texts), np.uint64)
    padded[place] = number[points]
    if LONGEST * bits + len(texts).bit_length() > 64:
        return alphabet, _by_rank(padded, place, doc, len(alphabet))
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    key = doc.astype(np.uint64)
    for n in range(LONGEST):
        key = key << shift | padded[place + n]
    key.sort()
    out = []
    for n in range(1, LONGEST + 1):
        run = key >> np.uint64((LONGEST - n) * bits)
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        counts = np.diff(np.r_[starts, len(run)])
        run = run[starts]
        whole = (run & mask) != 0
        run, counts = run[whole], counts[whole]
        columns = np.empty((len(run), n), np.uint16)
        for j in range(n):
            columns[:, j] = ((run >> np.uint64((n - 1 - j) * bits)) & mask) - np.uint64(1)
        out.append(((run >> np.uint64(n * bits)).astype(np.int64), columns, counts))
    return alphabet, out


def _by_rank(padded: np.ndarray, place: np.ndarray, doc: np.ndarray, letters: int) -> list[Counts]:
    """Where four code points don't fit one integer: each n-gram is numbered, and so extended."""
    out, known, at = [], doc.astype(np.uint64), place
    for n in range(1, LONGEST + 1):
        inside = padded[at + n - 1] != 0
        at, known, doc = at[inside], known[inside], doc[inside]
        _, first, known, counts = np.unique(known * np.uint64(letters + 1) + padded[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        known = known.astype(np.uint64)
        columns = np.stack([padded[at[first] + j].astype(np.int64) - 1 for j in range(n)], axis=1)
        out.append((doc[first], columns, counts))
    return out


def strings(alphabet: np.ndarray, columns: np.ndarray) -> pa.Array:
    """The n-grams as strings."""
    rows, n = columns.shape
    if not len(alphabet) or alphabet[-1] < 128:
        data = alphabet.astype(np.uint8).take(columns)
        offsets = np.arange(rows + 1, dtype=np.int32) * n
    else:
        encoded = [chr(c).encode("utf-8", "surrogatepass") for c in alphabet]
        used = np.array([len(e) for e in encoded])
        table = np.frombuffer(b"".join(e.ljust(4, b"\0") for e in encoded), np.uint8).reshape(-1, 4)
        widths = used[columns]
        data = table[columns][np.arange(4) < widths[:, :, None]]
        offsets = np.r_[0, np.cumsum(widths.sum(axis=1))].astype(np.int32)
    return pa.StringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _found_words(texts: list[str]) -> tuple[pa.Array, tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Words that occur; documents' places, words' places and counts; the same of pairs of adjacent words."""
    found = [_WORD.findall(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
    word, n = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    single, times = np.unique(doc * n + word, return_counts=True)
    beside = doc[1:] == doc[:-1]
    double, often = np.unique(((doc[:-1] * n + word[:-1]) * n + word[1:])[beside], return_counts=True)
    return coded.dictionary, (single // n, single % n, times), (double // n // n, double // n % n, double % n, often)


def word_counts(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words (``w:``, twice) and pairs of adjacent ones (``wb:``, three times): documents' places, features, counts."""
    words, (doc, word, times), (docs, left, right, often) = _found_words(texts)
    single = pc.binary_join_element_wise("w", words.take(pa.array(word)), ":")
    double = pc.binary_join_element_wise(pc.binary_join_element_wise("wb", words.take(pa.array(left)), ":"), words.take(pa.array(right)), " ")
    places = np.r_[doc, docs]
    order = np.argsort(places, kind="stable")
    return places[order], pa.concat_arrays([single, double]).take(pa.array(order)), np.r_[2 * times, 3 * often][order]


def word_hashes(texts: list[str]) -> list[Counts]:
    """Documents' places, hashes and counts of words, and of pairs of adjacent ones."""
    words, (doc, word, times), (docs, left, right, often) = _found_words(texts)
    every = np.arange(len(words))
    pairs = (extend(hash_start("wb:", len(words)), words, every) ^ np.uint32(ord(" "))) * _PRIME
    return [(doc, extend(hash_start("w:", len(words)), words, every)[word], 2 * times), (docs, extend(pairs[left], words, right), 3 * often)]


def hash_grams(alphabet: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """32-bit FNV-1a over UTF-16 units of n-grams."""
    points = alphabet.astype(np.uint64)
    wide = points > 0xFFFF
    over = np.where(wide, points - np.where(wide, np.uint64(0x10000), np.uint64(0)), np.uint64(0))
    first = np.where(wide, np.uint64(0xD800) + (over >> np.uint64(10)), points).astype(np.uint32)
    second = (np.uint64(0xDC00) + (over & np.uint64(0x3FF))).astype(np.uint32)
    h = np.full(len(columns), tx.SEED, np.uint32)
    for j in range(columns.shape[1]):
        c = columns[:, j]
        h = (h ^ first.take(c)) * _PRIME
        if wide.any():
            h = np.where(wide[c], (h ^ second[c]) * _PRIME, h)
    return h


def hash_start(prefix: str, n: int) -> np.ndarray:
    """``n`` times the 32-bit FNV-1a of a prefix in ASCII."""
    h = tx.SEED
    for c in prefix.encode("ascii"):
        h = (h ^ c) * tx.PRIME & tx.MASK
    return np.full(n, h, np.uint32)


def extend(h: np.ndarray, words: pa.Array, at: np.ndarray) -> np.ndarray:
    """Hashes ``h``, each continued by the word (in ASCII) at its place."""
    lengths = pc.binary_length(words).to_numpy().astype(np.int64)
    data = np.frombuffer("".join(words.to_pylist()).encode("ascii"), np.uint8)
    order = np.argsort(-lengths[at], kind="stable")
    starts, falling = (np.cumsum(lengths) - lengths)[at[order]], -lengths[at[order]]
    h = h[order]
    for j in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(falling, -j))  # those longer than j
        h[:n] = (h[:n] ^ data[starts[:n] + j]) * _PRIME
    out = np.empty_like(h)
    out[order] = h
    return out


def _each_part(rows: DataFrame, key: str, text: str, columns: tuple[str, str, str, str, str, str], part: Callable[[list[str]], Iterator[tuple[np.ndarray, pa.Array, pa.Array]]]) -> DataFrame:
    """``part`` of normalised texts, which gives texts' places in order and two columns, with the texts' keys.
    ``columns``: of each its name, its type in the lists and its type."""
    kind = rows.schema[key].dataType.simpleString()
    one, one_listed, one_kind, two, two_listed, two_kind = columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else normalize(t) for t in batch.column(1).to_pylist()]
            for some in parts_of(texts):
                keys = batch.column(0).take(pa.array(some))
                for places, first, second in part([texts[i] for i in some]):
                    if len(places):
                        starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
                        starts = np.union1d(starts, np.arange(0, len(places), LIST))
                        ends = pa.array(np.r_[starts, len(places)].astype(np.int32))
                        lists = [pa.ListArray.from_arrays(ends, a) for a in (first, second)]
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(places[starts])), *lists], names=[key, "_ones", "_twos"])

    lists = rows.select(key, text).mapInArrow(run, f"{key} {kind}, _ones array<{one_listed}>, _twos array<{two_listed}>")
    apart = lists.select(key, "_twos", F.posexplode("_ones").alias("_at", "_one"))
    return apart.select(key, F.col("_one").cast(one_kind).alias(one), F.get("_twos", F.col("_at")).cast(two_kind).alias(two))


def _once(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key no other row has, and the others, where there are any."""
    again = rows.groupBy(F.col(key).alias("_key")).count().where("count > 1")
    if again.isEmpty():
        return rows, None
    same = F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def _summed(rows: DataFrame, key: str, text: str, name: str, part: Callable) -> DataFrame:
    columns = ("gram", "string", "string", name, "int", "bigint")
    once, more = _once(rows, key)
    out = _each_part(once, key, text, columns, part)
    if more is None:
        return out
    return out.unionByName(_each_part(more, key, text, columns, part).groupBy(key, "gram").agg(F.sum(name).alias(name)))


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
    alphabet, counts = count_grams(texts)
    for places, columns, n in counts:
        yield places, strings(alphabet, columns), pa.array(n.astype(np.int32))


def _features(texts: list[str]) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
    yield from _grams(texts)
    places, grams, n = word_counts(texts)
    yield places, grams, pa.array(n.astype(np.int32))


def ngram_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """How often each n-gram of 1 to 4 code points occurs: ``(key, gram, n)``."""
    return _summed(rows, key, text, "n", _grams)


def features(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Weighted feature counts ``(key, gram, count)``."""
    return _summed(rows, key, text, "count", _features)


def sparse(rows: DataFrame, key: str, text: str, of_features: Callable[[DataFrame, str, int], DataFrame], dim: int = 512, digits: int = 4) -> DataFrame:
    """Bucket weights ``(key, bucket, weight)`` rounded to ``digits``, not yet of unit length; those of documents in
    several rows by ``of_features``."""
    damped = 1 + 0.5 * np.log1p(np.arange(4096))

    def part(texts: list[str]) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
        alphabet, counted = count_grams(texts)
        weights, there = np.zeros(len(texts) * dim), np.zeros(len(texts) * dim, bool)
        for d, h, n in [*((c[0], hash_grams(alphabet, c[1]), c[2]) for c in counted), *word_hashes(texts)]:
            cell = d * dim + h % np.uint32(dim)
            weight = damped.take(n) if n.max(initial=0) < len(damped) else 1 + 0.5 * np.log1p(n)
            weights += np.bincount(cell, weight * (1 - 2 * (h & np.uint32(1)).astype(np.float64)), len(weights))
            there[cell] = True
        there = np.flatnonzero(there)
        # no -0.0, which decimal rounding doesn't give
        yield there // dim, pa.array((there % dim).astype(np.int32)), pa.array(np.round(weights[there], digits) + 0.0)

    once, more = _once(rows, key)
    out = _each_part(once, key, text, ("bucket", "int", "bigint", "weight", "double", "double"), part)
    return out if more is None else out.unionByName(of_features(features(more, key, text), key, dim).withColumn("weight", F.round("weight", digits)))
