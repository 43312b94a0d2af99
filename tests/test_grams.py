"""Features counted where the documents lie: without an exchange, the same for repeated keys and for any alphabet."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_documents import features, fnv, grams, weights

import __spark_entry__ as entry
from mnesis.functions import embed
from mnesis.functions import grams as G

#: More code points than 16 bits can number, so that four don't fit one integer.
MANY = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 20_000)) + "".join(chr(c) for c in range(0x20000, 0x20000 + 42_000)) + "".join(chr(c) for c in range(0xAC00, 0xAC00 + 11_000))
ROWS = [(1, "ab ab word_1 word_1"), (1, "word_1 ＡＢ 😀"), (None, "abc é"), (None, "abcd"), (2, None), (3, ""), (4, "x" * 300 + " " + "long_word" * 40), (5, "中文 测试 word word two")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string")


def by_key(of, together=Counter):
    out = {}
    for k in {k for k, _ in ROWS}:
        total = together()
        for i, t in ROWS:
            if i == k and t is not None:
                total.update(of(t))
        out |= {(k, g): n for g, n in total.items()}
    return out


def moves_grams(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and ("gram" in line or "bucket" in line)]


def test_ngrams(spark, sf, rows):
    got = G.ngram_counts(rows, "doc_id", "text").collect()
    assert len(got) == len(by_key(grams)) and {(r.doc_id, r.gram): r.n for r in got} == by_key(grams)
    assert not moves_grams(spark, sf, "documents_ngrams")


def test_features(spark, sf, rows):
    got = G.features(rows, "doc_id", "text").collect()
    assert len(got) == len(by_key(features)) and {(r.doc_id, r.gram): r["count"] for r in got} == by_key(features)
    assert not moves_grams(spark, sf, "documents_features")


def test_sparse(spark, sf, rows):
    want = {(r.doc_id, r.bucket): r.weight for r in embed.sparse(embed.features(rows, "doc_id", "text"), "doc_id").collect()}
    got = {(r.doc_id, r.bucket): r.weight for r in G.sparse(rows, "doc_id", "text", embed.sparse).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=5.1e-5) for k in want)
    assert {b: got[5, b] for k, b in got if k == 5} == {b: round(w, 4) for b, w in weights(ROWS[-1][1]).items()}
    assert not moves_grams(spark, sf, "documents_sparse")


@pytest.mark.parametrize("texts", [["abab", "b", "cabab"], ["é😀é😀a", "aé"], [MANY + MANY[:9]]])
def test_counts_and_hashes_of_any_alphabet(texts):
    alphabet, counted = G.count_grams(texts)
    got, hashes = {}, {}
    for places, columns, n in counted:
        names = G.strings(alphabet, columns).to_pylist()
        got |= dict(zip(zip(places.tolist(), names), n.tolist()))
        hashes |= dict(zip(names, G.hash_grams(alphabet, columns).tolist()))
    assert got == {(i, t[a : a + n]): c for i, t in enumerate(texts) for (a, n), c in first_places(t)}
    assert all(h == fnv(g) for g, h in list(hashes.items())[:5000])
    words = ["w:abc", "wb:abc abcdef", "w:" + "x" * 90]
    got = G.extend(G.hash_start("wb:", 4), pa.array(words), np.array([2, 0, 1, 0]))
    assert got.tolist() == [fnv("wb:" + words[i]) for i in (2, 0, 1, 0)] and not len(G.extend(G.hash_start("w:", 0), pa.array([], pa.string()), np.zeros(0, int)))


def first_places(t):
    counts = Counter(t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1))
    return [((t.index(g), len(g)), c) for g, c in counts.items()] if len(t) < 100 else [((i, n), counts[t[i : i + n]]) for n in range(1, 5) for i in range(len(t) - n + 1)]


def test_parts_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(G, "POINTS", 5)
    texts = ["abc", None, "é", "", "abcdefgh", "ab", "éé", "x"]
    parts = list(G.parts_of(texts))
    assert sorted(i for p in parts for i in p) == [i for i, t in enumerate(texts) if t]
    assert all(len({texts[i].isascii() for i in p}) == 1 for p in parts)
    assert np.array_equal([len(p) == 1 or sum(len(texts[i]) for i in p) <= 5 for p in parts], [True] * len(parts))
