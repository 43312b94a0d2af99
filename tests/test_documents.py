"""The text queries over whole documents, against brute force in Python."""

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from mnesis.functions import text as tx

EDGES = [None, "", " ", "ab", "ＡＢ① Über ﬁne_x", "😀 word 😀😀 word_2", "e\u0301a\u0308 中文 测试 ΑΣ", "/Users//x y/é", "long wörd 中 " * 800]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("documents"))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(1_000_000 + i, t) for i, t in enumerate(EDGES)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return path, rows


def fnv(word):
    raw, h = word.encode("utf-16-le"), tx.SEED
    for i in range(0, len(raw), 2):
        h = (h ^ (raw[i] | raw[i + 1] << 8)) * tx.PRIME & tx.MASK
    return h


def normal(t):
    return unicodedata.normalize("NFKC", t).lower()


def words(t):
    return re.findall("[a-z0-9_]{3,}", normal(t))


def grams(t):
    t = normal(t)
    return Counter(t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1))


def pairs(t):
    w = words(t)
    return Counter(f"{a} {b}" for a, b in zip(w, w[1:]))


def features(t):
    out = grams(t)
    for w in words(t):
        out["w:" + w] += 2
    for p, n in pairs(t).items():
        out["wb:" + p] += 3 * n
    return out


def weights(t):
    out = {}
    for g, n in features(t).items():
        h = fnv(g)
        out[h % 512] = out.get(h % 512, 0.0) + (-1 if h % 2 else 1) * (1 + 0.5 * math.log1p(n))
    return out


def rows_of(spark, folder, name):
    return [tuple(r) for r in entry.queries()[name](spark, folder[0]).collect()]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("documents_normalized", normal),
        ("documents_words", words),
        ("documents_slug", lambda t: "--" + re.sub("^-|-$", "", re.sub("-+", "-", re.sub("[^A-Za-z0-9._-]", "-", t))) + "--"),
    ],
)
def test_one_row_for_each_document(spark, folder, name, want):
    assert dict(rows_of(spark, folder, name)) == {i: None if t is None else want(t) for i, t in folder[1]}


@pytest.mark.parametrize(("name", "want"), [("documents_bigrams", pairs), ("documents_ngrams", grams), ("documents_features", features)])
def test_counts(spark, folder, name, want):
    assert {(i, g): n for i, g, n in rows_of(spark, folder, name)} == {(i, g): n for i, t in folder[1] if t is not None for g, n in want(t).items()}


def test_hashes_of_all_words(spark, folder):
    every = {w for _, t in folder[1] if t is not None for w in t.split(" ")}
    assert set(rows_of(spark, folder, "documents_fnv1a")) == {(w, fnv(w), fnv(w) % 512) for w in every}
    assert dict(rows_of(spark, folder, "documents_sign")) == {w: -1 if fnv(w + "|") % 2 else 1 for w in every}


def test_weights_and_similar_documents(spark, folder):
    want = {i: weights(t) for i, t in folder[1] if t is not None}
    got = {(i, b): w for i, b, w in rows_of(spark, folder, "documents_sparse")}
    assert got.keys() == {(i, b) for i, w in want.items() for b in w}
    assert all(abs(v - want[i][b]) < 1e-4 for (i, b), v in got.items())
    ids = [i for i, _ in folder[1]]
    x = np.array([[want.get(i, {}).get(b, 0.0) for b in range(512)] for i in ids])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    s = (x / np.where(norm > 0, norm, 1)) @ (x / np.where(norm > 0, norm, 1)).T
    np.fill_diagonal(s, -9)
    found = {(q, r): (i, v) for q, i, v, r in rows_of(spark, folder, "documents_similar")}
    assert found.keys() == {(q, r) for q in ids if q % 20 == 0 for r in range(1, 6)}
    for (q, r), (i, v) in found.items():
        row = s[ids.index(q)]
        assert abs(v - np.sort(row)[-r]) < 2e-4 and abs(v - row[ids.index(i)]) < 2e-4
