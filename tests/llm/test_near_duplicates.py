import random

import numpy as np
import pytest

from mnesis.llm import near_duplicates as D
from mnesis.llm.words import word_spans, words

SCHEMA = "id string, text string, tags array<string>, class int, words string, n int"


def collection(seed, n=160, vocabulary=300):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            base = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 9)):
                k = rng.randrange(len(base))
                base[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [base[k], rng.choice(vocab)]])
            rng.shuffle(base)
        else:
            base = [vocab[min(int(rng.expovariate(0.03)), vocabulary - 1)] for _ in range(rng.randrange(10, 70))]
        rows.append((f"{i:04d}", " ".join(base), [rng.choice(vocab)] if rng.random() < 0.3 else None, 1, "x", 2))
    return rows


def brute(rows, t=0.7, least=12):
    sets: dict = {}
    for id_, text, tags, *_ in rows:
        if id_ is not None:
            sets.setdefault(id_, set()).update(words(text), *[words(x) for x in tags or []])
    ids = sorted(i for i in sets if len(sets[i]) >= least)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("seed", range(3))
def test_pairs_are_exact(spark, seed):
    rows = collection(seed)
    got = [tuple(r) for r in D.NearDuplicates(spark.createDataFrame(rows, SCHEMA)).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert got


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(5)
    bands = D.Bands(0.7, 12)
    counts = rng.integers(0, 50, D.SLOTS).astype(np.uint32)
    for _ in range(300):
        n = int(rng.integers(12, 90))
        base = rng.integers(-(2**63), 2**63 - 1, n)
        drop = int(rng.integers(0, int(0.3 * n) + 1))
        room = int(np.floor((n - drop) / 0.7 + 1e-9)) - n
        other = np.concatenate([base[drop:], rng.integers(-(2**63), 2**63 - 1, int(rng.integers(0, max(room, 0) + 1)))])
        if len(other) < 12 or len(np.intersect1d(base, other)) < 0.7 * len(np.union1d(base, other)):
            continue
        small, large = sorted([np.unique(base), np.unique(other)], key=len)
        index, _ = D.index_signatures([small], bands)
        probe, _ = D.probe_signatures([large], bands, counts)
        assert set(index.tolist()) & set(probe.tolist())


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**62, 40)) for _ in range(20)]
    sets += [np.setxor1d(s, rng.integers(0, 2**62, 5)) for s in sets]
    low, high = (x.view(np.uint64) for x in D.parity(sets))
    for i in range(len(sets)):
        for j in range(i):
            bits = int(low[i] ^ low[j]).bit_count() + int(high[i] ^ high[j]).bit_count()
            assert bits <= len(np.setxor1d(sets[i], sets[j]))


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    twelve = "a b c d e f g h i j k l"
    rows = [("1", twelve, None, 1, "x", 1), ("1", twelve, None, 1, "x", 1), ("2", twelve.upper(), [None, ""], 1, "x", 1), ("3", "a b c d e f g h i j k", ["L"], None, None, None), ("4", "a b c d e f g h i j k", None, 1, "x", 1), ("5", long, None, 1, "x", 1), ("6", long + " more", [], 1, "x", 1), ("7", None, None, 1, "x", 1), ("8", " ", None, 1, "x", 1), (None, twelve, None, 1, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = D.NearDuplicates(df)
    assert {tuple(r) for r in found.pairs().collect()} == {("1", "2"), ("1", "3"), ("2", "3"), ("5", "6")}
    reps = {r.id: (r.copies, r.links) for r in found.representatives().collect()}
    assert reps == {"1": (3, 0), "2": (3, 0), "3": (3, 0), "5": (1, 1), "6": (1, 1)}
    empty = D.NearDuplicates(spark.createDataFrame([], SCHEMA))
    assert empty.pairs().collect() == [] and empty.representatives().collect() == []


def test_words():
    assert words("ＡＢ_c­D, 中文。٣ x²!") == ["ab", "cd", "中文", "٣", "x2"]
    assert words(None) == [] and words("") == []
    text = "Ｆｏｏ, bar­baz ½ éte"
    assert [w for w, _, _ in word_spans(text)] == words(text)
    assert [text[a:b] for _, a, b in word_spans(text)][:2] == ["Ｆｏｏ", "bar­baz"]
