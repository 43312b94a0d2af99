import pytest
from pyspark.sql import functions as F

from mnesis.functions import text as tx


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_hash_has_the_published_values(spark):
    got = column(spark, ["a", "foobar", "é", "中", "", "😀", None], tx.fnv1a)
    h = tx.SEED
    for unit in (0xD83D, 0xDE00):
        h = (h ^ unit) * tx.PRIME & tx.MASK
    assert got == [0xE40C292C, 0xBF9CF968, 1812687940, 677484088, tx.SEED, h, None]


def test_tokens_at_the_edges_of_the_cjk_range(spark):
    texts = ["⺀", "⺁", "鿾", "鿿", "　", "각", "😀", "\t ﻿", "", "abcd", "中中"]
    assert column(spark, texts, tx.estimate_tokens) == [1, 1, 1, 1, 1, 1, 1, 0, 0, 1, 2]


def test_lengths_and_slices_count_utf16_units(spark):
    assert column(spark, ["a😀b", "", "é"], tx.utf16_length) == [4, 0, 1]
    assert column(spark, ["a😀b", "😀😀"], lambda c: tx.utf16_slice(c, 0, 3)) == ["a😀", "😀😀"]


def test_trim_knows_every_white_space(spark):
    assert column(spark, ["﻿　 a b \n", None, " "], tx.trim) == ["a b", None, ""]


@pytest.mark.parametrize(("path", "slug"), [("/", "----"), ("/a//b c", "--a-b-c--"), ("/工作", "----"), ("clean", "--clean--"), ("/Users/x y/é", "--Users-x-y--")])
def test_slug(spark, path, slug):
    assert column(spark, [path], tx.slugify) == [slug]


def test_words_and_grams(spark):
    assert column(spark, ["ab abc d_e fgh", ""], tx.word_tokens) == [["abc", "d_e", "fgh"], []]
    assert column(spark, [["a", "b", "c"], ["a"], []], tx.word_bigrams, "array<string>") == [["a b", "b c"], [], []]
    assert column(spark, ["abc", ""], tx.char_ngrams) == [["a", "b", "c", "ab", "bc", "abc"], []]


def test_normalize(spark):
    assert column(spark, ["ＡＢ①", "Ab", None], tx.normalize_text) == ["ab1", "ab", None]
