import pytest

from mnesis.llm.mixing import Mix, repetition_rates

DOCS, TARGETS = "doc_id bigint, text string, source string, tokens string, copy string", "source string, weight double, max_repeats int"


def test_rates_share_out_what_a_small_source_cannot_fill():
    rates = repetition_rates([("a", 0.5, 1, 1000), ("b", 0.5, 2, 100), ("c", 0.0, 3, 50), ("d", 0.2, 3, 0)], total=600)
    assert rates == {"a": 0.4, "b": 2.0, "c": 0.0, "d": 0.0}
    assert repetition_rates([], 10) == {} and repetition_rates([("a", 1.0, 0, 5), ("b", None, 1, 5)]) == {"a": 1.0, "b": 0.0}


def corpus(spark):
    rows = [(i, "some words in a row " * 5, ["Big", "big ", "SMALL-source", None, "other"][min(i % 40, 4) if i % 40 < 4 else 0], "t", "c") for i in range(4000)]
    return spark.createDataFrame(rows, DOCS)


def test_shares_are_near_the_targets_and_copies_within_the_cap(spark):
    targets = spark.createDataFrame([("big", 0.7, 1), ("small_source", 0.3, 4), ("absent", 0.1, 2)], TARGETS)
    mix = Mix(corpus(spark), targets)
    shares = {r.source: r for r in mix.shares().collect()}
    assert set(shares) == {"big", "small_source", "absent"}
    assert shares["small_source"].emitted_documents == 400 and shares["small_source"].rate == 4.0
    assert shares["absent"].actual_share == 0.0
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1)
    emitted = mix.emit()
    assert emitted.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 4
    assert emitted.columns == ["doc_id", "source", "copy", "text"]
    assert emitted.count() == sum(r.emitted_documents for r in shares.values())
    half = {r.source: r.actual_share for r in Mix(corpus(spark), targets, total=20_000).shares().collect()}
    assert half["big"] == pytest.approx(0.7, abs=0.05)


def test_the_draw_depends_on_the_seed_only(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    ids = [sorted(r.doc_id for r in Mix(corpus(spark), targets, total=20_000, seed=s).emit().collect()) for s in (1, 1, 2)]
    assert ids[0] == ids[1] != ids[2]


def test_edges(spark):
    targets = spark.createDataFrame([("a", 1.0, None), ("A ", None, 2), (None, 1.0, 1), ("b", float("nan"), 1)], TARGETS)
    docs = spark.createDataFrame([(1, None, "a", "t", "c"), (2, " ", "a", "t", "c"), (3, "text", "a", "t", "c"), (3, "text", "a", "t", "c"), (None, "x " * 100_000, "a", "t", "c"), (4, "text", "b", "t", "c")], DOCS)
    assert sorted(str(r.doc_id) for r in Mix(docs, targets).emit().select("doc_id").distinct().collect()) == ["3", "None"]
    empty = Mix(spark.createDataFrame([], DOCS), targets)
    assert empty.emit().collect() == [] and {r.actual_share for r in empty.shares().collect()} == {0.0}
    assert Mix(docs, spark.createDataFrame([], TARGETS)).emit().collect() == []


def test_texts_of_tabs_and_line_ends_have_no_part(spark):
    docs = spark.createDataFrame([(1, "one two", "a"), (2, "\t\n ", "a"), (3, None, "a"), (4, "", "a")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    assert [r.doc_id for r in Mix(docs, targets).emit().collect()] == [1]
