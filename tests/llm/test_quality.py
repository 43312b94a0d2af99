import numpy as np
import pytest

from mnesis.llm import quality as Q
from mnesis.llm.boosting import BoostedTrees

PROSE = "On the second attempt, the old schema was warm and the new one is cold. We looked at it again after lunch, and nobody objected to the plan."
EXAMPLES = [
    (PROSE, "prose"),
    ("# A heading\n\n" + PROSE.replace(" ", "\n", 6), "prose"),
    ("A: " + PROSE + "\nB: " + PROSE.replace("second", "third"), "prose"),
    ("这次发布之后,定时器变成了脆弱的定时器,大家都觉得可以接受。昨天的问题出在这里。", "prose"),
    (PROSE + "\n- one\n- two", "prose"),
    ("\n".join(f"- entry {i}" for i in range(9)), "list"),
    ("\n".join(f"{i}. slow cache" for i in range(9)), "list"),
    (", ".join(f"fast cache {i}" for i in range(30)), "list"),
    ("\n".join(f"[x] done item {i}" for i in range(9)), "list"),
    ("| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {i * 7} |" for i in range(9)), "table"),
    ("a,b,c\n" + "\n".join(f"{i},x{i},-" for i in range(9)), "table"),
    ("\n".join(f"a={i} b=x c=" for i in range(9)), "table"),
    ("a\tb\tc\n" * 9, "table"),
    ("<tr><td>a</td><td>b</td></tr>\n" * 9, "table"),
    ("Menu | Next | Login | Search | Next | Help | Top", "junk"),
    ("\n".join(f"    at a.b (c/d.js:{i}:7)" for i in range(9)), "junk"),
    (" ".join("The importer was trimmed by the end of it"), "junk"),
    ((PROSE[:72] + "\n") * 20, "junk"),
    ("#|.~>>&*#/>*!@~- +\\*_^.|?  ^?/$@ -@/<*/+~\\.+#_-!_=#=*", "junk"),
    (PROSE.replace("o", "ö").encode().decode("latin-1").replace("Ã", "Ã¤Ã¤Ã¤"), "junk"),
    ("xvq brtk plmw qzx jkrt vbnm wrtp zxcv lkjh gfds " * 4, "junk"),
]


@pytest.mark.parametrize(("text", "form"), EXAMPLES)
def test_weak_labels(text, form):
    values, weak = Q.statistics(text)
    assert len(values) == len(Q.STATISTICS) and np.isfinite(values).all()
    assert Q.FORMS[weak] == form


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 5))
    x[::50, 3] = np.nan
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] * x[:, 2] > 0.3)
    model = BoostedTrees(4).fit(x[:1000], y[:1000])
    p = model.probabilities(x[1000:])
    assert (p.argmax(axis=1) == y[1000:]).mean() > 0.85 and np.allclose(p.sum(axis=1), 1)
    flipped = np.where(rng.random(250) < 0.3, rng.integers(0, 4, 250), y[1000:1250])
    before = -np.log(model.probabilities(x[1000:1250])[np.arange(250), flipped]).mean()
    model.calibrate(x[1000:1250], flipped)
    assert -np.log(model.probabilities(x[1000:1250])[np.arange(250), flipped]).mean() < before
    assert model.calibrate(x[:0], y[:0]) is model


def test_agreement_with_hand_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/doc_labels.parquet")
    forms = Q.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    both = labels.where("form is not null").withColumnRenamed("form", "hand").join(forms, "doc_id").collect()
    assert np.mean([r.hand == r.form for r in both]) > 0.85  # annotators err too


def test_edges(spark):
    schema = "doc_id bigint, text string, weak string, chars string"
    rows = [(1, PROSE, "x", "y"), (1, PROSE, "x", "y"), (2, None, "x", "y"), (3, " \n", "x", "y"), (None, "- a\n- b\n- c", "x", "y"), (4, "word and the other " * 60_000, "x", "y"), (5, "a,b,c\n1,2,3\n4,5,6", "x", "y")]
    docs = spark.createDataFrame(rows, schema)
    stats = Q.document_statistics(docs)
    assert stats.count() == 7 and stats.where("chars is null").count() == 2
    labels = "doc_id bigint, form string, annotator string"
    some = spark.createDataFrame([(1, " Prose", "a"), (1, "prose", "b"), (5, "nonsense", "a"), (5, None, "a"), (None, "list", "a")], labels)
    for hand in (some, spark.createDataFrame([], labels), None):
        assert Q.classify(docs, hand).count() == 5
    assert Q.classify(spark.createDataFrame([], schema), some).collect() == []
    assert Q.classify(docs.where("text is null"), some).collect() == []


def test_trees_learn_the_forms_without_what_the_labels_are_made_of(spark, sf):
    assert not Q.LABEL_PARTS & set(Q.FEATURES) and Q.LABEL_PARTS < set(Q.STATISTICS)
    folder = sf.replace("0.001", "0.01")
    stats = Q.document_statistics(spark.read.parquet(f"{folder}/documents.parquet")).cache()
    labels = spark.read.parquet(f"{folder}/doc_labels.parquet")
    halves = [set(r.doc_id for r in Q.hand_checked(stats, labels).where(f"half = {h}").select("doc_id").collect()) for h in (0, 1)]
    assert halves[0] and halves[1] and not halves[0] & halves[1]
    # out of sample: trees of even documents on odd ones
    model = Q.train(stats.where("doc_id % 2 = 0"), None)
    odd = stats.where("doc_id % 2 = 1 and weak >= 0").toPandas()
    agree = model.raw(odd[Q.FEATURES].to_numpy(dtype=float)).argmax(axis=1) == odd["weak"].to_numpy()
    assert agree.mean() > 0.97
    got = Q.report(stats, labels)
    assert got["calibrated"] >= got["rule"] - 0.05 and got["documents"] == len(halves[1])
