import numpy as np
import pytest
from pyspark.sql import functions as F

from mnesis.llm import personal as P

CASES = [
    ("mail: karin_b @ ledger.test today", "email", "karin_b @ ledger.test"),
    ("write to aisha AT mail DOT shard DOT test and wait", "email", "aisha AT mail DOT shard DOT test"),
    ("login tilda_k (at) eu (dot) labs (dot) invalid.", "email", "tilda_k (at) eu (dot) labs (dot) invalid"),
    ("oyorvamin[at]mail.boldra.invalid, she said", "email", "oyorvamin[at]mail.boldra.invalid"),
    ("under <mailto:yuki@a.example>", "email", "yuki@a.example"),
    ("call (434) 555-0173 now", "phone", "(434) 555-0173"),
    ("the number is +44 (0)20 7946 0678.", "phone", "+44 (0)20 7946 0678"),
    ("Handy: 030/23125-305 und mehr", "phone", "030/23125-305"),
    ("电话+86 100 0000 2413；", "phone", "+86 100 0000 2413"),
    ("-- 07700 900 492", "phone", "07700 900 492"),
    ("her social is = 914.22.5868, cc", "id_number", "914.22.5868"),
    ("NINO QQ 33 46 44 C.", "id_number", "QQ 33 46 44 C"),
    ("passport no.: X93282382 (from", "id_number", "X93282382"),
    ("Ausweis: LJXH9HNR9 und", "id_number", "LJXH9HNR9"),
    ("身份证号：994407198809229578，", "id_number", "994407198809229578"),
    ("lives at 76 Ergwyn Lane, Unit 18", "address", "76 Ergwyn Lane"),
    ("visit Apt 9, 172 Velvam Lane.", "address", "Apt 9, 172 Velvam Lane."),
    ("ship it to P.O. Box 8177, Ethulm", "address", "P.O. Box 8177"),
    ("Anschrift: Am Vorpraplatz 132, Falzel", "address", "Am Vorpraplatz 132"),
    ("the parcel goes to 128 rue de Korarnquo;", "address", "128 rue de Korarnquo"),
    ("住在棠岚市桐翊路103号。", "address", "棠岚市桐翊路103号"),
    ("I spoke to Tomas Cinwynin, who owns it", "name", "Tomas Cinwynin"),
    ("cc I.L. Caldovin.", "name", "I.L. Caldovin"),
    ("Dr. Calzelow, Pavel.", "name", "Calzelow, Pavel"),
    ("reviewer: PETRA ERGXANSKY, then", "name", "PETRA ERGXANSKY"),
    ("联系人是淳于芷霁。", "name", "淳于芷霁"),
]
DECOYS = [
    "Build 6868-8184-54 failed at offset 8821673560.",
    "Set the page size to 258 989 6390 bytes in total.",
    "Timestamp 1742332961584 precedes 2025-07-05T10:30:00Z in the dump.",
    "The listener binds 203.0.113.132:19280 since v2.14.",
    "The remote is git@zangrifal.invalid:arnwyn/cluster.git and stays as it is.",
    "Ticket MEM-80771 covers the Kelsil Street module.",
    "The Ethtor Vorcal release adds a retry to cinsildov/fixture_handler.json.",
    "Pinned @minwes/journal@1.8.5 in the lock file.",
    "The prompt showed deploy@ubriostbol-03:~$ for a while.",
    "Trace 495a6127-03be-4204-a4d6-5b13b5686717 ends there.",
    "Lane 1 of Zelzel Bridge handles 205 items.",
]


@pytest.fixture(scope="module")
def model(spark, sf):
    items = spark.read.parquet(sf.replace("0.001", "0.01") + "/memory_item.parquet")
    return P.train(P._candidate_table(items))


def spans(model, text):
    own = P.candidates(text)
    return [(P.TYPES[c.type], text[c.start : c.end]) for c, _ in P.choose(own, [model.probability(P.features(text, c)) for c in own])]


@pytest.mark.parametrize(("text", "kind", "value"), CASES)
def test_pieces_are_found_whole(model, text, kind, value):
    assert (kind, value) in spans(model, text)


@pytest.mark.parametrize("text", DECOYS)
def test_identifiers_of_machines_are_not_personal(model, text):
    assert spans(model, text) == []


def test_votes_are_weighed_by_reliability():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.6
    reliability = [0.95, 0.9, 0.6, 0.5]
    counts: dict = {}
    for t in truth:
        vote = tuple(int(np.where(rng.random() < r, 1 if t else -1, -1 if t else 1)) for r in reliability)
        counts[vote] = counts.get(vote, 0) + 1
    p = P.aggregate_votes(counts)
    assert p[1, 1, -1, -1] > 0.9 and p[-1, -1, 1, 1] < 0.1


def test_table_edges(spark):
    schema = "workspace string, id string, text string, probability string, type string"
    rows = [("w", "a", "mail: yuki@a.example", "x", "y")] * 2 + [("w", None, "mail: yuki@a.example", None, None), ("w", "b", None, None, None), ("w", "c", " ", None, None), ("w", "d", "word " * 50_000 + "call (434) 555-0173 now", None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.id, r.pii_type, r.start_pos) for r in P.find_personal(df).collect()}
    assert got == {("a", "email", 6), ("d", "phone", 250_005)}
    assert P.find_personal(spark.createDataFrame([], schema)).collect() == []
    assert P.redact(spark.createDataFrame([], schema)).collect() == []


def test_redaction_keeps_the_rest(spark, model):
    df = spark.createDataFrame([(1, "ask Tomas Cinwynin (tomas@a.example) soon", "k"), (2, None, "k"), (3, "plain", "k")], "n int, text string, extra string")
    assert [tuple(r) for r in P.redact(df, model).orderBy("n").collect()] == [(1, "ask [NAME] ([EMAIL]) soon", "k"), (2, None, "k"), (3, "plain", "k")]


def test_positions_count_code_points(spark, model):
    text = "🧠🧠 cc Ivo Arnivard."
    assert [c.start for c in P.candidates(text)] == [6]
    assert spark.createDataFrame([(text,)], "text string").select(F.substring("text", 7, 3)).first()[0] == "Ivo"


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("I spoke to the team. Sarah Miller asked about it", "Sarah Miller"),
        ("cc Jean-Pierre Dupont.", "Jean-Pierre Dupont"),
        ("Dr. Quillby, Zorvan.", "Quillby, Zorvan"),
        ("owner: XYLA ERGXANSKY.", "XYLA ERGXANSKY"),
        ("今天联系人王小明，已经回电", "王小明"),
        ("请李明女士回电", "李明"),
    ],
)
def test_names_outside_the_tables_are_found(model, text, name):
    assert ("name", name) in spans(model, text)


def test_unknown_capitalised_names_are_put_to_the_vote(model):
    text = "Then Zorvan Quillby, who owns it, met Frau Hugo Brihuxin."
    assert {text[c.start : c.end] for c in P.candidates(text) if c.type == 4} >= {"Zorvan Quillby", "Hugo Brihuxin"}
    assert spans(model, "这是方法。高性能缓存") == []


@pytest.mark.parametrize("text", ["Reisepass 123456789", "ID number 12 345 678 901", "ni number 123456789", "id card 123456789", "identity 123456789"])
def test_every_cue_of_an_identifier_reaches_its_patterns(text):
    assert any(c.type == 2 for c in P.candidates(text))


@pytest.fixture(scope="module")
def informed(spark, sf):
    """A model that also knows which words the corpus has in lower case."""
    items = spark.read.parquet(sf.replace("0.001", "0.01") + "/memory_item.parquet")
    common = P.common_words(items)
    return P.train(P._candidate_table(items, common), common)


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("Please thank Ngozi Okafor and Priyanka Raghunathan", "name", "Ngozi Okafor"),
        ("Please thank Ngozi Okafor and Priyanka Raghunathan", "name", "Priyanka Raghunathan"),
        ("Svetlana Kuznetsova reviewed the index code", "name", "Svetlana Kuznetsova"),
        ("We met Zorvan Quillby yesterday at the office", "name", "Zorvan Quillby"),
        ("王伟昨天提交了补丁", "name", "王伟"),
        ("张小明说接口有问题", "name", "张小明"),
        ("I live at Avenida Paulista 1578, come by", "address", "Avenida Paulista 1578"),
        ("see 12 Rue de Rivoli, Paris", "address", "12 Rue de Rivoli"),
    ],
)
def test_texts_unlike_the_tables(informed, text, kind, value):
    assert (kind, value) in [(P.TYPES[c.type], text[c.start : c.end]) for c, _ in informed.find(text)]


@pytest.mark.parametrize("text", ["第五章讲的是缓存", "东方的服务器", "百里之外的机房", "周一提交补丁", "马上说明", "The Memory Store keeps rows", "Redis Cluster was slow", "The Ethtor Vorcal release adds a retry", "routed via 12 hops"])
def test_ordinary_words_are_no_names(informed, text):
    assert informed.find(text) == []


def test_the_classifier_sees_no_votes_and_silence_of_a_list_means_nothing():
    c = P.Candidate(4, 4, 16, (1, 0, 1, 0, 0, 0, 1))
    a, b = P.features("cc: Ngozi Okafor.", c), P.features("cc: Ngozi Okafor.", c._replace(votes=(-1,) * 7))
    assert a[0] != b[0] and a[1:] == b[1:]
    counts = {(1, 1, 1): 500.0, (1, 0, 1): 5.0, (-1, 0, -1): 500.0}
    assert P.aggregate_votes(counts, silent=(1,))[1, 0, 1] > 0.9


def test_slots_are_those_of_the_built_in_hash(spark):
    row = spark.createDataFrame([("naïve",)], "w string").select(F.pmod(F.xxhash64("w"), F.lit(P.SLOTS)).alias("s")).first()
    assert row.s == P.slot("naïve")
