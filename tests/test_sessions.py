from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnesis.config import Config
from mnesis.operators import extract, session

DATA = "struct<role:string,content:array<struct<type:string,text:string>>,source:struct<kind:string>,message:struct<role:string,content:array<struct<type:string,text:string>>>,target:string,inserted:array<struct<role:string,content:array<struct<type:string,text:string>>,source:struct<kind:string>>>>"
SCHEMA = f"workspace string, session_id string, seq bigint, type string, data {DATA}, ts timestamp, ingested_at timestamp"


def user(text, role="user", kind=None):
    return (role, [("text", text)], (kind,) if kind else None, None, None, None)


def reply(text):
    return (None, None, None, ("assistant", [("text", text)]), None, None)


def log(spark, rows):
    return session.session_log(spark.createDataFrame([("w", s, q, t, d, None, None) for s, q, t, d in rows], SCHEMA))


def test_span_keeps_the_tail_within_the_budget(spark):
    rows = [("s", 0, "user/message", user("a" * 20)), ("s", 1, "assistant/message", reply("b" * 10)), ("s", 2, "user/message", user("")), ("s", 3, "user/message", user("x", kind="plugin")), ("s", 4, "assistant/message", reply("")), ("big", 0, "user/message", user("c" * 100)), (None, 1, "user/message", user("x")), ("s", None, "user/message", user("x"))]
    surface = session.surface_events(log(spark, rows))
    assert {(r.session_id, r.seq, r.role) for r in surface.collect()} == {("s", 0, "user"), ("s", 1, "assistant"), ("s", 2, "user"), ("big", 0, "user")}
    # 8 for the empty message and 18 for the reply fit exactly; the first message does not; "big" has no span
    (r,) = session.collect_spans(surface, 26).collect()
    assert (r.first_seq, r.last_seq, r.text) == (1, 2, "[assistant @seq 1] " + "b" * 10 + "\n\n[user @seq 2] ")
    (whole,) = session.collect_spans(surface, 54).collect()
    assert whole.first_seq == 0
    assert session.collect_spans(session.surface_events(log(spark, []))).count() == 0


def test_progress_never_steps_back(spark):
    rows = spark.createDataFrame([("s", 5, 10), ("s", 5, 8), ("s", 3, 99), ("t", 1, None), (None, 9, 9)], "session_id string, last_captured_seq bigint, at bigint")
    assert {tuple(r) for r in session.capture_progress(rows).collect()} == {("s", 5, 8), ("t", 1, None)}


@pytest.mark.parametrize(("length", "chunks"), [(0, 0), (31, 0), (32, 1), (700, 1), (701, 2), (1280, 2), (1281, 3)])
def test_chunk_counts(spark, length, chunks):
    assert session.raw_chunks(spark.createDataFrame([("x" * length,)], "text string")).count() == chunks


def test_chunk_overlap_and_trim(spark):
    text = "".join(chr(97 + i % 26) for i in range(1300))
    got = [r.chunk for r in session.raw_chunks(spark.createDataFrame([(text,)], "text string")).orderBy("chunk_no").collect()]
    assert got == [text[0:700], text[580:1280], text[1160:]]
    assert session.raw_chunks(spark.createDataFrame([(" " * 40,), (None,)], "text string")).count() == 0


def test_cue_is_the_latest_of_inbox_and_message(spark):
    spliced = (None, None, None, None, "next-turn", [("user", [("text", " one ")], ("plugin",)), ("user", [("text", "two")], None), ("system", [("text", "no")], None)])
    rows = [("s", 0, "user/message", user("zero")), ("s", 1, "agent/inbox/spliced", spliced), ("t", 0, "user/message", user("x")), ("u", 0, "user/message", user("y" * 1300))]
    got = {r.session_id: r.query for r in session.query_cues(log(spark, rows)).collect()}
    assert got == {"s": "two", "u": "y" * 1200}


@pytest.mark.parametrize(
    ("answer", "texts"),
    [
        ('[{"text": "long enough text"}]', ["long enough text"]),
        ('```json\n[{"text": "long enough text"}]\n```', ["long enough text"]),
        ('Sure: [{"text": "long enough text"}] done', ["long enough text"]),
        ('{"text": "long enough text"}', None),
        ('[{"text": "long enough', None),
        ("[]", []),
        ('[{"text": "short"}, 7, null, {"text": "  long enough text "}]', ["long enough text"]),
        ("nothing", None),
        (None, None),
    ],
)
def test_extraction(spark, answer, texts):
    (r,) = spark.createDataFrame([(answer,)], "a string").select(extract.parse_extraction(F.col("a")).alias("c")).collect()
    assert (r.c if r.c is None else [c.text for c in r.c]) == texts


def test_extraction_defaults_and_limit(spark):
    many = "[" + ",".join('{"text": "entry number %d"}' % i for i in range(61)) + "]"
    odd = '[{"text": "long enough", "importance": "0.7", "kind": "task", "tags": ["a"]}, {"text": "long enough", "importance": "abc"}]'
    a, b = [r.c for r in spark.createDataFrame([(1, many), (2, odd)], "i int, a string").orderBy("i").select(extract.parse_extraction(F.col("a")).alias("c")).collect()]
    assert len(a) == 60 and a[0].kind == "fact" and a[0].importance == 0.5 and a[0].tags == []
    assert [(c.kind, c.importance, c.tags) for c in b] == [("task", 0.7, ["a"]), ("fact", 0.5, [])]


def test_extract_falls_back_to_raw(spark):
    spans = spark.createDataFrame([("s", 0, 1, "x" * 50), ("t", 0, 1, "fail" * 20)], "session_id string, first_seq bigint, last_seq bigint, text string")

    def model(text):
        if text.startswith("fail"):
            raise RuntimeError
        return '[{"text": "a memory worth keeping", "kind": "decision"}]'

    assert {(r.session_id, r.kind) for r in extract.extract(spans, model).collect()} == {("s", "decision"), ("t", "raw")}


def test_registered_spans_have_the_production_budget(spark, sf):
    """Sessions that fit in the default budget are kept whole, and only long spans are triggered."""
    config, queries = Config(), entry.queries()
    surface = session.surface_events(session.session_log(spark.read.parquet(f"{sf}/session_events.parquet"))).collect()
    size, events = Counter(), Counter()
    for r in surface:
        size[r.session_id] += len(r.text.encode("utf-16-le")) // 2 + session.EVENT_COST
        events[r.session_id] += 1
    whole = {s: n for s, n in events.items() if size[s] <= config.max_span_chars}
    assert any(size[s] > 2000 for s in whole)
    got = {r.session_id: r.events for r in queries["span_collect"](spark, sf).collect()}
    assert {s: got.get(s) for s in whole} == whole
    assert all(r.forced or r.tokens >= config.capture_token_threshold for r in queries["consolidation_trigger"](spark, sf).collect())
