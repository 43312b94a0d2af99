"""The store at its cap, over several workspaces, between readers and writers, and with routed models."""

import pytest
from pyspark.sql import functions as F
from test_sessions import SCHEMA as EVENTS
from test_sessions import reply, user

from mnesis.config import Config
from mnesis.operators import extract, session
from mnesis.sources import jsonl
from mnesis.sources.store import MemoryStore
from mnesis.workspace import claim, live_versions, release, scratch_path

CANDIDATES = "workspace string, session_id string, kind string, text string, importance double, tags array<string>, source_seqs array<bigint>"
FIRST = ["Alpha cache keys rotate nightly", "Alpha cache keys rotate at noon", "Alpha cache keys rotate weekly"]
SECOND = ["Bananas ripen in paper bags", "Quartz watches drift 15s a month", "Tides follow the moon by an hour"]


@pytest.fixture
def store(spark):
    return MemoryStore(spark, config=Config.of({"storage_root": scratch_path(spark, "m"), "max_items": 3, "embed_dim": 64, "dedupe_similarity": 0.999}))


def batch(spark, texts, workspace="w", importance=0.5, start=0):
    return spark.createDataFrame([(workspace, "s", "fact", t, importance, [], [start + i, start + i]) for i, t in enumerate(texts)], CANDIDATES)


def test_recall_searches_living_items_only_and_the_cap_is_kept(spark, store):
    assert store.add(batch(spark, FIRST, importance=0.1), 0).count() == 3
    # the newer ones push all the older ones out, whose vectors are nearest to the query
    assert store.add(batch(spark, SECOND, importance=0.9, start=10), 1).count() == 3
    assert {r.text for r in store.state().collect()} == set(SECOND)
    assert store.vectors().count() == 3
    hits = store.recall(spark.createDataFrame([("q", "w", "Alpha cache keys rotate"), ("other", "x", "Alpha cache keys")], "query string, workspace string, text string"), 2)
    assert {r.text for r in hits.where("query = 'q'").collect()} == set(SECOND)
    assert hits.where("query = 'other'").count() == 0
    # what was pushed out can be learnt again, and another workspace has a cap of its own
    again = batch(spark, FIRST[:1], importance=1.0).unionByName(batch(spark, FIRST, workspace="x"))
    assert {(r.workspace, r.text) for r in store.add(again, 3).collect()} == {("w", FIRST[0]), *(("x", t) for t in FIRST)}
    assert {(r.workspace, r["count"]) for r in store.state().groupBy("workspace").count().collect()} == {("w", 3), ("x", 3)}
    # compaction changes nothing that is read
    before = {tuple(r) for r in store.state().select("id", "text", "access_count").collect()}
    store.compact(force=True)
    assert {tuple(r) for r in store.state().select("id", "text", "access_count").collect()} == before
    assert len(live_versions(spark, f"{store.root}/ops")) == len(live_versions(spark, f"{store.root}/vectors")) == 1
    assert {(r["workspace"], r["items"], r["vectors"]) for r in store.stats().collect()} == {("w", 3, 3), ("x", 3, 3)}


def test_a_batch_beyond_the_cap_leaves_what_adding_one_by_one_would(spark, store):
    words = ["amber", "bishop", "candle", "dolphin", "ember", "falcon", "granite", "harbor"]
    weights = [0.9, 0.2, 0.8, 0.3, 0.7, 0.4, 0.6, 0.1]
    rows = [("w", "s", "fact", f"{w} {w[::-1]} notes", x, [], [i, i]) for i, (w, x) in enumerate(zip(words, weights))]
    alive: list = []
    for row in rows:
        if len(alive) >= 3:
            alive.remove(min(alive, key=lambda r: r[4]))
        alive.append(row)
    new = store.add(spark.createDataFrame(rows, CANDIDATES), 5)
    assert {r.text for r in new.collect()} == {r.text for r in store.state().collect()} == {r[3] for r in alive}
    assert store.size() == 3


def test_one_consolidation_at_a_time_and_none_when_disabled(spark, store):
    events = spark.createDataFrame([("w", "s", 0, "user/message", user("x" * 40), None, None), ("w", "s", 1, "compaction/start", None, None, None)], EVENTS)
    assert claim(spark, f"{store.root}/consolidating") and not claim(spark, f"{store.root}/consolidating")
    assert store.consolidate(events, 0).count() == 0 and store.captured().count() == 0
    release(spark, f"{store.root}/consolidating")
    off = MemoryStore(spark, config=Config.of({"storage_root": store.config.storage_root, "enabled": False, "embed_dim": 64}))
    assert off.consolidate(events, 0).count() == 0
    assert store.consolidate(events, 0).count() == 1
    assert store.captured().count() == 1


def test_context_recalls_from_the_sessions_workspace_and_rehearses_once(spark, store):
    store.add(batch(spark, ["The deploy key sits in the vault"]).unionByName(batch(spark, ["Nothing here about keys at all"], workspace="x")), 0)
    rows = [("w", "s", 0, "user/message", user("where is the deploy key"), None, None), ("x", "t", 0, "user/message", user("where is the deploy key"), None, None), ("y", "u", 0, "user/message", user("where is the deploy key"), None, None)]
    shown = store.context(session.session_log(spark.createDataFrame(rows, EVENTS)), 86_400_000)
    got = {r.session_id: r for r in shown.collect()}
    assert set(got) == {"s", "t"} and "vault" in got["s"].text and "Nothing" in got["t"].text
    assert got["s"].order == 140 and got["s"].name
    store.rehearse(shown, 1)
    # after a restart the same recall is still known
    MemoryStore(spark, config=store.config).rehearse(shown, 2)
    assert {(r.access_count, r.last_access_at) for r in store.state().collect()} == {(1, 1)}


def test_models_are_routed_and_streams_assembled(spark):
    header = spark.createDataFrame([("a", "p", "m"), ("b", "p", ""), ("c", None, None)], "session_id string, provider string, model string")
    agents = spark.createDataFrame([("a", "q", "n"), ("b", "q", "n")], "session_id string, provider string, model string")
    routes = extract.route_models(header, agents)
    assert {tuple(r) for r in routes.collect()} == {("a", "p/m"), ("b", "q/n"), ("c", None)}
    assert {tuple(r) for r in extract.route_models(header).collect()} == {("a", "p/m"), ("b", None), ("c", None)}
    delta = lambda i, t: {"type": "text-delta", "index": i, "text": t}
    assert extract.assemble_answer([delta(1, "[{"), delta(0, "z"), delta(1, "}]"), {"type": "finish", "reason": "length"}]) == ("[{}]z", True)

    def streamed(text, max_tokens):
        yield {"type": "text-delta", "index": 0, "text": '[{"text": "kept at %d tokens"}]' % max_tokens}
        yield {"type": "finish", "reason": "length"}

    def broken(text):
        raise RuntimeError

    spans = spark.createDataFrame([(s, 0, 1, s * 40) for s in "abc"], "session_id string, first_seq bigint, last_seq bigint, text string").join(routes, "session_id")
    asked = extract.answers(spans, {"p/m": streamed, "q/n": broken}, max_tokens=7)
    assert {(r.session_id, r.status) for r in asked.collect()} == {("a", "truncated"), ("b", "failed"), ("c", "unrouted")}
    found = extract.extract(spans, {"p/m": streamed, "q/n": broken}, max_tokens=7)
    assert {(r.session_id, r.kind, r.text) for r in found.collect()} == {("a", "fact", "kept at 7 tokens"), ("b", "raw", "b" * 40), ("c", "raw", "c" * 40)}


def test_the_head_of_a_span_is_carried_on_request(spark):
    surface = spark.createDataFrame([("s", i, "user", f"{i}" * 12) for i in range(9)], "session_id string, seq bigint, role string, text string")
    assert [(r.first_seq, r.last_seq) for r in session.collect_spans(surface, 60).collect()] == [(6, 8)]
    assert sorted((r.first_seq, r.last_seq) for r in session.all_spans(surface, 60).collect()) == [(0, 2), (3, 5), (6, 8)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text("".join('{"v": %d}\n' % i if i % 7 else "\n" for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = jsonl.read_jsonl(spark, str(path), "v int")
        assert got.where(F.col("v") != F.col("line_no")).count() == 0 and got.count() == 3000 - 3000 // 7
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
