import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sessions import SCHEMA as EVENTS
from test_sessions import reply, user

from mnesis.config import Config
from mnesis.operators import items, recall
from mnesis.sources import index_files, jsonl
from mnesis.sources.store import MemoryStore
from mnesis.streaming.pipeline import captured_marks, consolidate_stream
from mnesis.workspace import scratch_path

CANDIDATES = "kind string, text string, importance double, tags array<string>, source_seqs array<bigint>"


@pytest.fixture
def store(spark, tmp_path):
    return MemoryStore(spark, "/home/work", Config.of({"storage_root": str(tmp_path), "capture_token_threshold": 5, "max_items": 3, "embed_dim": 64}))


def test_importance_kind_and_tags(spark):
    rows = [(None, None, None), (0.0, "Fact", ["a"] * 13), (-1.0, "task", [None]), (2.0, "raw", []), (float("nan"), "x", ["b"]), (0.7, "summary", ["c"])]
    df = spark.createDataFrame([(str(i), k, "text long enough", t, x) for i, (x, k, t) in enumerate(rows)], "id string, kind string, text string, tags array<string>, importance double")
    got = items.normalize_items(df).orderBy("id").collect()
    assert [r.importance for r in got] == [0.5, 0.5, 0.0, 1.0, 0.5, 0.7]
    assert [r.kind for r in got] == ["fact", "fact", "task", "raw", "fact", "summary"]
    assert [len(r.tags) for r in got] == [0, 12, 1, 0, 1, 1]
    short = df.limit(1).withColumn("text", F.explode(F.array(F.lit("1234567"), F.lit(" 12345678 "), F.lit("😀😀😀😀"), F.lit(None))))
    assert [r.text for r in items.normalize_items(short).collect()] == ["12345678", "😀😀😀😀"]


def test_replay_in_line_order(spark):
    schema = "v int, op string, id string, item struct<id:string,access_count:bigint,last_access_at:bigint>, at bigint, count bigint, line_no bigint"
    rows = [(1, "touch", "a", None, 1, 9, 1), (1, "add", None, ("a", 0, 5), None, None, 2), (1, "touch", "a", None, 7, 1, 3), (2, "remove", "a", None, 8, None, 4), (1, "add", None, ("b", 0, 5), None, None, 5), (1, "remove", "b", None, 6, None, 6), (1, "touch", "b", None, 9, 4, 7), (1, "add", None, ("c", 2, 5), None, None, 8), (1, "remove", "c", None, 6, None, 9), (1, "add", None, ("c", 0, 6), None, None, 10)]
    got = {(r.id, r.last_access_at, r.access_count) for r in items.replay(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", 7, 1), ("c", 6, 0)}


def test_add_is_idempotent_dedupes_and_evicts(spark, store):
    rows = [("fact", "The cache lives in the gateway process", 0.9, ["a"], [0, 1]), ("fact", "The cache lives in the gateway process!", 0.9, [], [5, 6]), ("task", "Write the migration for the ledger", 0.1, [], [2, 3]), ("fact", "tiny", 0.5, [], [4, 4])]
    batch = spark.createDataFrame(rows, CANDIDATES)
    assert store.add(batch, 1000).count() == 2
    assert store.add(batch, 2000).count() == 0
    more = spark.createDataFrame([("decision", w, 0.8, [], [10 + i, 10 + i]) for i, w in enumerate(["Quartz watches drift 15s/month", "BAMBOO -- zoo supply: 900kg"])], CANDIDATES)
    assert store.add(more, 3000).count() == 2
    texts = {r.text for r in store.state().collect()}
    assert len(texts) == 3 and "Write the migration for the ledger" not in texts
    assert store.rebuild_index() == 0


def test_recall_render_and_rehearsal(spark, store):
    texts = ["The deploy key sits in the vault of team red", "Bananas ripen faster in a paper bag", "Unit tests run on every push to main"]
    store.add(spark.createDataFrame([("fact", t, 0.5, [], [i, i]) for i, t in enumerate(texts)], CANDIDATES), 0)
    asked = spark.createDataFrame([("s", "where does the deploy key sit")], "query string, text string")
    hits = store.recall(asked, 86_400_000)
    assert hits.where("rank = 1").first().text == texts[0]
    (r,) = recall.render(hits, 86_400_000).collect()
    assert r.text.splitlines()[0] == recall.HEADER and "| 1.0d old | rehearsed 0×] " + texts[0] in r.text
    once = hits.groupBy("query").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("query").alias("session_id"), F.lit("q").alias("query"), "ids")
    store.rehearse(once.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))), 5)
    assert {r.access_count for r in store.state().collect()} == {1}
    assert store.recall(spark.createDataFrame([], asked.schema), 0).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = []
    for s in range(2):
        for q in range(6):
            text = f"Session {s} message {q} says something quite particular about subject {s * 31 + q}"
            rows.append(("w", f"s{s}", q, "user/message" if q % 2 == 0 else "assistant/message", user(text) if q % 2 == 0 else reply(text), None, None))
        rows.append(("w", f"s{s}", 6, "turn/end", None, None, None))
    events = spark.createDataFrame(rows, EVENTS)
    config = {"capture_token_threshold": 5, "capture_mode": "raw", "embed_dim": 64, "dedupe_similarity": 0.999}
    batch = MemoryStore(spark, "b", Config.of(config | {"storage_root": str(tmp_path / "b")}))
    batch.consolidate(events, 1)
    source = str(tmp_path / "events")
    for s in range(2):
        events.where(F.col("session_id") == f"s{s}").coalesce(1).write.mode("append").parquet(source)
    stream = MemoryStore(spark, "b", Config.of(config | {"storage_root": str(tmp_path / "s")}))
    read = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    consolidate_stream(read, stream, str(tmp_path / "check"), clock=lambda b: 1).awaitTermination()
    assert {tuple(r) for r in stream.state().select("id", "text").collect()} == {tuple(r) for r in batch.state().select("id", "text").collect()}
    assert batch.state().count() > 0
    assert {tuple(r) for r in stream.captured().select("session_id", "last_captured_seq").collect()} == {(f"s{s}", 5) for s in range(2)}
    q = captured_marks(read).writeStream.format("memory").queryName("marks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.last_seq for r in spark.table("marks").collect()} == {6}


def test_jsonl(spark, tmp_path):
    path = tmp_path / "items.jsonl"
    path.write_text('{"v": 1, "op": "add"}\n\n  {"v": 1, "op": "touch"}  \n{broken\nnull\n[1]\n{"v": 2}\n')
    got = jsonl.read_jsonl(spark, str(path), "v int, op string").orderBy("line_no").collect()
    assert [(r.v, r.op, r.line_no) for r in got] == [(1, "add", 1), (1, "touch", 3), (2, None, 7)]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), "v int").count() == 0
    meta = tmp_path / "meta.json"
    assert jsonl.read_json(spark, str(meta), "v int", {"v": 0}) == {"v": 0}
    meta.write_text("{oops")
    assert jsonl.read_json(spark, str(meta), "v int", {"v": 0}) == {"v": 0}
    meta.write_text('{"v": 3}')
    assert jsonl.read_json(spark, str(meta), "v int") == {"v": 3}


def test_index_files(spark, tmp_path):
    rows = [("a", [1.0, 2.0]), ("b", [0.5, -1.0]), ("c", None)]
    index_files.write_index(spark.createDataFrame(rows, "id string, vector array<float>"), str(tmp_path), 2)
    assert {(r.id, tuple(r.vector)) for r in index_files.read_index(spark, str(tmp_path), 2).collect()} == {("a", (1.0, 2.0)), ("b", (0.5, -1.0))}
    assert index_files.read_index(spark, str(tmp_path), 3) is None
    assert index_files.read_index(spark, scratch_path(spark, "none"), 2) is None
    (tmp_path / "index.bin").write_bytes(np.zeros(3, "<f4").tobytes())
    assert index_files.read_index(spark, str(tmp_path), 2) is None
    (tmp_path / "index.json").write_text(json.dumps({"v": 2, "dim": 2, "ids": []}))
    assert index_files.read_index(spark, str(tmp_path), 2) is None


def test_config():
    assert Config.of({"top_k": 20}).candidates == 80 and Config().candidates == 32
    with pytest.raises(ValueError):
        Config.of({"nope": 1})
    assert math.isclose(Config().min_similarity, 0.24)
