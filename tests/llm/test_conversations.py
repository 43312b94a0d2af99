import pytest
from pyspark.sql import functions as F

from mnesis.llm import conversations as C

CONTENT = "array<struct<type:string,text:string>>"
DATA = f"struct<role:string,content:{CONTENT},source:struct<kind:string>,message:struct<role:string,content:{CONTENT}>>"
SCHEMA = f"workspace string, session_id string, seq bigint, type string, data {DATA}, ts timestamp, ingested_at timestamp, block string, event string"


def row(session, seq, type_, text="x", role="user", kind=None, ts=None):
    blocks = None if text is None else [("text", text)]
    data = None
    if type_ == "user/message":
        data = (role, blocks, (kind,) if kind else None, None)
    elif type_ in ("assistant/message", "tool/result"):
        data = (None, None, None, (role, blocks))
    return ("w", session, seq, type_, data, ts, None, "b", "e")


U, A, T, END = "user/message", "assistant/message", "tool/result", "turn/end"


def run(spark, tmp_path, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.hash("seq", "session_id") % 1_000_000))
    path = str(tmp_path / "events.parquet")
    df.repartition(3).write.mode("overwrite").parquet(path)
    return sorted((r.session_id, r.pos, r.seq, r.role) for r in C.rebuild(spark, path, **options).collect())


def test_whole_sessions_only(spark, tmp_path):
    rows = [row("ok", 0, U), row("ok", 1, T), row("ok", 2, A), row("ok", 3, END), row("ok", 3, END)]
    rows += [row("gap", 0, U), row("gap", 2, A)]
    rows += [row("late start", 1, U), row("late start", 2, A)]
    rows += [row("contradiction", 0, U), row("contradiction", 0, U, "y"), row("contradiction", 1, A)]
    rows += [row("unanswered", 0, U), row("unanswered", 1, A), row("unanswered", 2, U)]
    rows += [row("twice asked", 0, U), row("twice asked", 1, T), row("twice asked", 2, U), row("twice asked", 3, A)]
    rows += [row("assistant first", 0, A), row("assistant first", 1, U), row("assistant first", 2, A)]
    rows += [row("empty", 0, END), row("blank", 0, U, " \n　"), row("blank", 1, A, None)]
    rows += [row("plugin", 0, U, kind="plugin"), row("plugin", 1, A)]
    rows += [row("blank between", 0, U), row("blank between", 1, A, ""), row("blank between", 2, A), row("blank between", 3, U, role="system")]
    rows += [row(None, 0, U), row("ok", None, A)]
    assert run(spark, tmp_path, rows) == [
        ("blank between", 0, 0, "user"),
        ("blank between", 1, 2, "assistant"),
        ("ok", 0, 0, "user"),
        ("ok", 1, 1, "tool"),
        ("ok", 2, 2, "assistant"),
    ]


@pytest.mark.parametrize("broken", [False, True])
def test_an_endless_session_spreads_over_blocks(spark, tmp_path, monkeypatch, broken):
    monkeypatch.setattr(C, "BLOCK_BITS", 3)
    rows = [row("s", i, [U, T, A][i % 3]) for i in range(99)]
    if broken:  # the answer of the last question before a block's edge is missing
        rows[23] = row("s", 23, END)
    got = run(spark, tmp_path, rows, idle="1 hour")
    assert got == ([] if broken else [("s", i, i, ["user", "tool", "assistant"][i % 3]) for i in range(99)])


def test_null_fields_do_not_look_alike(spark, tmp_path):
    a, b = row("s", 0, U), list(row("s", 0, U))
    b[4] = ("user", [("text", "x"), (None, None)], None, None)
    assert run(spark, tmp_path, [a, tuple(b), row("s", 1, A)]) == []


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def stored(spark, path, rows, day):
    """One more file of events, of a day."""
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.lit(day * 86_400) + F.col("seq")))
    df.coalesce(1).write.mode("append").parquet(path)


def test_many_batches_give_what_one_gives(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    for i in range(4):  # each session's rows are spread over all files
        stored(spark, path, [row(f"s{k}", q, U if q % 2 == 0 else A) for k in range(3) for q in range(8) if (q + k) % 4 == i], 1)
    want = sorted((f"s{k}", q, q, "user" if q % 2 == 0 else "assistant") for k in range(3) for q in range(8))
    assert sorted(map(tuple, C.rebuild(spark, path, max_files=1).collect())) == want
    assert sorted(map(tuple, C.rebuild(spark, path).collect())) == want


def test_late_rows_are_buffered_within_lateness_and_refused_beyond(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    for day, seq in ((40, 1), (41, 2), (42, 3), (39, 0), (43, 4), (44, 5)):
        stored(spark, path, [row("s", seq, U if seq % 2 == 0 else A)], day)
    got = C.rebuild(spark, path, lateness="5 days", idle="3 days", max_files=1)
    assert sorted(r.seq for r in got.collect()) == [0, 1, 2, 3, 4, 5]
    # the drop is seen although later batches push it out of the progress that is usually kept
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        with pytest.raises(ValueError, match="came later than 1 hour"):
            C.rebuild(spark, path, lateness="1 hour", idle="1 hour", max_files=1)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)


def test_sessions_are_emitted_at_timeout_and_again_when_reopened(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    stored(spark, path, [row("s", 0, U), row("s", 1, A)], 1)
    stored(spark, path, [row("clock", 0, U)], 40)
    stream = C.Rebuilder(spark, spark.readStream.schema(SCHEMA).parquet(path), lateness="30 days", idle="1 hour", folder=str(tmp_path / "work"))

    def take():
        for start in (stream.start_fragments, stream.start_sessions):
            start().awaitTermination()
        return sorted(tuple(r) for r in stream.emitted().collect() if r.session_id == "s")

    take()
    stored(spark, path, [row("clock", 1, U)], 80)
    assert take() == [("s", 0, 0, "user"), ("s", 1, 1, "assistant")]  # closed by its timeout, with no end of the stream
    stored(spark, path, [row("s", 2, U)], 81)
    stored(spark, path, [row("clock", 2, U)], 120)
    take()
    stored(spark, path, [row("clock", 3, U)], 160)
    assert take() == []  # reopened by a question without an answer


def test_no_window_holds_messages(spark):
    fragments = spark.createDataFrame([], "session_id string, block bigint, events array<struct<seq:bigint,print:bigint,role:string>>")
    plan = C.assemble(fragments)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan
    for line in plan.splitlines():
        if "Window [" in line:
            assert "messages#" not in line or "sum(messages#" in line
    below = [line for line in plan.splitlines() if "Project" in line and "filter(" in line]
    assert below  # messages are made, but joined after the windows
