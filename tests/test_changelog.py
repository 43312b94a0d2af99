import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnesis.operators.changelog import ChangeTable, apply_changes, normalise_changes
from mnesis.workspace import scratch_path

SCHEMA = "line_no bigint, v int, op string, id string, item struct<id:string,access_count:bigint,last_access_at:bigint,created_at:bigint>, at bigint, count bigint, key string, first string"


def expected(rows):
    changes = {}
    for line, v, op, id_, item, at, count, *_ in rows:
        if v != 1 or op not in ("add", "touch", "remove"):
            continue
        key = (item[0] if item else None) if op == "add" else id_
        time = (item[3] if item and item[3] is not None else at) if op == "add" else at
        if key is None or time is None:
            continue
        c = item[1] if op == "add" else count if op == "touch" else None
        access = item[2] if op == "add" else None
        old = changes.get((op, key, time, c))
        if old is None or line < old[0]:
            changes[op, key, time, c] = (line, access)
    by = defaultdict(list)
    for (op, key, time, c), (line, access) in changes.items():
        by[key].append((time, line, op, c, access))
    out = set()
    for key, own in by.items():
        state = None
        for time, _, op, c, access in sorted(own, key=lambda x: x[:2]):
            if op == "add":
                state = (c, access)
            elif op == "touch":
                state = (c, time) if state else None
            else:
                state = None
        if state:
            out.add((key, *state))
    return out


def feed(rng, n):
    rows = []
    for line in range(1, n + 1):
        op = rng.choice(["add", "touch", "touch", "touch", "remove", "expire", None])
        id_ = rng.choice(["a", "b", "c", None])
        time = rng.choice([1, 2, 3, 4, 5, None])
        item = (id_, rng.randrange(3), rng.randrange(9), time) if op == "add" else None
        rows.append((line, rng.choice([1, 1, 1, 2]), op, None if op == "add" else id_, item, time, rng.choice([0, 1, 2, None]), "x", "y"))
    return rows + rng.sample(rows, n // 5)


def state(df):
    return {(r.id, r["count"], r["at"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_state_is_that_of_the_definition(spark, seed):
    rows = feed(random.Random(seed), 60)
    log = spark.createDataFrame(rows, SCHEMA)
    assert state(apply_changes(log)) == expected(rows)
    assert state(apply_changes(log, run_lines=7, max_runs=100)) == expected(rows)


def test_runs_compaction_and_late_repeats_change_nothing(spark):
    rng = random.Random(9)
    rows = feed(rng, 80)
    rng.shuffle(rows)
    table = ChangeTable(spark, scratch_path(spark, "t"), fan_in=2)
    for i in range(0, len(rows), 25):
        table.append(normalise_changes(spark.createDataFrame(rows[i : i + 25], SCHEMA)), run=i)
        assert state(table.read()) == expected(rows[: i + 25])
        table.compact(force=True)
    assert len(table.runs()) == 1
    assert state(table.read()) == expected(rows)


def test_a_hot_key_is_small_in_its_run(spark):
    rows = [(i, 1, "touch", "hot", None, i, i, None, None) for i in range(1, 400)] + [(400, 1, "add", None, ("hot", 1, 1, 0), None, None, None, None)]
    table = ChangeTable(spark).append(normalise_changes(spark.createDataFrame(rows, SCHEMA)))
    assert table.merged().count() == 2
    assert state(table.read()) == {("hot", 399, 399)}


def test_empty_table_and_rows_without_anything(spark):
    assert apply_changes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert apply_changes(spark.createDataFrame([(None,) * 9, (None, 1, "add", None, ("k", None, None, 3), None, None, None, None)], SCHEMA)).collect() == [("k", None, None)]
    assert ChangeTable(spark).read().count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_order_of_arrival_of_the_same_lines_is_irrelevant(spark, seed):
    rng = random.Random(seed)
    rows = feed(rng, 25)
    mixed = rows[:]
    rng.shuffle(mixed)
    assert state(apply_changes(spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(1)))) == expected(mixed)


def test_runs_number_themselves_compact_and_leave_replaced_files_to_readers(spark):
    rows = feed(random.Random(3), 90)
    path = scratch_path(spark, "t")
    table = ChangeTable(spark, path, fan_in=4)
    for i in range(0, len(rows), 12):
        table.append(normalise_changes(spark.createDataFrame(rows[i : i + 12], SCHEMA)))
        begun = table.read()
        table.compact()
        assert len(table.runs()) <= 4
        assert state(begun) == state(table.read()) == expected(rows[: i + 12])
    assert any("run=-" in r for r in table.runs())
    # another object over the same folder, and files of an append that never was committed
    again = ChangeTable(spark, path)
    again._write(again.merged().limit(1).withColumn("key", F.lit("ghost")).withColumn("run", F.lit(999).cast("bigint")))
    assert state(again.read()) == expected(rows)
    assert again.buckets == table.buckets


def test_a_read_moves_nothing_between_tasks(spark):
    table = ChangeTable(spark).append(normalise_changes(spark.createDataFrame(feed(random.Random(5), 60), SCHEMA)))
    assert "Exchange" not in table.read()._jdf.queryExecution().executedPlan().toString()
