"""Applying a feed of inserts, updates and deletes, kept as a log-structured merge table.

Changes arrive repeated and out of order. They are appended as *runs*, each collapsed and sorted by
key and sequence within a fixed number of buckets; a read merges the runs bucket by bucket, where they
lie, and lets tombstones win; compaction replaces many runs by one.

What a run keeps of a key is bounded, whatever the key's share of the feed: of the *lifecycle*
changes (add, remove) and of the *touches* only those at the latest time. Earlier ones can't decide
the state any more, whatever arrives later. All changes tied at that time stay, since a repeat that
arrives later must still be recognised as a repeat of the earlier line. So a hot key shrinks to a
few rows before any exchange by key.

Edge cases. Lines of other versions, other ops, without id or without time are no changes. A null
count is a value like any other. A null line number sorts after all others. An empty table gives an
empty state. Columns other than those named in :func:`normalise_changes` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnesis.workspace import drop_path, list_dirs, make_dir, read_version, replace_table, scratch_path

OPS = ("add", "touch", "remove")
RUN_SCHEMA = "key string, op string, time bigint, count bigint, line bigint, access bigint"
_LAST = 2**63 - 1


def normalise_changes(log: DataFrame) -> DataFrame:
    """Op-log lines ``(v, op, id, item, at, count, line_no)`` as changes
    ``(key, op, time, count, line, access)``.

    ``access`` is the time of access that an add starts with; a touch brings its own time.
    """
    add = F.col("op") == "add"
    return (
        log.where((F.col("v") == 1) & F.col("op").isin(*OPS))
        .select(
            F.when(add, F.col("item.id")).otherwise(F.col("id")).alias("key"),
            F.col("op"),
            F.when(add, F.coalesce("item.created_at", "at")).otherwise(F.col("at")).alias("time"),
            F.when(add, F.col("item.access_count")).when(F.col("op") == "touch", F.col("count")).alias("count"),
            F.coalesce("line_no", F.lit(_LAST)).alias("line"),
            F.when(add, F.col("item.last_access_at")).alias("access"),
        )
        .where(F.col("key").isNotNull() & F.col("time").isNotNull())
    )


def _distinct_changes(changes: DataFrame, *by: str) -> DataFrame:
    """One row for each distinct change, at the smallest of its lines."""
    return (
        changes.groupBy(*by, "key", "op", "time", "count")
        .agg(F.min(F.struct("line", "access")).alias("first"))
        .select(*by, "key", "op", "time", "count", "first.line", "first.access")
    )


def collapse(changes: DataFrame, *by: str) -> DataFrame:
    """Keep of each key (within ``by``) the changes that can still decide its state.

    ``rank() <= 1`` is evaluated before the exchange as well (WindowGroupLimit), so a hot key sends
    only its latest changes of each task.
    """
    lifecycle = F.col("op") != "touch"
    latest = Window.partitionBy(*by, "key", lifecycle).orderBy(F.col("time").desc())
    return (
        _distinct_changes(changes, *by)
        .withColumn("_rank", F.rank().over(latest))
        .where("_rank <= 1")
        .drop("_rank")
    )


def resolve(runs: DataFrame) -> DataFrame:
    """Merge collapsed runs into the rows alive at the end: ``(id, count, at)``.

    Bucketed runs stay where they are: a bucket's files, each in order of key, are merged by one task
    (its sort takes ordered stretches as they come), and both aggregates follow without an exchange.
    """
    at_key = _distinct_changes(runs)
    life = F.max(F.when(F.col("op") != "touch", F.struct("time", "line", "op", "count", "access")))
    touch = F.max(F.when(F.col("op") == "touch", F.struct("time", "line", "count")))
    later = (F.col("touch.time") > F.col("life.time")) | (
        (F.col("touch.time") == F.col("life.time")) & (F.col("touch.line") > F.col("life.line"))
    )
    touched = F.coalesce(later, F.lit(False))

    def pick(new: str, old: str) -> Column:
        return F.when(touched, F.col(new)).otherwise(F.col(old))

    return (
        at_key.groupBy("key")
        .agg(life.alias("life"), touch.alias("touch"))
        .where("life.op = 'add'")
        .select(
            F.col("key").alias("id"),
            pick("touch.count", "life.count").alias("count"),
            pick("touch.time", "life.access").alias("at"),
        )
    )


class ChangeTable:
    """A log-structured merge table of item changes below ``path``.

    A run is a folder ``runs/run=<n>`` with one file a bucket, sorted by key and sequence. What counts is
    the manifest, a small versioned table of live runs that is replaced after the files are complete: a
    run whose writing failed is never read. :meth:`compact` merges all live runs into one (numbered
    below zero) once there are more than ``fan_in``. The merged ones stay for readers that have begun,
    and are removed by the next compaction.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = 8, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "changes")
        self.fan_in = fan_in
        self.name = f"mnesis_changes_{hashlib.md5(self.path.encode()).hexdigest()}"
        kept = read_version(spark, f"{self.path}/buckets", "buckets int").first()
        self.buckets = kept.buckets if kept else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not kept:  # the number of buckets is that of the table for good
            replace_table(spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1), f"{self.path}/buckets")
        make_dir(spark, f"{self.path}/runs")
        # the session's catalog must know the buckets of the files to merge them without an exchange
        spark.sql(
            f"create table if not exists {self.name} ({RUN_SCHEMA}, run bigint) using parquet "
            f"partitioned by (run) clustered by (key) sorted by (key, time, line) into {self.buckets} buckets location '{self.path}/runs'"
        )
        if self.runs():
            spark.sql(f"msck repair table {self.name}")

    def _manifest(self) -> DataFrame:
        return read_version(self.spark, f"{self.path}/manifest", "run bigint, live boolean")

    def _numbers(self, live: bool = True) -> list[int]:
        return sorted(r.run for r in self._manifest().where(F.col("live") == live).collect())

    def _commit(self, live: Iterable[int], dead: Iterable[int]) -> None:
        rows = [(n, True) for n in sorted(live)] + [(n, False) for n in sorted(dead)]
        replace_table(self.spark.createDataFrame(rows, "run bigint, live boolean").coalesce(1), f"{self.path}/manifest")

    def runs(self) -> list[str]:
        """Paths of the live runs."""
        return [f"{self.path}/runs/run={n}" for n in self._numbers()]

    def _written(self) -> set[int]:
        return {int(name.split("=")[1]) for name in list_dirs(self.spark, f"{self.path}/runs") if name.startswith("run=")}

    def _write(self, collapsed: DataFrame) -> None:
        """One exchange by key: a task holds a bucket of every run, and writes a sorted file of each."""
        (
            collapsed.select(*[c.split()[0] for c in RUN_SCHEMA.split(", ")], "run")
            .repartition(self.buckets, "key")
            .write.partitionBy("run")
            .bucketBy(self.buckets, "key")
            .sortBy("key", "time", "line")
            .mode("append")
            .option("path", f"{self.path}/runs")
            .format("parquet")
            .saveAsTable(self.name)
        )

    def append(self, changes: DataFrame, run: Column | int | None = None) -> ChangeTable:
        """Append changes as one more run, or as those that ``run`` numbers, from 0 (a column: several in
        one pass over the feed). A number that is there already gets more files."""
        live, before = self._numbers(), self._written()
        if run is None:
            run = max([*live, *before, -1]) + 1
        named = {run} if isinstance(run, int) else None
        column = F.lit(run) if named else run
        self._write(collapse(changes.withColumn("run", column.cast("bigint")), "run"))
        after = self._written()
        self._commit({*live, *((named & after) if named else after - before - set(live))}, self._numbers(live=False))
        return self

    def merged(self) -> DataFrame:
        """All live runs side by side, not yet merged."""
        return self.spark.table(self.name).where(F.col("run").isin(self._numbers())).drop("run")

    def compact(self, force: bool = False) -> ChangeTable:
        """Replace all runs by one, if there are more than ``fan_in``."""
        live = self._numbers()
        if len(live) > self.fan_in or (force and len(live) > 1):
            number = min([0, *self._written()]) - 1
            dead = self._numbers(live=False)
            self._write(collapse(self.merged()).withColumn("run", F.lit(number).cast("bigint")))
            self._commit([number] if number in self._written() else [], live)
            for n in dead:
                self.spark.sql(f"alter table {self.name} drop if exists partition (run = {n})")
                drop_path(self.spark, f"{self.path}/runs/run={n}")
        return self

    def read(self) -> DataFrame:
        """The rows alive at the end: merge on read, tombstones applied."""
        return resolve(self.merged())


def apply_changes(log: DataFrame, run_lines: int = 250_000, max_runs: int = 64) -> DataFrame:
    """Rebuild the current state ``(id, count, at)`` from a whole feed of op-log lines.

    The feed is appended in runs of ``run_lines`` lines (more where that made over ``max_runs``
    runs), compacted when there are more than eight, and merged on read.
    """
    spark = log.sparkSession
    last = log.agg(F.max("line_no")).first()[0] or 0
    width = max(run_lines, last // max_runs + 1)
    changes = normalise_changes(log)
    run = F.when(F.col("line") == _LAST, F.lit(0)).otherwise(F.floor(F.col("line") / width))
    return ChangeTable(spark).append(changes, run).compact().read()
