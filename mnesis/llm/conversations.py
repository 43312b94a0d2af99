"""Rebuilding whole conversations from message rows with keyed streaming state.

Two streams, each with keyed state in event-time session windows:

* *Fragments.* The first is keyed by session and *seq block* (2 ** ``BLOCK_BITS`` consecutive sequence
  numbers), so an endless session spreads over many keys and the state of one key is bounded. Rows are
  buffered in the state of the key's window; once the watermark passes the idle timeout, the window
  closes and its fragment is emitted.
* *Sessions.* The second is keyed by session and fed with the closing times of fragments. When a
  session closes or times out, it is validated, and a whole one emits its messages. A row that comes
  after its session was closed opens it again: the session is then validated over all its fragments
  once more and emitted as a later *revision*, which replaces the earlier one.

A session is validated from one summary a block, folded in two levels (blocks to groups of 2 **
``GROUP_BITS``, groups to the session), so no window holds messages and none holds more than a group's
or a session's groups' summaries. Messages are joined back by session and block.

The watermark drops rows that are later than ``lateness``. A run in which that happened is refused
with an error instead of giving a result with holes; raise ``lateness`` then.

Edge cases. Rows without session_id or seq don't count. Repeated rows that agree in type and data
are one event; rows of a seq that disagree break their session. A missing ``ts`` falls back to
``ingested_at``, then to the epoch. Null or blank content is no message but holds its place in the
sequence. Columns not named here are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mnesis.workspace import exists, make_dir, scratch_path

#: A key of the state holds 2 ** BLOCK_BITS sequence numbers.
BLOCK_BITS = 10
#: A group of the summaries has 2 ** GROUP_BITS blocks.
GROUP_BITS = 10
#: State on disk, not in the executors' heaps, and every batch's count of late rows kept.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.numRecentProgressUpdates": "1000000",
}
#: White space of Unicode, for a Java regular expression.
NOT_BLANK = r"[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def has_text(blocks: Column) -> Column:
    """Whether the text blocks, joined by a space, are more than white space."""
    return F.coalesce(F.exists(blocks, lambda b: F.coalesce(b["text"].rlike(NOT_BLANK), F.lit(False))), F.lit(False))


def message_role(type_: Column, data: Column) -> Column:
    """``u``, ``a`` or ``t`` for a message of the user, the assistant or a tool; else null."""
    human = (data["role"] == "user") & F.coalesce(data["source"]["kind"] != "plugin", F.lit(True))
    return (
        F.when((type_ == "user/message") & human & has_text(data["content"]), F.lit("u"))
        .when((type_ == "assistant/message") & has_text(data["message"]["content"]), F.lit("a"))
        .when((type_ == "tool/result") & has_text(data["message"]["content"]), F.lit("t"))
    )


def keyed_events(events: DataFrame) -> DataFrame:
    """The few columns that the state holds: no text, but a fingerprint of type and data."""
    return events.where("session_id is not null and seq is not null").select(
        "session_id",
        F.shiftright("seq", BLOCK_BITS).alias("block"),
        F.struct(
            "seq",
            F.xxhash64(F.col("type"), F.to_json("data", {"ignoreNullFields": "false"})).alias("print"),
            message_role(F.col("type"), F.col("data")).alias("role"),
        ).alias("event"),
        # a watermark starts at the epoch, so what is dated before it is dated there
        F.greatest(F.coalesce("ts", "ingested_at", F.timestamp_seconds(F.lit(0))), F.timestamp_seconds(F.lit(0))).alias("event_time"),
    )


def fragment_stream(events: DataFrame, lateness: str = "30 days", idle: str = "7 days") -> DataFrame:
    """Streaming ``events`` to closed fragments ``(session_id, block, events, closed)``.

    State is kept for each (session, block) and idle window, and given up at its timeout.
    """
    return (
        events.withWatermark("event_time", lateness)
        .groupBy("session_id", "block", F.session_window("event_time", idle))
        .agg(F.collect_set("event").alias("events"))
        .select("session_id", "block", "events", F.col("session_window.end").alias("closed"))
    )


def closing_sessions(fragments: DataFrame, idle: str = "7 days") -> DataFrame:
    """Streaming fragments to the sessions that close: ``(session_id, fragments)``.

    Fragments come in order of their closing time, up to the order within a batch, so none is late.
    """
    return (
        fragments.select("session_id", "closed")
        .withWatermark("closed", "0 seconds")
        .groupBy("session_id", F.session_window("closed", idle))
        .agg(F.count("*").alias("fragments"))
        .select("session_id", "fragments")
    )


def merged_blocks(fragments: DataFrame) -> DataFrame:
    """Fragments of one block as one, in order: ``(session_id, block, n, seqs, first_seq, last_seq, messages)``."""
    merged = (
        fragments.groupBy("session_id", "block")
        .agg(F.flatten(F.collect_list("events")).alias("events"))
        .select("session_id", "block", F.array_sort(F.array_distinct("events")).alias("events"))
    )
    return merged.select(
        "session_id",
        "block",
        F.size("events").cast("bigint").alias("n"),
        F.size(F.array_distinct(F.transform("events", lambda e: e["seq"]))).cast("bigint").alias("seqs"),
        F.element_at("events", 1)["seq"].alias("first_seq"),
        F.element_at("events", -1)["seq"].alias("last_seq"),
        F.filter("events", lambda e: e["role"].isNotNull()).alias("messages"),
    )


def summaries(blocks: DataFrame) -> DataFrame:
    """What validation needs of each block: counts, its first role, its first and last turn (u or a), and
    whether a user's turn in it is followed by another."""
    turns = F.array_join(F.transform(F.filter("messages", lambda e: e["role"] != "t"), lambda e: e["role"]), "")
    kept = blocks.withColumn("turns", turns)
    return kept.select(
        "session_id",
        "block",
        "n",
        "seqs",
        "first_seq",
        "last_seq",
        F.size("messages").cast("bigint").alias("messages"),
        F.get("messages", 0)["role"].alias("first_role"),
        F.nullif(F.left("turns", F.lit(1)), F.lit("")).alias("first_turn"),
        F.nullif(F.right("turns", F.lit(1)), F.lit("")).alias("last_turn"),
        F.col("turns").contains("uu").alias("unanswered"),
    )


def _fold(parts: DataFrame, by: list[str], at: str) -> tuple[DataFrame, DataFrame]:
    """Parts with the messages before each within its group (``before``), and the groups' summaries."""
    earlier = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.select(
        "*",
        F.coalesce(F.sum("messages").over(earlier), F.lit(0)).alias("before"),
        # the last turn of the parts before; a user's turn must be answered before the next one
        F.last("last_turn", True).over(earlier).alias("open"),
    )
    crossed = F.coalesce((F.col("open") == "u") & (F.col("first_turn") == "u"), F.lit(False))
    groups = placed.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("n", "seqs", "messages")],
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in ("first_role", "first_turn")],
        F.max_by("last_turn", F.when(F.col("last_turn").isNotNull(), F.col(at))).alias("last_turn"),
        F.max(F.col("unanswered") | crossed).alias("unanswered"),
    )
    return placed.select(*by, at, "before"), groups


def validate(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From block summaries: ``(session_id, whole)``, and ``(session_id, block, base)`` with the number of
    the session's messages before each block."""
    grouped = parts.withColumn("group", F.shiftright("block", GROUP_BITS))
    blocks, groups = _fold(grouped, ["session_id", "group"], "block")
    places, sessions = _fold(groups, ["session_id"], "group")
    whole = (
        (F.col("n") == F.col("seqs"))
        & (F.col("first_seq") == 0)
        & (F.col("last_seq") + 1 == F.col("seqs"))
        & (F.col("first_role") == "u")
        & (F.col("last_turn") == "a")
        & ~F.col("unanswered")
    )
    bases = blocks.join(places.withColumnRenamed("before", "start"), ["session_id", "group"]).select("session_id", "block", (F.col("start") + F.col("before")).alias("base"))
    return sessions.select("session_id", F.coalesce(whole, F.lit(False)).alias("whole")), bases


def assemble(fragments: DataFrame) -> DataFrame:
    """Merge fragments, validate sessions and number the messages of the whole ones:
    ``(session_id, pos, seq, role)``."""
    blocks = merged_blocks(fragments)
    verdicts, bases = validate(summaries(blocks))
    return _messages(blocks, verdicts, bases)


def _messages(blocks: DataFrame, verdicts: DataFrame, bases: DataFrame) -> DataFrame:
    whole = bases.join(verdicts.where("whole").select("session_id"), "session_id", "left_semi")
    names = F.create_map(*[F.lit(x) for x in ("u", "user", "a", "assistant", "t", "tool")])
    return (
        blocks.select("session_id", "block", "messages")
        .join(whole, ["session_id", "block"])
        .select("session_id", "base", F.posexplode("messages").alias("i", "m"))
        .select("session_id", (F.col("base") + F.col("i")).alias("pos"), F.col("m.seq").alias("seq"), names[F.col("m.role")].alias("role"))
    )


MESSAGES = "session_id string, pos bigint, seq bigint, role string, revision bigint"


class Rebuilder:
    """The two streams over one folder of the shared file system."""

    def __init__(self, spark: SparkSession, events: DataFrame, lateness: str = "30 days", idle: str = "7 days", folder: str | None = None):
        self.spark, self.lateness, self.idle = spark, lateness, idle
        self.folder = folder or scratch_path(spark, "conversations")
        self.keyed = keyed_events(events)
        self.fragment_schema = T.StructType().add("session_id", "string").add("block", "long").add("events", T.ArrayType(self.keyed.schema["event"].dataType)).add("closed", "timestamp")
        for name in ("fragments", "ends/events", "ends/fragments"):
            make_dir(spark, f"{self.folder}/{name}")

    def _ended(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` and the end mark of their stream, once there is one."""
        return rows.unionByName(self.spark.readStream.schema(rows.schema).parquet(f"{self.folder}/ends/{name}"))

    def start_fragments(self, **trigger) -> StreamingQuery:
        fragments = fragment_stream(self._ended(self.keyed, "events"), self.lateness, self.idle)
        return (
            fragments.writeStream.format("parquet")
            .option("checkpointLocation", f"{self.folder}/state/fragments")
            .outputMode("append")
            .trigger(**(trigger or {"availableNow": True}))
            .start(f"{self.folder}/fragments")
        )

    def fragments(self) -> DataFrame:
        return self.spark.read.schema(self.fragment_schema).parquet(f"{self.folder}/fragments")

    def start_sessions(self, **trigger) -> StreamingQuery:
        source = self.spark.readStream.schema(self.fragment_schema).parquet(f"{self.folder}/fragments")
        closing = closing_sessions(self._ended(source.select("session_id", "closed"), "fragments"), self.idle)

        def emit(batch: DataFrame, revision: int) -> None:
            closed = batch.select("session_id").distinct()
            fragments = self.fragments()
            # narrow rows find the blocks; then one exchange by session and block serves all that follows
            wanted = fragments.select("session_id", "block").distinct().join(closed, "session_id", "left_semi")
            blocks = merged_blocks(fragments.join(wanted, ["session_id", "block"], "left_semi"))
            verdicts, bases = validate(summaries(blocks))
            # a session that isn't whole is marked, so that it replaces what was emitted of it before
            marks = verdicts.where("not whole").select("session_id", *[F.lit(None).cast(t).alias(c) for c, t in (("pos", "bigint"), ("seq", "bigint"), ("role", "string"))])
            # a batch that is run again writes the same folder again
            _messages(blocks, verdicts, bases).unionByName(marks).write.mode("overwrite").parquet(f"{self.folder}/messages/revision={revision}")

        return closing.writeStream.foreachBatch(emit).option("checkpointLocation", f"{self.folder}/state/sessions").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()

    def emitted(self) -> DataFrame:
        """Messages of whole conversations as last emitted: ``(session_id, pos, seq, role)``."""
        if not exists(self.spark, f"{self.folder}/messages"):
            return self.spark.createDataFrame([], MESSAGES).drop("revision")
        messages = self.spark.read.schema(MESSAGES).parquet(f"{self.folder}/messages")
        revisions = messages.groupBy("session_id").agg(F.min("revision").alias("first"), F.max("revision").alias("last"))
        again = revisions.where("first < last").select("session_id", "last")
        old = (messages["session_id"] == again["session_id"]) & (messages["revision"] < again["last"])
        return messages.join(again, old, "left_anti").where("role is not null").select("session_id", "pos", "seq", "role")

    def _end(self, name: str, schema: T.StructType, time: str) -> None:
        """A row far in the future, after all others, which moves the watermark past every window."""
        far = F.lit(datetime.datetime(9000, 1, 1)).cast("timestamp")
        row = [(far if f.name == time else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
        self.spark.range(1).select(*row).write.mode("append").parquet(f"{self.folder}/ends/{name}")

    def _run(self, start: Callable[[], StreamingQuery]) -> None:
        """Run a stream over what is there, and refuse it where it dropped rows as too late."""
        before = {k: self.spark.conf.get(k, None) for k in SETTINGS}
        for k, v in SETTINGS.items():
            self.spark.conf.set(k, v)
        try:
            query = start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        late = sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
        if late:
            raise ValueError(f"{late} rows came later than {self.lateness}; raise lateness")

    def to_end(self, one_batch: bool = False) -> DataFrame:
        """Take all that is there, end both streams, and return what was emitted. The end mark may come
        with the rows where these are one batch."""
        if not one_batch:
            self._run(self.start_fragments)
        self._end("events", self.keyed.schema, "event_time")
        self._run(self.start_fragments)
        self._end("fragments", T.StructType([self.fragment_schema["session_id"], self.fragment_schema["closed"]]), "closed")
        self._run(self.start_sessions)
        return self.emitted()


def rebuild(spark: SparkSession, path: str, lateness: str = "30 days", idle: str = "7 days", max_files: int | None = None) -> DataFrame:
    """Replay the table of session events at ``path`` through the streams, to its end, and return the
    messages of all whole conversations: ``(session_id, pos, seq, role)``.

    With ``max_files``, so many files are taken at a time; without, one batch holds them all.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # as a pattern, the path may be a folder or a single file
    return Rebuilder(spark, reader.parquet(f"{path[:-1]}[{path[-1]}]"), lateness, idle).to_end(one_batch=not max_files)
