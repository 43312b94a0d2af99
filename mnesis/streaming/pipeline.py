"""Structured Streaming: consolidation of a stream of session events, and running query cues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnesis.operators import session
from mnesis.operators.extract import Model
from mnesis.sources.store import FAN_IN, MemoryStore
from mnesis.workspace import append_version, live_versions, read_appended, rewrite_appended

#: How long a running stream gathers events before it consolidates.
DEBOUNCE = "400 milliseconds"


def consolidate_stream(events: DataFrame, store: MemoryStore, checkpoint: str, clock: Callable[[DataFrame], int] | None = None, model: Model | dict[str, Model] | None = None, **trigger) -> StreamingQuery:
    """Feed a stream of session events to ``store``, batch by batch.

    Events wait in a table below the store's root until their session is consolidated, so a batch that
    is run again after a failure finds the same state: ids are hashes, progress never steps back, and
    an event that waits twice counts once. A batch appends what it brings; the table is rewritten
    without what is captured only once it consists of more than ``FAN_IN`` folders. ``clock`` gives a
    batch's time in ms (by default its latest arrival). Without a trigger all that is there is taken;
    for a running stream pass ``processingTime=DEBOUNCE``, and end it with :func:`flush`.
    """
    waiting = f"{store.root}/waiting"

    def latest(batch: DataFrame) -> int:
        return batch.agg(F.coalesce(F.max(F.unix_millis("ingested_at")), F.lit(0))).first()[0]

    def take(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema)
        append_version(batch.where("session_id is not null and seq is not null"), waiting)
        log = session.since_capture(read_appended(spark, waiting, columns), store.captured())
        store.consolidate(log, (clock or latest)(batch), model)
        if len(live_versions(spark, waiting)) > FAN_IN:
            rewrite_appended(session.since_capture(read_appended(spark, waiting, columns), store.captured()).select(*batch.columns), waiting)

    return events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def flush(query: StreamingQuery) -> None:
    """Take what has arrived, then end the stream."""
    query.processAllAvailable()
    query.stop()


def captured_marks(events: DataFrame) -> DataFrame:
    """Running furthest sequence number and estimated number of events of each session, as keyed state of an update-mode stream.

    ``events`` is an approximate distinct count (relative standard deviation 5 %), so that the state of
    a session stays small however long it is; only ``last_seq`` is exact.
    """
    return (
        events.where("session_id is not null and seq is not null")
        .groupBy("session_id")
        .agg(F.max("seq").alias("last_seq"), F.approx_count_distinct("seq").alias("events"))
    )


def routed(events: DataFrame) -> DataFrame:
    """The stream with what each event triggers; malformed rows are marked, not raised."""
    bad = F.col("session_id").isNull() | F.col("seq").isNull() | F.col("type").isNull()
    return events.withColumn("route", F.when(bad, "malformed").otherwise(session.event_route(F.col("type"))))
