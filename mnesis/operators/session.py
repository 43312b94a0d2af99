"""From session events to spans: routing, surface events, bounded spans, chunks and query cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions import text as tx

#: What a span charges for each event besides its text.
EVENT_COST = 8
CHUNK, STEP, CHUNK_MIN = 700, 580, 32
QUERY_CHARS, QUERY_MIN = 1200, 2


def session_log(events: DataFrame) -> DataFrame:
    """One row for each (session_id, seq): the one that arrived first. Rows without either are dropped.

    A partial aggregate, so repeated deliveries shrink before the shuffle, and a long session spreads
    over its sequence numbers.
    """
    return (
        events.where("session_id is not null and seq is not null")
        .groupBy("session_id", "seq")
        .agg(F.min_by(F.struct("workspace", "type", "data", "ts", "ingested_at"), F.coalesce("ingested_at", "ts", F.timestamp_seconds(F.lit(0)))).alias("e"))
        .select("session_id", "seq", "e.*")
    )


def event_route(type_: Column) -> Column:
    """What an event triggers: ``inbox_cue``, ``user_cue``, ``touch_store``, ``consolidate``, ``force_consolidate`` or ``ignore``."""
    return (
        F.when(type_ == "agent/inbox/spliced", "inbox_cue")
        .when(type_ == "user/message", "user_cue")
        .when(type_.isin("assistant/message", "tool/result"), "touch_store")
        .when(type_ == "turn/end", "consolidate")
        .when(type_.startswith("compaction/"), "force_consolidate")
        .otherwise("ignore")
    )


def surface_events(log: DataFrame) -> DataFrame:
    """``(session_id, seq, role, text)``: a human's messages (even empty), and what assistant and tools said."""
    role = (
        F.when((F.col("type") == "user/message") & tx.is_human(F.col("data.role"), F.col("data.source.kind")), "user")
        .when(F.col("type") == "assistant/message", "assistant")
        .when(F.col("type") == "tool/result", "tool")
    )
    content = F.when(F.col("type") == "user/message", F.col("data.content")).otherwise(F.col("data.message.content"))
    return (
        log.select("session_id", "seq", role.alias("role"), tx.message_text(content).alias("text"))
        .where("role is not null")
        .where((F.col("role") == "user") | (F.col("text") != ""))
    )


def collect_spans(surface: DataFrame, max_span_chars: int = 24_000) -> DataFrame:
    """The newest events of each session that fit in ``max_span_chars``, as one text:
    ``(session_id, first_seq, last_seq, events, text, approx_tokens)``.

    Every event costs ``EVENT_COST`` at least, so only a bounded number of each session's newest events
    can fit; that many are kept by rank before the shuffle (WindowGroupLimit) and summed after it. A
    session whose newest event alone is too large gives no row.
    """
    newest = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    kept = (
        surface.withColumn("n", F.row_number().over(newest))
        .where(F.col("n") <= max_span_chars // EVENT_COST)
        .withColumn("used", F.sum(tx.utf16_length(F.col("text")) + EVENT_COST).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("used") <= max_span_chars)
    )
    return _joined(kept, "session_id")


def _joined(events: DataFrame, *by: str) -> DataFrame:
    """Events of each group as one text in order of seq."""
    line = F.concat(F.lit("["), "role", F.lit(" @seq "), "seq", F.lit("] "), "text")
    spans = events.groupBy(*by).agg(
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.count("*").alias("events"),
        F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines"),
    )
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")
    return spans.withColumn("text", text).drop("lines").withColumn("approx_tokens", tx.estimate_tokens(F.col("text")))


def all_spans(surface: DataFrame, max_span_chars: int = 24_000) -> DataFrame:
    """Spans like :func:`collect_spans`, but for all events of a session: the newest as there, and the
    events before it in further spans of about ``max_span_chars``.

    The running sum is taken over narrow rows; texts are only grouped by (session, span).
    """
    newest = Window.partitionBy("session_id").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cost = (tx.utf16_length(F.col("text")) + EVENT_COST).alias("cost")
    placed = surface.select("session_id", "seq", cost).select("session_id", "seq", F.floor((F.sum("cost").over(newest) - 1) / max_span_chars).alias("span"))
    return _joined(surface.join(placed, ["session_id", "seq"]), "session_id", "span").drop("span")


def session_workspaces(log: DataFrame) -> DataFrame:
    """The workspace whose store a session belongs to, ``(session_id, workspace)``: that of its first event."""
    return log.groupBy("session_id").agg(F.min_by("workspace", F.when(F.col("workspace").isNotNull(), F.col("seq"))).alias("workspace"))


def since_capture(surface: DataFrame, progress: DataFrame) -> DataFrame:
    """Surface events after each session's captured sequence number (all, without one)."""
    done = progress.select("session_id", "last_captured_seq")
    return surface.join(done, "session_id", "left").where(F.col("seq") > F.coalesce("last_captured_seq", F.lit(-1))).drop("last_captured_seq")


def capture_progress(progress: DataFrame) -> DataFrame:
    """The furthest capture of each session and the time it was first reached: ``(session_id, last_captured_seq, at)``.

    A null time is later than any known one.
    """
    furthest = F.struct("last_captured_seq", (-F.coalesce("at", F.lit(2**62))).alias("before"))
    return (
        progress.where("session_id is not null and last_captured_seq is not null")
        .groupBy("session_id")
        .agg(F.max(furthest).alias("m"))
        .select("session_id", "m.last_captured_seq", F.nullif(-F.col("m.before"), F.lit(2**62)).alias("at"))
    )


def triggered(spans: DataFrame, log: DataFrame, threshold: int = 6000) -> DataFrame:
    """Spans to consolidate: long enough at a turn's end, or any at a compaction. Adds ``forced``."""
    route = event_route(F.col("type"))
    calls = (
        log.select("session_id", route.alias("route"))
        .where(F.col("route").isin("consolidate", "force_consolidate"))
        .groupBy("session_id")
        .agg(F.max(F.col("route") == "force_consolidate").alias("forced"))
    )
    return spans.join(calls, "session_id").where(F.col("forced") | (F.col("approx_tokens") >= threshold))


def raw_chunks(spans: DataFrame, text: str = "text") -> DataFrame:
    """Overlapping pieces of ``text``: 700 UTF-16 units every 580, trimmed, of 32 units or more.

    Keeps the other columns and adds ``chunk_no`` and ``chunk``; the last piece is the first that
    reaches the end.
    """
    wide = tx.widen(F.col(text))
    last = F.greatest(F.lit(0), F.ceil((F.length("_w") - CHUNK) / F.lit(float(STEP)))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("_w"), i * STEP + 1, F.lit(CHUNK)))
    return (
        spans.withColumn("_w", wide)
        .where(F.length("_w") > 0)
        .select(*[c for c in spans.columns if c != text], F.posexplode(pieces).alias("chunk_no", "_p"))
        .withColumn("chunk", tx.trim(tx.narrow(F.col("_p"))))
        .drop("_p")
        .where(tx.utf16_length(F.col("chunk")) >= CHUNK_MIN)
    )


def query_cues(log: DataFrame) -> DataFrame:
    """The latest query of each session, ``(session_id, seq, query)``: from the inbox for the next turn, or a human's message.

    Cut to 1200 UTF-16 units after trimming; shorter ones than 2 don't count.
    """
    inserted = (
        log.where((F.col("type") == "agent/inbox/spliced") & (F.col("data.target") == "next-turn"))
        .select("session_id", "seq", F.posexplode("data.inserted").alias("i", "m"))
        .where("m.role = 'user'")
        .select("session_id", "seq", "i", tx.message_text(F.col("m.content")).alias("text"))
    )
    said = log.where((F.col("type") == "user/message") & tx.is_human(F.col("data.role"), F.col("data.source.kind"))).select(
        "session_id", "seq", F.lit(0).alias("i"), tx.message_text(F.col("data.content")).alias("text")
    )
    cues = inserted.unionByName(said).withColumn("text", tx.trim(F.col("text"))).where(tx.utf16_length(F.col("text")) >= QUERY_MIN)
    latest = cues.groupBy("session_id").agg(F.max(F.struct("seq", "i", "text")).alias("c"))
    return latest.select("session_id", F.col("c.seq").alias("seq"), tx.utf16_slice(F.col("c.text"), 0, QUERY_CHARS).alias("query"))
