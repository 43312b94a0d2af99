"""A memory store in tables: the op log, vectors and capture progress below one root, by workspace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnesis.config import Config
from mnesis.functions import text as tx
from mnesis.functions.embed import Embedder, HashedNGramEmbedder, embed_column
from mnesis.operators import dedupe, extract, items, recall, session
from mnesis.workspace import append_version, claim, live_versions, materialize, read_appended, read_version, release, replace_table, rewrite_appended, shared_dir

ITEM = "workspace string, id string, kind string, text string, tags array<string>, source_seqs array<bigint>, importance double, created_at bigint, last_access_at bigint, access_count bigint"
ITEM_STRUCT = f"struct<{', '.join(c.replace(' ', ': ', 1) for c in ITEM.split(', '))}>"
OPS = f"v int, op string, id string, item {ITEM_STRUCT}, at bigint, count bigint, line_no bigint"
VECTORS = "workspace string, id string, vector array<float>"
CAPTURE = "session_id string, last_captured_seq bigint, at bigint"
RECALLED = "session_id string, key string"
#: Appended folders of a table beyond which it is compacted.
FAN_IN = 16


class MemoryStore:
    """The items of one workspace, or of all of them. All state is in tables, so a restart needs no loading.

    With a ``workspace`` the store is that workspace's. Without one, rows carry a column ``workspace`` and
    every operation keeps the workspaces apart: what is compared, recalled or pushed out belongs to one.
    Item ids are hashes of workspace, session, text and first sequence number, so writing a batch again
    changes nothing. Items are appended as ops; :meth:`state` replays them.
    """

    def __init__(self, spark: SparkSession, workspace: str | None = None, config: Config = Config(), embedder: Embedder | None = None):
        self.spark, self.config = spark, config
        self.embedder = embedder or HashedNGramEmbedder(config.embed_dim)
        self.workspace = workspace
        slug = spark.range(1).select(tx.slugify(F.lit(workspace))).first()[0] if workspace is not None else "all"
        self.root = f"{config.storage_root or shared_dir(spark) + '/memory'}/{slug}"

    def _scoped(self, rows: DataFrame) -> DataFrame:
        """Rows with their workspace: that of the store, or their own; null is a workspace of its own, named empty."""
        return rows.withColumn("workspace", F.coalesce("workspace", F.lit("")) if self.workspace is None else F.lit(self.workspace))

    def ops(self) -> DataFrame:
        return read_appended(self.spark, f"{self.root}/ops", OPS)

    def vectors(self) -> DataFrame:
        """``(workspace, id, vector)`` of the living items; those of items that were pushed out don't count."""
        written = read_appended(self.spark, f"{self.root}/vectors", VECTORS).dropDuplicates(["id"])
        return written.join(self.state().select("id"), "id", "left_semi")

    def captured(self) -> DataFrame:
        return read_version(self.spark, f"{self.root}/capture", CAPTURE)

    def state(self) -> DataFrame:
        """Living items, with their last access and count."""
        alive = items.replay(self.ops())
        fields = [f"item.{c}" for c in ("workspace", "kind", "text", "tags", "source_seqs", "importance", "created_at")]
        return alive.select("id", *fields, "last_access_at", "access_count")

    def stats(self) -> DataFrame:
        """Living items and vectors of each workspace by kind: ``(workspace, kind, items, vectors)``."""
        held = self.vectors().select("id", F.lit(1).alias("held"))
        return self.state().join(held, "id", "left").groupBy("workspace", "kind").agg(F.count("*").alias("items"), F.count("held").alias("vectors"))

    def size(self) -> int:
        return self.state().count()

    def preload(self) -> DataFrame:
        """The living items, kept in the executors for the recalls to come."""
        kept = self.state().cache()
        kept.count()
        return kept

    def _append_ops(self, ops: DataFrame) -> None:
        """Ops get growing line numbers after the last; within a batch an id has one op, so their order means nothing."""
        last = self.ops().agg(F.coalesce(F.max("line_no"), F.lit(0))).first()[0]
        append_version(ops.withColumn("line_no", F.lit(last + 1) + F.monotonically_increasing_id()), f"{self.root}/ops")

    @staticmethod
    def _op(op: str, id_: Column | None = None, item: Column | None = None, at: Column | None = None, count: Column | None = None) -> list[Column]:
        def known(c: Column | None, kind: str) -> Column:
            return (F.lit(None) if c is None else c).cast(kind)

        return [
            F.lit(1).alias("v"),
            F.lit(op).alias("op"),
            known(id_, "string").alias("id"),
            (F.lit(None).cast(ITEM_STRUCT) if item is None else item).alias("item"),
            known(at, "bigint").alias("at"),
            known(count, "bigint").alias("count"),
        ]

    def add(self, candidates: DataFrame, now: int) -> DataFrame:
        """Add candidates ``(kind, text, importance, tags, source_seqs)``, with ``session_id`` if there is
        one; returns the items that were new and stay.

        Normalised, embedded, compared with the store and, greedily in order of first sequence number
        and id, with each other. A workspace never holds more than ``max_items``: of old and new items
        together the least reachable go, as if each candidate had pushed one out before it came in (so
        the last one stays). Only living items bar a candidate; what was pushed out can be learnt again.
        """
        scoped = self._scoped(candidates)
        first = F.coalesce(F.get("source_seqs", 0), F.lit(0))
        parts = ["workspace", *(["session_id"] if "session_id" in candidates.columns else []), "text"]
        key = F.sha2(F.concat_ws("\x1f", *parts, first.cast("string")), 256)
        state = materialize(self.state(), "living-items")
        fresh = (
            items.normalize_items(scoped.withColumn("importance", F.col("importance").cast("double")))
            .withColumn("id", key)
            .select("workspace", "id", "kind", "text", "tags", "source_seqs", "importance")
            .dropDuplicates(["id"])
            .join(state.select("id"), "id", "left_anti")
            .withColumn("vector", embed_column(F.col("text"), self.embedder))
        )
        fresh = materialize(fresh, "fresh-items")
        limit, dim, by = self.config.dedupe_similarity, self.config.embed_dim, ("workspace",)
        first_time = not live_versions(self.spark, f"{self.root}/vectors")
        unknown = fresh if first_time else dedupe.new_to_store(fresh, self.vectors(), limit, dim, by)
        ranked = unknown.withColumn("key", F.format_string("%020d/%s", first, F.col("id")))
        kept = dedupe.greedy(ranked.select("workspace", F.col("key").alias("id"), "vector"), limit, dim, by)
        new = ranked.join(kept.select(F.col("id").alias("key")), "key", "left_semi")
        new = materialize(new.withColumns({"created_at": F.lit(now).cast("bigint"), "access_count": F.lit(0).cast("bigint")}), "new-items")
        if new.isEmpty():
            return new.drop("key", "created_at", "access_count")
        gone = materialize(items.overflow(state, new, now, self.config.max_items, self.config.half_life_hours), "pushed-out")
        stay = new.join(gone.select("id"), "id", "left_anti")
        item = F.struct("workspace", "id", "kind", "text", "tags", "source_seqs", "importance", "created_at", F.col("created_at").alias("last_access_at"), "access_count")
        # vectors first: one without an item is ignored, and an item becomes visible with its vector
        append_version(stay.select("workspace", "id", "vector"), f"{self.root}/vectors")
        old = gone.where("not is_new")
        self._append_ops(old.select(*self._op("remove", F.col("id"))).unionByName(stay.select(*self._op("add", item=item))))
        self.compact()
        return stay.drop("key", "created_at", "access_count")

    def compact(self, force: bool = False) -> None:
        """Rewrite the op log as one add for each living item, and the vectors as those of living items,
        once either consists of more than ``FAN_IN`` folders. Readers that have begun keep theirs."""
        if force or len(live_versions(self.spark, f"{self.root}/vectors")) > FAN_IN:
            rewrite_appended(self.vectors().select("workspace", "id", "vector"), f"{self.root}/vectors")
        if force or len(live_versions(self.spark, f"{self.root}/ops")) > FAN_IN:
            item = F.struct("workspace", "id", "kind", "text", "tags", "source_seqs", "importance", "created_at", "last_access_at", "access_count")
            snapshot = self.state().select(*self._op("add", item=item)).withColumn("line_no", F.monotonically_increasing_id())
            rewrite_appended(snapshot, f"{self.root}/ops")

    def rebuild_index(self) -> int:
        """Embed the living items that have no usable vector; returns how many these were."""
        lacking = materialize(items.missing_vectors(self.state(), self.vectors(), self.config.embed_dim), "lacking")
        count = lacking.count()
        if count:
            new = lacking.select("workspace", "id", embed_column(F.col("text"), self.embedder).alias("vector"))
            append_version(new, f"{self.root}/vectors")
        return count

    def capture(self, progress: DataFrame) -> None:
        """Record progress ``(session_id, last_captured_seq, at)``; it never steps back."""
        both = self.captured().unionByName(progress.select("session_id", "last_captured_seq", "at"))
        replace_table(session.capture_progress(both), f"{self.root}/capture")

    def recall(self, queries: DataFrame, now: int) -> DataFrame:
        """Living items for each ``(query, text)``, of the query's workspace where the store has several;
        reading changes nothing, see :meth:`rehearse`."""
        cut = tx.utf16_slice(F.col("text"), 0, session.QUERY_CHARS)
        asked = self._scoped(queries).select("workspace", F.col("query").alias("id"), embed_column(cut, self.embedder).alias("vector"))
        return recall.recall(asked, self.vectors(), self.state(), now, self.config, by=("workspace",))

    def context(self, log: DataFrame, now: int) -> DataFrame:
        """What each session's next request is given: ``(session_id, seq, query, name, order, text, ids)``.

        The session's latest cue recalls from its workspace, and the hits are rendered in rank order.
        Sessions without a cue, or whose cue recalls nothing, have no row. Pass the result to
        :meth:`rehearse` once it was used.
        """
        cues = session.query_cues(log)
        if self.workspace is None:
            cues = cues.join(session.session_workspaces(log), "session_id")
        hits = self.recall(cues.select(F.col("session_id").alias("query"), F.col("query").alias("text"), *([] if self.workspace else ["workspace"])), now)
        shown = recall.render(hits, now).withColumnRenamed("query", "session_id")
        named = shown.withColumns({"name": F.lit(recall.CONTRIBUTION), "order": F.lit(self.config.recall_order)})
        return cues.select("session_id", "seq", "query").join(named, "session_id").select("session_id", "seq", "query", "name", "order", "text", "ids")

    def rehearse(self, recalls: DataFrame, now: int) -> None:
        """Touch the items of recalls ``(session_id, seq, query, ids)`` whose query or result differs from
        the session's last, which is kept in a table and so outlives a restart."""
        path = f"{self.root}/recalled"
        before = read_version(self.spark, path, RECALLED)
        changed = materialize(items.changed_queries(recalls, before), "changed-recalls")
        touches = items.touches(self.state(), changed, now)
        self._append_ops(touches.select(*self._op("touch", F.col("id"), at=F.col("at"), count=F.col("count"))))
        last = items.last_keys(changed)
        replace_table(last.unionByName(before.join(last, "session_id", "left_anti")), path)
        self.compact()

    def consolidate(self, events: DataFrame, now: int, model: extract.Model | dict[str, extract.Model] | None = None, force: bool = False, routes: DataFrame | None = None, carry_head: bool = False) -> DataFrame:
        """Capture what is new in session events: spans, extraction, adding, progress. Returns the new items.

        ``routes`` (session_id, model) names each session's model where ``model`` is a dictionary. With
        ``carry_head``, a session's events beyond ``max_span_chars`` are captured as further spans
        instead of being left out. A store that is disabled, or that another consolidation holds, takes
        nothing: the trigger is dropped and the progress stays.
        """
        nothing = self.spark.createDataFrame([], "workspace string, id string, kind string, text string, tags array<string>, source_seqs array<bigint>, importance double, vector array<float>")
        lock = f"{self.root}/consolidating"
        if not self.config.enabled or not claim(self.spark, lock):
            return nothing
        try:
            log = session.session_log(events)
            surface = session.since_capture(session.surface_events(log), self.captured())
            newest = session.collect_spans(surface, self.config.max_span_chars)
            due = newest if force else session.triggered(newest, log, self.config.capture_token_threshold).drop("forced")
            due = materialize(due, "due-spans")
            spans = due
            if carry_head:
                spans = session.all_spans(surface.join(due.select("session_id"), "session_id", "left_semi"), self.config.max_span_chars)
            if routes is not None:
                spans = spans.join(routes.select("session_id", "model"), "session_id", "left")
            found = extract.extract(spans, model, self.config.capture_mode, self.config.extract_max_tokens)
            if self.workspace is None:
                found = found.join(session.session_workspaces(log), "session_id")
            new = self.add(found.select(*([] if self.workspace else ["workspace"]), "session_id", "kind", "text", "importance", "tags", F.array("first_seq", "last_seq").alias("source_seqs")), now)
            self.capture(due.select("session_id", F.col("last_seq").alias("last_captured_seq"), F.lit(now).cast("bigint").alias("at")))
            return new
        finally:
            release(self.spark, lock)
