"""Memory items: normalisation, replay of the op log in line order, rehearsal, eviction and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions import score
from mnesis.functions import text as tx

#: Fixed values of the stored format.
KINDS = ("fact", "decision", "preference", "error-fix", "task", "file-change", "summary", "raw")
MIN_TEXT, MAX_TAGS = 8, 12


def normal_kind(kind: Column) -> Column:
    return F.when(kind.isin(*KINDS), kind).otherwise("fact")


def normal_importance(importance: Column) -> Column:
    """Within 0 and 1; null, NaN and 0 become 0.5."""
    known = F.nullif(F.nanvl(importance.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(known, F.lit(0.5))))


def normal_tags(tags: Column) -> Column:
    """The first twelve; none for null."""
    return F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, MAX_TAGS)


def normalize_items(items: DataFrame) -> DataFrame:
    """``kind``, ``text``, ``tags`` and ``importance`` as the store keeps them; texts under eight units are dropped."""
    clean = items.withColumns(
        {
            "text": tx.trim(F.col("text")),
            "kind": normal_kind(F.col("kind")),
            "importance": normal_importance(F.col("importance")),
            "tags": normal_tags(F.col("tags")),
        }
    )
    return clean.where(tx.utf16_length(F.col("text")) >= MIN_TEXT)


def latest_items(items: DataFrame) -> DataFrame:
    """One row for each id: the last ingested."""
    return items.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*[c for c in items.columns if c != "id"]), F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0)))).alias("i")).select("id", "i.*")


def replay(log: DataFrame) -> DataFrame:
    """State after the lines in order: ``(id, last_access_at, access_count, item)``.

    An add overwrites, a touch sets time and count of a living item, a remove ends it. One partial
    aggregate by id: the last add, the last remove, and the last touch decide.
    """
    add = F.col("op") == "add"
    lines = log.where((F.col("v") == 1) & F.col("op").isin("add", "touch", "remove")).select(
        F.when(add, F.col("item.id")).otherwise(F.col("id")).alias("key"), "op", "line_no", "item", "at", "count"
    )
    last = lines.where("key is not null").groupBy("key").agg(
        F.max(F.when(add, F.col("line_no"))).alias("added"),
        F.max_by("item", F.when(add, F.col("line_no"))).alias("item"),
        F.max(F.when(F.col("op") == "remove", F.col("line_no"))).alias("removed"),
        F.max(F.when(F.col("op") == "touch", F.struct("line_no", "at", "count"))).alias("touch"),
    )
    touched = F.coalesce(F.col("touch.line_no") > F.col("added"), F.lit(False))
    return last.where("added is not null and (removed is null or added > removed)").select(
        F.col("key").alias("id"),
        F.when(touched, F.col("touch.at")).otherwise(F.col("item.last_access_at")).alias("last_access_at"),
        F.when(touched, F.col("touch.count")).otherwise(F.col("item.access_count")).alias("access_count"),
        "item",
    )


def evict_candidates(items: DataFrame, as_of: int, surplus: int, half_life_hours: float = 168.0) -> DataFrame:
    """The ``surplus`` least reachable items (a top-k, ties to the smaller id), with their score."""
    s = score.accessibility(F.lit(score.NOMINAL_SIMILARITY), F.col("created_at"), F.col("importance"), F.col("access_count"), F.lit(as_of), half_life_hours)
    return items.select("id", F.round(s, 6).alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score")).orderBy("score", "id").limit(surplus)


def overflow(state: DataFrame, new: DataFrame, as_of: int, max_items: int, half_life_hours: float = 168.0) -> DataFrame:
    """What goes so that no workspace holds more than ``max_items``: ``(workspace, id, is_new)`` of old
    and new items.

    As if the new items came one by one in order of ``key``, each after the least reachable one was
    pushed out: the last new item stays, of the others the most reachable do. Ties: older before newer
    go, then the smaller id. Only workspaces that exceed the cap are ranked, by narrow rows.
    """

    def scored(rows: DataFrame, is_new: bool) -> DataFrame:
        s = score.accessibility(F.lit(score.NOMINAL_SIMILARITY), F.col("created_at"), F.col("importance"), F.col("access_count"), F.lit(as_of), half_life_hours)
        key = F.col("key") if is_new else F.lit(None).cast("string")
        return rows.select("workspace", "id", F.lit(is_new).alias("is_new"), key.alias("key"), F.coalesce(F.nanvl(F.round(s, 6), F.lit(None).cast("double")), F.lit(float("inf"))).alias("score"))

    both = scored(state, False).unionByName(scored(new, True))
    sizes = both.groupBy("workspace").agg((F.count("*") - max_items).alias("surplus"), F.max("key").alias("last")).where("surplus > 0")
    worst = Window.partitionBy("workspace").orderBy("score", "is_new", "id")
    return (
        both.join(sizes, "workspace")
        .where(~F.col("key").eqNullSafe(F.col("last")) | F.col("last").isNull())
        .withColumn("n", F.row_number().over(worst))
        .where("n <= surplus")
        .select("workspace", "id", "is_new")
    )


def store_stats(items: DataFrame) -> DataFrame:
    """Items by kind, and in all (kind ``*``)."""
    return items.rollup("kind").agg(F.count("*").alias("items")).select(F.coalesce("kind", F.lit("*")).alias("kind"), "items")


def missing_vectors(items: DataFrame, vectors: DataFrame, dim: int = 512) -> DataFrame:
    """Items without a usable vector, which are the ones to embed."""
    usable = vectors.where((F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))).select("id")
    return items.join(usable, "id", "left_anti")


def changed_queries(recalls: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Of recalls ``(session_id, seq, query, ids)``, those whose query or ranked ids differ from the
    session's last: they rehearse. Adds their ``key``.

    ``before`` (session_id, key) has the last keys of earlier recalls.
    """
    key = F.sha2(F.concat_ws("|", "query", F.array_join("ids", ",")), 256)
    earlier = Window.partitionBy("session_id").orderBy("seq")
    keyed = recalls.withColumn("key", key).withColumn("_last", F.lag("key").over(earlier))
    if before is not None:
        keyed = keyed.join(before.select("session_id", F.col("key").alias("_before")), "session_id", "left").withColumn("_last", F.coalesce("_last", "_before")).drop("_before")
    return keyed.where(F.col("_last").isNull() | (F.col("_last") != F.col("key"))).drop("_last")


def last_keys(changed: DataFrame) -> DataFrame:
    """The last key of each session: ``(session_id, key)``."""
    return changed.groupBy("session_id").agg(F.max_by("key", "seq").alias("key"))


def touches(items: DataFrame, changed: DataFrame, as_of: int) -> DataFrame:
    """Touch ops ``(op, id, at, count)`` for the items of changed recalls: one more access for each."""
    hits = changed.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("hits"))
    return items.join(hits, "id").select(F.lit("touch").alias("op"), "id", F.lit(as_of).cast("bigint").alias("at"), (F.col("access_count") + F.col("hits")).alias("count"))


def rehearse(items: DataFrame, recalls: DataFrame, as_of: int) -> DataFrame:
    """Touch ops for the items hit by changed queries among ``recalls`` ``(session_id, seq, query, ids)``."""
    return touches(items, changed_queries(recalls), as_of)
