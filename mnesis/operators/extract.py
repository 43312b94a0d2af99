"""Extraction of candidate memories from spans: a seam for a model, and the parser of its answers."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnesis.functions import text as tx
from mnesis.operators.session import raw_chunks
from mnesis.workspace import materialize

MAX_ENTRIES, MIN_TEXT = 60, 8


def parse_extraction(answer: Column) -> Column:
    """Candidates ``array<struct<kind, text, importance, tags>>`` of a model's answer; null where it holds no JSON array.

    Accepts a fenced block, and text around an array. Of the first 60 entries those with a text of
    eight units or more count; kind defaults to ``fact``, importance to 0.5, tags to none.
    """
    bare = F.regexp_replace(F.regexp_replace(tx.trim(answer), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    first, last = F.instr(bare, "["), F.length(bare) - F.instr(F.reverse(bare), "]") + 1
    inner = F.when((first > 0) & (F.instr(bare, "]") > 0) & (last > first), F.substring(bare, first, last - first + 1))

    def array_of(text: Column) -> Column:
        return F.when(F.try_variant_get(F.try_parse_json(text), "$[0]", "variant").isNotNull() | F.regexp_replace(text, r"\s+", "").eqNullSafe("[]"), F.from_json(text, "array<variant>"))

    is_json = F.try_parse_json(bare).isNotNull()
    entries = F.when(is_json, array_of(bare)).otherwise(array_of(inner))

    def field(e: Column, name: str, kind: str = "string") -> Column:
        return F.try_variant_get(e, f"$.{name}", kind)

    def shaped(e: Column) -> Column:
        importance = field(e, "importance").try_cast("double")
        return F.struct(
            F.coalesce(field(e, "kind"), F.lit("fact")).alias("kind"),
            tx.trim(field(e, "text")).alias("text"),
            F.when(importance.isNull() | F.isnan(importance) | (F.abs(importance) == float("inf")), 0.5).otherwise(importance).alias("importance"),
            F.coalesce(field(e, "tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        )

    long_enough = lambda e: tx.utf16_length(tx.trim(F.coalesce(field(e, "text"), F.lit("")))) >= MIN_TEXT
    return F.transform(F.filter(F.slice(entries, 1, MAX_ENTRIES), long_enough), shaped)


#: A model: from a span's text (and ``max_tokens``, if it takes that) to an answer, or to the parts of a
#: streamed one: ``{"type": "text-delta", "index": block, "text": ...}`` and ``{"type": "finish", "reason": ...}``.
Model = Callable[..., str | Iterable[dict]]
RAW, UNROUTED, FAILED, TRUNCATED, ANSWERED = "raw", "unrouted", "failed", "truncated", "answered"


def assemble_answer(answer: str | Iterable[dict]) -> tuple[str, bool]:
    """The text of an answer and whether it was cut at the limit of tokens.

    Deltas are joined by block, blocks in the order in which they first appear.
    """
    if isinstance(answer, str):
        return answer, False
    blocks: dict[int, list[str]] = {}
    cut = False
    for part in answer:
        if part.get("type") == "text-delta":
            blocks.setdefault(part.get("index"), []).append(part.get("text") or "")
        elif part.get("type") == "finish":
            cut |= part.get("reason") == "length"
    return "".join(t for texts in blocks.values() for t in texts), cut


def route_models(sessions: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """The model of each session, ``(session_id, model)``: the one its header names (``provider`` and
    ``model``, both given), else that of its agent in ``agents`` (session_id, provider, model), else null."""
    def named(df: DataFrame, name: str) -> DataFrame:
        both = F.when((F.col("provider") != "") & (F.col("model") != ""), F.concat_ws("/", "provider", "model"))
        return df.groupBy("session_id").agg(F.max(both).alias(name))

    routes = named(sessions, "_header")
    if agents is None:
        return routes.withColumnRenamed("_header", "model")
    return routes.join(named(agents, "_agent"), "session_id", "left").select("session_id", F.coalesce("_header", "_agent").alias("model"))


def answers(spans: DataFrame, model: Model | dict[str, Model] | None = None, mode: str = "llm", max_tokens: int = 2048) -> DataFrame:
    """``spans`` with each one's ``answer`` and its ``status``: ``raw`` (the mode, or no model at all),
    ``unrouted`` (no model for the session), ``failed``, ``truncated`` at the limit of tokens, or
    ``answered``. Models run in the tasks; a dictionary is looked up by the column ``model``.
    """
    if model is None or mode == "raw":
        return spans.withColumns({"answer": F.lit(None).cast("string"), "status": F.lit(RAW)})

    def ask(known: Model | None, text: str) -> tuple[str | None, str]:
        if known is None:
            return None, UNROUTED
        try:
            limit = {"max_tokens": max_tokens} if "max_tokens" in inspect.signature(known).parameters else {}
            got, cut = assemble_answer(known(text, **limit))
        except Exception:  # a failing model must not lose the span
            return None, FAILED
        return got, TRUNCATED if cut else ANSWERED

    @F.pandas_udf("struct<answer:string,status:string>")
    def answered(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, names in batches:
            got = [ask(model.get(n) if isinstance(model, dict) else model, t) for t, n in zip(texts, names)]
            yield pd.DataFrame(got, columns=["answer", "status"])

    name = F.col("model") if "model" in spans.columns else F.lit(None).cast("string")
    # written once, since a model is asked once for each span
    return materialize(spans.withColumn("_a", answered("text", name)).select(*spans.columns, "_a.*"), "answers")


def extract(spans: DataFrame, model: Model | dict[str, Model] | None = None, mode: str = "llm", max_tokens: int = 2048) -> DataFrame:
    """Candidates of each span: ``(session_id, first_seq, last_seq, position, kind, text, importance, tags)``.

    Without a model for it, in mode ``raw``, on an error or on an answer without an array, the span is
    cut into raw chunks; :func:`answers` tells which happened.
    """
    keys = ["session_id", "first_seq", "last_seq"]
    answered = answers(spans, model, mode, max_tokens).withColumn("candidates", parse_extraction(F.col("answer")))
    parsed = answered.where("candidates is not null").select(*keys, F.posexplode("candidates").alias("position", "c")).select(*keys, "position", "c.*")
    raw = raw_chunks(answered.where("candidates is null").select(*keys, "text")).select(
        *keys, F.col("chunk_no").alias("position"), F.lit("raw").alias("kind"), F.col("chunk").alias("text"), F.lit(0.5).alias("importance"), F.array().cast("array<string>").alias("tags")
    )
    return parsed.unionByName(raw)
