"""Queries of the training-data operators, each over its whole tables, and SQL where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnesis.llm import contamination, conversations, mixing, near_duplicates, neighbours, personal, quality
from mnesis.workspace import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register the decorated function as query ``name`` with its oracle."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


CONVERSATIONS_SQL = r"""
with events as (
  select distinct session_id, seq, "type", "data" from session_events where session_id is not null and seq is not null
), texts as (
  select session_id, seq, "type", "data",
    array_to_string([b.text for b in (case when "type" = 'user/message' then "data".content else "data".message.content end) if b.text is not null], ' ') as t
  from events
), roles as (
  select session_id, seq, case
    when not regexp_matches(coalesce(t, ''), '\S') then null
    when "type" = 'user/message' and "data".role = 'user' and coalesce("data".source.kind, '') <> 'plugin' then 'user'
    when "type" = 'assistant/message' then 'assistant'
    when "type" = 'tool/result' then 'tool' end as r
  from texts
), steps as (
  select session_id, seq, r,
    row_number() over (partition by session_id, r is not null order by seq) - 1 as pos,
    lag(case when r <> 'tool' then r end ignore nulls) over (partition by session_id order by seq) as prev
  from roles
), whole as (
  select session_id from steps group by session_id
  having count(*) = count(distinct seq) and min(seq) = 0 and max(seq) = count(*) - 1
    and arg_min(r, seq) filter (r is not null) = 'user'
    and arg_max(r, seq) filter (r is not null and r <> 'tool') = 'assistant'
    and count(*) filter (r = 'user' and prev = 'user') = 0
)
select session_id, pos, seq, r as "role" from steps where r is not null and session_id in (select session_id from whole)
"""


@query("p5_found", CONVERSATIONS_SQL)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of whole conversations, through the keyed stream."""
    return conversations.rebuild(spark, f"{sf_dir}/session_events.parquet")


#: Exact search; the index gives the same on tables that fit one cell.
SIMILAR_SQL = """
with usable as (
  select id, any_value(list_transform(vector, lambda x: x::double)) as v from vector_index
  where id is not null and len(vector) = 512 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(vector, lambda x: x <> 0)) > 0 group by id
), n as (
  select id, v, sqrt(list_dot_product(v, v)) as n from usable
), scored as (
  select a.id as a, b.id as b, list_dot_product(a.v, b.v) / (a.n * b.n) as s from n a join n b on a.id <> b.id
), best as (
  select a, b from scored qualify row_number() over (partition by a order by s desc, b) <= 5 and s >= 0.70
)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from best
"""


@query("p3_found", SIMILAR_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar vectors over the whole collection."""
    return neighbours.similar_pairs(read_table(spark, sf_dir, "vector_index")).select("id_a", "id_b")


#: Windows of ten words, without NFKC.
LEAKS_SQL = r"""
with texts as (
  select doc_id as k, true as doc, text as t from documents where text is not null
  union all select item_id, false, passage from eval_passages where passage is not null
), w as (
  select k, doc, regexp_extract_all(lower(regexp_replace(t, '\p{Cf}', '', 'g')), '[\p{L}\p{N}]+') as w from texts
), runs as (
  select distinct k, doc, array_to_string(w[i:i + 9], ' ') as run from w, lateral (select unnest(range(1, len(w) - 8)) as i)
)
select distinct d.k as doc_id, p.k as item_id from runs d join runs p on d.run = p.run where d.doc and not p.doc
"""


@query("p6_found", LEAKS_SQL)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items that they leak."""
    leaks = contamination.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_passages"))
    return leaks.select("doc_id", "item_id")


@query("p6_clean")
def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without the spans that leak evaluation items."""
    return contamination.remove_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_passages"))


@query("p7_mix")
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by the target weights."""
    return mixing.Mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets")).emit()


@query("p7_shares")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the sources in the mix."""
    return mixing.Mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets")).shares()


#: Without NFKC, which SQL lacks; the tables' words don't need it but for full-width forms.
NEAR_DUPLICATES_SQL = r"""
with texts as (
  select id, text as t from memory_item where id is not null and text is not null
  union all select id, unnest(tags) from memory_item where id is not null
), w as (
  select distinct id, unnest(regexp_extract_all(lower(regexp_replace(t, '\p{Cf}', '', 'g')), '[\p{L}\p{N}]+')) as w from texts where t is not null
), n as (
  select id, count(*) as n from w group by id having count(*) >= 12
), shared as (
  select a.id as a, b.id as b, count(*) as k from w a join w b on a.w = b.w and a.id < b.id
  where a.id in (select id from n) and b.id in (select id from n) group by a.id, b.id
)
select a as id_a, b as id_b from shared join n x on x.id = a join n y on y.id = b where k >= 0.7::double * (x.n + y.n - k) - 1e-9
"""


@query("p4_found", NEAR_DUPLICATES_SQL)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of near-duplicate items."""
    return near_duplicates.NearDuplicates(read_table(spark, sf_dir, "memory_item")).pairs()


@query("p4_classes")
def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its class of equal word sets, and the class's number of near-duplicate classes."""
    return near_duplicates.NearDuplicates(read_table(spark, sf_dir, "memory_item")).representatives()


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which more than half isn't prose, with their form."""
    forms = quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "doc_labels"))
    return forms.where("form <> 'prose'").select("doc_id", "form").distinct()


@query("p8_statistics")
def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document."""
    return quality.document_statistics(read_table(spark, sf_dir, "documents")).drop("weak")


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of personal information in the items' texts."""
    return personal.find_personal(read_table(spark, sf_dir, "memory_item")).select("id", "pii_type", "start_pos").distinct()


@query("p1_redacted")
def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items' texts with typed placeholders."""
    return personal.redact(read_table(spark, sf_dir, "memory_item").select("workspace", "id", "text"))
