"""Queries for the engine's own operators, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnesis.config import Config
from mnesis.functions import embed, grams, score, vectors
from mnesis.functions import text as tx
from mnesis.operators import dedupe, extract, items, recall, session
from mnesis.plans.catalog import query
from mnesis.sources.store import MemoryStore
from mnesis.workspace import materialize, read_table, scratch_path, spread

#: The time of all scores here: 2026-01-01, in ms.
AS_OF = 1_767_225_600_000
DIM = 64
WS = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def fnv_sql(text: str) -> str:
    """FNV-1a over UTF-16 units in SQL."""
    units = f"flatten(list_transform(list_filter(string_split({text}, ''), lambda ch: ch <> ''), lambda ch: case when unicode(ch) > 65535 then [55296 + ((unicode(ch) - 65536) >> 10), 56320 + ((unicode(ch) - 65536) & 1023)] else [unicode(ch)] end))"
    return f"list_reduce(list_prepend(2166136261::bigint, list_transform({units}, lambda u: u::bigint)), lambda h, u: (xor(h, u) * 16777619) % 4294967296)"


# ---- hashes and text

WORDS_SQL = "select distinct unnest(string_split(p_name, ' ')) as word from part"


def _part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()


@query("fnv1a_hash", f"select word, {fnv_sql('word')} as hash, {fnv_sql('word')} % 512 as bucket from ({WORDS_SQL})")
def fnv1a_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tx.fnv1a(F.col("word"))
    return _part_words(spark, sf_dir).select("word", h.alias("hash"), (h % 512).alias("bucket"))


@query("hash_sign", f"select word, case when {fnv_sql('word || chr(124)')} % 2 = 0 then 1 else -1 end as sign from ({WORDS_SQL})")
def hash_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_words(spark, sf_dir).select("word", tx.hash_sign(F.col("word")).alias("sign"))


@query("text_normalize", "select c_custkey, lower(c_name) as text from customer")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select("c_custkey", tx.normalize_text(F.col("c_name")).alias("text"))


@query("word_tokens", "select p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9_]{3,}') as words from part")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", tx.word_tokens(tx.normalize_text(F.col("p_name"))).alias("words"))


@query(
    "word_bigrams",
    """with w as (select p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9_]{3,}') as ws from part),
       i as (select p_partkey, ws, unnest(range(1, len(ws))) as i from w)
       select p_partkey, ws[i] || ' ' || ws[i + 1] as pair, count(*) as n from i group by all""",
)
def word_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tx.word_tokens(tx.normalize_text(F.col("p_name")))
    rows = read_table(spark, sf_dir, "part").select("p_partkey", words.alias("words"))
    return rows.select("p_partkey", F.explode(tx.word_bigrams(F.col("words"))).alias("pair")).groupBy("p_partkey", "pair").agg(F.count("*").alias("n"))


GRAMS_SQL = "select p_partkey, substr(t, i, n) as gram from (select p_partkey, lower(p_name) as t from part), unnest(range(1, 5)) a(n), lateral (select unnest(range(1, length(t) - n + 2)) as i)"


@query("char_ngrams", f"select p_partkey, gram, count(*) as n from ({GRAMS_SQL}) group by all")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").select("p_partkey", tx.normalize_text(F.col("p_name")).alias("t"))
    return rows.select("p_partkey", F.explode(tx.char_ngrams(F.col("t"))).alias("gram")).groupBy("p_partkey", "gram").agg(F.count("*").alias("n"))


FEATURES_SQL = f"""
  with w as (select p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9_]{{3,}}') as ws from part),
  f as (select p_partkey, gram, 1 as k from ({GRAMS_SQL})
    union all select p_partkey, 'w:' || unnest(ws), 2 from w
    union all select p_partkey, 'wb:' || ws[i] || ' ' || ws[i + 1], 3 from (select p_partkey, ws, unnest(range(1, len(ws))) as i from w))
  select p_partkey, gram, sum(k)::bigint as "count" from f group by all"""


@query("ngram_features", FEATURES_SQL)
def ngram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.features(read_table(spark, sf_dir, "part"), "p_partkey", "p_name")


SPARSE_SQL = f"""
  with c as ({FEATURES_SQL}), h as (select gram, {fnv_sql('gram')} as h from (select distinct gram from c))
  select p_partkey, h % 512 as bucket, sum(case when h % 2 = 0 then 1 else -1 end * (1 + 0.5::double * ln(1 + "count"))) as w
  from c join h using (gram) group by all"""


@query("hash_embed_sparse", f"select p_partkey, bucket, round(w, 4) as weight from ({SPARSE_SQL})")
def hash_embed_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = embed.features(read_table(spark, sf_dir, "part"), "p_partkey", "p_name")
    return embed.sparse(features, "p_partkey").select("p_partkey", "bucket", F.round("weight", 4).alias("weight"))


@query("hash_embed")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", embed.embed_column(F.col("text"), embed.HashedNGramEmbedder()).alias("vector"))


@query(
    "doc_similarity_join",
    f"""with s as ({SPARSE_SQL}), n as (select p_partkey, sqrt(sum(w * w)) as n from s group by 1),
    v as (select s.p_partkey, bucket, w / n as w from s join n using (p_partkey)),
    p as (select a.p_partkey as query, b.p_partkey as id, round(sum(a.w * b.w), 4) as similarity from v a join v b using (bucket)
      where a.p_partkey % 20 = 0 and a.p_partkey <> b.p_partkey group by 1, 2)
    select query, similarity, rank from (select *, row_number() over (partition by query order by similarity desc, id) as rank from p) where rank <= 5""",
)
def doc_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar names of every twentieth part, among all parts."""
    rows = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), embed.embed_column(F.col("p_name"), embed.HashedNGramEmbedder()).alias("vector"))
    rows = materialize(rows, "part-vectors")
    found = vectors.search(rows.where("id % 20 = 0"), rows, 5, 512, digits=4, exclude_self=True)
    return found.select("query", "similarity", F.col("rank").cast("bigint").alias("rank"))


@query(
    "token_estimate",
    rf"""select doc_id, ceil(0.6::double * length(regexp_replace(text, '[^\x{{2e81}}-\x{{9ffe}}]', '', 'g'))
      + length(regexp_replace(text, '[\x{{2e81}}-\x{{9ffe}}{WS}\x0b]', '', 'g')) / 4)::bigint as tokens from documents""",
)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query("slugify_workspace", "select c_custkey, '--' || regexp_replace(regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9._-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') || '--' as slug from customer")
def slugify_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select("c_custkey", tx.slugify(F.col("c_name")).alias("slug"))


@query(
    "raw_chunks",
    rf"""with w as (select doc_id, regexp_replace(text, '([\x{{10000}}-\x{{10ffff}}])', '\1' || chr(64976), 'g') as t from documents),
    c as (select doc_id, i as chunk_no, regexp_replace(replace(substr(t, i * 580 + 1, 700), chr(64976), ''), '^[{WS}\x0b]+|[{WS}\x0b]+$', '', 'g') as c
      from w, lateral (select unnest(range(0, 1 + greatest(0, ceil((length(t) - 700) / 580.0)::int))) as i) where length(t) > 0)
    select doc_id, chunk_no::bigint as chunk_no, md5(c) as hash from c where length(regexp_replace(c, '[\x{{10000}}-\x{{10ffff}}]', 'xx', 'g')) >= 32""",
)
def raw_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = session.raw_chunks(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunks.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("chunk").alias("hash"))


# ---- the same over whole documents: long, empty, null and non-ASCII texts. SQL has no NFKC, so those that normalise have none

DOCUMENT_WORDS_SQL = "select distinct unnest(string_split(text, ' ')) as word from documents"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("word")).distinct()


@query("documents_fnv1a", f"select word, {fnv_sql('word')} as hash, {fnv_sql('word')} % 512 as bucket from ({DOCUMENT_WORDS_SQL})")
def documents_fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tx.fnv1a(F.col("word"))
    return _document_words(spark, sf_dir).select("word", h.alias("hash"), (h % 512).alias("bucket"))


@query("documents_sign", f"select word, case when {fnv_sql('word || chr(124)')} % 2 = 0 then 1 else -1 end as sign from ({DOCUMENT_WORDS_SQL})")
def documents_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_words(spark, sf_dir).select("word", tx.hash_sign(F.col("word")).alias("sign"))


@query("documents_slug", "select doc_id, '--' || regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') || '--' as slug from documents")
def documents_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@query("documents_normalized")
def documents_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


@query("documents_words")
def documents_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", tx.word_tokens(tx.normalize_text(F.col("text"))).alias("words"))


@query("documents_bigrams")
def documents_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents_words(spark, sf_dir)
    return rows.select("doc_id", F.explode(tx.word_bigrams(F.col("words"))).alias("pair")).groupBy("doc_id", "pair").agg(F.count("*").alias("n"))


@query("documents_ngrams")
def documents_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.ngram_counts(_documents(spark, sf_dir), "doc_id", "text")


@query("documents_features")
def documents_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.features(_documents(spark, sf_dir), "doc_id", "text")


@query("documents_sparse")
def documents_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.sparse(_documents(spark, sf_dir), "doc_id", "text", embed.sparse, digits=4)


@query("documents_similar")
def documents_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar documents to every twentieth one, among all."""
    rows = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), embed.embed_column(F.col("text"), embed.HashedNGramEmbedder()).alias("vector"))
    rows = materialize(rows, "document-vectors")
    found = vectors.search(rows.where("id % 20 = 0"), rows, 5, 512, digits=4, exclude_self=True)
    return found.select("query", "id", "similarity", F.col("rank").cast("bigint").alias("rank"))


# ---- vectors

POOL_SQL = "select vec_id as id, embedding as v from embeddings"
PAIRS_SQL = f"select q.id as query, p.id as id, round(list_dot_product(q.v::double[], p.v::double[]), 6) as similarity from ({POOL_SQL}) q, ({POOL_SQL}) p where q.id % 20 = 0"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("vector_topk", f"select query, id, similarity, rank from (select *, row_number() over (partition by query order by similarity desc, id) as rank from ({PAIRS_SQL})) where rank <= 6")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most similar vectors to every twentieth one."""
    pool = _pool(spark, sf_dir)
    return vectors.search(pool.where("id % 20 = 0"), pool, 6, DIM).withColumn("rank", F.col("rank").cast("bigint"))


@query("max_similarity", f"select query, max(similarity) as similarity from ({PAIRS_SQL}) where query <> id group by 1")
def max_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    return vectors.search(pool.where("id % 20 = 0"), pool, 1, DIM, exclude_self=True).select("query", "similarity")


@query("vector_dot", "select vec_id, round(list_dot_product(embedding::double[], list_reverse(embedding)::double[]), 4) as dot from embeddings")
def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.reverse("embedding")), 4).alias("dot"))


@query("l2_normalize", "select vec_id, round(embedding[1]::double * 3 / sqrt(list_dot_product(list_transform(embedding, lambda x: x::double * 3), list_transform(embedding, lambda x: x::double * 3))), 4) as first from embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.element_at(vectors.l2_normalize(tripled), 1), 4).alias("first"))


@query("dedupe_vs_store", f"select id from ({POOL_SQL}) c where id % 20 = 0 and not exists (select 1 from ({PAIRS_SQL}) p where p.query = c.id and p.id % 20 <> 0 and similarity >= 0.45)")
def dedupe_vs_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    return dedupe.new_to_store(pool.where("id % 20 = 0"), pool.where("id % 20 <> 0"), 0.45, DIM).select("id")


@query(
    "dedupe_greedy",
    f"""with recursive v as ({POOL_SQL}), e as materialized (
      select a.id as a, b.id as b from v a, v b where a.id < b.id and round(list_dot_product(a.v::double[], b.v::double[]), 6) >= 0.45),
    ordered as (select id, row_number() over (order by id) as n from v),
    step(n, kept) as (select 0::bigint, []::bigint[] union all
      select o.n, case when exists (select 1 from e where e.b = o.id and list_contains(s.kept, e.a)) then s.kept else list_append(s.kept, o.id) end
      from step s join ordered o on o.n = s.n + 1)
    select unnest(kept) as id from step where n = (select max(n) from step)""",
)
def dedupe_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.greedy(_pool(spark, sf_dir), 0.45, DIM)


# ---- sessions

LOG_SQL = """select session_id, seq, arg_min(struct_pack(t := "type", d := "data"), coalesce(ingested_at, ts)) as e from session_events
  where session_id is not null and seq is not null group by session_id, seq"""
TEXT_SQL = "coalesce(array_to_string([b.text for b in {} if b.text is not null], ' '), '')"
SURFACE_SQL = f"""select * from (select session_id, seq,
    case when e.t = 'user/message' and e.d.role = 'user' and coalesce(e.d.source.kind, '') <> 'plugin' then 'user'
      when e.t = 'assistant/message' then 'assistant' when e.t = 'tool/result' then 'tool' end as "role",
    case when e.t = 'user/message' then {TEXT_SQL.format('e.d.content')} else {TEXT_SQL.format('e.d.message.content')} end as text
  from ({LOG_SQL})) where "role" is not null and ("role" = 'user' or text <> '')"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.session_log(read_table(spark, sf_dir, "session_events"))


@query("message_text", f"select session_id, seq, md5({TEXT_SQL.format('e.d.content')}) as hash from ({LOG_SQL}) where e.t = 'user/message'")
def message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).where("type = 'user/message'").select("session_id", "seq", F.md5(tx.message_text(F.col("data.content"))).alias("hash"))


@query("human_messages", f"select session_id, seq from ({LOG_SQL}) where e.t = 'user/message' and e.d.role = 'user' and coalesce(e.d.source.kind, '') <> 'plugin'")
def human_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).where("type = 'user/message'")
    return rows.where(tx.is_human(F.col("data.role"), F.col("data.source.kind"))).select("session_id", "seq")


@query("surface_events", f"""select session_id, seq, "role", md5(text) as hash from ({SURFACE_SQL})""")
def surface_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.surface_events(_log(spark, sf_dir)).select("session_id", "seq", "role", F.md5("text").alias("hash"))


@query(
    "event_routing",
    """select route, count(*) as events from (select case when "type" = 'agent/inbox/spliced' then 'inbox_cue' when "type" = 'user/message' then 'user_cue'
      when "type" in ('assistant/message', 'tool/result') then 'touch_store' when "type" = 'turn/end' then 'consolidate'
      when starts_with("type", 'compaction/') then 'force_consolidate' else 'ignore' end as route from session_events) group by 1""",
)
def event_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "session_events").groupBy(session.event_route(F.col("type")).alias("route")).agg(F.count("*").alias("events"))


SPAN_CHARS, SPAN_TOKENS = Config().max_span_chars, Config().capture_token_threshold
SPANS_SQL = rf"""select *, ceil(0.6::double * length(regexp_replace(text, '[^\x{{2e81}}-\x{{9ffe}}]', '', 'g'))
    + length(regexp_replace(text, '[\x{{2e81}}-\x{{9ffe}}{WS}\x0b]', '', 'g')) / 4)::bigint as tokens from (
  select session_id, min(seq) as first_seq, max(seq) as last_seq, count(*) as events, string_agg('[' || "role" || ' @seq ' || seq || '] ' || text, chr(10) || chr(10) order by seq) as text
  from (select *, sum(length(regexp_replace(text, '[\x{{10000}}-\x{{10ffff}}]', 'xx', 'g')) + 8) over (partition by session_id order by seq desc rows unbounded preceding) as used from ({{}})) where used <= {SPAN_CHARS} group by 1)"""
PROGRESS_SQL = 'select session_id, last_captured_seq, min("at") as "at" from (select *, max(last_captured_seq) over (partition by session_id) as m from capture_progress where session_id is not null) where last_captured_seq = m group by 1, 2'


def _span_columns(spans: DataFrame) -> DataFrame:
    return spans.select("session_id", "first_seq", "last_seq", "events", F.md5("text").alias("hash"), F.col("approx_tokens").alias("tokens"))


@query("span_collect", f"select session_id, first_seq, last_seq, events, md5(text) as hash, tokens from ({SPANS_SQL.replace('{}', SURFACE_SQL)})")
def span_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_columns(session.collect_spans(session.surface_events(_log(spark, sf_dir)), SPAN_CHARS))


INCREMENT_SQL = f"select s.* from ({SURFACE_SQL}) s left join ({PROGRESS_SQL}) p using (session_id) where s.seq > coalesce(p.last_captured_seq, -1)"


@query("span_incremental", f"select session_id, first_seq, last_seq, events, md5(text) as hash, tokens from ({SPANS_SQL.replace('{}', INCREMENT_SQL)})")
def span_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = session.capture_progress(read_table(spark, sf_dir, "capture_progress"))
    return _span_columns(session.collect_spans(session.since_capture(session.surface_events(_log(spark, sf_dir)), progress), SPAN_CHARS))


@query(
    "consolidation_trigger",
    f"""with calls as (select session_id, bool_or(starts_with(e.t, 'compaction/')) as forced from ({LOG_SQL}) where e.t = 'turn/end' or starts_with(e.t, 'compaction/') group by 1)
    select session_id, forced, tokens from ({SPANS_SQL.replace('{}', SURFACE_SQL)}) join calls using (session_id) where forced or tokens >= {SPAN_TOKENS}""",
)
def consolidation_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    spans = session.collect_spans(session.surface_events(log), SPAN_CHARS)
    return session.triggered(spans, log, SPAN_TOKENS).select("session_id", "forced", F.col("approx_tokens").alias("tokens"))


@query("capture_progress", PROGRESS_SQL)
def capture_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.capture_progress(read_table(spark, sf_dir, "capture_progress"))


@query(
    "query_cue",
    rf"""with log as ({LOG_SQL}), cues as (
      select session_id, seq, 0 as i, {TEXT_SQL.format('e.d.content')} as t from log where e.t = 'user/message' and e.d.role = 'user' and coalesce(e.d.source.kind, '') <> 'plugin'
      union all select session_id, seq, i - 1, {TEXT_SQL.format('m.content')} from (select session_id, seq, generate_subscripts(e.d.inserted, 1) as i, unnest(e.d.inserted) as m from log where e.t = 'agent/inbox/spliced' and e.d.target = 'next-turn') where m."role" = 'user'),
    ready as (select session_id, seq, i, regexp_replace(t, '^[{WS}\x0b]+|[{WS}\x0b]+$', '', 'g') as t from cues)
    select session_id, seq, md5(substr(t, 1, 1200)) as hash from ready where length(t) >= 2 or (length(t) = 1 and unicode(t) > 65535)
    qualify row_number() over (partition by session_id order by seq desc, i desc, t desc) = 1""",
)
def query_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.query_cues(_log(spark, sf_dir)).select("session_id", "seq", F.md5("query").alias("hash"))


CHUNKS_SQL = rf"""with w as (select session_id, regexp_replace(text, '([\x{{10000}}-\x{{10ffff}}])', '\1' || chr(64976), 'g') as t from ({SPANS_SQL.replace('{}', SURFACE_SQL)})),
    c as (select session_id, i as position, regexp_replace(replace(substr(t, i * 580 + 1, 700), chr(64976), ''), '^[{WS}\x0b]+|[{WS}\x0b]+$', '', 'g') as c
      from w, lateral (select unnest(range(0, 1 + greatest(0, ceil((length(t) - 700) / 580.0)::int))) as i) where length(t) > 0)
    select session_id, position::int as position, 'raw' as kind, md5(c) as hash from c where length(regexp_replace(c, '[\x{{10000}}-\x{{10ffff}}]', 'xx', 'g')) >= 32"""


@query("consolidate_raw", CHUNKS_SQL)
def consolidate_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions' spans cut into raw candidates."""
    spans = session.collect_spans(session.surface_events(_log(spark, sf_dir)))
    return extract.extract(spans, mode="raw").select("session_id", "position", "kind", F.md5("text").alias("hash"))


# ---- items

ITEM_SQL = """select id, arg_max(struct_pack(kind := kind, text := text, tags := tags, importance := importance, created_at := created_at, access_count := access_count), ingested_at) as i
  from memory_item where id is not null group by id"""
NORMAL_SQL = rf"""select id, case when i.kind in ('fact', 'decision', 'preference', 'error-fix', 'task', 'file-change', 'summary', 'raw') then i.kind else 'fact' end as kind,
    least(1.0, greatest(0.0, case when i.importance is null or isnan(i.importance) or i.importance = 0 then 0.5 else i.importance end)) as importance,
    coalesce(len(i.tags[1:12]), 0) as tags, regexp_replace(i.text, '^[{WS}\x0b]+|[{WS}\x0b]+$', '', 'g') as text, i.created_at as created_at, i.access_count as access_count from ({ITEM_SQL})"""
STORED_SQL = rf"select * from ({NORMAL_SQL}) where length(regexp_replace(text, '[\x{{10000}}-\x{{10ffff}}]', 'xx', 'g')) >= 8"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.normalize_items(items.latest_items(read_table(spark, sf_dir, "memory_item")))


@query("normalize_item", f"select id, kind, importance, tags, md5(text) as hash from ({STORED_SQL})")
def normalize_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("id", "kind", "importance", F.size("tags").cast("bigint").alias("tags"), F.md5("text").alias("hash"))


RECENCY_SQL = f"exp(-greatest(0, ({AS_OF} - created_at))::double / 604800000.0)"
STRENGTH_SQL = "(1 - exp(-access_count / 3.0))"
REACH_SQL = f"((0.55::double * 0.3::double + 0.25::double * {RECENCY_SQL} + 0.2::double * importance) * (0.5::double + 0.5::double * {STRENGTH_SQL}))"


@query("recency_decay", f"select id, round({RECENCY_SQL}, 6) as recency from ({STORED_SQL})")
def recency_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("id", F.round(score.recency(F.col("created_at"), F.lit(AS_OF)), 6).alias("recency"))


@query("rehearsal_strength", f"select id, round({STRENGTH_SQL}, 6) as strength from ({STORED_SQL})")
def rehearsal_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("id", F.round(score.strength(F.col("access_count")), 6).alias("strength"))


@query("accessibility_score", f"select id, round({REACH_SQL}, 6) as score from ({STORED_SQL})")
def accessibility_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach = score.accessibility(F.lit(0.3), F.col("created_at"), F.col("importance"), F.col("access_count"), F.lit(AS_OF))
    return _items(spark, sf_dir).select("id", F.round(reach, 6).alias("score"))


@query("evict_candidates", f"select id, round({REACH_SQL}, 6) as score from ({STORED_SQL}) where {REACH_SQL} is not null order by 2, 1 limit 25")
def evict_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 least reachable items."""
    return items.evict_candidates(_items(spark, sf_dir), AS_OF, 25)


@query("store_stats", f"select coalesce(kind, '*') as kind, count(*) as items from ({STORED_SQL}) group by rollup (kind)")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.store_stats(_items(spark, sf_dir))


OPLOG_SQL = """with lines as (select line_no, op, case when op = 'add' then item.id else "id" end as k, item, "at" as t, "count" as c from items_log where v = 1 and op in ('add', 'touch', 'remove')),
    adds as (select k, max(line_no) as a, arg_max(item, line_no) as item from lines where op = 'add' and k is not null group by k),
    gone as (select k, max(line_no) as r from lines where op = 'remove' group by k),
    touches as (select l.k, arg_max(struct_pack(t := l.t, c := l.c), line_no) as x from lines l join adds using (k) where l.op = 'touch' and l.line_no > adds.a group by l.k)
    select adds.k as id, case when touches.k is null then item.last_access_at else x.t end as last_access_at, case when touches.k is null then item.access_count else x.c end as access_count
    from adds left join gone using (k) left join touches using (k) where r is null or a > r"""


@query("oplog_replay", OPLOG_SQL)
def oplog_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.replay(read_table(spark, sf_dir, "items_log")).drop("item")


USABLE_SQL = "select id, arg_min(vector, row_no) as v from vector_index where id is not null and len(vector) = 512 and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 group by id"


@query("index_rebuild", f"select id from ({STORED_SQL}) where id not in (select id from ({USABLE_SQL}))")
def index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that lack a usable vector and must be embedded."""
    return items.missing_vectors(_items(spark, sf_dir), read_table(spark, sf_dir, "vector_index")).select("id")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first usable vector of each id."""
    usable = read_table(spark, sf_dir, "vector_index").where((F.size("vector") == 512) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    return usable.where("id is not null").groupBy("id").agg(F.min_by("vector", "row_no").alias("vector"))


RECALL_SQL = f"""with v as ({USABLE_SQL}),
    hits as (select q.id as query, v.id, round(list_dot_product(q.v::double[], v.v::double[]), 6) as similarity from v q, v where ('0x' || right(q.id, 8))::bigint % 20 = 0),
    cut as (select *, row_number() over (partition by query order by similarity desc, id) as r from hits qualify r <= 32),
    s as (select query, cut.id, similarity, r, kind, importance, created_at, access_count, text,
      round((0.55::double * similarity + 0.25::double * {RECENCY_SQL} + 0.2::double * importance) * (0.5::double + 0.5::double * {STRENGTH_SQL}), 6) as accessibility
      from cut join ({STORED_SQL}) i on i.id = cut.id where similarity >= 0.24)
    select *, row_number() over (partition by query order by accessibility desc, r) as rank from s qualify rank <= 6"""


def _recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalls for a stated query set: the stored vectors whose id (its last 32 bits) is divisible by 20, against all."""
    index = materialize(_index(spark, sf_dir), "usable-vectors")
    known = _items(spark, sf_dir).select("id", "kind", "text", "importance", "created_at", "access_count")
    return recall.recall(index.where("conv(right(id, 8), 16, 10) % 20 = 0"), index, known, AS_OF, Config())


@query("recall_topk", f"select query, id, similarity, accessibility, rank from ({RECALL_SQL})")
def recall_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recalled(spark, sf_dir).select("query", "id", "similarity", "accessibility", F.col("rank").cast("bigint").alias("rank"))


@query(
    "recall_render",
    f"""select query, rank, kind, floor(similarity * 100 + 0.5)::bigint as rel, floor(importance * 10 + 0.5)::bigint as importance,
      floor(greatest(0, ({AS_OF} - created_at) / 86400000.0) * 10 + 0.5)::bigint as age, access_count as rehearsed from ({RECALL_SQL})""",
)
def recall_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each rendered line."""
    line = r"^- \[([^|]+) \| rel ([0-9.]+) \| importance ([0-9.]+) \| ([0-9.]+)d old \| rehearsed (\d+)×\] "
    lines = recall.render(_recalled(spark, sf_dir), AS_OF).select("query", F.posexplode(F.split("text", r"\n(?=- \[)")).alias("rank", "line")).where("rank > 0")

    def part(i: int, digits: int) -> F.Column:
        return F.round(F.regexp_extract("line", line, i).cast("double") * 10**digits).cast("bigint")

    return lines.select("query", F.col("rank").cast("bigint").alias("rank"), F.regexp_extract("line", line, 1).alias("kind"), part(2, 2).alias("rel"), part(3, 1).alias("importance"), part(4, 1).alias("age"), part(5, 0).alias("rehearsed"))


@query("rehearsal_apply", f"""select i.id, count(*) + any_value(i.access_count) as "count" from ({RECALL_SQL}) r join ({STORED_SQL}) i on i.id = r.id group by i.id""")
def rehearsal_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touches after every query of the set was recalled twice: the repeat changes nothing."""
    recalled = materialize(_recalled(spark, sf_dir), "recalled")
    ranked = recalled.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r"))
    once = ranked.select(F.col("query").alias("session_id"), "query", F.transform("r", lambda x: x["id"]).alias("ids"))
    twice = once.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    return items.rehearse(_items(spark, sf_dir), twice, AS_OF).select("id", "count")


# ---- extraction

@query(
    "parse_extraction",
    rf"""select id, row_number() over (partition by id order by ingested_at) * 0 as position, coalesce(kind, 'fact') as kind, md5(regexp_replace(text, '^[{WS}\x0b]+|[{WS}\x0b]+$', '', 'g')) as hash from memory_item
      where id is not null and length(regexp_replace(regexp_replace(text, '^[{WS}\x0b]+|[{WS}\x0b]+$', '', 'g'), '[\x{{10000}}-\x{{10ffff}}]', 'xx', 'g')) >= 8""",
)
def parse_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item as a model would answer it, in a fenced block, parsed back."""
    rows = read_table(spark, sf_dir, "memory_item").where("id is not null")
    answer = F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct("kind", "text", "tags"))), F.lit("\n```"))
    parsed = rows.select("id", F.posexplode(extract.parse_extraction(answer)).alias("position", "c"))
    return parsed.select("id", F.col("position").cast("bigint").alias("position"), "c.kind", F.md5("c.text").alias("hash"))


GREEDY_SQL = """with recursive v as ({rows}), e as materialized (
      select a.g as g, a.n as a, b.n as b from v a join v b on a.g = b.g and a.n < b.n and round(list_dot_product(a.v::double[], b.v::double[]), 6) >= {limit}),
    step(g, n, kept) as (select distinct g, 0::bigint, []::bigint[] from v union all
      select v.g, v.n, case when exists (select 1 from e where e.g = v.g and e.b = v.n and list_contains(s.kept, e.a)) then s.kept else list_append(s.kept, v.n) end
      from step s join v on v.g = s.g and v.n = s.n + 1),
    last as (select g, max_by(kept, n) as kept from step group by g)
    select v.* from v join last on last.g = v.g where list_contains(last.kept, v.n)"""
ADDED_SQL = GREEDY_SQL.format(
    rows=f"select 0 as g, row_number() over (order by s.id) as n, s.id, u.v from ({STORED_SQL}) s join ({USABLE_SQL}) u on u.id = s.id",
    limit=Config().dedupe_similarity,
)


@query("memory_add", f"select id from ({ADDED_SQL})")
def memory_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable items added to an empty store: what greedy deduplication keeps, by stored vectors."""
    rows = _items(spark, sf_dir).join(_index(spark, sf_dir), "id").select("id", "vector")
    return dedupe.greedy(rows, Config().dedupe_similarity, 512)


# ---- the store: adding, and what a session's next request is given

WIDE, NARROW = "".join(map(chr, (*range(0xFF01, 0xFF5F), 0xA0, 0x3000))), "".join(map(chr, (*range(0x21, 0x7F), 0x20, 0x20)))


def embed_sql(texts: str) -> str:
    """``(k, v)``: embeddings of ``texts`` ``(k, t)`` in SQL. It has no NFKC; full-width forms and spaces,
    which the tables have, are mapped one by one."""
    wide, narrow = WIDE.replace("'", "''"), NARROW.replace("'", "''")
    return f"""with x as (select distinct k, lower(translate(t, '{wide}', '{narrow}')) as t from ({texts})),
      w as (select k, regexp_extract_all(t, '[a-z0-9_]{{3,}}') as ws from x),
      f as (select k, substr(t, i, n) as gram, 1 as c from x, unnest(range(1, 5)) a(n), lateral (select unnest(range(1, length(t) - n + 2)) as i)
        union all select k, 'w:' || unnest(ws), 2 from w
        union all select k, 'wb:' || ws[i] || ' ' || ws[i + 1], 3 from (select k, ws, unnest(range(1, len(ws))) as i from w)),
      counts as (select k, gram, sum(c) as c from f group by all),
      h as (select gram, {fnv_sql('gram')} as h from (select distinct gram from counts)),
      b as (select k, h % 512 as bucket, sum(case when h % 2 = 0 then 1 else -1 end * (1 + 0.5::double * ln(1 + c))) as w from counts join h using (gram) group by all),
      m as (select k, map_from_entries(list((bucket, w))) as m, sqrt(sum(w * w)) as n from b group by k)
      select k, list_transform(range(512), lambda i: (coalesce(m[i], 0) / n)::float) as v from m"""


CANDIDATES_SQL = rf"""select item_id, workspace, text, first, kind, importance, tags, sha256(concat_ws(chr(31), workspace, text, first::varchar)) as id from (
    select n.* exclude (id), n.id as item_id, coalesce(o.workspace, '') as workspace, coalesce(o.first, 0) as first from ({STORED_SQL}) n
    join (select id, arg_max(workspace, ingested_at) as workspace, arg_max(source_seqs[1], ingested_at) as first from memory_item where id is not null group by id) o on o.id = n.id)"""
STORE_SQL = GREEDY_SQL.format(
    rows=f"""select c.workspace as g, row_number() over (partition by c.workspace order by printf('%020d/%s', c.first, c.id)) as n, c.id, c.text, c.kind, c.importance, e.v
      from (select id, any_value(workspace) as workspace, any_value(text) as text, any_value(first) as first, arg_min(kind, item_id) as kind, arg_min(importance, item_id) as importance from ({CANDIDATES_SQL}) group by id) c
      join ({embed_sql(f"select id as k, text as t from ({CANDIDATES_SQL})")}) e on e.k = c.id""",
    limit=Config().dedupe_similarity,
)


def _filled_store(spark: SparkSession, sf_dir: str) -> tuple[MemoryStore, DataFrame]:
    """A store of all workspaces, to which all items of the table were added."""
    store = MemoryStore(spark, config=Config.of({"storage_root": scratch_path(spark, "store")}))
    # copies of one candidate may differ in kind and importance; that of the smallest id is added
    rows = items.latest_items(read_table(spark, sf_dir, "memory_item"))
    same = rows.groupBy("workspace", tx.trim(F.col("text")).alias("_t"), F.coalesce(F.get("source_seqs", 0), F.lit(0)).alias("_f"))
    candidates = same.agg(F.min_by(F.struct("kind", "text", "importance", "tags", "source_seqs"), "id").alias("c")).select("workspace", "c.*")
    return store, store.add(candidates, AS_OF)


@query("store_add", f"select g as workspace, id, md5(text) as hash from ({STORE_SQL})")
def store_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items added to an empty store: normalised, embedded, and kept where their workspace has nothing like them."""
    return _filled_store(spark, sf_dir)[1].select("workspace", "id", F.md5("text").alias("hash"))


DAY = 86_400_000
CUES_SQL = rf"""with log as ({LOG_SQL}), cues as (
      select session_id, seq, 0 as i, {TEXT_SQL.format('e.d.content')} as t from log where e.t = 'user/message' and e.d.role = 'user' and coalesce(e.d.source.kind, '') <> 'plugin'
      union all select session_id, seq, i - 1, {TEXT_SQL.format('m.content')} from (select session_id, seq, generate_subscripts(e.d.inserted, 1) as i, unnest(e.d.inserted) as m from log where e.t = 'agent/inbox/spliced' and e.d.target = 'next-turn') where m."role" = 'user'),
    ready as (select session_id, seq, i, regexp_replace(t, '^[{WS}]+|[{WS}]+$', '', 'g') as t from cues),
    homes as (select session_id, coalesce(arg_min(workspace, seq), '') as workspace from session_events where session_id is not null and seq is not null and workspace is not null group by 1)
    select session_id, workspace, substr(t, 1, 1200) as t from ready join homes using (session_id) where length(t) >= 2 or (length(t) = 1 and unicode(t) > 65535)
    qualify row_number() over (partition by session_id order by seq desc, i desc, t desc) = 1"""
CONTEXT_SQL = f"""with cues as materialized ({CUES_SQL}), kept as materialized ({STORE_SQL}),
    q as (select session_id, workspace, v from cues join ({embed_sql('select session_id as k, t from cues')}) e on e.k = session_id),
    hits as (select session_id, id, kind, text, importance, round(list_dot_product(q.v::double[], kept.v::double[]), 6) as s from q join kept on kept.g = q.workspace),
    cut as (select *, row_number() over (partition by session_id order by s desc, id) as r from hits qualify r <= 32),
    reach as (select *, round((0.55::double * s + 0.25::double * exp(-{DAY} / 604800000.0) + 0.2::double * importance) * 0.5::double, 6) as a from cut where s >= 0.24),
    ranked as (select *, row_number() over (partition by session_id order by a desc, r) as n from reach qualify n <= 6)
    select session_id, md5('{recall.HEADER}' || chr(10) || string_agg(printf('- [%s | rel %.2f | importance %.1f | 1.0d old | rehearsed 0×] %s', kind, floor(s * 100 + 0.5) / 100, floor(importance * 10 + 0.5) / 10, text), chr(10) order by n)) as hash,
      string_agg(id, ',' order by n) as ids from ranked group by session_id"""


@query("store_recall", CONTEXT_SQL)
def store_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that every session's next request is given, a day after all items were added to the store:
    its latest cue recalls from the store of its workspace."""
    store, _ = _filled_store(spark, sf_dir)
    shown = store.context(_log(spark, sf_dir), AS_OF + DAY)
    return shown.select("session_id", F.md5("text").alias("hash"), F.array_join("ids", ",").alias("ids"))
