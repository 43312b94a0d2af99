import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnesis.config import Config
from mnesis.functions import embed, score, vectors
from mnesis.operators import dedupe
from mnesis.plans import reference_queries


def test_embedder_agrees_with_its_sql_form_and_is_signed_by_parity(spark):
    texts = ["Short text one", "über 中文 😀 mixed_text", "a", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    model = embed.HashedNGramEmbedder(512)
    dense = model.embed(texts)
    sums = np.zeros((len(texts), 512))
    for r in embed.sparse(embed.features(rows, "id", "t"), "id").collect():
        sums[r.id, r.bucket] = r.weight
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    assert np.allclose(dense, sums / np.where(norm > 0, norm, 1), atol=1e-6)
    assert (dense[:, ::2] >= 0).all() and (dense[:, 1::2] <= 0).all() and not dense[3].any()
    udf = rows.select("id", embed.embed_column(F.col("t"), model).alias("v")).orderBy("id").collect()
    assert np.allclose([r.v for r in udf], dense)


def test_search_equals_brute_force_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vector array<float>")
    rows = rows.unionByName(spark.createDataFrame([(90, None), (91, [1.0]), (92, [float("nan")] * 8)], "id bigint, vector array<float>"))
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 8 * 10)
    got = {(r.query, r.id, r["rank"]) for r in vectors.search(rows.where("id < 25"), rows, 4, 8, exclude_self=True).collect()}
    s = np.round(x.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T, 6)
    np.fill_diagonal(s, -np.inf)
    want = {(q, int(i), k + 1) for q in range(25) for k, i in enumerate(np.lexsort((np.arange(60), -s[q]))[:4])}
    assert got == want


def test_greedy_equals_taking_rows_in_order(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vector array<double>")
    s, kept = np.round(x @ x.T, 6), []
    for i in range(80):
        if not kept or s[i, kept].max() < 0.8:
            kept.append(i)
    assert sorted(r.id for r in dedupe.greedy(rows, 0.8, 3).collect()) == kept
    empty = spark.createDataFrame([], "id bigint, vector array<double>")
    assert dedupe.greedy(empty, 0.8, 3).count() == 0
    assert dedupe.new_to_store(rows, empty, 0.8, 3).count() == 80


def test_memory_add_rejects_at_the_default_similarity(spark, sf):
    rows = reference_queries._items(spark, sf).join(reference_queries._index(spark, sf), "id").select("id", "vector").collect()
    ids, x = zip(*sorted((r.id, r.vector) for r in rows))
    s, kept = np.round(np.array(x, dtype=float) @ np.array(x, dtype=float).T, 6), []
    for i in range(len(ids)):
        if not kept or s[i, kept].max() < Config().dedupe_similarity:
            kept.append(i)
    assert sorted(r.id for r in entry.queries()["memory_add"](spark, sf).collect()) == [ids[i] for i in kept]
    assert len(kept) < len(ids)


def test_scores(spark):
    week = 168 * 3_600_000
    rows = spark.createDataFrame([(0, 0.0, 0), (-week, 1.0, 3), (week, 0.5, 0)], "c bigint, i double, n int")
    r = rows.select(
        F.round(score.recency(F.col("c"), F.lit(0)), 6).alias("r"),
        F.round(score.strength(F.col("n")), 6).alias("s"),
        F.round(score.accessibility(F.lit(1.0), F.col("c"), F.col("i"), F.col("n"), F.lit(0)), 6).alias("a"),
    ).collect()
    assert [x.r for x in r] == [1.0, round(np.exp(-1), 6), 1.0]
    assert [x.s for x in r] == [0.0, round(1 - np.exp(-1), 6), 0.0]
    assert r[0].a == 0.4 and r[2].a == 0.45
