"""Recall: exact search, re-ranking by accessibility, and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnesis.config import Config
from mnesis.functions import score, vectors

#: The first line of what is injected, and the name it is injected under.
HEADER = "Recalled long-term memories (retrieved by semantic relevance; use them when they bear on the current task, ignore otherwise):"
CONTRIBUTION = "memory:bionic-recall"


def recall(queries: DataFrame, index: DataFrame, items: DataFrame, as_of: int, config: Config = Config(), by: tuple[str, ...] = ()) -> DataFrame:
    """The items each query recalls: ``(query, id, similarity, accessibility, rank, <item columns>)``.

    ``queries`` and ``index`` are ``(id, vector)``, with the columns ``by`` in which they must agree.

    Two stages: the ``config.candidates`` most similar vectors; of those, items at the least similarity
    or above, ranked by accessibility, the first ``top_k``. An item outside the first cut can't return.
    """
    hits = vectors.search(queries, index, config.candidates, config.embed_dim, by=by).withColumnRenamed("rank", "similarity_rank")
    reach = score.accessibility(F.col("similarity"), F.col("created_at"), F.col("importance"), F.col("access_count"), F.lit(as_of), config.half_life_hours)
    order = Window.partitionBy("query").orderBy(F.col("accessibility").desc(), "similarity_rank")
    return (
        hits.where(F.col("similarity") >= config.min_similarity)
        .join(items, "id")
        .withColumn("accessibility", F.round(reach, 6))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= config.top_k)
        .drop("similarity_rank")
    )


def fixed(x, digits: int):
    """A number with so many decimals, halves rounded up."""
    return F.format_string(f"%.{digits}f", F.floor(x * 10**digits + 0.5) / 10**digits)


def render(recalled: DataFrame, as_of: int) -> DataFrame:
    """One text for each query, ``(query, text, ids)``: a header and a line for each item in rank order."""
    days = F.greatest(F.lit(0.0), (F.lit(as_of) - F.col("created_at")) / F.lit(86_400_000.0))
    line = F.concat(
        F.lit("- ["), "kind", F.lit(" | rel "), fixed(F.col("similarity"), 2), F.lit(" | importance "), fixed(F.col("importance"), 1),
        F.lit(" | "), fixed(days, 1), F.lit("d old | rehearsed "), F.col("access_count").cast("string"), F.lit("×] "), "text",
    )
    ranked = recalled.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), "id"))).alias("r"))
    lines = F.transform("r", lambda x: x["line"])
    return ranked.select("query", F.concat_ws("\n", F.lit(HEADER), F.array_join(lines, "\n")).alias("text"), F.transform("r", lambda x: x["id"]).alias("ids"))
