"""Vectors: products and norms as columns, and exact search of a stated query set."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of queries that are broadcast, at most.
BLOCK_BYTES = 64 << 20
#: Rows of one side in a block of a block join (about), and rows multiplied with such a block at a time.
BLOCK_ROWS, TILE = 4096, 1024


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(v.cast("array<double>"))


def matrix(column: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable vectors (of ``dim`` finite numbers) as rows, and their places."""
    at = np.array([i for i, v in enumerate(column) if v is not None and len(v) == dim], dtype=int)
    if not len(at):
        return np.zeros((0, dim)), at
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column.iloc[at]])
    finite = np.isfinite(x).all(axis=1)
    return x[finite], at[finite]


def best_of(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores of each row; ties go to the smaller id."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -scores, rows))
    r = rows[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    place = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
    return order[place < k]


def _scan(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, digits: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query place, id and similarity of the ``k`` best rows of ``x`` for each query."""
    s = np.round(q @ x.T, digits)
    if exclude_self:
        s[q_ids[:, None] == x_ids[None]] = -np.inf
    if s.shape[1] > k:  # all that reach the k-th highest, ties and all
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))
    else:
        i, j = np.nonzero(np.isfinite(s))
    keep = best_of(i, x_ids[j], s[i, j], k)
    return i[keep], x_ids[j[keep]], s[i[keep], j[keep]]


def block_join(left: DataFrame, right: DataFrame, by: tuple[str, ...], compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``compare`` of every block of ``left`` with every block of ``right`` under the same ``by``.

    Rows (by, id, vector) of one group are cut by a hash of the id into blocks of about ``BLOCK_ROWS``; a
    row travels to as many tasks as the other side has blocks. Nothing goes through the driver, and a
    hot group is many tasks.
    """
    keys = list(by) or ["_all"]
    # aliases, because both sides may be the same table
    sides = [df.select(*[F.col(c).alias(c) for c in (*by, "id", "vector")], *([] if by else [F.lit(0).alias("_all")])) for df in (left, right)]
    counts = [df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name)) for df, name in zip(sides, ("_lefts", "_rights"))]
    sizes = counts[0].join(counts[1], keys)

    def cut(df: DataFrame, own: str, own_count: str, other: str, other_count: str) -> DataFrame:
        return (
            df.join(sizes, keys)
            .withColumn(own, F.pmod(F.xxhash64("id", F.lit(29)), F.col(own_count)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)))
            .drop("_lefts", "_rights")
        )

    a, b = cut(sides[0], "_l", "_lefts", "_r", "_rights"), cut(sides[1], "_r", "_rights", "_l", "_lefts")
    return a.groupBy(*keys, "_l", "_r").cogroup(b.groupBy(*keys, "_l", "_r")).applyInPandas(compare, schema)


def search(queries: DataFrame, vectors: DataFrame, k: int, dim: int, digits: int = 6, exclude_self: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` vectors of largest dot product for each query: ``(query, id, similarity, rank)``.

    ``queries`` (id, vector) are compared with all ``vectors`` (id, vector) that agree in the columns
    ``by``. Without ``by``, queries that fit ``BLOCK_BYTES`` (their count is checked first) are broadcast
    and multiplied with the vectors where they lie; more of them, or groups, go through
    :func:`block_join`. Either way a task keeps k rows for each query, so few rows are ranked in the
    end. Similarities are rounded, ties go to the smaller id. Vectors that are null, of another length
    or not finite take no part.
    """
    spark = vectors.sparkSession
    kinds = dict(queries.dtypes)["id"], dict(vectors.dtypes)["id"]
    schema = f"query {kinds[0]}, id {kinds[1]}, similarity double"
    most = max(1, BLOCK_BYTES // (8 * dim))
    small = [] if by else queries.select("id", "vector").limit(most + 1).toPandas()
    if len(small) and len(small) <= most:
        q, at = matrix(small["vector"], dim)
        shared = spark.sparkContext.broadcast((small["id"].to_numpy()[at], q))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            rows, found, scores = np.zeros(0, int), None, np.zeros(0)
            for batch in batches:
                x, place = matrix(batch["vector"], dim)
                if not len(x) or not len(q):
                    continue
                i, own, s = _scan(q, ids, x, batch["id"].to_numpy()[place], k, digits, exclude_self)
                rows, scores = np.r_[rows, i], np.r_[scores, s]
                found = own if found is None else np.concatenate([found, own])
                keep = best_of(rows, found, scores, k)
                rows, found, scores = rows[keep], found[keep], scores[keep]
            if found is not None:
                yield pd.DataFrame({"query": ids[rows], "id": found, "similarity": scores})

        found = vectors.select("id", "vector").mapInPandas(scan, schema)
    elif not by and not len(small):
        found = spark.createDataFrame([], schema)
    else:

        def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            q, at = matrix(a["vector"], dim)
            x, place = matrix(b["vector"], dim)
            ids, out = a["id"].to_numpy()[at], []
            for first in range(0, len(q) if len(x) else 0, TILE):
                i, own, s = _scan(q[first : first + TILE], ids[first : first + TILE], x, b["id"].to_numpy()[place], k, digits, exclude_self)
                out.append(pd.DataFrame({"query": ids[first + i], "id": own, "similarity": s}))
            return pd.concat(out) if out else pd.DataFrame({"query": a["id"][:0], "id": b["id"][:0], "similarity": np.zeros(0)})

        found = block_join(queries, vectors, by, compare, schema)
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
