"""Dropping what is already remembered: against the store, and greedily within a batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions import vectors as vx
from mnesis.workspace import materialize

#: Rows of a group that are decided in one round.
ROUND_ROWS = 4096


def new_to_store(candidates: DataFrame, store: DataFrame, threshold: float, dim: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Candidates (id, vector, ...) whose largest similarity to the store (of the same ``by``) is below ``threshold``."""
    known = vx.search(candidates.select(*by, "id", "vector"), store.select(*by, "id", "vector"), 1, dim, by=by)
    return candidates.join(known.where(F.col("similarity") >= threshold).select(F.col("query").alias("id")), "id", "left_anti")


def _accept(threshold: float, dim: int):
    """Take the rows of a group in order of id, and mark those that are kept; rows without a usable vector are."""

    def accept(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable", ignore_index=True)
        x, at = vx.matrix(part["vector"], dim)
        keep = np.ones(len(part), bool)
        dropped = np.zeros(len(x), bool)
        for first in range(0, len(x), vx.TILE):  # rows of a tile against themselves and all after
            near = np.round(x[first : first + vx.TILE] @ x[first:].T, 6) >= threshold
            for i in range(len(near)):
                if not dropped[first + i]:
                    dropped[first + i + 1 :] |= near[i, i + 1 :]
        keep[at[dropped]] = False
        return part.assign(_kept=keep)

    return accept


def greedy(rows: DataFrame, threshold: float, dim: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Ids that stay when the rows of each group ``by`` are taken in order of id and each is dropped if
    an accepted earlier one is at ``threshold`` or above. Ids are unique, over all groups.

    In rounds: the next ``ROUND_ROWS`` rows of every group (a rank limit before the shuffle) are decided
    in one task a group, then all rows after them are compared, in blocks, with those that were
    accepted. No pair is ever stored. A round accepts or drops all it takes, so there are about as many
    rounds as accepted rows of the largest group over ``ROUND_ROWS``; every round is written out.
    """
    keys = list(by) or ["_all"]
    waiting = rows.select(*by, "id", "vector")
    if not by:
        waiting = waiting.withColumn("_all", F.lit(0))
    accepted = None
    while True:
        first = Window.partitionBy(*keys).orderBy("id")
        ranked = waiting.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= ROUND_ROWS).drop("_n")
        marked = ranked.groupBy(*keys).applyInPandas(_accept(threshold, dim), f"{ranked._jdf.schema().toDDL()}, _kept boolean")
        taken = materialize(marked, "greedy-round")
        kept = taken.where("_kept").drop("_kept")
        ids = kept.select("id")
        accepted = ids if accepted is None else accepted.unionByName(ids)
        ends = taken.groupBy(*keys).agg(F.max("id").alias("_end"), F.count("*").alias("_n")).where(F.col("_n") >= ROUND_ROWS)
        if ends.isEmpty():
            return accepted
        later = waiting.join(ends.drop("_n"), keys).where(F.col("id") > F.col("_end")).drop("_end")
        waiting = materialize(new_to_store(later, kept, threshold, dim, tuple(keys)), "undecided")
        if waiting.isEmpty():
            return accepted
