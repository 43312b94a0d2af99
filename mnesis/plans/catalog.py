"""The core's queries by name, each with the SQL that must give the same rows where SQL can.

A query is ``(spark, sf_dir) -> DataFrame``. Modules of this package add theirs to ``QUERIES`` and
``ORACLES`` with :func:`query`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnesis.operators.changelog import apply_changes
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


REPLAY_SQL = """
with changes as (
  select op, case when op = 'add' then item.id else "id" end as k,
         case when op = 'add' then coalesce(item.created_at, "at") else "at" end as t,
         case when op = 'add' then item.access_count when op = 'touch' then "count" end as c,
         line_no as l, item.last_access_at as a
  from items_log where v = 1 and op in ('add', 'touch', 'remove')
), firsts as (
  select op, k, t, c, min(l) as l, arg_min(a, l) as a from changes
  where k is not null and t is not null group by op, k, t, c
), life as (
  select * from firsts where op <> 'touch' qualify row_number() over (partition by k order by t desc, l desc) = 1
), touch as (
  select * from firsts where op = 'touch' qualify row_number() over (partition by k order by t desc, l desc) = 1
)
select life.k as "id",
       case when touch.t > life.t or (touch.t = life.t and touch.l > life.l) then touch.c else life.c end as "count",
       case when touch.t > life.t or (touch.t = life.t and touch.l > life.l) then touch.t else life.a end as "at"
from life left join touch on life.k = touch.k where life.op = 'add'
"""


@query("p2_found", REPLAY_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items alive at the end of the feed."""
    return apply_changes(read_table(spark, sf_dir, "items_log"))
