"""JSON lines with line numbers, appended and read back; single JSON documents with a fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnesis.functions import text as tx


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` of the text files at ``path``, from 1, in order of file and place.

    Files are split like any others. Within a split, lines come in order; the number of a line is its
    place in the split plus the lines of all splits before, which are summed from one row a split.
    """
    place = ["_file", "_block"]
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy(*place).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    bases = splits.select(*place, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_base"))
    return lines.join(bases, place).select((F.col("_base") + F.col("_at")).alias("line_no"), "line")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Objects of JSON-lines files with ``line_no`` (see :func:`numbered_lines`); blank and corrupt lines and
    ``null`` are skipped. A missing file gives no rows."""
    from mnesis.workspace import exists

    if not exists(spark, path):
        empty = spark.createDataFrame([], schema)
        return empty.withColumn("line_no", F.lit(None).cast("bigint"))
    parsed = numbered_lines(spark, path).select("line_no", tx.trim(F.col("line")).alias("line")).where("line <> ''")
    ok = F.try_parse_json("line")
    return (
        parsed.where(ok.isNotNull() & F.col("line").startswith("{"))
        .select(F.from_json("line", schema).alias("o"), "line_no")
        .where("o is not null")
        .select("o.*", "line_no")
    )


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines (a new part file in the folder ``path``)."""
    rows.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, fallback: dict | None = None) -> dict | None:
    """One JSON document as a dictionary; ``fallback`` where it is missing or corrupt."""
    from mnesis.workspace import exists

    if not exists(spark, path):
        return fallback
    row = spark.read.text(path, wholetext=True).where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("o")).first()
    return row.o.asDict(recursive=True) if row and row.o is not None else fallback
