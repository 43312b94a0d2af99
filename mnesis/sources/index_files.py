"""Vector indexes: as raw little-endian single floats with a manifest, and checked on reading."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnesis.workspace import exists

#: Bytes written at a time.
WRITE_BYTES = 1 << 20
SCHEMA = "id string, row_no bigint, vector array<float>"


def read_index(spark: SparkSession, folder: str, dim: int = 512) -> DataFrame | None:
    """Rows of ``index.bin`` with the ids of ``index.json``; None where either is missing, of another
    version or dimension, corrupt, or where their lengths don't agree.

    The binary file is read in records of one vector each, split over tasks; the manifest's ids are
    joined by row number, so neither passes through the driver but for the manifest's head.
    """
    manifest_path, bin_path = f"{folder}/index.json", f"{folder}/index.bin"
    if not (exists(spark, manifest_path) and exists(spark, bin_path)):
        return None
    manifest = (
        spark.read.text(manifest_path, wholetext=True)
        .where(F.try_parse_json("value").isNotNull())
        .select(F.from_json("value", "v int, dim int, ids array<string>").alias("m"))
        .select("m.*")
    )
    head = manifest.select("v", "dim", F.size("ids").alias("n")).first()
    length = spark.read.format("binaryFile").load(bin_path).select("length").first()[0]
    if head is None or head.v != 1 or head.dim != dim or head.n < 0 or length != head.n * dim * 4:
        return None
    ids = manifest.select(F.posexplode("ids").alias("row_no", "id")).select(F.col("row_no").cast("bigint"), "id")
    if not head.n:
        return spark.createDataFrame([], SCHEMA)

    records = spark.sparkContext.binaryRecords(bin_path, dim * 4).zipWithIndex()
    raw = spark.createDataFrame(records.map(lambda x: (x[1], bytearray(x[0]))), "row_no bigint, raw binary")

    def floats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row_no": batch["row_no"], "vector": [np.frombuffer(b, "<f4") for b in batch["raw"]]})

    return raw.mapInPandas(floats, "row_no bigint, vector array<float>").join(ids, "row_no").select("id", "row_no", "vector")


def write_index(vectors: DataFrame, folder: str, dim: int = 512) -> None:
    """Write ``index.bin`` and ``index.json`` for a host that reads these files, on any file system.

    The format is one file in one order, so the rows are streamed through the driver a partition at a
    time; bulk indexes are kept as parquet instead. Each file appears whole, under its name.
    """
    spark = vectors.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)  # the host that shares the files writes none
    fs.mkdirs(hadoop.Path(folder))

    def publish(name: str, parts: Iterator[bytes]) -> None:
        fresh, final = hadoop.Path(f"{folder}/.{name}.new"), hadoop.Path(f"{folder}/{name}")
        out = fs.create(fresh, True)
        for part in parts:
            out.write(bytearray(part))
        out.close()
        fs.delete(final, False)
        fs.rename(fresh, final)

    ids: list[str] = []

    def rows() -> Iterator[bytes]:
        held: list[bytes] = []
        for row in vectors.select("id", "vector").orderBy("id").toLocalIterator(prefetchPartitions=True):
            if row.vector is not None and len(row.vector) == dim:
                ids.append(row.id)
                held.append(np.asarray(row.vector, dtype="<f4").tobytes())
                if len(held) * dim * 4 >= WRITE_BYTES:
                    yield b"".join(held)
                    held.clear()
        yield b"".join(held)

    try:
        publish("index.bin", rows())
        publish("index.json", iter([json.dumps({"v": 1, "dim": dim, "ids": ids}).encode()]))
    finally:
        fs.setWriteChecksum(True)
