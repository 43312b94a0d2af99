"""Where operators keep intermediate tables, and how they cut lineage.

Everything written between stages goes to the shared folder that the cluster names in
``spark.checkpoint.dir``. A folder of our own is used only where that setting is absent (tests,
a laptop), because a machine-local folder is not visible to other executors.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_SCRATCH: list[tuple[SparkSession, str]] = []
#: A claim older than this (in ms) is of a driver that died.
STALE_MS = 6 * 3_600_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is configured and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="mnesis-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. What is written there is removed when this process ends;
    results are lazy, so it can't go earlier."""
    path = f"{shared_dir(spark)}/mnesis/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_remove_scratch)
    _SCRATCH.append((spark, path))
    return path


def _remove_scratch() -> None:
    for spark, path in _SCRATCH:
        if "://" not in path or path.startswith("file:"):
            shutil.rmtree("/" + path.split(":", 1)[-1].lstrip("/"), ignore_errors=True)
        else:
            try:
                drop_path(spark, path)
            except Exception:  # the session is gone already
                return


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends here and
    survives the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where it comes in fewer pieces than that (one small file, say); large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path on whatever file system it lives."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop_path, True)


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of ``path``; none where it doesn't exist."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop_path) if s.isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def make_dir(spark: SparkSession, path: str) -> None:
    """Make the folder at ``path``, if it isn't there."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop_path)


def replace_table(df: DataFrame, path: str, keep: int = 2) -> None:
    """Replace the versioned table at ``path`` at once: readers see the old version or the new one.

    Every version is a folder of its own, complete when its ``_SUCCESS`` is there; :func:`read_version`
    takes the newest complete one. The ``keep`` newest versions stay for readers that have begun.
    """
    spark = df.sparkSession
    versions = list_dirs(spark, path)
    number = 1 + max((int(v[1:]) for v in versions), default=0)
    df.write.parquet(f"{path}/v{number:012d}")
    for old in versions[: max(0, len(versions) + 1 - keep)]:
        drop_path(spark, f"{path}/{old}")


def read_version(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest complete version of the table at ``path``; empty where there is none."""
    done = [v for v in list_dirs(spark, path) if exists(spark, f"{path}/{v}/_SUCCESS")]
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{done[-1]}")


def _versions(spark: SparkSession, path: str) -> list[str]:
    """All folders of the appended table at ``path`` in order; a base (``b``) stands for all before it."""
    return sorted(list_dirs(spark, path), key=lambda v: v[1:])


def _next(spark: SparkSession, path: str) -> str:
    return f"{1 + max((int(v[1:]) for v in list_dirs(spark, path)), default=0):012d}"


def live_versions(spark: SparkSession, path: str) -> list[str]:
    """The complete folders of the appended table at ``path``, from its last base on."""
    done = [v for v in _versions(spark, path) if exists(spark, f"{path}/{v}/_SUCCESS")]
    bases = [i for i, v in enumerate(done) if v[0] == "b"]
    return done[bases[-1] :] if bases else done


def append_version(df: DataFrame, path: str) -> None:
    """Append ``df`` to the table at ``path`` as one more folder, visible once it is complete."""
    df.write.parquet(f"{path}/v{_next(df.sparkSession, path)}")


def rewrite_appended(df: DataFrame, path: str) -> None:
    """Replace all folders of the table at ``path`` by one, at once. Those that the replaced base had
    stood for are removed; the replaced ones stay for readers that have begun."""
    spark = df.sparkSession
    live = live_versions(spark, path)
    dead = [v for v in _versions(spark, path) if live and v[1:] < live[0][1:]]
    df.write.parquet(f"{path}/b{_next(spark, path)}")
    for v in dead:
        drop_path(spark, f"{path}/{v}")


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All live folders of the table at ``path``."""
    done = [f"{path}/{v}" for v in live_versions(spark, path)]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def claim(spark: SparkSession, path: str, stale_ms: int = STALE_MS) -> bool:
    """Take the marker at ``path``, which one holder at a time has; False where another has it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).getModificationTime() < time.time() * 1000 - stale_ms:
        fs.delete(hadoop_path, False)
    return fs.createNewFile(hadoop_path)


def release(spark: SparkSession, path: str) -> None:
    """Give the marker at ``path`` back."""
    drop_path(spark, path)
