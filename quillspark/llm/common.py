"""What the operators of this package share: the shared folder, table access, cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer tasks than there are cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or set as the context's checkpoint folder.

    Where neither is set, a temporary one of our own on a local master (tests), else an error: other machines
    would not see it.
    """
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not set_dir and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(set_dir or tempfile.mkdtemp(prefix="quillspark-"))
        current = sc._jsc.sc().getCheckpointDir()
    return set_dir or current.get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor costs nothing before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


_STATE: dict = {}


def worker_state(key, make):
    """What a Python worker keeps between tasks: of one operator at a time, so that idle caches don't add up."""
    if key not in _STATE:
        _STATE.clear()
        trim()
        _STATE[key] = make()
    return _STATE[key]


def fresh_worker() -> None:
    """For operators that keep nothing: what another one kept in this Python worker goes."""
    if _STATE:
        _STATE.clear()
        trim()


def trim() -> None:
    """Gives freed memory back to the system; a worker that waits for its next task holds none of the last one's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _remove(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class ArrowFolder:
    """A folder whose files tasks write and read with pyarrow; its uri names a file system that pyarrow can open."""

    def __init__(self, spark: SparkSession, path: str):
        from pyarrow.fs import FileSystem

        self.spark, self.path = spark, path
        made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.uri = system.makeQualified(made).toString()
        try:
            FileSystem.from_uri(self.uri)
        except Exception as e:
            raise ValueError(f"{self.uri}: pyarrow can't open this file system; let spark.checkpoint.dir name another one") from e
        system.mkdirs(made)

    def drop(self) -> None:
        _remove(self.spark, self.path)


def arrow_folder(spark: SparkSession, what: str) -> ArrowFolder:
    return ArrowFolder(spark, fresh_path(spark, what))


class Stored:
    """df as a Parquet table in the shared folder (column by column and compressed, unlike a checkpoint).

    Use ``.df``; ``.drop()`` once everything made from it has been written.
    """

    def __init__(self, df: DataFrame, what: str, codec: str | None = None):
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, what)
        (df.write.option("compression", codec) if codec else df.write).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)
