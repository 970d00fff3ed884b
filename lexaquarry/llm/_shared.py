"""The shared folder, tables written to cut lineage, and small helpers of every operator."""

from __future__ import annotations

import atexit
import ctypes
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under the cluster's ``spark.checkpoint.dir``.

    Only where that setting is absent and all executors are threads of this machine (``local`` masters: tests, a laptop)
    a local folder is taken and set; on a cluster its absence is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lexaquarry-")
            spark.sparkContext.setCheckpointDir(base)
        _FOLDERS[app] = f"{base.rstrip('/')}/lexaquarry-{app}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _remove(spark: SparkSession, folder: str) -> None:
    """Best effort: the session may be gone before the interpreter."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, folder: str) -> None:
    """Remove a table written by ``materialize`` that no returned DataFrame reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions within remove their shuffle files when they end; else these lie on disk until the driver happens to collect its
    garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends in files that survive lost executors."""
    path = new_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables made by ``materialize`` that no DataFrame in use reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t._written)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Shared:
    """A broadcast of any object of this package, classes by value, so executors need not have the package."""

    def __init__(self, spark: SparkSession, x):
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(x))

    @property
    def value(self):
        return pickle.loads(self.bytes.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(f: Callable, **options) -> Callable:
    """A function of Arrow batches that gives free memory back to the system when its partition is done: idle Python workers
    share the executor's memory with the JVM."""

    def run(batches):
        yield from f(batches, **options)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the DataFrame doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name
