"""Work tables: intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Partitions up to which a table is dealt to more tasks.
FEW = 64
_LOCAL: dict[str, str] = {}
#: Spark's setting by which a query's shuffle files go when it has ended; sessions that have it on just now, by how many callers, with what it was.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TIDIED: dict[int, tuple[int, str]] = {}
_LOCK = threading.Lock()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; below a temporary folder where that is unset and the master is local, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _LOCAL.get("dir") or _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="lorespark-"))
    return f"{base.rstrip('/')}/lorespark/{name}-{uuid.uuid4().hex}"


def work_folder(spark: SparkSession, name: str) -> str:
    """A path as by work_path that goes, with all in it, when the driver ends."""
    path = work_path(spark, name)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a work table and read back; the table goes when the driver ends."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that end meanwhile go with their end, and don't wait for the driver's garbage collection. Callers may overlap."""
    session = spark._jsparkSession.hashCode()
    with _LOCK:
        n, before = _TIDIED.get(session) or (0, spark.conf.get(_CLEAN_UP))
        _TIDIED[session] = n + 1, before
        spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _TIDIED.pop(session)
            if n > 1:
                _TIDIED[session] = n - 1, before
            else:
                spark.conf.set(_CLEAN_UP, before)


def release(table: DataFrame) -> None:
    """Delete a work table that nothing reads any more, before the driver ends."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def spread(table: DataFrame) -> DataFrame:
    """A scanned table with a partition for each core, where it comes in fewer, as one file with one group of rows does.

    A table of FEW partitions or more is left as it is: those are large, and a shuffle of them would cost more than idle cores.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < min(cores, FEW) else table
