"""Keyed changes of Parquet tables: each gives the new contents, to be written beside the old."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new, which take the place of rows with the same keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def remove(df: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return df.join(gone.select(*keys), list(keys), "left_anti")


def changed(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """df with columns set to new values where the condition holds."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def add_missing(old: DataFrame, seed: DataFrame, *keys: str) -> DataFrame:
    """old with those rows of seed whose keys it lacks; doing it twice changes nothing."""
    return old.unionByName(seed.join(old.select(*keys), list(keys), "left_anti"))


class VersionedTable:
    """A Parquet table that is replaced as a whole: each write is a new folder, and a pointer names the current one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        path, fs = self._fs()
        return fs.exists(path)

    def create(self, schema: str) -> None:
        """An empty table, unless there is one."""
        if not self.exists():
            self.write(self.spark.createDataFrame([], schema))

    def drop(self) -> None:
        """No table, whether there was one or not."""
        path, fs = self._fs()
        fs.delete(path, True)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._current()}")

    def _current(self) -> str:
        return self.spark.read.text(f"{self.path}/current").first()[0]

    def write(self, df: DataFrame, *partition_by: str) -> str:
        name = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{name}")
        pointer = self.spark.createDataFrame([(name,)], "value string")
        pointer.coalesce(1).write.mode("overwrite").text(f"{self.path}/current")
        return name
