"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.session import shared_dir


class Scratch:
    """Writes tables as Parquet under the shared folder and reads them again.

    Lineage ends at a written table, so a lost executor costs only the tasks that were running.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df, path in [t for t in self.tables if any(t[0] is x for x in tables)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.tables = [t for t in self.tables if not any(t[0] is x for x in tables)]

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables but these."""
        self.drop(*(df for df, _ in self.tables if not any(df is x for x in tables)))
