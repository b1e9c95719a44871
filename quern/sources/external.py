"""Read-only Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Folder(dict):
    """Frames of NAME.parquet, read when first asked for."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path = spark, path

    def __missing__(self, name: str) -> DataFrame:
        self[name] = df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return df
