"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the contracts define a word's limits.
WORD = r"[^\x20\x09-\x0D]+"


#: What one Arrow batch holds at most, in the JVM and in a Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches, whose rows are whole texts here, unless the session bounds them itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        for key, most in BATCH.items():
            spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        root = "/tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Intermediate tables, written to the shared folder so that a lost executor costs no recomputation.

    Each operator call gets a folder of its own; tables that the result no longer needs are dropped
    as soon as their successor is written, the rest when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{scratch_root(spark)}/quern-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Drop the named tables, or all of them."""
        try:
            jvm = self.spark._jvm
            for name in names or ("",):
                path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the application may have ended already
            if names:
                raise


def checked(df: DataFrame, *columns: str) -> None:
    """Raise where an input lacks a column that the operator reads."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def row_keys(*columns: Column) -> list[Column]:
    """Two hashes of a row's content, 128 bits in all, null-safe to join on.

    Repeated rows get the same key, and so the same per-row result, which makes a recomputed
    partition harmless; the columns go in twice, in another order and with another seed.
    """
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(0x9E3779B9), *reversed(columns)).alias("k2")]


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """A batch's texts as bytes (null: empty), in runs of about `most` bytes: (first row, texts)."""
    values = batch.column(column)
    if not pa.types.is_binary(values.type) and not pa.types.is_large_binary(values.type):
        values = values.cast(pa.large_binary())
    sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            yield start, [x or b"" for x in values[start:i].to_pylist()]
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, [x or b"" for x in values[start:].to_pylist()]


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(f, schema)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
