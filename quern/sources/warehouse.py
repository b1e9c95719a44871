"""Versioned tables: immutable Parquet parts and one manifest that is swapped atomically."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import TransactionError
from ..schema import RID, TableDef

EMPTY = {"tables": {}, "snapshots": {}, "hash": None, "acl": None, "ids": 0, "version": 0}


class Warehouse:
    """Tables under one folder of any file system that Spark reaches.

    A part is never changed: an insert adds one, an update or delete writes the table's new image.
    A commit renames a new manifest over the old one, so readers see all of it or nothing, and
    frames that still read old parts stay valid until vacuum().
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("").getFileSystem(self._conf)

    def manifest(self) -> dict:
        path = self._path("MANIFEST.json")
        if not self._fs.exists(path):
            return json.loads(json.dumps(EMPTY))
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, manifest: dict, since: dict | None = None) -> None:
        """Swap the manifest. With `since`, only if no table's parts have changed since it was read.

        The check and the rename are two steps; on a store without an atomic rename a lock of its own is needed.
        """
        if since is not None:
            now = self.manifest()["tables"]
            parts = lambda tables, name: tables.get(name, {}).get("parts", [])
            if moved := [name for name in {*now, *since["tables"]} if parts(now, name) != parts(since["tables"], name)]:
                raise TransactionError(f"another session has changed {', '.join(sorted(moved))}")
        manifest = manifest | {"version": manifest.get("version", 0) + 1}
        new = self._path(f"MANIFEST-{uuid.uuid4().hex}.json")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else self._fs.getUri(), self._conf)
        option = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        context.rename(self._fs.makeQualified(new), self._fs.makeQualified(self._path("MANIFEST.json")), options)

    def read(self, manifest: dict, table: TableDef) -> DataFrame:
        parts = manifest["tables"].get(table.name, {}).get("parts", [])
        schema = table.struct(rid=True)
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in parts])

    def write(self, name: str, df: DataFrame) -> str:
        part = f"{name}/v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{part}")
        return part

    def drop_part(self, part: str) -> None:
        self._fs.delete(self._path(part), True)

    def vacuum(self, older_than: float = 7 * 86_400) -> int:
        """Delete the parts that the manifest does not name and that were written so many seconds ago; how many.

        Younger ones may be staged by a statement or transaction that is open in another session.
        """
        before = (time.time() - older_than) * 1000
        live = {p for t in self.manifest()["tables"].values() for p in t["parts"]}
        gone = 0
        for table in self._fs.listStatus(self._path("")):
            if table.isDirectory():
                for part in self._fs.listStatus(table.getPath()):
                    name = f"{table.getPath().getName()}/{part.getPath().getName()}"
                    if name not in live and part.getModificationTime() <= before:
                        self._fs.delete(part.getPath(), True)
                        gone += 1
        return gone


def numbered(df: DataFrame, column: str, first: int) -> DataFrame:
    """`column` counts the rows of a materialised frame from `first` without gaps, with no single task for them.

    monotonically_increasing_id holds the partition and the row in it; the partitions' counts, one
    row each, are summed up and joined to the rows.
    """
    marked = df.withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright("__m", 33)
    counts = marked.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("__p", (F.coalesce(ahead, F.lit(0)) + F.lit(first)).alias("__start"))
    at = F.col("__start") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.withColumn("__p", part).join(F.broadcast(starts), "__p").withColumn(column, at).drop("__m", "__p", "__start")


__all__ = ["RID", "Warehouse", "numbered"]
