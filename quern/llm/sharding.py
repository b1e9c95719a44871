"""Sharding by jump consistent hashing, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked, table

#: The multiplier of the published algorithm's 64-bit generator, as two 32-bit halves.
HIGH, LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
MASK = 0xFFFFFFFF


def jump_shard(key: Column, shards: int) -> Column:
    """Shard (0 to shards - 1) of a 64-bit key by jump consistent hashing (Lamping and Veach).

    The generator's state is held as two 32-bit halves, multiplied in 16-bit pieces, so nothing
    overflows under ANSI arithmetic. Each jump goes further right, so `shards` steps always do; a
    step after the last jump changes nothing. With one shard more, a key stays or goes to the new one.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    state = F.struct(
        F.shiftrightunsigned(key, 32).alias("h"), key.bitwiseAND(F.lit(MASK)).alias("l"),
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
    )

    def cut(x: Column) -> Column:
        return x.bitwiseAND(F.lit(MASK))

    def step(s: Column, _: Column) -> Column:
        low0, low1 = s["l"].bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(s["l"], 16)
        high0, high1 = s["h"].bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(s["h"], 16)

        def times(x0: Column, x1: Column, by: int) -> Column:
            return x0 * F.lit(by) + F.shiftleft((x1 * F.lit(by)).bitwiseAND(F.lit(0xFFFF)), 16)

        low = times(low0, low1, LOW) + F.lit(1)
        carry = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(low1 * F.lit(LOW), 16)
        high = cut(carry + times(low0, low1, HIGH) + times(high0, high1, LOW))
        ratio = F.lit(float(1 << 31)) / (F.shiftrightunsigned(high, 1) + F.lit(1)).cast("double")
        moved = F.struct(high.alias("h"), cut(low).alias("l"), s["j"].alias("b"), F.floor((s["j"] + F.lit(1)).cast("double") * ratio).alias("j"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, step, lambda s: s["b"].cast("int"))


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", pieces: int = 256) -> DataFrame:
    """Shard and slot of each row: all columns, and shard_key long, shard int, grown_shard int, slot long.

    The key's value and the number of shards alone decide the shard; grown_shard is the shard with
    one shard more. Slots number a shard's rows from 0 without gaps. To keep a shard from being one
    task, its rows fall into `pieces` parts by hash; the parts' counts (shards * pieces rows at
    most, a proven bound) give each part's first slot, and parts are numbered on their own. A null
    key is a key like others. Rows with equal keys share a shard and get slots of their own, in an
    order that may differ between runs only among rows whose columns are all equal. An empty table
    gives an empty result. Columns of the result's own names are replaced.
    """
    checked(docs, key)
    docs = docs.drop("shard_key", "shard", "grown_shard", "slot", "__piece")
    rows = docs.withColumn("shard_key", F.xxhash64(F.col(f"`{key}`")))
    rows = rows.withColumn("shard", jump_shard(F.col("shard_key"), shards)).withColumn("grown_shard", jump_shard(F.col("shard_key"), shards + 1))
    content = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map" not in t and "variant" not in t])
    rows = rows.withColumn("__piece", F.pmod(content, F.lit(pieces)).cast("int"))
    counts = rows.groupBy("shard", "__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("shard").orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    order = [F.col("shard_key"), content]
    within = F.row_number().over(W.partitionBy("shard", "__piece").orderBy(*order)) - 1
    numbered = rows.withColumn("__row", within).join(F.broadcast(first), ["shard", "__piece"])
    return numbered.select(*[F.col(f"`{c}`") for c in docs.columns], "shard_key", "shard", "grown_shard", (F.col("__first") + F.col("__row")).cast("long").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_documents(rows, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
