"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checked, table

#: No document is taken more often than this, and no source's target exceeds so many times its size.
MOST = 3


def source_targets(sizes: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), most: int = MOST, tilts: tuple[float, ...] = (-0.5, 0.0, 0.5)) -> DataFrame:
    """Targets by water-filling: (source, source_size) -> + rank, weight, target, tilt, demand.

    Sources by code point, null last, weigh the cycle's values in turn. All sizes are shared by
    weight; a target stops at `most` times its source's size and the excess goes to the others by
    weight, until none is above. With sources in the order of most * size / weight, those that stop
    are a prefix; running sums find where it ends. This table has a row a source.

    demand is the sum of all sizes, which the targets share. The tilts go to the sources in turn and
    are centred on their mean by target (to six places), so that at any time the schedules of all
    sources add up to the same: time is the share of the demand that is met.
    """
    named = W.orderBy(F.col("source").cast("binary").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(named) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    run = ranked.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    run = run.withColumn("stops", F.col("cap") / F.col("weight") <= F.col("level"))
    free = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.least(F.col("cap"), free * F.col("weight")))
    run = run.withColumns({"target": target, "tilt": F.element_at(F.array(*[F.lit(float(x)) for x in tilts]), (F.col("rank") % len(tilts) + 1).cast("int"))})
    mean = F.sum(F.col("target") * F.col("tilt")).over(everything) / F.sum("target").over(everything)
    centred = F.col("tilt") - F.coalesce(F.floor(mean * 1e6 + 0.5) / F.lit(1e6), F.lit(0.0))
    return run.select("source", "source_size", "rank", "weight", "target", centred.alias("tilt"), F.sum("source_size").over(everything).alias("demand"))


def schedule_time(share: Column, tilt: Column) -> Column:
    """Training time t in [0, 1] at which a source has spent `share` of its target.

    The source's weight at time t is proportional to 1 + tilt * (2t - 1), -1 <= tilt <= 1. Its
    integral up to t is (1 - tilt) * t + tilt * t^2, whose inverse is closed.
    """
    a = F.lit(1.0) - tilt
    root = F.sqrt(a * a + F.lit(4.0) * tilt * share)
    return F.when(F.abs(tilt) < 1e-9, share).otherwise(F.least(F.lit(1.0), F.lit(2.0) * share / (a + root)))


def mix_sources(
    docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", cycle: tuple[float, ...] = (1, 2, 3),
    tilts: tuple[float, ...] = (-0.5, 0.0, 0.5), most: int = MOST, pieces: int = 1024,
) -> DataFrame:
    """Assign each row its passes and training positions: all columns, and size, source_size, target, passes, taken, positions.

    A source's rows stand in the order of md5(key); a row's first pass starts where the sizes
    before it sum to. Pass p of a row lies p source sizes further. A pass is taken where its middle
    is before the source's target, so what a source takes is within half a document of its target,
    and no row has more than `most` passes. positions holds where in the whole mix, in units of
    size, each taken pass stands: the source's weight schedule is integrated and inverted at the
    share of its target that is taken before, which gives the time, and time times demand is the position.

    The running sums are made in two levels: a piece of the hash order (source, first digits of
    the md5) is summed, the pieces' sums (sources * pieces rows, a bound for any one source) are
    accumulated, and rows are summed within their piece. So no source is one task. Rows with the
    same key have the same hash and stand next to each other, told apart by their content. Null or
    empty texts have size 0 and no pass; a null source is a source of its own. An empty table gives
    an empty result. Columns of the result's own names are replaced.
    """
    checked(docs, key, source)
    own = ("size", "source_size", "target", "passes", "taken", "positions")
    rows = docs.withColumn("__size", F.coalesce(size, F.lit(0)).cast("long")).drop(*own)
    names = [c for c in rows.columns if not c.startswith("__")]
    rows = rows.withColumn("__src", F.col(f"`{source}`")).withColumn("__h", F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("__piece", (F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") % pieces).cast("int"))
    sums = rows.groupBy("__src", "__piece").agg(F.sum("__size").alias("__sum"))
    sizes = sums.groupBy(F.col("__src").alias("source")).agg(F.sum("__sum").alias("source_size"))
    before = W.partitionBy("__src").orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    first = sums.select("__src", "__piece", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__first"))
    targets = source_targets(sizes, cycle, most, tilts)
    first = first.join(targets, first["__src"].eqNullSafe(targets["source"])).select(
        F.col("__src").alias("__s2"), F.col("__piece").alias("__p2"), "__first", "source_size", "target", F.col("tilt").alias("__tilt"), F.col("demand").alias("__demand")
    )
    within = W.partitionBy("__src", "__piece").orderBy("__h", *[F.col("__size")], F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if c in names and not t.startswith(("map", "variant"))])).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    rows = rows.join(first, rows["__src"].eqNullSafe(first["__s2"]) & (rows["__piece"] == first["__p2"]))
    start = (F.col("__first") + F.col("__in")).cast("double")
    middle = start + F.col("__size") / F.lit(2.0)
    passes = F.when(F.col("__size") > 0, F.least(F.lit(most), F.greatest(F.lit(0), F.ceil((F.col("target") - middle) / F.col("source_size"))))).otherwise(0).cast("int")
    rows = rows.withColumn("passes", passes).withColumn("__start", start)
    share = lambda p: F.least(F.lit(1.0), (F.col("__start") + p * F.col("source_size")) / F.col("target"))
    positions = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("passes") - 1, F.lit(0))), lambda p: schedule_time(share(p), F.col("__tilt")) * F.col("__demand"))).otherwise(F.array().cast("array<double>"))
    return rows.select(
        *[F.col(f"`{c}`") for c in names], F.col("__size").alias("size"), "source_size", "target", "passes",
        (F.col("passes") * F.col("__size")).cast("long").alias("taken"), positions.alias("positions"),
    )


def training_order(mixed: DataFrame, key: str = "doc_id", each_pass: bool = True) -> DataFrame:
    """Rows range-sorted by training position: one a pass (column position), rows without a pass go.

    With each_pass off, one a document, by its first position, and those without a pass last.
    """
    if each_pass:
        return mixed.withColumn("position", F.explode("positions")).drop("positions").sort("position", F.col(f"`{key}`"))
    first = F.when(F.size("positions") > 0, F.element_at("positions", 1))
    return mixed.withColumn("position", first).drop("positions").sort(F.col("position").asc_nulls_last(), F.col(f"`{key}`"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).alias("words"))
    ordered = training_order(mix_sources(docs, F.col("words")), each_pass=False)
    return ordered.select("doc_id", "size", "source_size", "target", "taken", F.col("position").alias("first_position"))


OP9_SQL = """
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
           FROM documents),
q AS (SELECT *, CAST(('0x' || left(h, 8)) AS BIGINT) % 1024 AS piece FROM d),
c AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY piece, h, size, doc_id
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS start,
             sum(size) OVER (PARTITION BY source) AS source_size FROM q),
s AS (SELECT source, CAST(max(source_size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM c GROUP BY source),
w AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, rank)),
t AS (SELECT *, CASE WHEN cap / weight <= level THEN cap
             ELSE least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight > level)) END AS target FROM l),
u AS (SELECT *, CASE rank % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS own FROM t),
v AS (SELECT *, own - floor(sum(target * own) OVER () / sum(target) OVER () * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS tilt,
             CAST(sum(source_size) OVER () AS DOUBLE) AS demand FROM u),
m AS (SELECT c.*, t.target, t.tilt, t.demand, CASE WHEN size > 0 THEN least(3, greatest(0, CAST(ceil((t.target - (start + size / 2.0::DOUBLE)) / t.source_size) AS BIGINT))) ELSE 0 END AS passes
      FROM c JOIN v AS t ON c.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, least(1.0, start / target) AS share FROM m)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(passes * size AS BIGINT) AS taken,
       CASE WHEN passes = 0 THEN NULL WHEN abs(tilt) < 1e-9 THEN share
            ELSE least(1.0, 2.0::DOUBLE * share / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4.0::DOUBLE * tilt * share))) END * demand AS first_position
FROM f
"""
