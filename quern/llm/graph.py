"""Connected components of a link table, by contraction within tasks and alternating large-star and small-star steps."""

from __future__ import annotations

from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Links that a task contracts at once; where no more are left, one task ends the work.
TASK_LINKS = 1 << 18


def _contract(batches):
    """The links of a task as (least node, node) of each component among them, TASK_LINKS links at a time."""
    up: dict = {}

    def root(x):
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def forest(schema):
        stars = [(root(x), x) for x in up if up[x] != x]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], schema.field(k).type) for k in (0, 1)], names=["a", "b"])

    seen, schema = 0, None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
            seen += 1
            if seen == TASK_LINKS:
                yield forest(schema)
                seen = 0
    if schema is not None:
        yield forest(schema)


def components(links: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """Component of each linked node: (node, root), root the least node that links reach.

    links: (a, b) of one orderable type, any direction, repeats and loops allowed; nodes without a
    link to another node are not in the result. Each round first contracts links within tasks, of
    which each holds TASK_LINKS at once at most; once all links fit one task, that ends the work.
    Until then star steps join what tasks found. Each round writes its edges to the shared folder,
    so lineage stays short; the number of rounds is logarithmic in a component's size.
    """
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges, last = scratch.save(pairs, f"{name}-0"), None
    for k in range(1, rounds + 1):
        tasks = max(1, ceil(edges.count() / TASK_LINKS))
        edges = scratch.save(edges.coalesce(tasks).mapInArrow(_contract, edges.schema), f"{name}-{k}-within")
        scratch.drop(f"{name}-{k - 1}")
        if tasks == 1:
            return _members(edges)
        # large-star: each node's larger neighbours move to its least neighbour (itself included).
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small-star: each node's smaller neighbours, and itself, move to its least one.
        down = large.select(F.col("b").alias("n"), F.col("a").alias("s"))
        low = down.groupBy("n").agg(F.min("s").alias("m"))
        small = down.join(low, "n").select(F.col("m").alias("a"), F.col("s").alias("b")).union(low.select(F.col("m").alias("a"), F.col("n").alias("b")))
        new = scratch.save(small.where("a < b").distinct(), f"{name}-{k}")
        sign = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{k}-within")
        edges = new
        if tuple(sign) == last:
            return _members(edges)
        last = tuple(sign)
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def _members(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("b").alias("node"), F.col("a").alias("root")).union(stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
