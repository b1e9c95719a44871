"""Embedding near-dedup by a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked, row_keys, table
from .graph import components
from .topk import finite

#: Largest number of rows of one list that a task compares; longer lists are cut into pairs of parts.
PART = 2048


def pivot_sample(classes: DataFrame, pivots: int) -> np.ndarray:
    """The reference points: `pivots` vectors of least hash. Bounded: at most 4096 vectors reach the driver."""
    rows = classes.select("v").orderBy(F.xxhash64("v"), "k2").limit(min(pivots, 4096)).collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stack(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def near_duplicate_vectors(
    rows: DataFrame, threshold: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    length: int = 8, shared: int = 2, pivots: int | None = None,
) -> DataFrame:
    """Links of cosine >= threshold within a label, and their components: all columns, and n_links, component_id, kept.

    Equal vectors of a label are one class with a count, so copies are never paired. Each class is
    described by its `length` nearest of the reference points, in order; an inverted list holds the
    classes of a (label, length) that have a point in their description. Two classes of a list that
    share `shared` points at least, and whose first shared point is the list's, are verified in
    double precision there and then: each pair once, and no pair leaves its task. What leaves is,
    for each class, the number of vectors it links to and the least class it reaches within the
    list. Lists over PART classes are cut into parts, and each pair of parts is a task, so no list
    is gathered whole and none is capped.

    The points are the vectors of least hash, about the square root of the number of classes, at
    most 4096 (the one fitted sample; every row is indexed). Recall against brute force is measured
    by tests and stated in the README; links found are all true.

    Null or zero vectors, those with null or non-finite components, and rows with a null label link
    with nothing: n_links 0, and their own id as component. Vectors of different lengths are not
    compared. Repeated rows link with each other. A null id never names a component, unless alone.
    Empty tables give empty results. Columns of the result's own names are replaced.
    """
    checked(rows, id, vector, label)
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "vectors")
    rows = rows.drop("n_links", "component_id", "kept")
    v, name = F.col(f"`{vector}`"), F.col(f"`{label}`")
    usable = finite(v) & name.isNotNull() & F.exists(F.coalesce(v, F.array()), lambda x: x != 0)
    keyed = rows.withColumns({"__ok": usable}).withColumns(dict(zip(("__k1", "__k2"), row_keys(name, v), strict=True)))
    classes = keyed.where("__ok").groupBy(F.col("__k1").alias("k1"), F.col("__k2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col(f"`{id}`")).alias("least"), F.first(name).alias("label"), F.first(v).cast("array<double>").alias("v")
    )
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "classes")
    edges, degrees = None, None
    found = []
    for dim, count in [(r[0], r[1]) for r in classes.groupBy("dim").count().collect()]:
        own = classes.where(F.col("dim") == dim)
        points = pivot_sample(own, pivots or max(16, min(4096, 2 ** round(np.log2(max(1, count)) / 2))))
        found.append(_links(own, _unit(points), min(length, len(points)), shared, threshold))
    if found:
        links = found[0]
        for more in found[1:]:
            links = links.union(more)
        links = scratch.save(links, "links")
        degrees = links.groupBy(F.col("cid")).agg(F.sum("deg").alias("deg"))
        edges = links.select(F.col("cid").alias("a"), F.col("root").alias("b"))
        roots = components(edges, scratch, "components")
        member = classes.select("cid", "k1", "k2", "n", "least").join(roots, classes["cid"] == roots["node"], "left").join(degrees, "cid", "left")
        member = member.withColumn("root", F.coalesce("root", "cid"))
        least = member.groupBy("root").agg(F.min("least").alias("component"))
        member = member.join(least, "root").select("k1", "k2", (F.coalesce("deg", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    else:
        member = spark.createDataFrame([], "k1 long, k2 long, links long, component long")
    out = keyed.join(member, F.col("__ok") & (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2")), "left")
    own_id = F.col(f"`{id}`")
    group = F.coalesce("component", own_id)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"), own_id.eqNullSafe(group).alias("kept"))


def _links(classes: DataFrame, points: np.ndarray, length: int, shared: int, threshold: float) -> DataFrame:
    def describe(batches):
        for b in batches:
            x = _stack(b.column("v"))
            order = np.argsort(-(_unit(x) @ points.T), axis=1, kind="stable")[:, :length].astype(np.int32)
            near = pa.ListArray.from_arrays(np.arange(0, order.size + 1, length, dtype=np.int32), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("label"), b.column("n"), b.column("v"), near], names=["cid", "label", "n", "v", "near"])

    kind = classes.schema["label"].dataType.simpleString()
    described = classes.select("cid", "label", "n", "v").mapInArrow(describe, f"cid long, label {kind}, n long, v array<double>, near array<int>")
    listed = described.withColumn("point", F.explode("near"))
    sizes = listed.groupBy("label", "point").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    listed = listed.join(sizes, ["label", "point"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    listed = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    listed = listed.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    need, out = min(shared, length), pa.schema([("cid", pa.int64()), ("deg", pa.int64()), ("root", pa.int64())])
    n_points = len(points)

    def verify(key, t):
        point, lo, hi = (key[i].as_py() for i in (1, 2, 3))
        t = t.sort_by("cid")
        cid, n, near, part = t["cid"].to_numpy(), t["n"].to_numpy(), _stack(t["near"]).astype(np.int64), t["part"].to_numpy()
        x = _unit(_stack(t["v"]))
        hot = np.zeros((len(cid), n_points), np.float32)
        hot[np.arange(len(cid))[:, None], near] = 1
        # points before the list's own: a pair that shares one of them belongs to that point's list
        before = hot[:, :point]
        deg, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
        for s in range(0, len(cid), 512):
            i = slice(s, s + 512)
            count = hot[i] @ hot.T
            mine = (count >= need) & (before[i] @ before.T == 0)
            a, b = np.nonzero(mine)
            a += s
            keep = (a < b) & ((part[a] != part[b]) if lo != hi else True)
            a, b = a[keep], b[keep]
            good = np.concatenate([np.einsum("ij,ij->i", x[a[j : j + 65536]], x[b[j : j + 65536]]) >= threshold for j in range(0, len(a), 65536)] or [np.zeros(0, bool)])
            a, b = a[good], b[good]
            np.add.at(deg, a, n[b])
            np.add.at(deg, b, n[a])
            while len(a):
                np.minimum.at(root, a, root[b])
                np.minimum.at(root, b, root[a])
                root = root[root]
                if (root[a] == root[b]).all():
                    break
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        linked = deg > 0
        return pa.table([cid[linked], deg[linked], cid[root[linked]]], schema=out)

    return listed.groupBy("label", "point", "lo", "hi").applyInArrow(verify, "cid long, deg long, root long")


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", "n_links", "component_id", "kept")
