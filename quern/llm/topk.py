"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked, table

#: Rows of a shard tile and queries of a block: what one task holds at a time.
TILE, BLOCK, FAN_IN = 16384, 4096, 32


def finite(vector: Column) -> Column:
    """True for a vector that is not null and holds no null, NaN or infinity."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if dim else np.zeros((len(column), 0))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles where every partial sum fits 53 bits, Python integers beyond."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if bound < 2.0**53:
        return q @ x.T
    exact = np.array([[int(v) for v in row] for row in q], dtype=object) @ np.array([[int(v) for v in row] for row in x], dtype=object).T
    if max((abs(v) for v in exact.ravel()), default=0) >= 2**63:
        raise OverflowError("a score does not fit 64 bits")
    return exact


def best_of_tile(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ids ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        at = np.concatenate([above, level[: k - len(above)]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))] if scores.dtype != object else np.array(sorted(at, key=lambda i: (-scores[i], ids[i])), dtype=int)


def exact_top_k(items: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: float | None = None) -> DataFrame:
    """The k items of highest inner product for each query: (query_id, rank, <id>, score).

    With `scale`, components become floor(scale * x) and scores are exact integers (long); without,
    scores are doubles. A query never gets the item with its own id; ties go to the smaller id.
    Items fall into tiles and queries into blocks by hash of their id; each (tile, block) pair is one
    matrix product, of which a query keeps its k best at once. Those lists are merged in a tree, of
    which each level takes FAN_IN lists of a query. A task so holds one tile and one block at most,
    whatever the table's size. Queries against all rows are the stated job; shuffled are items once
    for each block of queries.

    Vectors that are null, or hold null, NaN or infinity, and rows with a null id take no part;
    vectors of different lengths are not compared. Repeated item rows each take a rank; repeated
    identical query rows count once. Fewer than k items: all of them. Empty tables: no rows. Other
    columns are not read.
    """
    checked(items, id, vector)
    pick = lambda df: df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where(F.col("id").isNotNull() & finite(F.col("v"))).withColumn("dim", F.size("v"))
    items, queries = pick(items), pick(queries).dropDuplicates()
    tiles, blocks = (max(1, -(-df.count() // n)) for df, n in ((items, TILE), (queries, BLOCK)))
    left = items.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    whole = scale is not None
    out = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64() if whole else pa.float64()), ("tile", pa.int64())])

    def tile_best(key, a, b):
        if not len(a) or not len(b):
            return out.empty_table()
        dim, tile = key[0].as_py(), key[1].as_py()
        a = a.sort_by("id")
        ids, x = a["id"].to_numpy(), matrix(a["v"], dim)
        qids, q = b["id"].to_numpy(), matrix(b["v"], dim)
        if whole:
            x, q = np.floor(x * scale), np.floor(q * scale)
        own = np.searchsorted(ids, qids, "left"), np.searchsorted(ids, qids, "right")
        found = []
        for start in range(0, len(q), 256):
            scores = _products(q[start : start + 256], x)
            for i, row in enumerate(scores, start):
                lo, hi = own[0][i], own[1][i]
                others = np.concatenate([row[:lo], row[hi:]]) if hi > lo else row
                kept = np.concatenate([ids[:lo], ids[hi:]]) if hi > lo else ids
                at = best_of_tile(kept, others, k)
                found.append((np.full(len(at), qids[i]), kept[at], others[at]))
        score = np.concatenate([f[2] for f in found])
        return pa.table([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), score.astype(np.int64) if whole else score.astype(np.float64), np.full(len(score), tile)], schema=out)

    keys = ["dim", "tile", "block"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile_best, f"query_id long, id long, score {'long' if whole else 'double'}, tile long")
    groups = tiles
    while True:
        groups = -(-groups // FAN_IN)
        best = best.withColumn("tile", F.floor(F.col("tile") / FAN_IN))
        by = W.partitionBy("query_id", "tile").orderBy(F.desc("score"), "id")
        best = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        if groups == 1:
            return best.select("query_id", "rank", F.col("id").alias(id), "score")
        best = best.drop("rank")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_top_k(rows, rows.where(F.col("vec_id") % 100 == 0), 10, scale=1024.0)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
