"""Operator 3: nearest neighbours by a block matrix join, exact in its result.

Vectors are dealt by hash into blocks of bounded bytes, queries and candidates alike; each pair of blocks meets in one
task. There both are quantised to int8 and multiplied as tiles. The product, with the length of what quantisation cut
off each vector, bounds every cosine from both sides; pairs whose upper bound is below the k-th best lower bound of
their query, or below the k-th best score of the tiles before, are discarded, the survivors are recomputed in double
precision, and a heap for each query merges the bests of the task's tiles. The bests of all tasks are ranked by a
window. Nothing near is lost: recall is 1.

A candidate is sent once for each block of queries and a query once for each block of candidates, so blocks are as
large as a task can hold; there are as many of candidates as the session has shuffle partitions, if tiles fill them.

Defined results
---------------
* a vector that is null or zero, or holds a null or non-finite component, and a row without vec_id take no part;
* a query's own row is left out by its vec_id; queries of equal vec_id and different vectors are answered apart;
* repeated rows count once; ties go to the smaller vec_id;
* vectors of different lengths do not meet; fewer than k candidates give fewer rows;
* empty table: empty result; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.session import materialise

#: Vectors multiplied at once, and the most bytes of doubles that a block has on either side.
CANDIDATES, QUERIES, BLOCK_BYTES = 4096, 1024, 32 << 20
#: Survivors recomputed together.
TOGETHER = 1 << 18
#: Room for rounding in the bounds, which are otherwise exact.
SLACK = 1e-6


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles; each row is scaled by a power of two, which leaves cosines as they are, bit by bit."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each summed from the first component to the last."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, the scale of each row, and the length of what is cut off, of the rows at unit length."""
    unit = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    return whole, scale, np.sqrt(((unit - whole * scale[:, None]) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 tiles: up to 1,024 components at once their sums are whole numbers below 2**24."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], 1024):
        out += a[:, d : d + 1024].astype(np.float32) @ b[:, d : d + 1024].astype(np.float32).T
    return out


def best_of_tiles(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """(minus cosine, vec_id) of the k nearest of ``rows`` to each query, nearest first."""
    bests: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    lengths = [np.sqrt(dots(m, m)) for m in (queries, rows)]
    for c in range(0, len(rows), CANDIDATES):
        there = slice(c, c + CANDIDATES)
        candidates = quantise(rows[there])
        for b in range(0, len(queries), QUERIES):
            here = slice(b, b + QUERIES)
            floor = np.array([-x[-1][0] if len(x) == k else -np.inf for x in bests[here]])
            q, at = survivors(quantise(queries[here]), candidates, query_ids[here][:, None] == ids[there], floor, k)
            scores = np.empty(len(q))
            for i in range(0, len(q), TOGETHER):
                left, right = q[i : i + TOGETHER] + b, at[i : i + TOGETHER] + c
                scores[i : i + TOGETHER] = dots(queries[left], rows[right]) / (lengths[0][left] * lengths[1][right])
            bounds = np.searchsorted(q, np.arange(len(floor) + 1))
            found = list(zip((-scores).tolist(), ids[at + c].tolist(), strict=True))
            for n in np.flatnonzero(np.diff(bounds)).tolist():
                bests[b + n] = heapq.nsmallest(k, bests[b + n] + found[bounds[n] : bounds[n + 1]])
    return bests


def survivors(queries: tuple, candidates: tuple, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of a tile that may be among their query's k best: those not below ``floor`` and k others."""
    (qa, qs, qe), (ca, cs, ce) = queries, candidates
    near = products(qa, ca) * qs[:, None] * cs
    room = qe[:, None] + (1 + qe[:, None]) * ce + SLACK
    low = np.where(own, -np.inf, near - room)
    if low.shape[1] >= k:
        floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
    return np.nonzero(~own & (near + room >= floor[:, None]))


def nearest(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows of largest cosine to each row that ``is_query`` picks."""
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("q"))
    every = every.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).dropDuplicates(["vec_id", "embedding"])
    every = materialise(every.withColumn("h", F.xxhash64("vec_id", "embedding")).withColumn("dim", F.size("embedding")), "vectors")
    n, n_queries, dim = every.agg(F.count("*"), F.count_if("q"), F.max("dim")).first()
    most = max(1, BLOCK_BYTES // (8 * (dim or 1)))
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, query_blocks = max(n // most, min(partitions, n // CANDIDATES)) + 1, n_queries // most + 1

    def both(df: DataFrame, own: str, c: int, other: str, m: int) -> DataFrame:
        """Each row in its own block of one side, and once for each block of the other side."""
        others = F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))
        return df.withColumn(own, F.pmod("h", F.lit(c))).withColumn(other, F.explode(others))

    left = both(every.filter("q").select("vec_id", "embedding", "h", "dim"), "qb", query_blocks, "cb", blocks)
    right = both(every.select("vec_id", "embedding", "h", "dim"), "cb", blocks, "qb", query_blocks)

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = [[]] * len(queries)
        if len(queries) and len(rows):
            ids = [t.column("vec_id").to_numpy() for t in (queries, rows)]
            found = best_of_tiles(ids[0], _matrix(queries.column("embedding")), ids[1], _matrix(rows.column("embedding")), k)
        of = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))), pa.int64())
        flat = [x for best in found for x in best]
        return pa.table({
            "query_id": queries.column("vec_id").take(of), "h": queries.column("h").take(of),
            "vec_id": pa.array([x[1] for x in flat], pa.int64()), "score": pa.array([-x[0] for x in flat], pa.float64()),
        })

    cell = ("dim", "qb", "cb")
    tiles = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, "query_id long, h long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id"))
    return tiles.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_sql(k: int, every: int, table: str = "embeddings") -> str:
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    return f"""
WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM {table}
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, {dot("q.v", "c.v")} / (sqrt({dot("q.v", "q.v")}) * sqrt({dot("c.v", "c.v")})) AS score
      FROM e AS q JOIN e AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {every} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= {k}"""
