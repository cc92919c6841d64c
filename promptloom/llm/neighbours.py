"""Approximate nearest neighbours by collision counting, query-aware.

Each of ``functions`` random directions has one sorted array of projections.  A query looks at a
window around its own projection in every array and counts, per vector, the windows it fell into.
Virtual rehashing widens all windows together, radius by radius, and only what the wider windows
add is counted.  Vectors that reach the collision threshold are verified on the original numbers.
A query ends when its k nearest verified vectors lie within the radius: a vector within the radius
falls into two thirds of the windows on average, well above the threshold of one half.

Every vector is indexed, in blocks of bounded size; a task holds one block of vectors and one block
of queries, and hands on at most k rows a query.  No candidate is dropped: all that reach the
threshold are verified, and at the widest radius all vectors are.

Defined results: vectors that are null, empty, zero, or hold null, NaN or infinite components take
no part, neither do rows whose id is null; equal rows count once; a query meets only vectors of its
own length, and none that carries its own id; ties go to the smaller id; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries of a block.
BLOCK, QUERY_BLOCK = 65_536, 256
FUNCTIONS, THRESHOLD, WIDTH = 48, 0.5, 2.0
#: Radii on the unit sphere, where no two points lie further apart than 2.
FIRST_RADIUS, GROWTH, WIDEST = 0.1, 1.25, 2.0


class Index:
    """Sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, functions: int = FUNCTIONS, threshold: float = THRESHOLD):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.directions = np.random.default_rng(vectors.shape[1]).standard_normal((vectors.shape[1], functions))
        projections = (vectors / self.norms[:, None]) @ self.directions
        self.orders = np.argsort(projections, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projections.T, self.orders, axis=1)
        self.needed = int(np.ceil(threshold * functions))

    def scores(self, query: np.ndarray, norm: float, rows: np.ndarray) -> np.ndarray:
        return (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * norm)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest found, nearest first."""
        norm = float(np.sqrt((query * query).sum()))
        centres = (query / norm) @ self.directions
        size = self.ids.size
        counts, seen = np.zeros(size, np.int32), self.ids == query_id
        low = high = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centres, strict=True)])
        ids, scores = np.empty(0, np.int64), np.empty(0)
        radius = FIRST_RADIUS
        while True:
            if radius > WIDEST:
                reached = ~seen
            else:
                half = WIDTH * radius / 2
                wider_low = np.array([np.searchsorted(s, c - half, "left") for s, c in zip(self.sorted, centres, strict=True)])
                wider_high = np.array([np.searchsorted(s, c + half, "right") for s, c in zip(self.sorted, centres, strict=True)])
                wider_low, wider_high = np.minimum(wider_low, low), np.maximum(wider_high, high)
                fresh = [o[a:b] for o, a, b in zip(self.orders, wider_low, low, strict=True)]
                fresh += [o[a:b] for o, a, b in zip(self.orders, high, wider_high, strict=True)]
                low, high = wider_low, wider_high
                counts += np.bincount(np.concatenate(fresh), minlength=size).astype(np.int32)
                reached = (counts >= self.needed) & ~seen
            rows = np.flatnonzero(reached)
            if rows.size:
                seen[rows] = True
                ids = np.concatenate([ids, self.ids[rows]])
                scores = np.concatenate([scores, self.scores(query, norm, rows)])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            # the cosine of two points of the sphere that lie the radius apart
            if radius > WIDEST or (ids.size == k and scores[-1] >= 1 - radius * radius / 2):
                return ids, scores
            radius *= GROWTH


def _matrix(table: pa.Table, column: str, size: int) -> np.ndarray:
    values = table.column(column).combine_chunks()
    return np.asarray(values.flatten(), dtype=np.float64).reshape(len(values), size)


def _search_block(k: int):
    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        size = key[0].as_py()
        index = Index(vectors.column("id").to_numpy(), _matrix(vectors, "vector", size))
        asked, found, scores = [], [], []
        for query_id, query in zip(queries.column("id").to_numpy(), _matrix(queries, "vector", size), strict=True):
            ids, cosines = index.search(int(query_id), query, k)
            asked.append(np.full(ids.size, query_id, np.int64))
            found.append(ids)
            scores.append(cosines)
        return pa.table({"query_id": np.concatenate(asked), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    return run


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Id, vector and length of the rows that take part, each once."""
    vector = F.col("vector")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
        .filter(F.col("id").isNotNull() & vector.isNotNull() & (F.size(vector) > 0))
        .filter(~bad & F.exists(vector, lambda x: x != 0))
        .dropDuplicates(["id", "vector"])
        .withColumn("length", F.size("vector"))
    )


def nearest(
    rows: DataFrame, is_query: Column, k: int = 5, *, id_column: str = "vec_id", vector_column: str = "embedding",
    block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest of every row that ``is_query`` selects.

    ``is_query`` is a condition on ``id``.
    """
    vectors = usable(rows, id_column, vector_column)
    queries = vectors.filter(is_query)
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = ["length", "block", "query_block"]
    left = vectors.withColumn("block", part(blocks)).withColumn("query_block", every(query_blocks))
    right = queries.withColumn("query_block", part(query_blocks)).withColumn("block", every(blocks))
    found = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(_search_block(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
