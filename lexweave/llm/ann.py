"""Largest inner products by collision counting over single-projection sorted arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import cut

#: Rows of the index in one block and queries in one block: what one task holds.
BLOCK, QUERIES = 8192, 512
#: Projections, and the share of them in which a vector must fall into the query's windows.
PROJECTIONS, SHARE = 64, 0.5
#: Windows widen by this factor until so many of a block's vectors (beside the k wanted) pass the threshold.
WIDEN, VERIFY = 1.1, 0.25


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def directions(dim: int, count: int) -> np.ndarray:
    """Random directions as columns, fixed for a dimension; each run of dim of them is orthogonal."""
    rng = np.random.Generator(np.random.PCG64(dim))
    runs = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.hstack(runs)[:, :count]


class CollisionIndex:
    """One sorted array of projections for each random direction over a block's vectors.

    Inner products become distances: vectors are scaled by the largest length and get one more component that
    brings them to length 1, queries are normalised and get a nought there. A query's windows are runs of the
    sorted arrays around its own projections, all of one half-width, which grows until enough vectors lie in
    SHARE of the windows. A vector lies in a window if its rank in the array does, so narrow windows are read
    entry by entry and wide ones are held against all ranks at once.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, projections: int = PROJECTIONS):
        self.ids, self.vectors, self.short = ids, vectors.astype(np.float64), vectors.astype(np.float32)
        self.lines = directions(vectors.shape[1] + 1, projections)
        self.longest = longest
        scaled = self.vectors / longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1, keepdims=True)))
        spots = np.hstack([scaled, rest]) @ self.lines
        n, m = spots.shape
        kind = np.uint16 if n < 1 << 16 else np.uint32
        self.order = np.ascontiguousarray(np.argsort(spots, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.sort(spots, axis=0).T)
        self.ranks = np.empty((m, n), dtype=kind)
        np.put_along_axis(self.ranks, self.order, np.broadcast_to(np.arange(n, dtype=kind), (m, n)), axis=1)
        self.shifted, self.inside = np.empty_like(self.ranks), np.empty((m, n), dtype=bool)
        self.need, self.least = 1 + int(VERIFY * n), math.ceil(SHARE * m)
        # Where windows begin to grow: what a few of the block's own vectors needed, less one step.
        self.start = float(np.median(np.abs(spots - np.median(spots, axis=0)))) / 8 or 1e-9
        tried = [self.windows(q, self.start, 20)[1] for q in self.vectors[:: max(1, n // 8)][:8]]
        self.start = min(tried) / WIDEN

    def windows(self, query: np.ndarray, half: float, k: int) -> tuple[np.ndarray, float]:
        """The vectors that pass the threshold once enough do, and the half-width they needed."""
        m, n = self.ranks.shape
        spot = np.append(query / math.sqrt(float(query @ query)), 0.0) @ self.lines
        while True:
            a = np.array([s.searchsorted(x) for s, x in zip(self.sorted, spot - half, strict=True)])
            b = np.array([s.searchsorted(x, "right") for s, x in zip(self.sorted, spot + half, strict=True)])
            if int((b - a).sum()) * 16 < m * n:
                counts = np.bincount(np.concatenate([o[i:j] for o, i, j in zip(self.order, a.tolist(), b.tolist(), strict=True)]), minlength=n)
            else:
                kind = self.ranks.dtype.type
                np.subtract(self.ranks, a.astype(kind)[:, None], out=self.shifted)
                np.less(self.shifted, (b - a).astype(kind)[:, None], out=self.inside)
                counts = self.inside.view(np.uint8).sum(axis=0, dtype=np.uint8 if m < 256 else np.uint32)
            found = np.flatnonzero(counts >= self.least)
            if len(found) >= min(n, self.need + k) or int((b - a).min()) >= n:
                return found, half
            half *= WIDEN

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k nearest verified vectors other than own, nearest first."""
        query = query.astype(np.float64)
        return self.verify(self.windows(query, self.start, k)[0], own, query, k)

    def verify(self, found: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        found = found[self.ids[found] != own]
        if len(found) > k:
            # Single precision tells all but those that may be among the k best; the error is bounded by lengths.
            rough = self.short[found] @ query.astype(np.float32)
            floor = np.partition(rough, len(rough) - k)[len(rough) - k]
            found = found[rough >= floor - 1e-4 * self.longest * math.sqrt(float(query @ query))]
        score = (self.vectors[found] * query).sum(axis=1)
        ids = self.ids[found]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products with the rows of vectors.

    Both have (vec_id, embedding). Rows of vectors are dealt by hash to blocks, queries to blocks of theirs; a
    task has one block of each, builds the block's index and answers its queries, and the k best over all
    blocks are kept. Vectors that are null, zero or hold null or non-finite components take no part, nor do
    rows without vec_id; vectors of another length than the query's don't match it. A row with the query's own
    vec_id is no candidate, and of repeated query rows one is asked. Ties go to the smaller vec_id. An empty
    table gives no rows.
    """
    # Components as they are: scores are taken in double precision on the original vectors.
    clean = [t.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if "float" in t.schema["embedding"].dataType.simpleString() else "array<double>").alias("embedding"), F.size("embedding").alias("dim")) for t in (vectors, queries)]
    data, asked = clean[0], clean[1].dropDuplicates(["vec_id"])
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows, longest = data.agg(F.count("*"), F.max(length)).first()
    n = asked.count()
    blocks, parts = max(1, math.ceil(rows / block)), max(1, math.ceil(n / query_block))
    data = data.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.withColumn("p", F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.lit(parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            index = CollisionIndex(left["vec_id"].to_numpy(np.int64), np.stack(left["embedding"].to_numpy()), longest)
            for own, q in zip(right["vec_id"].tolist(), right["embedding"], strict=True):
                ids, score = index.search(own, np.asarray(q), k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = cut(data.groupBy("dim", "b", "p").cogroup(asked.groupBy("dim", "b", "p")).applyInPandas(answer, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
