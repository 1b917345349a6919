"""Nearest neighbours by collision counting (query-aware hashing).

Each of ``functions`` hash functions projects a vector to one line. A block of
vectors keeps, for every function, the projections in sorted order. A query
opens on each line a window centred at its own projection and widens all of
them together, radius by radius (virtual rehashing: the arrays never change);
only what a widening adds is counted. A vector that has collided with the query
on ``threshold`` of the lines is verified by its exact distance. A query is done
with a block when the share ``enough`` of the block's vectors (20 k at least) has
been verified, which is what recall depends on.

Every vector is in exactly one block, whose size is bounded; queries meet the
blocks in groups, and the best of all blocks are merged by distance. As every
query meets every block, work grows with queries times vectors: a stated query
set against all rows, in blocks. Windows that have not settled after ``ROUNDS``
widenings (as of a query far outside the block) give way to verifying the whole block.

Defined results: vectors that are null or zero, or hold null, NaN or infinite
components, and those whose length isn't the most common one, take no part; finite
components may have any size: lines are scaled by the block's largest one, and a distance too large
for a double is infinite and comes last. Ties go to the smaller vec_id. A query leaves out its own
row alone: other rows with its vec_id, or its vector, are candidates. A query row that repeats in whole is
asked once, and its repeats are its neighbours; rows that share a vec_id but not
the vector are queries of their own, with one query_id and told apart by ``vector``, the
hash of theirs. With fewer than k candidates all are returned. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.llm.common import split_count

#: Vectors in a block, and queries that meet it at once.
BLOCK, QUERIES = 4096, 2048
#: Widenings of a query's windows before the rest of a block is verified.
ROUNDS = 200
FOUND = "query_id bigint, vector bigint, vec_id bigint, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """The vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return vectors.select("vec_id", e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)


def projections(dim: int, functions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, functions))


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision; those whose squares overflow are taken at another scale."""
    with np.errstate(over="ignore"):
        gap = vectors - query
        out = np.sqrt((gap**2).sum(1))
        for k in np.flatnonzero(np.isinf(out)).tolist():
            most = np.abs(gap[k]).max()
            out[k] = most * np.sqrt(((gap[k] / most) ** 2).sum()) if np.isfinite(most) else np.inf
    return out


class SortedLines:
    """A block's vectors, sorted along every hash function."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, functions: int, seed: int):
        self.vectors, self.ids = vectors, ids
        self.axes = projections(vectors.shape[1], functions, seed)
        self.scale = float(np.abs(vectors).max()) or 1.0
        lines = vectors / self.scale @ self.axes
        self.order = np.argsort(lines, axis=0, kind="stable").T.astype(np.int32)
        self.lines = np.take_along_axis(lines.T, self.order, axis=1)
        self.unit = max(float(lines.std()), 1e-12)

    def search(self, queries: np.ndarray, k: int, threshold: float, growth: float, first: float, enough: float) -> list[list[tuple[float, int]]]:
        """For each query the nearest that are found: (distance, id), best first."""
        n, (q, m) = len(self.ids), (len(queries), len(self.lines))
        need, least = int(np.ceil(threshold * m)), max(20 * k, int(enough * n))
        with np.errstate(over="ignore"):
            at = np.clip(queries / self.scale, -1e150, 1e150) @ self.axes
        hits, checked, distance = np.zeros((q, n), dtype=np.int32), np.zeros((q, n), dtype=bool), np.full((q, n), np.inf)

        def verify(i: int, ready: np.ndarray) -> None:
            checked[i, ready] = True
            distance[i, ready] = distances(self.vectors[ready], queries[i])

        low = np.stack([np.searchsorted(self.lines[j], at[:, j]) for j in range(m)], 1)
        high, active, width = low.copy(), np.arange(q), first * self.unit
        for _ in range(ROUNDS):
            if not len(active):
                break
            wide_low = np.stack([np.searchsorted(self.lines[j], at[active, j] - width) for j in range(m)], 1)
            wide_high = np.stack([np.searchsorted(self.lines[j], at[active, j] + width, side="right") for j in range(m)], 1)
            going = []
            for i, a, b, c, d in zip(active.tolist(), wide_low.tolist(), low[active].tolist(), high[active].tolist(), wide_high.tolist(), strict=True):
                new = np.concatenate([x for j in range(m) for x in (self.order[j, a[j] : b[j]], self.order[j, c[j] : d[j]])])
                hits[i] += np.bincount(new, minlength=n).astype(np.int32)
                verify(i, np.flatnonzero((hits[i] >= need) & ~checked[i]))
                done = int(checked[i].sum())
                if done < n and done < least:
                    going.append(i)
            low[active], high[active] = np.minimum(low[active], wide_low), np.maximum(high[active], wide_high)
            active, width = np.array(going, dtype=np.int64), width * growth
        for i in active.tolist():
            verify(i, np.flatnonzero(~checked[i]))
        out = []
        for i in range(q):
            some = np.flatnonzero(checked[i])
            best = some[np.lexsort((self.ids[some], distance[i, some]))][:k]
            out.append(list(zip(distance[i, best].tolist(), self.ids[best].tolist(), strict=True)))
        return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, functions: int = 96, threshold: float = 0.75, growth: float = 1.1, first: float = 0.9, enough: float = 0.15, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score, vector): each query's ``k`` nearest found. Both tables have vec_id and embedding;
    the queries are rows of ``vectors``."""
    vectors, queries = usable(vectors), usable(queries).distinct()
    common = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = common["d"] if common else 0
    vectors, queries = vectors.where(F.size("embedding") == dim), queries.where(F.size("embedding") == dim)
    blocks, groups = split_count(common["count"] if common else 0, block), split_count(queries.count(), QUERIES)
    own = F.xxhash64("vec_id", "embedding")
    # Blocks by id and vector, so that copies of one vector and rows of one id are spread.
    v = vectors.select("vec_id", "embedding", F.lit(False).alias("query"), F.lit(0).cast("long").alias("vector"), F.pmod(own, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    q = queries.select("vec_id", "embedding", F.lit(True).alias("query"), F.xxhash64("embedding").alias("vector"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(own, F.lit(groups)).cast("int").alias("part"))

    def search(table: pa.Table) -> pa.Table:
        is_query, ids, vector = (table.column(c).to_numpy() for c in ("query", "vec_id", "vector"))
        matrix = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        rows: list[tuple] = []
        order = np.flatnonzero(~is_query)
        order = order[np.argsort(ids[order], kind="stable")]
        if len(order) and is_query.any():
            lines = SortedLines(matrix[order], ids[order], functions, seed)
            asked = np.flatnonzero(is_query)
            for at in range(0, len(asked), 64):
                some = asked[at : at + 64]
                for i, found in zip(some.tolist(), lines.search(matrix[some], k + 1, threshold, growth, first, enough), strict=True):
                    rows += [(int(ids[i]), int(vector[i]), x, d) for d, x in found]
        return pa.table({c: pa.array([r[j] for r in rows], t) for j, (c, t) in enumerate((("query_id", pa.int64()), ("vector", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    found = v.unionByName(q).groupBy("block", "part").applyInArrow(search, FOUND)
    # One more than k were asked for: the query's own row is at distance 0, and of rows like it one is left out.
    each = Window.partitionBy("query_id", "vector")
    is_own = (F.col("score") == 0) & (F.col("vec_id") == F.col("query_id"))
    best = found.withColumn("place", F.row_number().over(each.orderBy("score", ~is_own, "vec_id")))
    left = best.where((F.col("place") <= k + 1)).withColumn("own", is_own & (F.row_number().over(each.orderBy(~is_own, "score", "vec_id")) == 1)).where("not own")
    rank = F.row_number().over(each.orderBy("score", "vec_id")).cast("int")
    return left.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "vector")


def brute_force(vectors: DataFrame, queries: DataFrame, k: int = 10) -> list[tuple]:
    """The exact answer for small tables, on the driver; for measuring recall. (query_id, rank, vec_id, score)"""
    rows = sorted((r["vec_id"], r["embedding"]) for r in usable(vectors).collect())
    sizes = [len(r[1]) for r in rows]
    rows = [r for r in rows if len(r[1]) == max(set(sizes), key=lambda n: (sizes.count(n), n))]
    ids, matrix = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = []
    for r in usable(queries).distinct().collect():
        if len(r["embedding"]) != matrix.shape[1]:
            continue
        query = np.array(r["embedding"])
        others = np.ones(len(ids), dtype=bool)
        others[np.flatnonzero((ids == r["vec_id"]) & (matrix == query).all(1))[:1]] = False
        d = distances(matrix[others], query)
        order = np.lexsort((ids[others], d))[:k]
        out += [(r["vec_id"], n + 1, int(ids[others][i]), float(d[i])) for n, i in enumerate(order)]
    return out
