"""Exact top-k inner-product search: a KD-tree per shard, best-first by box bounds, with the k-th score so far passed on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors in a shard at most about while there are few, bytes of vectors in a shard when there are many, vectors in a leaf, queries compared at once.
SHARD_ROWS, SHARD_BYTES, LEAF, QUERY_BLOCK = 8192, 32 << 20, 256, 512
#: Integers below it are exact as doubles.
EXACT = float(1 << 53)
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows as int64, exact: as doubles where none can leave their exact range, else as Python's integers.

    Products beyond the range of int64 stop at its ends; the lowest stays free as a mark."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, int(LOWEST) + 1, int(HIGHEST)).astype(np.int64)


class KDTree:
    """Median splits along the widest side down to ``leaf`` points. Every node, inner or leaf, has the tight bounding box of its points.

    Node i's children are ``child[i]``, ``child[i] + 1``; a leaf has none (-1) and its points, rows and ids in ``leaves[i]``."""

    def __init__(self, points: np.ndarray, rows: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        boxes, self.child, self.leaves, todo = [], [], {}, []

        def add(at: np.ndarray) -> None:
            boxes.append((points[at].min(axis=0), points[at].max(axis=0)))
            self.child.append(-1)
            todo.append((len(boxes) - 1, at))

        if len(points):
            add(np.arange(len(points)))
        while todo:
            node, at = todo.pop()
            lo, hi = boxes[node]
            axis = int(np.argmax(hi - lo))
            if len(at) <= leaf or hi[axis] == lo[axis]:
                self.leaves[node] = (points[at], rows[at], ids[at])
                continue
            half = len(at) // 2
            order = np.argpartition(points[at, axis], half)
            self.child[node] = len(boxes)
            add(at[order[:half]])
            add(at[order[half:]])
        self.lo, self.hi = (np.array([b[side] for b in boxes]) for side in (0, 1))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each node's box allows each query, with room for rounding beyond exact doubles."""
        with np.errstate(over="ignore", invalid="ignore"):
            bound = np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T
            room = np.abs(queries) @ np.maximum(np.abs(self.lo), np.abs(self.hi)).T
            return np.maximum(np.where(room < EXACT, bound, np.nan_to_num(bound + 1e-9 * room, nan=np.inf)), float(LOWEST))

    def search(self, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and score of each query's best ``k`` here that reach ``kth``; the row ``own`` takes no part.

        Best first, many queries a round: each open query takes the node with the highest bound from its frontier. An inner node gives way to
        its children; a leaf's points are scored, and raise the query's k-th score. A query closes when no bound in its
        frontier reaches that score. Equal scores go to smaller ids."""
        n, floor = len(queries), kth.astype(np.int64).copy()
        best, name = np.full((n, k), LOWEST), np.full((n, k), HIGHEST)
        frontier = np.full((n, len(self.child)), -np.inf)
        if self.child and n:
            bound = self.bounds(queries)
            frontier[:, 0] = bound[:, 0]
        while self.child and n:
            node = np.argmax(frontier, axis=1)
            top = frontier[np.arange(n), node]
            open_ = np.flatnonzero((top > -np.inf) & (top >= floor.astype(float)))
            if not len(open_):
                break
            for j in np.unique(node[open_]):
                q = open_[node[open_] == j]
                frontier[q, j] = -np.inf
                if (c := self.child[j]) >= 0:
                    frontier[q, c : c + 2] = bound[q, c : c + 2]
                    continue
                points, rows, ids = self.leaves[j]
                score = products(queries[q], points)
                score[(own[q][:, None] == rows[None, :]) | (score < floor[q][:, None])] = LOWEST
                if not (new := (score > LOWEST).any(axis=1)).any():
                    continue
                q, score = q[new], score[new]
                some = np.flatnonzero((score > LOWEST).any(axis=0))
                score, ids = score[:, some], ids[some]
                s = np.concatenate([best[q], score], axis=1)
                i = np.concatenate([name[q], np.where(score > LOWEST, ids[None, :], HIGHEST)], axis=1)
                pick = np.lexsort((i, ~s), axis=1)[:, :k]
                best[q], name[q] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
                floor[q] = np.maximum(floor[q], best[q][:, -1])
        at, col = np.nonzero(best > LOWEST)
        return at, name[at, col], best[at, col]


def _search(k: int, leaf: int, block: int):
    """Streams a sorted partition: a shard's vectors come first and become its tree, then its queries, block by block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, tree = None, [], None

        def planted() -> KDTree:
            if not held:
                return KDTree(np.empty((0, 1)), *[np.empty(0, np.int64)] * 2, leaf)
            return KDTree(np.concatenate([np.stack(r.v.to_numpy()) for r in held]).astype(float), *[np.concatenate([r[c].to_numpy() for r in held]) for c in ("row", "id")], leaf)

        for f in frames:
            for s, g in f.groupby("shard", sort=False):
                if s != shard:
                    shard, held, tree = s, [], None
                if len(c := g[g.is_query == 0]):
                    held.append(c[["row", "id", "v"]])
                q = g[g.is_query == 1]
                for i in range(0, len(q), block):
                    if tree is None:
                        tree, held = planted(), []
                    part = q.iloc[i : i + block]
                    at, ids, score = tree.search(np.stack(part.v.to_numpy()).astype(float), part.row.to_numpy(), part.kth.to_numpy(), k)
                    yield pd.DataFrame({"row": part.row.to_numpy()[at], "query_id": part.id.to_numpy()[at], "vec_id": ids.astype(np.int64), "score": score.astype(np.int64)})

    return run


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(row, id, v)``: a key of the row and ``floor(scale * x)`` of each component, as doubles that are integers.

    Rows with a null id, null, empty or non-finite vectors or components, and components beyond a double when scaled, are left out."""
    x = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    x = x.withColumn("v", F.transform("v", lambda c: c * F.lit(float(scale))))
    bad: Column = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # From 2^53 on, every double is an integer.
    x = x.where((F.size("v") > 0) & ~bad).withColumn("v", F.transform("v", lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c)))
    return x.select(F.monotonically_increasing_id().alias("row"), "id", "v")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, leaf: int = LEAF, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the exact ``k`` best inner products of every vector whose id is divisible by ``every``,
    against all other rows; ties go to the smaller id; all, if there are fewer than ``k``.

    Vectors are dealt to shards of about ``shard_rows``, or of ``SHARD_BYTES`` once there are more shards than the session's parallelism, so that
    queries are sent as seldom as memory allows. Queries first search one shard, and carry the k-th score found to all others as
    the bound from which anything counts. Only each shard's best ``k`` leave it. Rows that repeat an id are vectors of their own: a query's
    other rows are candidates, and each of them asks for itself. Vectors of several lengths are compared only with those of their own
    length. Scores beyond the range of a long stop at its ends. Further columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = materialize(quantized(vectors, id_col, vector_col, scale), "vectors")
    dim = F.size("v")
    n, longest = v.agg(F.count("*"), F.max(dim)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = max(1, min(-(-n // shard_rows), max(spark.sparkContext.defaultParallelism, -(-n * longest * 8 // SHARD_BYTES))))
    home = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    shard = lambda s: F.concat_ws("/", dim.cast("string"), s.cast("string"))
    none = F.lit(int(LOWEST)).cast("long")
    points = v.select(shard(home).alias("shard"), F.lit(0).alias("is_query"), "row", "id", "v", none.alias("kth"))
    asked = v.where(F.pmod("id", F.lit(every)) == 0)
    run, out = _search(k, leaf, block), "row long, query_id long, vec_id long, score long"

    def searched(queries: DataFrame) -> DataFrame:
        return points.unionByName(queries).repartition("shard").sortWithinPartitions("shard", "is_query").mapInPandas(run, out)

    first = asked.select(shard(home).alias("shard"), F.lit(1).alias("is_query"), "row", "id", "v", none.alias("kth"))
    near = materialize(searched(first), "first-shard")
    kth = near.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    other = asked.join(kth, "row", "left").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("s") != home)
    rest = other.select(shard(F.col("s")).alias("shard"), F.lit(1).alias("is_query"), "row", "id", "v", F.coalesce("kth", none).alias("kth"))
    both = near.unionByName(searched(rest)) if shards > 1 else near
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id")))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
