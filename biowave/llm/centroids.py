"""Centroid clustering of integer vectors, exact to the last digit.

Components become integers floor(scale * x). Squared distances are worked out as |x|² - 2 x·c + |c|², the product by
BLAS in float64 for blocks of vectors: below 2^53 every intermediate sum is an integer that float64 holds, so the result
is exact whatever the order of summation. A block whose magnitudes could go beyond is worked out in 64-bit integers, and
beyond these in unbounded ones. Rounds are treeAggregates over blocks in the shared folder; what comes to the driver is
k centroids and k sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from biowave.llm.common import materialize

BLOCK = 4096  # vectors of a block
EXACT, WORD = 1 << 53, 1 << 62  # magnitudes below which float64 and int64 sums are exact
BLOCKS = "ids binary, known binary, x binary"
LONG = 1 << 63


def blocks_of(vectors: DataFrame, dim: int) -> DataFrame:
    """vectors (_id bigint, _x array) with exactly dim components, none null or not finite, as blocks of doubles."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            keep = np.array(lists.value_lengths().fill_null(-1)) == dim
            flat = lists.filter(pa.array(keep)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
            fine = np.isfinite(x).all(axis=1)
            x, ids = x[fine], ids.filter(pa.array(keep)).filter(pa.array(fine))
            known, ids = np.array(ids.is_valid()), ids.fill_null(0).to_numpy()
            out = [(ids[k : k + BLOCK].tobytes(), known[k : k + BLOCK].tobytes(), x[k : k + BLOCK].tobytes()) for k in range(0, len(x), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in (zip(*out, strict=True) if out else ((), (), ()))], ["ids", "known", "x"])

    return vectors.mapInArrow(cut, BLOCKS)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as float64 where that is exact (below 2^53), else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale) if math.log2(scale).is_integer() else np.full(x.shape, np.inf)
    if scaled.size == 0 or np.abs(scaled).max() < EXACT:
        return scaled
    return np.array([_floor(v, scale) for v in x.ravel().tolist()], object).reshape(x.shape)


def _floor(v: float, scale: int) -> int:
    top, bottom = v.as_integer_ratio()
    return scale * top // bottom


def _apart(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances in the narrowest numbers that hold every sum on the way."""
    reach = int(np.abs(x).max()) + int(np.abs(centroids).max())
    bound = x.shape[1] * reach * reach  # no less than |x|² + 2 |x·c| + |c|²
    kind = np.float64 if bound < EXACT else np.int64 if bound < WORD else object
    x, c = (np.array([int(v) for v in m.ravel().tolist()], object).reshape(m.shape) if kind is object else m.astype(kind) for m in (x, centroids))
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows x from integer centroids, a row for each vector.

    Rows and centroids with components beyond the bound are worked out apart, so they don't slow the others down.
    """
    bound = math.isqrt((EXACT - 1) // x.shape[1]) // 2
    far_x, far_c = ((np.abs(m) > bound).any(axis=1) for m in (x, centroids))
    if not far_x.any() and not far_c.any():
        return _apart(x, centroids) if len(x) else np.zeros((0, len(centroids)))
    out = np.empty((len(x), len(centroids)), object)
    for i in filter(len, map(np.flatnonzero, (far_x, ~far_x))):
        for j in filter(len, map(np.flatnonzero, (far_c, ~far_c))):
            out[np.ix_(i, j)] = [[int(v) for v in row] for row in _apart(x[i], centroids[j]).tolist()]
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the smaller at ties; squared distance) of each row."""
    apart = squared_distances(x, centroids)
    best = apart.argmin(axis=1).astype(np.int64)
    return best, apart[np.arange(len(x)), best]


def group_sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Exact sums of the rows of each cluster, as Python's integers."""
    most = len(x) * int(np.abs(x).max()) if x.size else 0
    if most < EXACT and x.dtype == np.float64:
        member = (cluster[None, :] == np.arange(k)[:, None]).astype(np.float64)
        return (member @ x).astype(np.int64).astype(object)
    out = np.zeros((k, x.shape[1]), object)
    np.add.at(out, cluster, x.astype(np.int64).astype(object) if x.dtype == np.float64 else x)
    return out


def _folded(blocks: DataFrame, zero: tuple, of: Callable) -> tuple:
    """treeAggregate of tuples that `of` works out for each block; they are added up."""
    add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
    return blocks.rdd.treeAggregate(zero, lambda acc, row: add(acc, of(row)), add, depth=3)


@dataclass
class Clusters:
    assigned: DataFrame  #: the id, cluster, distance of each kept vector
    centroids: DataFrame  #: cluster, components (decimal texts), cluster_inertia, inertia: one row a centroid


def cluster(
    vectors: DataFrame, k: int, rounds: int, order: Column, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 256,
) -> Clusters:
    """The kept vectors' clusters after `rounds` rounds, and the centroids.

    Kept are vectors of exactly dim components, none null or not finite. The k of them that come first by `order` (ties by
    components) are the centroids at the start, in that order; fewer vectors make fewer centroids. Each round assigns every
    vector to the nearest centroid, the smaller number at ties, and moves each centroid that has vectors to the floor of
    their mean. distance is squared, of a last assignment; distances and sums beyond 64 bits are null. Rows that repeat
    an id are vectors each, ids may be null, other columns are ignored, and an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vector_col).alias("_x"), order.alias("_order"))
    finite = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    first = rows.where((F.size("_x") == dim) & finite).orderBy(F.asc_nulls_last("_order"), "_x").limit(k).select("_x").collect()  # k rows
    start = integers(np.array([r["_x"] for r in first], np.float64).reshape(-1, dim), scale)
    now = np.array([int(v) for v in start.ravel().tolist()], object).reshape(start.shape)
    n = len(now)
    blocks = materialize(blocks_of(rows.select("_id", "_x"), dim))

    def read(data: bytes) -> np.ndarray:
        return integers(np.frombuffer(data, np.float64).reshape(-1, dim), scale)

    for _ in range(rounds if n else 0):
        sent = spark.sparkContext.broadcast(now)  # k x dim integers

        def moved(row: Row, sent: Broadcast = sent) -> tuple:
            x = read(row["x"])
            best, _ = nearest(x, sent.value)
            return group_sums(x, best, n), np.bincount(best, minlength=n).astype(np.int64)

        sums, counts = _folded(blocks, (np.zeros((n, dim), object), np.zeros(n, np.int64)), moved)
        now = np.array([s // int(c) if c else old for s, c, old in zip(sums, counts, now, strict=True)], object)
        sent.unpersist()
    last = spark.sparkContext.broadcast(now)

    def cost(row: Row) -> tuple:
        best, apart = nearest(read(row["x"]), last.value)
        out = np.zeros(n, object)
        np.add.at(out, best, np.array([int(d) for d in apart.tolist()], object))
        return (out,)

    (spent,) = _folded(blocks, (np.zeros(n, object),), cost)
    total = _long(int(sum(spent)))
    centroids = [(j, [str(v) for v in c], _long(int(s)), total) for j, (c, s) in enumerate(zip(now, spent, strict=True))]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, known, data in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                best, apart = nearest(read(data), last.value)
                columns = [
                    pa.array(np.frombuffer(ids, np.int64), pa.int64(), mask=~np.frombuffer(known, bool)),
                    pa.array(best, pa.int64()).cast(pa.int32()),
                    pa.array([_long(int(d)) for d in apart.tolist()], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "cluster", "distance"])

    assigned = blocks.mapInArrow(placed, "_id bigint, cluster int, distance bigint").withColumnRenamed("_id", id_col)
    return Clusters(assigned, spark.createDataFrame(centroids, "cluster int, components array<string>, cluster_inertia bigint, inertia bigint"))


def _long(v: int) -> int | None:
    return v if v < LONG else None
