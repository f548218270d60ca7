"""Clusters of integer vectors around centroids, by partial-distance search.

A vector becomes integers, floor(scale * x). For each vector the squared differences are
added up a block of dimensions at a time, those of highest variance first. The centroid
that is nearest on the first block gives the first full distance; any other is abandoned
once its partial distance is strictly above the best one so far, and survivors finish all
dimensions. So distances are exact, and ties go to the smaller number.

Each round is a scan of the stored integers: a task adds up its own vectors by cluster, and
only these sums are shuffled, a row a task, cluster and dimension. Centroids (k times width
numbers) are the only thing that passes through the driver; no group of vectors meets in a task, so
copies of one vector, however many, are no hot key.

Left out: vectors that are null, of another length, or hold a null, NaN or infinity. A
vector without an id is clustered like any other but starts no centroid. Repeated rows are
vectors of their own; where starting vectors tie by their hash, as rows of one id do, those
with smaller components come first. With fewer than k starting vectors there are so many
centroids; with none (an empty table) the result is empty. A component of ``LARGEST`` or more
by size is an error, since its distances wouldn't fit a long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, lean, ship, stored

K, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
#: Dimensions whose squared differences are added up at a time.
BLOCK = 8
LARGEST = 1 << 27
#: Vectors searched side by side: bounds the arrays of a task.
SIDE_BY_SIDE = 1 << 12


def _integers(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their integers)."""
    right = pc.equal(pc.list_value_length(column), width).fill_null(False)
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    x = column.filter(right).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    finite = np.isfinite(x).all(axis=1)
    q = np.floor(scale * x[finite])
    if (np.abs(q) >= LARGEST).any():
        raise ValueError(f"a component of {LARGEST} or more by size: distances would not fit a long")
    return at[finite], q.astype(np.int32)


def _lists(q: np.ndarray) -> pa.Array:
    n, width = q.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(q.ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def integer_vectors(rows: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the kept rows of (vec_id, embedding): floor(scale * x) of each component."""
    ship(rows.sparkSession)

    def work(batches):
        for b in batches:
            at, q = _integers(b.column(1), width, scale)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), _lists(q)], names=["vec_id", "q"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "embedding").mapInArrow(lean(work), f"vec_id {kind}, q array<int>")


def first_centroids(vectors: DataFrame, k: int = K, seed: int = 1) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in that order; a task keeps k of its own."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(told.alias("h"), "vec_id", "q").orderBy("h", "vec_id", "q").limit(k).collect()
    return np.array([r.q for r in rows], dtype=np.int64)


def by_variance(vectors: DataFrame, width: int = WIDTH) -> np.ndarray:
    """The dimensions by descending variance; the order changes the work, never the result."""

    def work(batches):
        n, total, squares = 0, np.zeros(width), np.zeros(width)
        for b in batches:
            x = _matrix(b.column(0), width).astype(np.float64)
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(total), pa.array(squares)], names=["dim", "n", "total", "squares"])

    sums = vectors.select("q").mapInArrow(work, "dim int, n long, total double, squares double").groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")]).collect()
    spread = {r.dim: r.squares / r.n - (r.total / r.n) ** 2 if r.n else 0.0 for r in sums}
    return np.array(sorted(range(width), key=lambda d: (-spread.get(d, 0.0), d)))


def nearest(q: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each vector, and how many squared differences were added up."""
    x, c = q[:, order].astype(np.int64), centroids[:, order]
    n, width = x.shape
    partial = np.stack([((x[:, :block] - own[:block]) ** 2).sum(axis=1) for own in c], axis=1)
    first = who = partial.argmin(axis=1)
    who = who.copy()
    best = partial[np.arange(n), first] + ((x[:, block:] - c[first, block:]) ** 2).sum(axis=1)
    terms = n * (len(c) * min(block, width) + max(0, width - block))
    for k, own in enumerate(c):
        rows = np.flatnonzero((first != k) & (partial[:, k] <= best))
        part = partial[rows, k]
        for lo in range(block, width, block):
            if not len(rows):
                break
            d = x[rows, lo : lo + block] - own[lo : lo + block]
            terms += d.size
            part = part + (d * d).sum(axis=1)
            stay = part <= best[rows]
            rows, part = rows[stay], part[stay]
        closer = (part < best[rows]) | (k < who[rows])
        best[rows[closer]], who[rows[closer]] = part[closer], k
    return who, best, terms


def _searched(column: pa.Array, centroids: np.ndarray, order: np.ndarray):
    """(integers, cluster, distance) of a batch, SIDE_BY_SIDE vectors at a time."""
    q = _matrix(column, len(order))
    for lo in range(0, len(q), SIDE_BY_SIDE):
        own = q[lo : lo + SIDE_BY_SIDE]
        yield own, *nearest(own, centroids, order)[:2]


def moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the means of their vectors; empty ones stay."""
    k, width = centroids.shape

    def work(batches):
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for b in batches:
            for own, who, _ in _searched(b.column(0), centroids, order):
                n += np.bincount(who, minlength=k)
                for c in np.unique(who):
                    total[c] += own[who == c].sum(axis=0, dtype=np.int64)
        c, d = np.divmod(np.arange(k * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(n[c]), pa.array(total[c, d])], names=["cluster", "dim", "n", "total"])

    out = centroids.copy()
    for r in vectors.select("q").mapInArrow(lean(work), "cluster int, dim int, n long, total long").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        if r.n:
            out[r.cluster, r.dim] = r.total // r.n  # Python's floors
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def work(batches):
        for b in batches:
            found = list(_searched(b.column(1), centroids, order))
            who, best = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(who.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "q").mapInArrow(lean(work), f"vec_id {kind}, cluster int, distance long")


def clustered(rows: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) after so many rounds over rows (vec_id, embedding)."""
    vectors = stored(integer_vectors(rows, width, scale), "integers")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), centroids
    order = by_variance(vectors, width)
    for _ in range(rounds):
        centroids = moved(vectors, centroids, order)
    found = stored(assigned(vectors, centroids, order), "assigned")
    forget(vectors)
    return found, centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Assignments with cluster_inertia, inertia, and the digest of each one's centroid."""
    own = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    told = [(c, own.get(c, 0), sum(own.values()), hashlib.sha256(",".join(map(str, q)).encode()).hexdigest()) for c, q in enumerate(centroids.tolist())]
    of_each = found.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid
