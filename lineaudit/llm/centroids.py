"""Exact integer k-means whose assignments are found by Orchard's search.

Centroids keep a list of all centroids by distance from them. A vector starts at some centroid and walks down its list:
a centroid that is closer than the best so far (or as close with a smaller number) becomes the best one and the walk goes
on in its list; centroids seen before are skipped; the walk ends at the first centroid that lies strictly beyond twice the
best distance, since by the triangle inequality neither it nor any later one can be as close. All vectors of an Arrow batch
walk at the same time.

Components x of a vector become floor(256 x). Distances are squared Euclidean and exact: a kept vector may have no
component beyond ``WIDEST`` then, which keeps every sum within 64 bits (an error names the vector, none is dropped).
Vectors that are null, of another length or with null or non-finite components are left out. Equal vectors and repeated
or null ids are rows like any other. Fewer vectors than ``k`` give fewer centroids, an empty table gives no rows.

Vectors never move: a task assigns its own and adds them up per centroid, and only those sums (k rows per task) are
shuffled. The driver holds the k centroids and their k x k distances, whose size the data does not change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.llm.common import settle

#: Largest magnitude of a scaled component: (2 * 2^26)^2 * 256 components < 2^63.
WIDEST = 1 << 26
LONGEST = 256
SCALE = 256


class Lists:
    """The neighbour lists of a set of centroids, built once per task."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        gap = centroids[:, None, :] - centroids[None, :, :]
        between = np.einsum("ijd,ijd->ij", gap, gap)
        k = len(centroids)
        # A centroid leads its own list; equal ones follow by number.
        self.order = np.lexsort((np.broadcast_to(np.arange(k), (k, k)), between), axis=1)
        self.reach = np.take_along_axis(between, self.order, axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of every vector, the smaller number among equals."""
        n, k = len(vectors), len(self.centroids)
        best = np.zeros(n, np.int64)
        gap = vectors - self.centroids[0]
        closest = np.einsum("nd,nd->n", gap, gap)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        at = np.ones(n, np.int64)
        walking = np.arange(n) if k > 1 else np.arange(0)
        while len(walking):
            here, place = best[walking], at[walking]
            # Squares: beyond twice the distance is beyond four times its square, written without the product.
            reach = self.reach[here, place]
            go = (reach + 3) // 4 <= closest[walking]
            walking, here, place = walking[go], here[go], place[go]
            met = self.order[here, place]
            at[walking] += 1
            new = ~seen[walking, met]
            who, met = walking[new], met[new]
            seen[who, met] = True
            gap = vectors[who] - self.centroids[met]
            found = np.einsum("nd,nd->n", gap, gap)
            jump = (found < closest[who]) | ((found == closest[who]) & (met < best[who]))
            who = who[jump]
            best[who], closest[who], at[who] = met[jump], found[jump], 0
            walking = walking[at[walking] < k]
        return best, closest


def scaled(embedding: Column, size: int) -> Column:
    """floor(256 x) per component, null for vectors that are not kept."""
    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    keep = (F.size(embedding) == size) & ~F.exists(embedding, odd)
    wide = F.exists(embedding, lambda x: F.abs(x.cast("double") * SCALE) >= WIDEST)
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return F.when(keep, F.when(~wide, whole).otherwise(F.raise_error(F.lit(
        f"a component is beyond {WIDEST} / {SCALE}: squared distances would not fit 64 bits")).cast("array<int>")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _batches(chunks: Iterator[pa.RecordBatch], lists: Lists, size: int):
    for b in chunks:
        if b.num_rows:
            vectors = _matrix(b.column("v"), size)
            yield b, vectors, *lists.nearest(vectors)


def summed(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Per centroid the sum of each component of its vectors and, in the last column, their number."""
    k, size = centroids.shape

    def run(chunks):
        lists, sums = Lists(centroids), np.zeros((k, size + 1), np.int64)
        for _, v, best, _ in _batches(chunks, lists, size):
            sums[:, size] += np.bincount(best, minlength=k)
            order = np.argsort(best, kind="stable")
            heads = np.flatnonzero(np.diff(best[order], prepend=-1))
            sums[best[order][heads], :size] += np.add.reduceat(v[order], heads, axis=0)
        held = np.flatnonzero(sums[:, size])
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(list(sums[held]), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = vectors.mapInArrow(run, "cluster bigint, sums array<bigint>").select("cluster", F.posexplode("sums").alias("i", "x"))
    out = np.zeros((k, size + 1), np.int64)
    for r in parts.groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect():  # k * (size + 1) numbers
        out[r["cluster"], r["i"]] = r["x"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every row of ``vectors(vec_id, v)``."""
    size = centroids.shape[1]
    id_type = pa.int64()

    def run(chunks):
        lists = Lists(centroids)
        for b, _, best, closest in _batches(chunks, lists, size):
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(id_type), pa.array(best.astype(np.int32)), pa.array(closest)],
                                             names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest digest of their id, in this order; k rows on the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def clustered(embeddings: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: str = "2") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every kept vector, the final centroids), from ``embeddings(vec_id, embedding)``."""
    if size > LONGEST:
        raise ValueError(f"vectors of over {LONGEST} components would need wider sums")
    vectors = settle(embeddings.select("vec_id", scaled(F.col("embedding"), size).alias("v")).where("v is not null"))
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return assigned(vectors, np.zeros((1, size), np.int64)), centroids
    for _ in range(rounds):
        sums = summed(vectors, centroids)
        held = sums[:, size] > 0
        centroids = np.where(held[:, None], sums[:, :size] // np.where(held, sums[:, size], 1)[:, None], centroids)
    return assigned(vectors, centroids), centroids


def report(embeddings: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, cluster_size) per kept vector."""
    spark = embeddings.sparkSession
    rows, centroids = clustered(embeddings, **options)
    rows = settle(rows)
    inertia = {r["cluster"]: r for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d"), F.count("*").alias("n")).collect()}
    facts = [(c, r["d"], sum(x["d"] for x in inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), r["n"])
             for c, r in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, cluster_size bigint")
    # One row per centroid, whatever the number of vectors.
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size")
