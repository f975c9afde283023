"""Centroid clustering by delta Lloyd on integer vectors.

The kept vectors are written once as integers with their owner and distance, and every round writes them
anew with what changed. A round knows which centroids the last one moved. A vector whose owner stayed
where it was keeps its stored distance and is compared with the moved centroids only; a vector whose
owner moved is compared with all. Cluster sums and counts are kept over the rounds: vectors that changed
their owner are taken off one sum and put to another, signed, by partial sums before the shuffle, so that
only k rows of integers reach the driver. All arithmetic is on integers, hence results depend neither on
partitions nor on the order of sums.

Defined results: vectors that are null, of another length than `dim`, or that hold a null or non-finite
component are not kept and have no row in the result. Components, scaled and floored, are held within
2^27 on both sides (reached by values beyond two million only), so that distances fit a long. Repeated rows are
vectors of their own. A null id takes part but is no start; fewer vectors than k give as many centroids;
of centroids at the same distance the one of smaller number owns; a centroid without vectors stays where
it is; an empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import stash

LIMIT = 2**27
STATE = "vec_id long, v array<int>, was int, owner int, distance long"


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of two integer matrices."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) ** 2 * 4 * x.shape[1] < 2**52:
        a, b = x.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and distance after the centroids flagged in `moved` moved; an owner of -1 stands for none yet."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | moved[owner]
    if lost.any():
        d = squared_distances(x[lost], centroids)
        owner[lost] = d.argmin(1)
        distance[lost] = d.min(1)
    near = np.flatnonzero(moved)
    kept = np.flatnonzero(~lost)
    if len(near) and len(kept):
        d = squared_distances(x[kept], centroids[near])
        best, least = near[d.argmin(1)], d.min(1)
        taken = (least < distance[kept]) | ((least == distance[kept]) & (best < owner[kept]))
        owner[kept[taken]], distance[kept[taken]] = best[taken], least[taken]
    return owner, distance


def _assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            v = b.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(b), centroids.shape[1])
            was, before = (b.column(n).to_numpy(zero_copy_only=False) for n in ("owner", "distance"))
            owner, distance = reassigned(x, was, before, centroids, moved)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), v, pa.array(was), pa.array(owner, pa.int32()), pa.array(distance)], names=["vec_id", "v", "was", "owner", "distance"])

    return state.mapInArrow(run, STATE)


def _transfers(state: DataFrame, dim: int) -> list:
    """cluster, n, s0, s1, ...: signed counts and sums of the vectors that changed their owner."""
    ends = F.array(F.struct(F.col("owner").alias("cluster"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("cluster"), F.lit(-1).alias("sign")))
    signed = state.filter("owner != was").select("v", F.explode(ends).alias("e")).select("v", "e.*").filter("cluster >= 0")
    return signed.groupBy("cluster").agg(F.sum("sign").alias("n"), *[F.sum(F.col("sign") * F.col("v")[j].cast("long")).alias(f"s{j}") for j in range(dim)]).collect()


def integer_vectors(vectors: DataFrame, dim: int, scale: int, column: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors of `dim` finite components, each floor(scale * x)."""
    finite = F.forall(column, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    whole = F.transform(column, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return vectors.filter((F.size(column) == dim) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Start: the k vectors of least sha256 of `1:<vec_id>`. After `rounds` rounds vectors are assigned once more.
    """
    spark = vectors.sparkSession
    none = F.lit(-1)
    state = stash(integer_vectors(vectors, dim, scale).withColumns({"was": none, "owner": none, "distance": F.lit(0).cast("long")}), "centroid-vectors")
    first = state.filter("vec_id is not null").orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256), "v").limit(k).select("v").collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dim)
    summary = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return state.limit(0).select("vec_id", F.col("owner").alias("cluster"), "distance").join(F.broadcast(spark.createDataFrame([], summary)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    moved = np.ones(len(centroids), bool)
    counts, sums = [0] * len(centroids), [[0] * dim for _ in centroids]
    for n in range(rounds + 1):
        state = stash(_assign(state, centroids, moved), "centroid-owners")
        if n == rounds:
            break
        for cluster, more, *s in _transfers(state, dim):
            counts[cluster] += more
            sums[cluster] = [a + b for a, b in zip(sums[cluster], s)]
        after = np.array([[a // m for a in s] if m else c.tolist() for c, s, m in zip(centroids, sums, counts)], np.int64)
        moved = (after != centroids).any(1)
        centroids = after
    inertia = {r["owner"]: r["d"] for r in state.groupBy("owner").agg(F.sum("distance").alias("d")).collect()}
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, d, sum(inertia.values()), digests[c]) for c, d in inertia.items()]
    told = F.broadcast(spark.createDataFrame(rows, summary))  # at most k rows
    return state.select("vec_id", F.col("owner").alias("cluster"), "distance").join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
