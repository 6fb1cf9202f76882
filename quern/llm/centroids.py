"""Centroid clustering in expressions of the JVM: k-means over integer vectors, exact at every size.

A vector's squared distance to a literal centroid array is |x|^2 - 2 x.c + |c|^2, the product being a ``zip_with``
folded by ``aggregate``; ``array_min`` of (distance, number) structs chooses the cluster, and grouped sums of
the component columns, at most k rows a task, move the centroids. All numbers are 64-bit integers, so neither
the order of rows nor their partitioning changes a result. The driver sees k centroids, never a vector.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

#: Largest absolute component for which distances over 64 components fit a long.
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, x (``dims`` longs, floor(scale * component)), most (its largest size) and xx (its squared length,
    NULL beyond ``LARGEST``) of the usable rows.

    Usable vectors have exactly ``dims`` components, none NULL, NaN or infinite.
    """
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))))
    kept = kept.where(F.coalesce((F.size(v) == dims) & finite, F.lit(False))).select("vec_id", x.alias("x"))
    kept = kept.withColumn("most", F.array_max(F.transform("x", lambda c: F.greatest(c, -1 - c))))
    return kept.withColumn("xx", F.when(F.col("most") <= LARGEST, F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c * c)))


def _nearest(centroids: list[list[int]]) -> Column:
    """The (distance, cluster) struct of the centroid nearest to x; of equally near ones that with the smaller number."""
    to = [
        f"struct(xx + {sum(v * v for v in c)}L - 2 * aggregate(zip_with(x, array({', '.join(f'{v}L' for v in c)}), (a, b) -> a * b), 0L, (t, p) -> t + p)"
        f" AS distance, {i} AS cluster)"
        for i, c in enumerate(centroids)
    ]
    return F.expr(f"array_min(array({', '.join(to)}))")  # written as text: thousands of literals, one call


def initial_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the k smallest sha256 of ``<seed>:<vec_id>``; NULL ids come last, ties go by the vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k)
    return [list(r.x) for r in first.collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid replaced by the floor of its vectors' mean; empty ones stay."""
    near = rows.select(_nearest(centroids)["cluster"].alias("cluster"), "x")
    sums = near.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(x[{i}]) AS s{i}") for i in range(len(centroids[0]))])
    out = list(centroids)
    for r in sums.collect():  # at most k rows
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(len(out[r.cluster]))]
    return out


def centroid_clusters(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable row; the centroids).

    ``vectors`` has vec_id and embedding; other columns are ignored. Rows that are not usable (see
    ``whole_vectors``) are left out. Repeated rows and ids are clustered each; a NULL id starts a centroid only
    where there are fewer than k others. With fewer than k usable rows there are as many centroids as rows; equal
    centroids leave the later one empty, and it stays. An empty table gives no rows and no centroids. A component
    beyond ``LARGEST`` in size is a ValueError, and a sum beyond a long is Spark's own error.
    """
    rows = staged(whole_vectors(vectors, dims, scale), "vectors")
    if (rows.agg(F.max("most")).first()[0] or 0) > LARGEST:
        raise ValueError(f"components must be at most {LARGEST // scale} in size")
    centroids = initial_centroids(rows, k, seed)
    if not centroids:
        none = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        columns = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in none.split(", ")]
        return rows.select("vec_id", *columns).limit(0), []
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    near = rows.select("vec_id", _nearest(centroids).alias("near"))
    final = staged(near.select("vec_id", "near.cluster", "near.distance"), "clusters")
    inertia = {r.cluster: r.d for r in final.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(inertia.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])[F.col("cluster")]
    return final.select(
        "vec_id", "cluster", "distance",
        at([inertia.get(i, 0) for i in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(total).cast("long").alias("inertia"), at(sha, "string").alias("centroid_sha256"),
    ), centroids
