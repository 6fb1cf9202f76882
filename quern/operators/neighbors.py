"""Exact nearest neighbours by cosine of every row of a table, pruned by pivots.

The angle between vectors is a metric. Vectors are put under the nearest of some pivots, and a pivot's reach is the largest
angle to one of its vectors. A query first meets the pivots next to it, which bounds the angle of its k-th neighbour; after that
only pivots whose reach can come under the bound: by the triangle inequality no vector of another pivot does. Pivots and reaches
are all that tasks need to know beforehand, so their size is set by a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..storage import staged

#: Room for rounding in angles.
EPS = 1e-6


def _unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at unit length, and which of them have a length (the others are left out)."""
    if not vectors:
        return np.zeros((0, 0)), np.zeros(0, dtype=bool)
    x = np.array(vectors, dtype=float)
    size = np.linalg.norm(x, axis=1)
    good = np.isfinite(size) & (size > 0)
    return x[good] / size[good, None], good


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if not len(x):
        return np.zeros((0, len(pivots)))
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def pruned_knn(
    queries: DataFrame, pool: DataFrame, *, key: str, vector: str, k: int, exclude: str | None = None, pivots: int = 64, block: int = 4096,
    counts: dict[str, int] | None = None,
) -> DataFrame:
    """(query, neighbor, rank, similarity): the ``k`` nearest of ``pool`` by cosine for each query, ties by key, itself left out.

    Rows that equal the query in ``exclude`` are left out. Vectors that are NULL, not finite or all zero have no neighbours and
    are none. Answers are those of all pairs, cosines counted to twelve digits. A pivot with more than ``block`` vectors is dealt
    over several tasks. ``counts`` takes the (query, vector) pairs that were compared, and all there are.
    """
    extra = [F.col(exclude).cast("string").alias("e")] if exclude else [F.lit(None).cast("string").alias("e")]
    pick = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), *extra)
    kind = pick(pool).schema["key"].dataType.simpleString()
    sample = pick(pool).where(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))).orderBy(F.xxhash64("key"), "key").limit(pivots)
    centres, _ = _unit([r.v for r in sample.select("v").collect()])  # at most ``pivots`` vectors
    none = queries.sparkSession.createDataFrame([], f"query {kind}, neighbor {kind}, rank int, similarity double")
    if not len(centres):
        return none

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, good = _unit(batch["v"].tolist())
            angles = _angles(x, centres)
            near = angles.argmin(axis=1)
            own = batch[good]
            yield pd.DataFrame({"key": own["key"], "e": own["e"], "v": pd.Series(list(x), index=own.index, dtype=object), "c": near, "a": angles[np.arange(len(x)), near]})

    rows = pick(pool).mapInPandas(placed, f"key {kind}, e string, v array<double>, c int, a double")
    rows = staged(rows, "placed")
    told = {r.c: r for r in rows.groupBy("c").agg(F.max("a").alias("reach"), F.count(F.lit(1)).alias("n")).collect()}
    size = np.array([told[c].n if c in told else 0 for c in range(len(centres))])
    reach = np.array([told[c].reach if c in told else -np.inf for c in range(len(centres))])
    blocks = F.element_at(F.array(*[F.lit(int(max(1, -(-n // block)))) for n in size]), F.col("c") + 1)
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("key"), blocks).cast("int"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with the nearest pivots that have k + 1 vectors together."""
        for batch in batches:
            x, good = _unit(batch["v"].tolist())
            own, out = batch[good].reset_index(drop=True), []
            for i, angles in enumerate(_angles(x, centres)):
                have = 0
                for c in np.argsort(angles):
                    if size[c]:
                        out.append((i, c))
                        have += size[c]
                        if have > k:
                            break
            at = [i for i, _ in out]
            yield pd.DataFrame({"key": own["key"].iloc[at].to_numpy(), "e": own["e"].iloc[at].to_numpy(), "v": pd.Series([x[i] for i in at], dtype=object), "c": [c for _, c in out]})

    def later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with the pivots that it has not met and that may hold a nearer vector."""
        for batch in batches:
            out = []
            x = np.array(batch["v"].tolist(), dtype=float)
            for i, angles in enumerate(_angles(x, centres)):
                bound, met = batch["bound"].iloc[i], set(batch["met"].iloc[i])
                out += [(i, c) for c in np.flatnonzero((size > 0) & (angles - reach <= bound + EPS)) if c not in met]
            at = [i for i, _ in out]
            yield pd.DataFrame({"key": batch["key"].iloc[at].to_numpy(), "e": batch["e"].iloc[at].to_numpy(), "v": pd.Series([x[i] for i in at], dtype=object), "c": [c for _, c in out]})

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            b = b.sort_values("key")
            near = np.round(np.array(a["v"].tolist()) @ np.array(b["v"].tolist()).T, 12)
            near[a["key"].to_numpy()[:, None] == b["key"].to_numpy()[None, :]] = -np.inf
            if exclude:
                near[(a["e"].to_numpy()[:, None] == b["e"].to_numpy()[None, :]) & b["e"].notna().to_numpy()[None, :]] = -np.inf
            keys, others = a["key"].tolist(), b["key"].tolist()
            at = min(k, near.shape[1]) - 1
            bound = -np.partition(-near, at, axis=1)[:, at]
            for i in range(len(a)):
                found = np.flatnonzero((near[i] >= bound[i]) & (near[i] > -np.inf))  # in the order of keys, ties included
                out += [(keys[i], others[j], float(near[i, j])) for j in found[np.argsort(-near[i, found], kind="stable")][:k]]
        return pd.DataFrame(out, columns=["query", "neighbor", "similarity"])

    def compared(asked: DataFrame) -> DataFrame:
        """The k best of each query and block of a pivot. A pivot's queries are dealt in blocks, too."""
        left = asked.withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("q", F.pmod(F.xxhash64("key"), shares[F.col("c")]).cast("int"))
        right = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), shares[F.col("c")] - 1)))
        by = ["c", "b", "q"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best, f"query {kind}, neighbor {kind}, similarity double")

    def dealt_over(asked: DataFrame):
        n = {r.c: r["count"] for r in asked.groupBy("c").count().collect()}
        if counts is not None:
            counts["compared"] = counts.get("compared", 0) + int(sum(m * size[c] for c, m in n.items()))
        return F.array(*[F.lit(int(max(1, -(-n.get(c, 0) // block)))) for c in range(len(centres))])

    fields = f"key {kind}, e string, v array<double>, c int"
    asked = staged(pick(queries).mapInPandas(first, fields), "asked")
    shares = dealt_over(asked)
    order = [F.col("similarity").desc(), F.col("neighbor")]
    top = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    begun = staged(top(compared(asked)), "begun")
    bounds = begun.groupBy(F.col("query").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least"))
    bound = F.when(F.col("n") >= k, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "least")))).otherwise(10.0)
    met = asked.groupBy("key", "e", "v").agg(F.collect_set("c").alias("met")).join(bounds, "key", "left")
    rest = met.select("key", "e", "v", "met", F.coalesce(bound, F.lit(10.0)).alias("bound"))
    asked = staged(rest.mapInPandas(later, fields), "later")
    shares = dealt_over(asked)
    if counts is not None:
        counts["all"] = int(size.sum()) * rest.select("key").distinct().count()
    both = begun.select("query", "neighbor", "similarity").unionByName(compared(asked)).distinct()
    return top(both).select("query", "neighbor", F.col("rank").cast("int").alias("rank"), "similarity")
