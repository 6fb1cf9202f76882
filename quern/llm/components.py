"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to u's smallest neighbour (or u)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large")
    out = both.join(least, "u").where(F.col("v") > F.col("u"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the smallest of them. Edges have u > v here."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "small")
    moved = edges.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v: longs); root is the component's smallest node.

    Self-loops and repeated edges are allowed, NULL ends are ignored. Every half round is written to
    the shared folder. The smallest-neighbour tables are written before their joins, so that the
    rows of a node with very many neighbours can be split over tasks.
    """
    clean = edges.where("u is not null and v is not null and u != v")
    clean = clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = staged(clean, "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        large = staged(_large_star(now).where("u != v").distinct(), "edges")
        now = staged(_small_star(large).where("u != v").distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
