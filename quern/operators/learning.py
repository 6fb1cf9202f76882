"""Linear models from Gram matrices, group-wise baselines, interpretable scores, ordered folds."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import staged
from .aggregates import spearman
from .grams import Candidate, Grams, chosen_inside, clamp, cross_validate, held_out, nested, predicted  # noqa: F401


def gram(df: DataFrame, features: list[str], target: str, group: str | None = None, weight: str | None = None) -> DataFrame:
    """(group, i, j, s): sums of w * x_i * x_j, with the intercept as feature "1" and the target as "y".

    One aggregation with all products as columns: every fold, subset and ridge strength is solved
    from these (features + 2)^2 / 2 numbers a group, without another pass.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    cols = {"1": F.lit(1.0), **{f: F.col(f).cast("double") for f in features}, "y": F.col(target).cast("double")}
    pairs = list(combinations_with_replacement(cols, 2))
    keys = [group] if group else []
    sums = df.groupBy(*keys).agg(*[F.sum(w * cols[a] * cols[b]).alias(f"s{n}") for n, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"s{n}").alias("s")) for n, (a, b) in enumerate(pairs)])
    return sums.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")


def solve(cells: list, features: list[str], alpha: float) -> dict[str, float]:
    """Ridge weights (the intercept free) from the cells of ``gram``: at most (features + 2)^2 numbers."""
    names = ["1", *features]
    value = {(c["i"], c["j"]): c["s"] for c in cells} | {(c["j"], c["i"]): c["s"] for c in cells}
    a = np.array([[value[(i, j)] for j in names] for i in names]) + alpha * np.diag([0.0] + [1.0] * len(features))
    return dict(zip(names, np.linalg.solve(a, np.array([value[(i, "y")] for i in names])).tolist(), strict=True))


def answered(df: DataFrame, rules: dict[str, Column], pred: str, truth: str, keys: list[str]) -> DataFrame:
    """(keys, rule, coverage, within_1, mae): answers that a rule lets out. A NULL prediction is no answer."""
    told = {n: F.coalesce(c, F.lit(False)) & F.col(pred).isNotNull() for n, c in rules.items()}
    rows = df.where(F.col(truth).isNotNull()).withColumn("__rule", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("told")) for n, c in told.items()])))
    error = F.when(F.col("__rule.told"), F.abs(F.col(pred) - F.col(truth)))
    return rows.groupBy(*keys, F.col("__rule.rule").alias("rule")).agg(
        F.round(F.avg(F.col("__rule.told").cast("int")), 6).alias("coverage"), F.round(F.avg((error <= 1).cast("int")), 6).alias("within_1"),
        F.round(F.avg(error), 6).alias("mae"),
    )


def weak_gate(rows: DataFrame, group: str, origin: str, truth: str, weak: str, pool_mean: float) -> DataFrame:
    """(n, weak_within_1, origin_within_1, rho, beats) of weak labels on the rows that have one and a truth.

    A weak label is centred as training does it: less the pool's mean, plus the mean truth of the other groups. It has
    to beat the mean truth of the origin's rows in other groups (of all of them, if there are fewer than two).
    """
    known = rows.where(F.col(truth).isNotNull())
    outer = others_mean(known, [group], [], truth).withColumnRenamed("others_mean", "__all")
    sums = known.groupBy(group, origin).agg(F.sum(truth).alias("__s"), F.count(truth).alias("__n"))
    w = Window.partitionBy(origin)
    here = sums.withColumn("__rn", F.sum("__n").over(w) - F.col("__n")).withColumn("__m", (F.sum("__s").over(w) - F.col("__s")) / F.nullif(F.col("__rn"), F.lit(0)))
    have = known.where(F.col(weak).isNotNull()).join(outer, group).join(here.select(group, origin, "__rn", "__m"), [group, origin], "left")
    base = F.when(F.col("__rn") >= 2, F.col("__m")).otherwise(F.col("__all"))
    centred = have.withColumn("__c", F.col(weak) - (F.lit(pool_mean) - F.col("__all"))).withColumn("__base", base)
    near = lambda c: F.avg((F.abs(F.col(c) - F.col(truth)) <= 1).cast("int"))
    out = centred.agg(F.count(F.lit(1)).alias("n"), F.round(near("__c"), 6).alias("weak_within_1"), F.round(near("__base"), 6).alias("origin_within_1"))
    rho = spearman(centred.withColumn("__one", F.lit(1)), ["__one"], "__c", truth).select("rho")
    return out.crossJoin(F.broadcast(rho)).withColumn("beats", F.col("weak_within_1") > F.col("origin_within_1"))


def transfer(rows: DataFrame, weights: list[float], features: list[str], truth: str, store: str, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """(store, n, mae, within_1, mean_mae, rho): a fitted model on another source's labels, beside that source's mean."""
    table = rows.where(F.col(truth).isNotNull()).withColumn("weights", F.array(*[F.lit(w) for w in weights]))
    scored = table.withColumn("pred", predicted(rows, features, low=low, high=high))
    means = scored.groupBy(store).agg(F.avg(truth).alias("__mean"))
    error = F.abs(F.col("pred") - F.col(truth))
    out = scored.join(means, store).groupBy(store).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(error), 6).alias("mae"), F.round(F.avg((error <= 1).cast("int")), 6).alias("within_1"),
        F.round(F.avg(F.abs(F.col("__mean") - F.col(truth))), 6).alias("mean_mae"),
    )
    return out.join(spearman(scored.withColumn("pred", F.round("pred", 6)), [store], "pred", truth).select(store, "rho"), store, "left")


def vector_grams(df: DataFrame, vector: str, target: str, fold: str) -> dict:
    """fold -> Gram matrix of (1, vector, target). Tasks sum products of whole batches; one small matrix a task and fold is
    shuffled, as rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for k, part in batch.groupby("f"):
                x = np.column_stack([np.ones(len(part)), np.array(part["v"].tolist(), dtype=float), part["y"].to_numpy(dtype=float)])
                sums[k] = sums.get(k, 0) + x.T @ x
        for k, m in sums.items():
            i, j = np.triu_indices(len(m))
            yield pd.DataFrame({"f": k, "i": i, "j": j, "s": m[i, j]})

    rows = df.where(F.col(target).isNotNull() & F.col(vector).isNotNull()).select(F.col(fold).cast("long").alias("f"), F.col(vector).alias("v"), F.col(target).cast("double").alias("y"))
    out: dict = {}
    for r in rows.mapInPandas(run, "f long, i long, j long, s double").groupBy("f", "i", "j").agg(F.sum("s").alias("s")).collect():
        out.setdefault(r["f"], {})[(r["i"], r["j"])] = r["s"]
    full = {}
    for k, cells in out.items():
        size = max(i for i, _ in cells) + 1
        full[k] = np.zeros((size, size))
        for (i, j), v in cells.items():
            full[k][i, j] = full[k][j, i] = v
    return full


def vector_ridge(grams: dict, alpha: float, without=None) -> list[float]:
    """Intercept and weights of a ridge on vectors, from the folds but one."""
    m = sum(v for k, v in grams.items() if k != without)
    a = m[:-1, :-1] + alpha * np.diag([0.0] + [1.0] * (len(m) - 2))
    return np.linalg.solve(a, m[:-1, -1]).tolist()


def pick_vector_model(df: DataFrame, vector: str, target: str, fold: str, alphas: list[float]) -> DataFrame:
    """(alpha, mae, picked): ridge strengths on vectors by their mean absolute error on held-out folds; least wins, the first of
    equal ones. A very large strength is the mean."""
    grams = vector_grams(df, vector, target, fold)
    rows = [(float(a), k, vector_ridge(grams, a, k)) for a in alphas for k in sorted(grams)]
    table = df.sparkSession.createDataFrame(rows, "alpha double, __f long, w array<double>")
    scored = df.where(F.col(target).isNotNull()).withColumn("__f", F.col(fold).cast("long")).join(F.broadcast(table), "__f")
    dot = F.aggregate(F.zip_with(F.slice("w", 2, 1 << 20), F.col(vector), lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    mae = scored.groupBy("alpha").agg(F.round(F.avg(F.abs(F.col("w")[0] + dot - F.col(target))), 6).alias("mae"))
    order = Window.orderBy("mae", "alpha")  # a row per strength
    return mae.withColumn("picked", F.row_number().over(order) == 1)


def others_mean(df: DataFrame, group: list[str], outer: list[str], value: str) -> DataFrame:
    """Per group, the mean of ``value`` over the other groups of its outer key."""
    sums = df.groupBy(*outer, *group).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    w = Window.partitionBy(*outer)
    s, n = F.sum("__s").over(w) - F.col("__s"), F.sum("__n").over(w) - F.col("__n")
    return sums.select(*outer, *group, (s / F.nullif(n, F.lit(0))).alias("others_mean"))


def group_offsets(df: DataFrame, group: str, residual: Column, shrink: float, weight: Column | None = None) -> DataFrame:
    """Mean residual by group, shrunken towards zero."""
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(group).agg((F.sum(w * residual) / (F.sum(w) + shrink)).alias("offset"))


def contributions(weights: dict[str, float], features: dict[str, Column], least: float, k: int) -> tuple[Column, Column]:
    """(prediction without intercept, the names of the ``k`` largest contributions of at least ``least``)."""
    parts = F.array(*[F.struct((F.lit(w) * features[n]).alias("c"), F.lit(n).alias("n")) for n, w in weights.items()])
    big = F.filter(parts, lambda p: F.abs(p["c"]) >= least)
    ordered = F.array_sort(F.transform(big, lambda p: F.struct((-F.abs(p["c"])).alias("a"), p["n"].alias("n"))))
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["c"])
    return total, F.transform(F.slice(ordered, 1, k), lambda p: p["n"])


def boosted_baseline(df: DataFrame, features: list[str], target: str, fold: Column, trees: int = 10, depth: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(importances, errors) of a gradient-boosted regression: (feature, importance), and (mae, mean_mae) on the rows where
    ``fold`` holds, which it did not see, beside the mean of what it saw. Rows with a NULL are left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = df.select(*features, F.col(target).cast("double").alias("__y"), fold.alias("__test")).dropna()
    rows = VectorAssembler(inputCols=features, outputCol="__x").transform(rows)
    seen = rows.where("NOT __test")
    model = GBTRegressor(featuresCol="__x", labelCol="__y", maxIter=trees, maxDepth=depth, seed=seed).fit(seen)
    mean = seen.agg(F.avg("__y").alias("__m"))
    errors = model.transform(rows.where("__test")).crossJoin(F.broadcast(mean)).agg(
        F.avg(F.abs(F.col("prediction") - F.col("__y"))).alias("mae"), F.avg(F.abs(F.col("__m") - F.col("__y"))).alias("mean_mae")
    )
    importance = list(zip(features, map(float, model.featureImportances.toArray()), strict=True))
    return df.sparkSession.createDataFrame(importance, "feature string, importance double"), errors


def ships(model: DataFrame, vote: DataFrame, key: str, margin: float = 0.05) -> DataFrame:
    """(key, model_f1, vote_f1, ship): whether a model beats the neighbours' vote by the margin. Both have key and f1; a missing one is 0."""
    a, b = model.select(key, F.col("f1").alias("model_f1")), vote.select(key, F.col("f1").alias("vote_f1"))
    both = a.join(b, key, "full").select(key, F.coalesce("model_f1", F.lit(0.0)).alias("model_f1"), F.coalesce("vote_f1", F.lit(0.0)).alias("vote_f1"))
    return both.withColumn("ship", F.col("model_f1") >= F.col("vote_f1") + margin - 1e-9)


def or_others_mean(df: DataFrame, pred: str, truth: str, group: str) -> DataFrame:
    """Add ``filled``: the prediction or, where there is none, the mean truth of the other groups."""
    means = others_mean(df, [group], [], truth)
    return df.join(means, group).withColumn("filled", F.coalesce(pred, "others_mean")).drop("others_mean")


def same_result(name: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """(run, n, identical): whether two runs gave the same rows, by order-independent checksums of all columns."""
    columns = sorted(first.columns)
    digest = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64(*columns) % 1_000_003), F.lit(0)).alias("s"))
    a, b = digest(first).alias("a"), digest(second).alias("b")
    same = (F.col("a.n") == F.col("b.n")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.s") == F.col("b.s"))
    return a.crossJoin(b).select(F.lit(name).alias("run"), F.col("a.n").alias("n"), same.alias("identical"))


def dense(x: np.ndarray, weights: np.ndarray, bias: np.ndarray, activation: str) -> np.ndarray:
    """One layer of a network: relu, sigmoid or identity."""
    z = x @ weights + bias
    return np.maximum(z, 0) if activation == "relu" else 1 / (1 + np.exp(-z)) if activation == "sigmoid" else z


def network_tags(df: DataFrame, key: str, vector: str, layers: list[tuple[np.ndarray, np.ndarray, str]], labels: list[str], threshold: float, most: int = 5) -> DataFrame:
    """(key, tag, p, rank): the labels of at least ``threshold``, the most likely first, ties by label, ``most`` of them. The
    weights are a model's, so bounded, and go with the tasks; batches are multiplied as matrices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = np.argsort(np.array(labels))
        for batch in batches:
            batch = batch[batch["v"].notna()]
            x = np.array(batch["v"].tolist(), dtype=float).reshape(len(batch), -1)
            for w, b, activation in layers:
                x = dense(x, w, b, activation) if len(x) else x
            out = []
            for k, p in zip(batch["k"], x, strict=True):
                best = [j for j in order[np.argsort(-p[order], kind="stable")] if p[j] >= threshold][:most]
                out += [(k, labels[j], float(p[j]), i) for i, j in enumerate(best, 1)]
            yield pd.DataFrame(out, columns=["k", "tag", "p", "rank"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, f"k {kind}, tag string, p double, rank int").withColumnRenamed("k", key)


def indicators(value: Column, values: list[str], prefix: str) -> dict[str, Column]:
    """One 0/1 feature for each listed value; NULL and others have none."""
    return {f"{prefix}{v}": F.coalesce((value == v).cast("double"), F.lit(0.0)) for v in values}


def bands(value: Column, edges: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """One 0/1 feature for each range, its end exclusive."""
    return {n: F.coalesce(((value >= a) & (value < b)).cast("double"), F.lit(0.0)) for n, (a, b) in edges.items()}


def capped_counts(items: Column, values: list[str], prefix: str, most: int = 3) -> dict[str, Column]:
    """How often each value is in an array, up to ``most``."""
    n = lambda v: F.size(F.filter(items, lambda x: x == v))
    return {f"{prefix}{v}": F.greatest(F.lit(0.0), F.least(F.lit(float(most)), n(v).cast("double"))) for v in values}


def centred(value: Column, middle: float = 3.0) -> Column:
    """A value about the scale's middle, 0 where it is missing."""
    return F.coalesce(F.round(value - middle, 4), F.lit(0.0))
