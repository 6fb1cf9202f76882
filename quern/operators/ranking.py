"""Ranks, top-k, first and last rows by key. Every order ends in a unique key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import staged


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows of each key. Spark prunes below the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: one aggregation, no sort of the group."""
    return _extreme(df, keys, order, F.min_by)


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, as in a log where later lines win."""
    return _extreme(df, keys, order, F.max_by)


def _extreme(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Whether two aliased sides agree in ``keys``, NULLs being equal; no keys agree always."""
    return reduce(lambda a, k: a & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")), keys, F.lit(True))


def running_counts(df: DataFrame, group: list[str], value: str, measures: dict[str, Column], buckets: int = 64, few: int = 1 << 18) -> DataFrame:
    """(group, value, each measure, upto_<measure>, all_<measure>): sums per distinct value, up to it, and of the group.

    ``value`` is numeric; NULLs are left out. The sums by distinct value are staged and counted: up to ``few`` in a group,
    one window adds them up. Beyond that there are two levels: distinct values are cut into about equal ranges at
    approximate quantiles (any cut gives the same sums), summed within a range, and a range starts
    with the sums of those before it. So no task holds more than ``few`` of a group's distinct values.
    """
    sums = staged(df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(*[c.alias(m) for m, c in measures.items()]), "sums")
    if (sums.groupBy(*group).count().agg(F.max("count")).first()[0] or 0) <= few:
        by, upto = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return sums.select(*group, value, *measures, *[F.sum(m).over(upto).alias(f"upto_{m}") for m in measures], *[F.sum(m).over(by).alias(f"all_{m}") for m in measures])
    cuts = sums.groupBy(*group).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 500).alias("__cuts"))
    s, c = sums.alias("s"), F.broadcast(cuts.alias("c")) if not group else cuts.alias("c")
    below = F.size(F.filter("__cuts", lambda x: x < F.col(value)))
    dealt = staged(s.join(c, same_keys("s", "c", group)).select("s.*", below.alias("__range")), "ranges")
    ranges = dealt.groupBy(*group, "__range").agg(*[F.sum(m).alias(f"__{m}") for m in measures])
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    every = Window.partitionBy(*group)
    starts = ranges.select(
        *group, "__range", *[F.coalesce(F.sum(f"__{m}").over(before), F.lit(0)).alias(f"__start_{m}") for m in measures],
        *[F.sum(f"__{m}").over(every).alias(f"all_{m}") for m in measures],
    )
    upto = Window.partitionBy(*group, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d, t = dealt.alias("d"), starts.alias("t")
    joined = d.join(t, same_keys("d", "t", [*group, "__range"])).select("d.*", *[f"t.__start_{m}" for m in measures], *[f"t.all_{m}" for m in measures])
    out = joined.select("*", *[(F.col(f"__start_{m}") + F.sum(m).over(upto)).alias(f"upto_{m}") for m in measures])
    return out.select(*group, value, *measures, *[f"upto_{m}" for m in measures], *[f"all_{m}" for m in measures])


def average_ranks(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the rank in the group, ties at their mean; NULL values have none."""
    counts = running_counts(df, group, value, {"n": F.count(F.lit(1))})
    ranks = counts.select(*group, value, (F.col("upto_n") - (F.col("n") - 1) / 2).alias(out), F.col("all_n").alias(f"{out}_of"))
    a, b = df.alias("a"), ranks.alias("b")
    return a.join(b, same_keys("a", "b", group) & (F.col(f"a.{value}") == F.col(f"b.{value}")), "left").select("a.*", f"b.{out}", f"b.{out}_of")


def quintile(df: DataFrame, group: list[str], value: str, out: str = "quintile", classes: int = 5) -> DataFrame:
    """Classes 1..``classes`` by rank within the group, ties by their average rank, NULL stays NULL."""
    ranked = average_ranks(df, group, value, "__rank")
    share = F.col("__rank") / F.col("__rank_of")
    place = F.least(F.lit(classes), F.greatest(F.lit(1), F.ceil(share * classes - 1e-9))).cast("int")
    return ranked.withColumn(out, F.when(share.isNotNull(), place)).drop("__rank", "__rank_of")


def exact_percentiles(df: DataFrame, group: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """(group, n, a column per entry of ``ps``): percentiles interpolated linearly between neighbours, NULLs left out.

    Exact without holding a group's values in one place: the two values at a percentile's ranks are found in
    the running counts.
    """
    counts = running_counts(df, group, value, {"n": F.count(F.lit(1))})
    place = {name: (F.col("all_n") - 1) * p for name, p in ps.items()}
    found = []
    for name, at in place.items():
        found += [
            F.min(F.when(F.col("upto_n") > F.floor(at), F.col(value))).alias(f"__lo_{name}"),
            F.min(F.when(F.col("upto_n") > F.ceil(at), F.col(value))).alias(f"__hi_{name}"),
            F.max(at - F.floor(at)).alias(f"__part_{name}"),
        ]
    out = counts.groupBy(*group).agg(F.max("all_n").alias("n"), *found)
    between = lambda n: F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__part_{n}")
    return out.select(*group, "n", *[between(n).alias(n) for n in ps])


def owned_by_first(df: DataFrame, key: str, owner: str, order: list[str]) -> DataFrame:
    """Drop rows whose key was first seen with another owner; rows without a key stay."""
    has = F.col(key).isNotNull() & (F.col(key) != "")
    first = df.where(has).groupBy(key).agg(F.min_by(owner, F.struct(*order)).alias("__owner"))
    kept = df.where(has).join(first, key).where(F.col(owner).eqNullSafe(F.col("__owner"))).select(*df.columns)
    return kept.unionByName(df.where(~F.coalesce(has, F.lit(False))))


def hash_sample(df: DataFrame, key: str, n: int, strata: list[str] | None = None, seed: int = 42) -> DataFrame:
    """``n`` rows (of each stratum) by a hash of the key and a seed: the same ones on every run."""
    order = [F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), F.col(key)]
    if not strata:
        return df.orderBy(*order).limit(n)
    return top_k(df, strata, order, n).drop("rn")


def diverse_top_k(
    df: DataFrame, keys: list[str], item: str, score: str, features: list[str], k: int = 3, weight: float = 0.7, ties: list[Column] | None = None
) -> DataFrame:
    """Greedy re-ranking: weight * score - (1 - weight) * the largest cosine to what is chosen so far.

    Scores count as whole percents, rounded half to even, as they are shown; worth is compared at nine digits, and
    ties go by ``ties``, then the item. ``k`` is small and unrolled: each round is a join with the row
    chosen last and a top-1 per key, so no group is gathered.
    """
    order_ties = [*(ties or []), F.col(item)]
    size = F.sqrt(sum((F.col(f) * F.col(f) for f in features), F.lit(0.0)))
    pool = df.withColumn("__size", size).withColumn("__near", F.lit(0.0)).withColumn("__percent", F.bround(F.col(score) * 100))
    chosen = None
    for r in range(1, k + 1):
        worth = F.round(weight * F.col("__percent") / 100 - (1 - weight) * F.col("__near"), 9)
        best = top_k(pool.withColumn("__worth", worth), keys, [F.col("__worth").desc(), *order_ties], 1, "__rn")
        step = best.select(*keys, item, F.col("__worth").alias("worth"), F.lit(r).alias("place"))
        chosen = step if chosen is None else chosen.unionByName(step)
        if r == k:
            break
        last = best.select(*keys, F.col(item).alias("__item"), F.col("__size").alias("__last"), *[F.col(f).alias(f"__{f}") for f in features])
        near = sum((F.col(f) * F.col(f"__{f}") for f in features), F.lit(0.0)) / F.nullif(F.col("__size") * F.col("__last"), F.lit(0.0))
        pool = (
            pool.join(last, keys).where(F.col(item) != F.col("__item"))
            .withColumn("__near", F.greatest("__near", F.coalesce(near, F.lit(0.0))))
            .select(*pool.columns)
        )
    return chosen


def best_and_worst(df: DataFrame, keys: list[str], error: str, item: str, best: int = 3, worst: int = 2) -> DataFrame:
    """(keys, item, error, side): the rows with the least and the most error of each key, ties by item; a row
    that is both is listed as best. Two pruned top-k, not one window over a whole key."""
    rows = df.select(*keys, item, error)
    low = top_k(rows, keys, [F.col(error), F.col(item)], best).withColumn("side", F.lit("best"))
    high = top_k(rows, keys, [F.col(error).desc(), F.col(item)], worst).withColumn("side", F.lit("worst"))
    both = low.unionByName(high).drop("rn")
    return both.groupBy(*keys, item, error).agg(F.min("side").alias("side"))


def quota_sample(df: DataFrame, key: str, n: int, first: Column, quota: int, seed: int = 42) -> DataFrame:
    """``n`` rows by a hash of the key and a seed: up to ``quota`` of those where ``first`` holds, then any others."""
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    rows = df.withColumn("__first", F.coalesce(first, F.lit(False))).withColumn("__place", place)
    preferred = rows.where("__first").orderBy("__place", key).limit(quota)
    rest = rows.join(preferred.select(key), key, "left_anti").orderBy("__place", key).limit(n)
    both = preferred.withColumn("__turn", F.lit(0)).unionByName(rest.withColumn("__turn", F.lit(1)))
    return both.orderBy("__turn", "__place", key).limit(n).select(*df.columns)
