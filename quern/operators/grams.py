"""Ridge models judged on groups that they did not see, from Gram matrices that stay a table, one row a group.

A model without some groups is solved from the sum over all groups less theirs. So one pass gives the matrices, one sum the
totals, and every model is solved inside a task: without its own group for each group, and without two groups for
each pair of them. What the driver holds has the size of one model, however many groups there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import staged

#: Groups whose models are solved together, and rows that are scored together.
OUTERS, ROWS = 128, 20_000


@dataclass(frozen=True)
class Candidate:
    """A way to fit: the ridge strength, a weight for each kind of label, the kinds whose labels are shifted to the first
    kind's mean, the features that are used (None: all), and whether groups have offsets."""

    name: str
    alpha: float
    kinds: dict[str, float] = field(default_factory=lambda: {"": 1.0})
    centred: tuple[str, ...] = ()
    features: tuple[str, ...] | None = None
    shrink: float | None = None


def clamp(x: Column, low: float, high: float) -> Column:
    """Within a scale; NULL stays (least and greatest alone would pass over it)."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


class _Sums:
    """What a candidate's fit needs of some groups. All parts add up over groups, so groups can be taken off again.

    With X and y of a group, weighted by kind: xx = X'X, xy = X'y, and for the kinds that are shifted x1 = X'1. For offsets,
    with s = X'1, t = 1'y and d = n + shrink: sx = s t / d, s1 = s n(kind) / d, ss = s s' / d. n and y of each kind give
    the shifts.
    """

    def __init__(self, how: Candidate, used: list[int], flat: np.ndarray):
        self.how, self.used, self.flat = how, used, flat

    @classmethod
    def of(cls, how: Candidate, used: list[int], cells: list[dict[str, np.ndarray]], size: int) -> _Sums:
        """One row for each of the groups' ``cells`` (kind -> upper triangle of the products of 1, features, y)."""
        i, j = np.triu_indices(size)
        full = {k: np.zeros((len(cells), size, size)) for k in how.kinds}
        for at, group in enumerate(cells):
            for k, m in group.items():
                if k in full:
                    full[k][at, i, j] = m
                    full[k][at, j, i] = m
        part = {k: m[:, used][:, :, used] for k, m in full.items()}
        total = sum(w * part[k] for k, w in how.kinds.items())
        xy = sum(w * full[k][:, used, -1] for k, w in how.kinds.items())
        x1 = [how.kinds[k] * part[k][:, 0] for k in how.centred]
        parts = [total.reshape(len(cells), -1), xy, *x1]
        if how.shrink is not None:
            s = total[:, 0]
            d = s[:, :1] + how.shrink
            parts += [s * xy[:, :1] / d, *[s * how.kinds[k] * part[k][:, 0, :1] / d for k in how.centred]]
            parts.append((s[:, :, None] * s[:, None] / d[:, :, None]).reshape(len(cells), -1))
        parts += [full[k][:, 0, at, None] for k in how.kinds for at in (0, -1)]
        return cls(how, used, np.concatenate(parts, axis=1) if cells else np.zeros((0, 1)))

    def weights(self) -> np.ndarray:
        """Intercept and weights for each row; NaN where there is nothing to fit."""
        how, u, flat, at = self.how, len(self.used), self.flat, 0

        def take(n: int) -> np.ndarray:
            nonlocal at
            at += n
            return flat[:, at - n : at]

        xx, xy, x1 = take(u * u).reshape(-1, u, u), take(u), [take(u) for _ in how.centred]
        if how.shrink is not None:
            sx, s1, ss = take(u), [take(u) for _ in how.centred], take(u * u).reshape(-1, u, u)
        means = {}
        for k in how.kinds:
            n, y = take(1), take(1)
            means[k] = np.where(n > 0.5, y / np.where(n > 0.5, n, 1), np.nan)
        first = means[next(iter(how.kinds))]
        shifts = [np.nan_to_num(means[k] - first) for k in how.centred]
        right = xy - sum((s * x for s, x in zip(shifts, x1, strict=True)), np.zeros_like(xy))
        empty = xx[:, 0, 0] < 1e-9
        left = xx + how.alpha * np.diag([0.0] + [1.0] * (u - 1))
        left[empty] = np.eye(u)
        solve = lambda b: np.linalg.solve(left, b[:, :, None])[:, :, 0]
        w = solve(right)
        if how.shrink is not None:
            told = sx - sum((s * x for s, x in zip(shifts, s1, strict=True)), np.zeros_like(sx))
            for _ in range(5):  # offsets of the groups, then weights for labels less their offset, in turn
                w = solve(right - told + np.einsum("bij,bj->bi", ss, w))
        w[empty] = np.nan
        return w


class Grams:
    """The Gram matrices of a table: ``table`` has a row a group (g, cells: kind -> products of 1, features and y)."""

    def __init__(self, df: DataFrame, features: list[str], target: str, group: str, kind: str | None = None):
        self.features, self.size = features, len(features) + 2
        cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
        keyed = df.where(F.col(target).isNotNull()).withColumn("__g", F.col(group)).withColumn("__k", F.col(kind) if kind else F.lit(""))
        products = [F.sum(a * b).alias(f"s{n}") for n, (a, b) in enumerate(combinations_with_replacement(cols, 2))]
        sums = keyed.groupBy("__g", "__k").agg(*products)
        cells = F.struct("__k", F.array(*[F.col(f"s{n}") for n in range(len(products))]))
        table = sums.groupBy(F.col("__g").alias("g")).agg(F.map_from_entries(F.collect_list(cells)).alias("cells"))
        self.table = staged(table, "grams")
        self._totals: dict[Candidate, _Sums] = {}

    def _used(self, how: Candidate) -> list[int]:
        return [0, *(i + 1 for i, f in enumerate(self.features) if how.features is None or f in how.features)]

    def sums(self, how: Candidate, cells: list) -> _Sums:
        read = [{k: np.asarray(v, dtype=float) for k, v in dict(c).items()} for c in cells]
        return _Sums.of(how, self._used(how), read, self.size)

    def whole(self, how: Candidate, weights: np.ndarray) -> list[float]:
        """Weights of all features, 0 for those that are not used."""
        out = np.zeros(self.size - 1)
        out[self._used(how)] = weights
        return out.tolist()

    def totals(self, candidates: list[Candidate]) -> list[np.ndarray]:
        """Each candidate's sums over all groups: added up in tasks, then by Spark."""
        tool = _Tool(self.features, self.size)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for c, how in enumerate(candidates) if len(batch) else ():
                    flat = tool.sums(how, batch["cells"]).flat.sum(axis=0)
                    sums[c] = sums.get(c, 0) + flat
            for c, flat in sums.items():
                yield pd.DataFrame({"c": c, "i": np.arange(len(flat)), "v": flat})

        rows = self.table.select("cells").mapInPandas(run, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
        out = [np.zeros(1 + max((r.i for r in rows if r.c == c), default=-1)) for c in range(len(candidates))]
        for r in rows:
            out[r.c][r.i] = r.v
        return out

    def fit(self, how: Candidate) -> list[float] | None:
        """Intercept and weights of the model of all groups; None without rows."""
        (flat,) = self.totals([how])
        if not len(flat):
            return None
        w = _Sums(how, self._used(how), flat[None]).weights()[0]
        return None if np.isnan(w).any() else self.whole(how, w)

    def without_own(self, candidates: list[Candidate]) -> DataFrame:
        """(g, candidate, weights): for every group the models that saw all others."""
        tool, totals = _Tool(self.features, self.size), self.totals(candidates)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for how, total in zip(candidates, totals, strict=True) if len(batch) else ():
                    own = tool.sums(how, batch["cells"])
                    weights = _Sums(how, own.used, total - own.flat).weights()
                    out += [(g, how.name, tool.whole(how, w)) for g, w in zip(batch["g"], weights, strict=True) if not np.isnan(w).any()]
                yield pd.DataFrame(out, columns=["g", "candidate", "weights"])

        kind = self.table.schema["g"].dataType.simpleString()
        return self.table.mapInPandas(run, f"g {kind}, candidate string, weights array<double>")

    def offsets(self, how: Candidate) -> DataFrame:
        """(g, offset): each group's shrunken mean residual under the model of all groups."""
        w = np.array(self.fit(how))
        tool = _Tool(self.features, self.size)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                own = tool.sums(how, batch["cells"])
                u = len(own.used)
                s, y = own.flat[:, :u], own.flat[:, u * u]
                yield pd.DataFrame({"g": batch["g"], "offset": (y - s @ w[own.used]) / (s[:, 0] + how.shrink)})

        kind = self.table.schema["g"].dataType.simpleString()
        return self.table.mapInPandas(run, f"g {kind}, offset double")


class _Tool(Grams):
    """What tasks need of ``Grams``: no table."""

    def __init__(self, features: list[str], size: int):
        self.features, self.size = features, size


def predicted(df: DataFrame, features: list[str], weights: str = "weights", low: float = 1.0, high: float = 5.0) -> Column:
    """The clipped prediction of a row's ``weights`` (intercept first)."""
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    return clamp(F.aggregate(F.zip_with(F.col(weights), x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), low, high)


def held_out(df: DataFrame, grams: Grams, group: str, candidates: list[Candidate], low: float = 1.0, high: float = 5.0) -> DataFrame:
    """``df`` for each candidate (candidate, pred): every row predicted by a model that saw nothing of its group."""
    table = staged(grams.without_own(candidates).withColumnRenamed("g", group), "models")
    return df.join(table, group).withColumn("pred", predicted(df, grams.features, low=low, high=high)).drop("weights")


def pair_errors(
    df: DataFrame, grams: Grams, group: str, target: str, candidates: list[Candidate], low: float = 1.0, high: float = 5.0
) -> DataFrame:
    """(outer, place, n, far, near): for every group left out and every candidate, how the rows of each other group are
    predicted by models that saw neither group: their number, summed absolute error, and number within 1.

    Blocks of groups to leave out meet blocks of rows. A task solves its models from the totals less both groups' sums;
    the rows of a large group are dealt over several blocks.
    """
    outers = max(1, -(-grams.table.count() // OUTERS))
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in grams.features])
    rows = df.where(F.col(target).isNotNull()).select(F.col(group).alias("g"), x.alias("x"), F.col(target).cast("double").alias("y"))
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    blocks = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // ROWS))
    deal = F.pmod(F.xxhash64("g") + F.pmod(F.xxhash64("x", "y", F.rand(7)), F.ceil(F.col("n") / ROWS)), F.lit(blocks)).cast("int")
    placed = staged(rows.join(counts, "g").select("g", "x", "y", deal.alias("rb")), "rows")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = placed.withColumn("ob", every(outers))
    ob = F.pmod(F.xxhash64("g", F.lit(1)), F.lit(outers)).cast("int")
    out = grams.table.select("g", "cells", ob.alias("ob"), every(blocks).alias("rb"), F.lit(True).alias("outer"))
    inner = placed.select("g", "rb").distinct().join(grams.table, "g").select("g", "cells", every(outers).alias("ob"), "rb", F.lit(False).alias("outer"))
    tool, totals = _Tool(grams.features, grams.size), grams.totals(candidates)

    def errors(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        told = []
        outer, inner = b[b["outer"]], b[~b["outer"]].reset_index(drop=True)
        if len(a) and len(outer) and len(inner):
            names = outer["g"].to_numpy()
            parts = {g: (np.array(rows["x"].tolist(), dtype=float), rows["y"].to_numpy()) for g, rows in a.groupby("g")}
            for place, (how, total) in enumerate(zip(candidates, totals, strict=True)):
                off, own = tool.sums(how, outer["cells"]), tool.sums(how, inner["cells"])
                sums = np.zeros((3, len(names)))
                for at, g in enumerate(inner["g"]):
                    x, y = parts[g]
                    w = _Sums(how, off.used, total - own.flat[at] - off.flat).weights()
                    error = np.abs(np.clip(x[:, off.used] @ w.T, low, high) - y[:, None])
                    known = (names != g) & ~np.isnan(w).any(axis=1)
                    sums += np.where(known, [np.full(len(names), len(y)), error.sum(axis=0), (error <= 1).sum(axis=0)], 0)
                told += [(o, place, int(n), far, int(near)) for o, n, far, near in zip(names, *sums, strict=True) if n]
        return pd.DataFrame(told, columns=["outer", "place", "n", "far", "near"])

    kind = grams.table.schema["g"].dataType.simpleString()
    met = left.groupBy("ob", "rb").cogroup(out.unionByName(inner).groupBy("ob", "rb"))
    found = met.applyInPandas(errors, f"outer {kind}, place int, n long, far double, near long")
    return found.groupBy("outer", "place").agg(*[F.sum(c).alias(c) for c in ("n", "far", "near")])


def chosen_inside(
    df: DataFrame, grams: Grams, group: str, target: str, candidates: list[Candidate], by: str = "mae", low: float = 1.0, high: float = 5.0
) -> DataFrame:
    """(group, candidate): for every held-out group the candidate that is best on the other groups, each of these predicted
    by models that saw neither it nor the held-out one. ``by``: least "mae", or most "within_1" and then least mae;
    the earlier of equal candidates.
    """
    scores = pair_errors(df, grams, group, target, candidates, low, high)
    scores = scores.select("outer", "place", F.round(F.col("far") / F.col("n"), 9).alias("mae"), F.round(F.col("near") / F.col("n"), 9).alias("near"))
    order = F.struct("mae", "place") if by == "mae" else F.struct(-F.col("near"), "mae", "place")
    best = scores.groupBy(F.col("outer").alias(group)).agg(F.min_by("place", order).alias("place"))
    names = F.array(*[F.lit(c.name) for c in candidates])
    return best.select(group, F.element_at(names, F.col("place") + 1).alias("candidate"))


def nested(df: DataFrame, features: list[str], target: str, group: str, candidates: list[Candidate], kind: str | None = None, by: str = "mae",
           low: float = 1.0, high: float = 5.0) -> DataFrame:
    """``df``'s rows of the first kind with candidate and pred: selection inside, prediction outside. A group's rows have no
    part in the choice of the candidate that predicts them."""
    grams = Grams(df, features, target, group, kind)
    rows = df.where(F.col(kind) == next(iter(candidates[0].kinds))) if kind else df
    picked = staged(chosen_inside(rows, grams, group, target, candidates, by, low, high), "picked")
    return held_out(rows, grams, group, candidates, low, high).join(picked, [group, "candidate"])


def cross_validate(df: DataFrame, features: list[str], target: str, group: str, alphas: list[float]) -> dict[float, float]:
    """Mean absolute error of leave-one-group-out ridge for each alpha, from one Gram per group."""
    grams = Grams(df, features, target, group)
    ways = [Candidate(str(a), a) for a in alphas]
    far = float("inf")
    errors = held_out(df, grams, group, ways, -far, far).groupBy("candidate").agg(F.avg(F.abs(F.col("pred") - F.col(target))).alias("mae"))
    return {float(r["candidate"]): r["mae"] for r in errors.collect()}
