"""One-versus-rest logistic models of many tags at once, judged on groups of rows that they did not see.

All tags are fitted together: a task multiplies its rows (X) with the weights of all tags (P = sigmoid(X W')) and sums each
tag's gradient and Hessian as matrix products; the tasks' sums meet by model and tag, where the Newton step is solved. No table of
rows x tags is made: a row's tags are a short list, and what leaves a task is sums, or at most ``most`` tags a row.

Of F folds there is a model without each fold, which decides that fold's rows, and one without each pair of folds: with those a
fold's threshold is picked on the other folds, by models that saw neither them nor it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..storage import staged

#: Tags that are fitted in one go, and rows that are multiplied in one go.
TAGS, ROWS = 256, 2048


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sets(folds: list[int]) -> list[tuple[int, ...]]:
    """The folds that each model leaves out: every one, and every two."""
    return [(f,) for f in folds] + list(combinations(folds, 2))


def newton_step(s: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """The next weights from the sums of one tag: Hessian and gradient, flat. The intercept is free."""
    p = len(w)
    penalty = ridge * np.diag([0.0] + [1.0] * (p - 1))
    left = s[: p * p].reshape(p, p) + penalty + 1e-9 * np.eye(p)
    return w + np.clip(np.linalg.solve(left, s[p * p :] - penalty @ w), -4, 4)


def fit_tags(rows: DataFrame, size: int, tags: int, without: list[tuple[int, ...]], rounds: int, ridge: float) -> np.ndarray:
    """Weights (models, tags, size) of the logistic models that leave out the folds of ``without``. ``rows``: fold, x, t (numbers of
    the row's tags). Two rounds that change nothing end the fit. Rows that are equal in all three are one, with their number as weight."""
    rows = staged(rows.groupBy("fold", "x", "t").agg(F.count(F.lit(1)).alias("n")), "distinct")
    weights = np.zeros((len(without), tags, size))
    for first in range(0, tags, TAGS):
        last = min(first + TAGS, tags)
        w = weights[:, first:last]
        for _ in range(rounds):
            told = _round(rows, w, first, without, ridge)
            moved = max((np.abs(told[k] - w[k]).max() for k in told), default=0.0)
            for (m, t), new in told.items():
                w[m, t] = new
            if moved < 1e-9:
                break
    return weights


def _round(rows: DataFrame, w: np.ndarray, first: int, without: list[tuple[int, ...]], ridge: float) -> dict[tuple[int, int], np.ndarray]:
    """(model, tag) -> weights after one Newton step on all rows."""
    w = w.copy()
    models, tags, size = w.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((models, tags, size * size + size))
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                x, fold = np.array(part["x"].tolist(), dtype=float), part["fold"].to_numpy()
                n = part["n"].to_numpy(dtype=float)[:, None]
                y = np.zeros((len(part), tags))
                for i, own in enumerate(part["t"]):
                    own = np.asarray(own, dtype=int) - first
                    y[i, own[(own >= 0) & (own < tags)]] = 1.0
                squares = (x[:, :, None] * x[:, None]).reshape(len(part), -1)
                for m, left_out in enumerate(without):
                    seen = ~np.isin(fold, left_out)
                    p = _sigmoid(x[seen] @ w[m].T)
                    out[m, :, : size * size] += (n[seen] * p * (1 - p)).T @ squares[seen]
                    out[m, :, size * size :] += (n[seen] * (y[seen] - p)).T @ x[seen]
        for m in range(models):
            yield pd.DataFrame({"m": m, "t": np.arange(tags), "s": list(out[m])})

    def step(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        m, t = int(key[0]), int(key[1])
        return pd.DataFrame({"m": [m], "t": [t], "w": [newton_step(np.sum(np.stack(parts["s"].to_list()), axis=0), w[m, t], ridge)]})

    told = rows.mapInPandas(sums, "m int, t int, s array<double>").groupBy("m", "t").applyInPandas(step, "m int, t int, w array<double>")
    return {(r.m, r.t): np.array(r.w) for r in told.collect()}


def _scores(x: np.ndarray, w: np.ndarray, known: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most likely tags of each row and their probabilities, ties by number; tags that are not ``known`` are none."""
    p = _sigmoid(x @ w.T)
    p[:, ~known] = -1.0
    best = np.argsort(-p, axis=1, kind="stable")[:, :most]
    return best, np.take_along_axis(p, best, axis=1)


def decided_tags(
    df: DataFrame, key: str, features: list[str], tags: str, fold: str, vocabulary: list[str], grid: list[float], least: int = 5, most: int = 5,
    rounds: int = 12, ridge: float = 1.0,
) -> DataFrame:
    """(key, fold, threshold, truth, tags): for every row the tags that models decide which did not see its fold: the most likely
    ones of at least the fold's threshold, at most ``most``, the likeliest first.

    A fold's threshold is that of ``grid`` with the best micro F1 of the same decision on the other folds, each decided by
    models that saw neither it nor the fold; the first of equal ones. A tag of ``vocabulary`` is modelled where at least
    ``least`` rows of what the model saw have it. ``truth`` holds all distinct tags of the row, those outside of the
    vocabulary too. The weights, (folds + 1) * folds / 2 models x tags x features numbers, go with the tasks: the vocabulary
    bounds them. Features should be scaled alike. A NULL feature counts as 0, NULL tags as none; rows without a fold are
    neither seen nor decided.
    """
    words = sorted(set(vocabulary))
    number = {w: i for i, w in enumerate(words)}
    x = F.array(F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    truth = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(tags), F.array().cast("array<string>")))))
    base = df.where(F.col(fold).isNotNull()).select(F.col(key).alias("key"), F.col(fold).cast("int").alias("fold"), x.alias("x"), truth.alias("truth"))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["t"] = [[number[w] for w in own if w in number] for own in batch["truth"]]
            yield batch

    kind = base.schema["key"].dataType.simpleString()
    rows = staged(base.mapInPandas(numbered, f"key {kind}, fold int, x array<double>, truth array<string>, t array<int>"), "rows")
    counts = rows.select("fold", F.explode_outer("t").alias("t")).groupBy("fold", "t").agg(F.count(F.lit(1)).alias("n")).collect()
    folds = sorted({r.fold for r in counts})
    without = _sets(folds)
    at = {s: m for m, s in enumerate(without)}
    known = np.zeros((len(without), len(words)), dtype=int)
    for r in counts:
        if r.t is not None:
            known[[m for m, s in enumerate(without) if r.fold not in s], r.t] += r.n
    known = known >= least
    weights = fit_tags(rows.select("fold", "x", "t"), len(features) + 1, len(words), without, rounds, ridge)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(folds), len(grid), 3))
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                for inner, part in batch.iloc[start : start + ROWS].groupby("fold"):
                    xs = np.array(part["x"].tolist(), dtype=float)
                    have = np.zeros((len(part), len(words)), dtype=bool)
                    for i, own in enumerate(part["t"]):
                        have[i, np.asarray(own, dtype=int)] = True
                    true = part["truth"].map(len).sum()
                    for f, outer in enumerate(folds):
                        if outer == inner:
                            continue
                        m = at[tuple(sorted((outer, int(inner))))]
                        best, p = _scores(xs, weights[m], known[m], most)
                        right = np.take_along_axis(have, best, axis=1)
                        for g, threshold in enumerate(grid):
                            over = p >= threshold
                            tp = (right & over).sum()
                            sums[f, g] += (tp, over.sum() - tp, true - tp)
        for f in range(len(folds)):
            yield pd.DataFrame({"f": f, "g": np.arange(len(grid)), "tp": sums[f, :, 0], "fp": sums[f, :, 1], "fn": sums[f, :, 2]})

    scored = rows.select("fold", "x", "t", "truth").mapInPandas(counted, "f int, g int, tp double, fp double, fn double")
    found = {(r.f, r.g): r for r in scored.groupBy("f", "g").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect()}
    thresholds = {}
    for f, outer in enumerate(folds):
        f1 = [2 * r.tp / (2 * r.tp + r.fp + r.fn) if (r := found[(f, g)]).tp else 0.0 for g in range(len(grid))]
        thresholds[outer] = grid[int(np.argmax(np.round(f1, 12)))]

    def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                for own, part in batch.iloc[start : start + ROWS].groupby("fold"):
                    m = at[(int(own),)]
                    best, p = _scores(np.array(part["x"].tolist(), dtype=float), weights[m], known[m], most)
                    told = [[words[t] for t, q in zip(ts, ps, strict=True) if q >= thresholds[int(own)]] for ts, ps in zip(best, p, strict=True)]
                    yield pd.DataFrame({"key": part["key"], "fold": part["fold"], "threshold": thresholds[int(own)], "truth": part["truth"], "tags": told})

    out = rows.select("key", "fold", "x", "truth").mapInPandas(decided, f"key {kind}, fold int, threshold double, truth array<string>, tags array<string>")
    return out.withColumnRenamed("key", key)
