"""Tag models against one fit for each tag with numpy alone."""

import random

import numpy as np
import pytest

from quern.operators import tagmodels as TM


def fitted(x, y, ridge):
    """A logistic regression by Newton's method, the intercept free."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    penalty = ridge * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve(a.T @ ((p * (1 - p))[:, None] * a) + penalty + 1e-9 * np.eye(len(w)), a.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -4, 4)
    return w


def plain(rows, vocabulary, grid, least, most, ridge):
    """The decisions, row by row and tag by tag."""
    x, fold = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
    truths = [set(r[2] or ()) for r in rows]

    def decide(seen, at, threshold):
        models = {}
        for t in sorted(vocabulary):
            y = np.array([t in truths[i] for i in seen], dtype=float)
            if y.sum() >= least:
                models[t] = fitted(x[seen], y, ridge)
        out = []
        for i in at:
            p = {t: 1 / (1 + np.exp(-(w[0] + x[i] @ w[1:]))) for t, w in models.items()}
            out.append([t for t in sorted(p, key=lambda t: (-round(p[t], 12), t)) if p[t] >= threshold][:most])
        return out

    result = {}
    for f in sorted(set(fold)):
        best = None
        for threshold in grid:
            tp = fp = fn = 0
            for g in sorted(set(fold) - {f}):
                at = np.flatnonzero(fold == g)
                for i, told in zip(at, decide(np.flatnonzero((fold != f) & (fold != g)), at, threshold), strict=True):
                    hits = len(truths[i] & set(told))
                    tp, fp, fn = tp + hits, fp + len(told) - hits, fn + len(truths[i]) - hits
            f1 = round(2 * tp / (2 * tp + fp + fn), 12) if tp else 0.0
            if best is None or f1 > best[0]:
                best = (f1, threshold)
        at = np.flatnonzero(fold == f)
        for i, told in zip(at, decide(np.flatnonzero(fold != f), at, best[1]), strict=True):
            result[rows[i][0]] = (int(f), best[1], told)
    return result


@pytest.mark.parametrize("block", [2, 256])
def test_decisions_equal_a_fit_for_each_tag(spark, monkeypatch, block):
    monkeypatch.setattr(TM, "TAGS", block)
    monkeypatch.setattr(TM, "ROWS", 17)
    rng = random.Random(4)
    rows = []
    for i in range(150):
        x = [rng.gauss(0, 1), rng.gauss(0, 1)]
        tags = [t for t, p in (("big", x[0] > 0.3), ("low", x[1] < 0), ("coin", rng.random() < 0.5), ("both", x[0] > 0 and x[1] > 0), ("rare", i % 50 == 0)) if p]
        rows.append((i, x, rng.choice([tags, [*tags, "outside"], tags + tags]), i % 3))
    df = spark.createDataFrame([(i, *x, t, f) for i, x, t, f in rows], "i long, a double, b double, tags array<string>, fold int").repartition(4)
    vocabulary, grid = ["big", "low", "coin", "both", "rare", "never"], [0.2, 0.4, 0.6]
    got = {r.i: r for r in TM.decided_tags(df, "i", ["a", "b"], "tags", "fold", vocabulary, grid, least=4, most=3, rounds=40).collect()}
    want = plain(rows, vocabulary, grid, 4, 3, 1.0)
    assert len(got) == len(want)
    for i, (fold, threshold, told) in want.items():
        assert (got[i].fold, got[i].threshold, got[i].tags) == (fold, threshold, told)
        assert got[i].truth == sorted(set(rows[i][2]))
    right = [("big" in got[i].tags) == ("big" in rows[i][2]) for i in got]
    assert sum(right) > 0.9 * len(right) and not any("never" in r.tags or "rare" in r.tags for r in got.values())


def test_odd_rows(spark):
    schema = "i long, a double, tags array<string>, fold int"
    rows = [(1, None, None, 0), (2, 1.0, [], 1), (3, 0.0, ["x", None], None), (None, 1.0, ["x"], 1), (4, 1.0, ["x"], 2), (4, 1.0, ["x"], 2)]
    df = spark.createDataFrame(rows, schema)
    got = TM.decided_tags(df, "i", ["a"], "tags", "fold", ["x"], [0.5], least=1, rounds=3).collect()
    assert sorted(((r.i, r.fold) for r in got), key=repr) == sorted([(1, 0), (2, 1), (None, 1), (4, 2), (4, 2)], key=repr)
    assert TM.decided_tags(df.limit(0), "i", ["a"], "tags", "fold", ["x"], [0.5]).count() == 0
    assert all(r.tags == [] for r in TM.decided_tags(df, "i", ["a"], "tags", "fold", [], [0.5]).collect())


def test_equal_rows_are_fitted_once(spark, monkeypatch):
    seen, whole = [], TM._round
    monkeypatch.setattr(TM, "_round", lambda rows, *rest: (seen.append(rows.count()), whole(rows, *rest))[1])
    rows = [(i % 3, [1.0, float(i % 5)], [0] if i % 7 < 3 else []) for i in range(420)]
    df = spark.createDataFrame(rows, "fold int, x array<double>, t array<int>").repartition(3)
    got = TM.fit_tags(df, 2, 1, [(0,)], 30, 1.0)
    kept = [r for r in rows if r[0] != 0]
    want = fitted(np.array([[r[1][1]] for r in kept]), np.array([float(r[2] == [0]) for r in kept]), 1.0)
    assert np.allclose(got[0, 0], want, atol=1e-9) and set(seen) == {30}
