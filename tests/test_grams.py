"""Ridge models without one and without two groups, against refitting with numpy."""

import numpy as np
import pytest

from quern.operators import grams as G


def table(seed, n, groups, kinds=("",)):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, groups, n)
    g[: n // 3] = 0  # one group has a third of the rows
    x = rng.normal(size=(n, 2))
    kind = np.array([kinds[i] for i in rng.integers(0, len(kinds), n)])
    y = np.clip(3 + x @ [0.7, -0.4] + 0.3 * (g % 3) + rng.normal(size=n) * 0.3 + 0.5 * (kind == kinds[-1]), 1, 5)
    return g, x, kind, y


def refitted(how, g, x, kind, y, without):
    """Weights of a candidate on the rows of other groups, labels shifted and offsets in turn, from the rows themselves."""
    seen = ~np.isin(g, without) & np.isin(kind, list(how.kinds))
    if not seen.any():
        return None
    g, x, kind, y = g[seen], x[seen], kind[seen], y[seen].copy()
    first = kind == next(iter(how.kinds))
    for k in how.centred:
        if (kind == k).any() and first.any():
            y[kind == k] -= y[kind == k].mean() - y[first].mean()
    w = np.array([how.kinds[k] for k in kind])
    used = [i for i, f in enumerate("ab") if how.features is None or f in how.features]
    a = np.column_stack([np.ones(len(y)), x[:, used]])
    left = a.T @ (w[:, None] * a) + how.alpha * np.diag([0.0] + [1.0] * len(used))
    out = np.linalg.solve(left, a.T @ (w * y))
    if how.shrink is not None:
        for _ in range(5):
            off = {k: (w * (y - a @ out))[g == k].sum() / (w[g == k].sum() + how.shrink) for k in set(g)}
            out = np.linalg.solve(left, a.T @ (w * (y - np.array([off[k] for k in g]))))
    whole = np.zeros(3)
    whole[[0, *(i + 1 for i in used)]] = out
    return whole


WAYS = [
    G.Candidate("plain", 1.0), G.Candidate("one", 3.0, features=("b",)), G.Candidate("offsets", 2.0, shrink=4.0),
    G.Candidate("kinds", 1.0, {"x": 1.0, "y": 0.5}), G.Candidate("shifted", 1.0, {"x": 1.0, "z": 0.3, "y": 0.5}, ("z", "y")),
    G.Candidate("all", 1.5, {"x": 1.0, "z": 0.3}, ("z",), ("a",), 6.0),
]


def frame(spark, g, x, kind, y):
    rows = [(i, f"g{g[i]}", float(x[i, 0]), float(x[i, 1]), str(kind[i]), float(y[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "i long, g string, a double, b double, k string, y double").repartition(5)


@pytest.mark.parametrize("how", WAYS, ids=[w.name for w in WAYS])
def test_models_equal_refitting(spark, how):
    kinds = ("x", "y", "z") if "x" in how.kinds else ("",)
    g, x, kind, y = table(3, 160, 7, kinds)
    df = frame(spark, g, x, kind, y)
    grams = G.Grams(df, ["a", "b"], "y", "g", "k")
    assert np.allclose(grams.fit(how), refitted(how, g, x, kind, y, []), atol=1e-8)
    own = {r.g: r.weights for r in grams.without_own([how]).collect()}
    for k in range(7):
        assert np.allclose(own[f"g{k}"], refitted(how, g, x, kind, y, [k]), atol=1e-8)
    got = {r.outer: r for r in G.pair_errors(df, grams, "g", "y", [how]).collect()}
    for o in range(7):
        far = near = n = 0
        for i in range(7):
            if i != o:
                w = refitted(how, g, x, kind, y, [o, i])
                error = np.abs(np.clip(w[0] + x[g == i] @ w[1:], 1, 5) - y[g == i])
                far, near, n = far + error.sum(), near + (error <= 1).sum(), n + len(error)
        r = got[f"g{o}"]
        assert (r.n, r.near) == (n, near) and abs(r.far - far) < 1e-6


def test_many_groups_in_blocks(spark, monkeypatch):
    """Hundreds of groups, one with a third of the rows, in many blocks; a sample of them refitted."""
    monkeypatch.setattr(G, "OUTERS", 50)
    monkeypatch.setattr(G, "ROWS", 100)
    g, x, kind, y = table(5, 1500, 400)
    df = frame(spark, g, x, kind, y)
    ways = [G.Candidate("1", 1.0), G.Candidate("50", 50.0)]
    grams = G.Grams(df, ["a", "b"], "y", "g")
    present = sorted(set(g))
    got = {(r.outer, r.place): r for r in G.pair_errors(df, grams, "g", "y", ways).collect()}
    assert len(got) == 2 * len(present) and all(r.n == len(y) - (g == int(o[1:])).sum() for (o, _), r in got.items())
    for o in (0, present[1], present[-1]):
        for place, how in enumerate(ways):
            far = 0.0
            for i in present:
                if i != o:
                    w = refitted(how, g, x, kind, y, [o, i])
                    far += np.abs(np.clip(w[0] + x[g == i] @ w[1:], 1, 5) - y[g == i]).sum()
            assert abs(got[(f"g{o}", place)].far - far) < 1e-6
    chosen = G.nested(df, ["a", "b"], "y", "g", ways)
    assert chosen.count() == len(y)


def test_empty_tables_and_lone_groups(spark):
    g, x, kind, y = table(1, 30, 3)
    df = frame(spark, g, x, kind, y)
    assert G.nested(df.limit(0), ["a", "b"], "y", "g", WAYS[:2]).count() == 0
    assert G.Grams(df.limit(0), ["a", "b"], "y", "g").fit(WAYS[0]) is None
    lone = df.where("g = 'g0'")
    assert G.nested(lone, ["a", "b"], "y", "g", WAYS[:2]).count() == 0  # nothing is left to learn from
    missing = df.withColumn("y", df.y.cast("double")).selectExpr("*").unionByName(df.selectExpr("i", "'gx' AS g", "a", "b", "k", "CAST(NULL AS DOUBLE) AS y"))
    assert G.held_out(missing, G.Grams(missing, ["a", "b"], "y", "g"), "g", WAYS[:1]).where("g = 'gx'").count() == 0
