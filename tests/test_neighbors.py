"""The pruned search against all pairs."""

import numpy as np
import pytest

from quern.operators import neighbors as N


def brute(rows, queries, k, exclude):
    out = {}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if v is not None and np.all(np.isfinite(v)) and np.linalg.norm(v) > 0}
    label = {i: g for i, _, g in rows}
    for q in queries:
        if q in unit:
            near = [(-round(float(unit[q] @ u), 12), i) for i, u in unit.items() if i != q and not (exclude and label[i] is not None and label[i] == label[q])]
            out[q] = sorted(near)[:k]
    return out


def clustered(seed, n, groups, dims=8, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    at = rng.integers(0, groups, n)
    at[: n // 3] = 0  # a hot cluster
    return [(i, [float(x) for x in centres[at[i]] + spread * rng.normal(size=dims)], int(at[i]) if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("exclude,block", [(None, 4096), ("g", 40)])
def test_neighbours_equal_all_pairs(spark, exclude, block):
    rows = clustered(1, 400, 12) + [(900, None, 1), (901, [0.0] * 8, 2), (902, [float("nan")] + [1.0] * 7, 3), (903, clustered(1, 400, 12)[5][1], 4)]
    df = spark.createDataFrame(rows, "i long, v array<double>, g int").repartition(5)
    got: dict[int, list] = {}
    for r in N.pruned_knn(df, df, key="i", vector="v", k=5, exclude=exclude, pivots=16, block=block).collect():
        got.setdefault(r.query, []).append((r["rank"], r.neighbor, r.similarity))
    want = brute(rows, [i for i, *_ in rows], 5, exclude)
    assert got.keys() == {q for q, near in want.items() if near}
    for q, near in want.items():
        mine = sorted(got[q])
        assert [-s for s, _ in near] == pytest.approx([s for *_, s in mine], abs=2e-12)
        exact = [i for _, i in near]
        assert [i for _, i, _ in mine] == exact or sorted(s for s, _ in near) == pytest.approx(sorted(-s for *_, s in mine), abs=2e-12)


def test_most_pairs_are_skipped(spark):
    rows = clustered(2, 3000, 40, dims=16, spread=0.02)
    df = spark.createDataFrame(rows, "i long, v array<double>, g int")
    counts: dict[str, int] = {}
    asked = df.where("i % 10 = 0")
    got = N.pruned_knn(asked, df, key="i", vector="v", k=5, pivots=128, counts=counts)
    want = brute(rows, range(0, 3000, 500), 5, None)
    found: dict[int, list] = {}
    for r in got.collect():
        found.setdefault(r.query, []).append((r["rank"], r.neighbor))
    assert all([i for _, i in near] == [i for _, i in sorted(found[q])] for q, near in want.items())
    print("pairs compared:", counts)
    assert counts["all"] == 3000 * 300 and counts["compared"] < counts["all"] / 2


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, None, 2)], "i long, v array<double>, g int")
    got = sorted((r.query, r.neighbor, r["rank"]) for r in N.pruned_knn(df, df, key="i", vector="v", k=4).collect())
    assert got == [(1, 2, 1), (2, 1, 1)]
    assert N.pruned_knn(df, df, key="i", vector="v", k=4, exclude="g").count() == 0
    assert N.pruned_knn(df.limit(0), df, key="i", vector="v", k=4).count() == 0
    assert N.pruned_knn(df, df.limit(0), key="i", vector="v", k=4).count() == 0
