import hashlib
import math

import numpy as np
import pytest

from quern.llm import centroids

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k=16, rounds=3, dims=64, scale=64, seed=1):
    """(vec_id, cluster, distance) of every usable (vec_id, vector) in plain Python, and the centroids."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * float(x)) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [x for _, x in order[:k]]

    def near():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(cents)) for _, x in kept]

    for _ in range(rounds):
        at = [i for _, i in near()]
        for c in set(at):
            own = [x for (_, x), i in zip(kept, at, strict=True) if i == c]
            cents[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(v, i, d) for (v, _), (d, i) in zip(kept, near(), strict=True)], cents


def check(df, rows, **options):
    got, cents = centroids.centroid_clusters(df, **options)
    want, want_cents = brute(rows, **options)
    got = got.collect()
    assert cents == want_cents
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == sorted(want, key=repr)
    total = sum(w[2] for w in want)
    for r in got:
        assert r.inertia == total and r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()


def test_whole_table_equals_plain_python(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(df, [(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_rows(spark):
    """NULLs everywhere, wrong lengths, NaN and infinite components, ties, repeated rows and ids, clashing columns."""
    rng = np.random.default_rng(3)
    rows = [(i % 40, [float(x) for x in rng.integers(-3, 4, 4) / 64]) for i in range(120)]
    rows += [(None, [0.5, -0.5, 0.0, 0.25]), (None, None), (7, None), (8, []), (9, [1.0, 2.0, 3.0]), (10, [1.0, None, 0.0, 0.0])]
    rows += [(11, [math.nan, 0.0, 0.0, 0.0]), (12, [math.inf, 0.0, 0.0, 0.0]), (13, [-math.inf, 0.0, 0.0, 0.0]), (14, [-0.001, -0.0, 0.001, 1e5])]
    rows += [rows[0]] * 5
    df = spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS)
    df = df.selectExpr("*", *[f"'{c}' AS `{c}`" for c in "x xx v near cluster distance n s0 h inertia".split()])
    check(df, rows, dims=4)
    check(df, rows, dims=4, k=300, rounds=2)  # more clusters than rows, many of them equal
    check(df, rows, dims=3, k=2)
    empty, cents = centroids.centroid_clusters(df.limit(0))
    assert cents == [] and empty.count() == 0
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="at most"):
        centroids.centroid_clusters(df, dims=2)


def test_main_path_stays_in_the_jvm(spark, sf):
    df = centroids.centroid_clusters(spark.read.parquet(f"{sf}/embeddings.parquet"))[0]
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
