"""Profiles against a plain fold, and the stream against the batch over several micro-batches with events out of order."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import profiles as P

EVENT = "u long, t timestamp, i long, rating int, values map<string,double>, shares map<string,double>, signals map<string,string>, liked array<string>, disliked array<string>"


def plain(events, attributes):
    """(wants, likes, changes) after each event, by the rules as they are told."""
    wants, likes, out = dict.fromkeys(attributes, 3.0), {}, []
    clip = lambda x, a, b: max(a, min(b, x))
    for n, (rating, values, shares, signals, liked, disliked) in enumerate(events):
        w, c = dict(wants), dict(likes)
        pull, rate = (rating - 3) / 2, 1 / (n + 2)
        for a in attributes:
            v = (values or {}).get(a)
            if v is None or math.isnan(v):
                continue
            if pull > 0:
                w[a] = clip(w[a] + rate * pull * (v - w[a]), 1, 5)
            elif pull < 0:
                w[a] = clip(w[a] + rate * pull * math.copysign(1, v - w[a]) * max(0, 1 - abs(v - w[a]) / 2) * (v != w[a]), 1, 5)
        for k, s in (shares or {}).items() if pull else ():
            c[k] = clip(c.get(k, 0) + rate * pull * s, -1, 1)
        for a in attributes:
            w[a] = clip(w[a] + {"lower": -0.5, "higher": 0.5}.get((signals or {}).get(a), 0), 1, 5)
        for names, by in ((liked, 0.3), (disliked, -0.3)):
            for k in names or ():
                c[k] = clip(c.get(k, 0) + by, -1, 1)
        out.append((w, c, {a for a in w if abs(w[a] - wants[a]) >= 0.05} | {k for k in c if abs(c[k] - likes.get(k, 0)) >= 0.05}))
        wants, likes = w, c
    return out


def random_events(seed, users, each):
    rng = random.Random(seed)
    rows = []
    for i in range(users * each):
        values = rng.choice([None, {"a": rng.uniform(1, 5), "b": rng.choice([None, 3.0, math.nan, rng.uniform(1, 5)])}, {"c": 2.0}])
        shares = rng.choice([None, {}, {"x": rng.random(), "y": 0.5}])
        signals = rng.choice([None, {"a": "lower"}, {"b": "higher", "a": "none"}])
        pick = lambda: rng.choice([None, [], ["x"], ["z", "é\"q"]])
        rows.append((i % users, rng.randrange(0, 20_000), i, rng.randrange(1, 6), values, shares, signals, pick(), pick()))
    return rows


def as_frame(spark, rows):
    df = spark.createDataFrame(rows, EVENT.replace("t timestamp", "t long"))
    return df.withColumn("t", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")))


def near(got, want):
    return set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_history_equals_a_plain_fold(spark):
    rows = random_events(1, 7, 60)
    got = {(r.u, r.i): r for r in P.history(as_frame(spark, rows).repartition(5), "u", ["t", "i"], ["a", "b"]).collect()}
    assert len(got) == len(rows)
    for user in range(7):
        own = sorted((r for r in rows if r[0] == user), key=lambda r: r[1:3])
        for n, (r, (wants, likes, changes)) in enumerate(zip(own, plain([r[3:] for r in own], ["a", "b"]), strict=True), 1):
            g = got[(user, r[2])]
            assert g.n == n and near(g.wants, wants) and near(g.likes, likes) and set(g.changes) == changes
    last = {r.u: r for r in P.final(as_frame(spark, rows), "u", ["t", "i"], ["a", "b"]).collect()}
    assert {u: r.n for u, r in last.items()} == dict.fromkeys(range(7), 60)
    assert P.history(as_frame(spark, rows).limit(0), "u", ["t", "i"], ["a"]).count() == 0


def run_stream(spark, tmp_path, batches, **options):
    """The rows of the stream over micro-batches of one file each."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, rows in enumerate(batches):
            as_frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
            for f in (tmp_path / f"part{n}").glob("*.parquet"):
                (tmp_path / "in").mkdir(exist_ok=True)
                f.rename(tmp_path / "in" / f"{n:03d}.parquet")
                os.utime(tmp_path / "in" / f"{n:03d}.parquet", (1_000_000 + n, 1_000_000 + n))
        source = spark.readStream.schema(as_frame(spark, batches[0]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        name = "p" + tmp_path.name.replace("-", "_")
        told = P.history_stream(source, ["a", "b"], "u", ("t", "i"), **options)
        query = told.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        return spark.table(name).collect(), query.lastProgress
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


END = (99, 10_000_000, -1, 3, None, None, None, None, None)


def test_the_stream_equals_the_batch_with_events_out_of_order(spark, tmp_path):
    """Events come up to half an hour late, in five micro-batches; the last one moves the watermark on."""
    rows = random_events(2, 4, 30)
    rng = random.Random(3)
    arrival = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 1800))
    batches = [arrival[n * 30 : n * 30 + 30] for n in range(4)] + [[END]]
    times = [[r[1] for r in b] for b in batches]
    assert any(min(b) < max(a) for a, b in zip(times, times[1:], strict=False))  # later batches hold earlier events
    out, _ = run_stream(spark, tmp_path, batches, late="1 hour", idle="365 days")
    want = {(r.u, r.i): r for r in P.history(as_frame(spark, rows), "u", ["t", "i"], ["a", "b"]).collect()}
    got = {(r.u, r.i): r for r in out if r.i >= 0}
    assert set(got) == set(want) and len([r for r in out if r.i >= 0]) == len(got)
    for k, w in want.items():
        g = got[k]
        assert g.n == w.n and g.t == w.t and near(g.wants, w.wants) and near(g.likes, w.likes) and set(g.changes) == set(w.changes)


def test_late_events_are_dropped_and_idle_profiles_end(spark, tmp_path):
    like = lambda t, i: (1, t, i, 5, {"a": 5.0}, None, None, None, None)
    day = 86_400
    batches = [[like(0, 1)], [like(3 * day, 2), like(3 * day + 60, 3)], [like(20 * day, 5)], [like(day, 4)], [like(90 * day, 6)], [(*END[:1], 200 * day, *END[2:])]]
    out, _ = run_stream(spark, tmp_path, batches, late="1 hour", idle="30 days")
    got = {r.i: r.n for r in out if r.i > 0}
    assert got == {1: 1, 2: 2, 3: 3, 5: 4, 6: 1}  # 4 was behind the watermark; after 70 days the profile starts afresh


@pytest.mark.parametrize("rating,step", [(3, 0.0), (5, 0.5 * 1.0 * 2.0), (1, -0.5 * 1.0 * 0.0), (4, 0.5 * 0.5 * 2.0)])
def test_first_steps(rating, step):
    state = P.start_of(["a"])
    P.moved(state, 0, [("a", 5.0, (rating - 3) / 2, True)])
    assert state["a"] == pytest.approx(3 + step)


def test_halves_of_a_millionth_round_as_in_sql(spark, tmp_path):
    """Users with one event, whose preference has seven decimals, the last a five."""
    import duckdb

    from quern import plans

    source = "SELECT 1 + 5 * i AS event_id, TIMESTAMP '2024-01-01' AS ts, i AS user_id, 'view' AS event_type, i / 100.0 AS value, '' AS props FROM range(8000) r(i)"
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST(value AS DOUBLE) AS value) FROM ({source})) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.execute(plans.oracle_sql()["profile_fold"]).fetchall())
    assert sorted(tuple(r) for r in plans.queries()["profile_fold"](spark, str(tmp_path)).collect()) == want
