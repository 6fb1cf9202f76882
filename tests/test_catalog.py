"""Commits of several tables: crashes, races, rejected rows; loads with ids, scopes and protected rows."""

import threading

import pytest
from pyspark.sql import functions as F

from quern.operators.catalog import Catalog, Conflict, Rejected, Table, load


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def pair(spark):
    a = spark.createDataFrame([(1, 3), (2, 9)], "k long, v int")
    b = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "k long, a long")
    return a, b


def test_commits_name_every_table(spark, tmp_path, pair):
    c = Catalog(spark, str(tmp_path / "x"))
    a, b = pair
    assert c.version() == 0 and c.tables() == {}
    assert c.commit({"a": a, "b": b}, references=[("b", "a", "a", "k")]) == 1
    assert c.commit({"a": a.where("k = 1")}, {"a": {"small": F.col("v") < 5}}) == 2
    assert rows(c.read("a"), "k") == [(1,)] and rows(c.read("b"), "k") == [(10,), (11,), (12,)]
    assert rows(c.read("a", 1), "k") == [(1,), (2,)]


def test_rejected_rows_are_not_committed(spark, tmp_path, pair):
    c = Catalog(spark, str(tmp_path / "x"))
    a, b = pair
    c.commit({"a": a, "b": b})
    for tables, options in (
        ({"a": a}, {"checks": {"a": {"small": F.col("v") < 5}}}), ({"a": a.limit(0)}, {}), ({"a": a.where("k = 1")}, {"references": [("b", "a", "a", "k")]}),
        ({"a": a.withColumn("v", F.lit(None).cast("int"))}, {"checks": {"a": {"known": F.col("v") > 0}}}),
    ):
        with pytest.raises(Rejected):
            c.commit(tables, **options)
        assert c.version() == 1 and rows(c.read("a"), "k") == [(1,), (2,)]
    assert c.commit({"a": a.limit(0)}, may_be_empty={"a"}) == 2


def test_a_crash_leaves_the_old_catalog(spark, tmp_path, pair, monkeypatch):
    c = Catalog(spark, str(tmp_path / "x"))
    a, b = pair
    c.commit({"a": a, "b": b})
    for step in ("_publish", "version"):  # before the manifest is written, and before it is known whether anyone else wrote one
        with monkeypatch.context() as m:
            def crash(*_):
                raise OSError("lost")

            m.setattr(c, step, crash)
            with pytest.raises(OSError):
                c.commit({"a": a.where("k = 2")}, base=1)
        assert c.version() == 1 and rows(c.read("a"), "k") == [(1,), (2,)]
    # between writing and renaming: a file under another name; and a manifest that is torn
    (tmp_path / "x/commits/.000000000002-abc").write_text('{"tables": {}, "whole": true}')
    (tmp_path / "x/commits/000000000002.json").write_text('{"tables": {"a": ')
    (tmp_path / "x/commits/000000000003.json").write_text("")
    assert c.version() == 1 and rows(c.read("a"), "k") == [(1,), (2,)]
    assert c.commit({"a": a.where("k = 2")}) == 4 and rows(c.read("a"), "k") == [(2,)]


def test_of_two_writers_one_wins(spark, tmp_path, pair, monkeypatch):
    c = Catalog(spark, str(tmp_path / "x"))
    a, _ = pair
    c.commit({"a": a})
    assert c.commit({"a": a.where("k = 1")}, base=1) == 2
    with pytest.raises(Conflict):
        c.commit({"a": a.where("k = 2")}, base=1)
    # both pass every check, then both rename
    both, seen = threading.Barrier(2), []
    publish = Catalog._publish

    def together(self, number, tables):
        both.wait(60)
        publish(self, number, tables)

    monkeypatch.setattr(Catalog, "_publish", together)

    def write(k):
        try:
            seen.append((k, Catalog(spark, str(tmp_path / "x")).commit({"a": a.where(f"k = {k}")}, base=2)))
        except Conflict:
            seen.append((k, None))

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [k for k, n in seen if n == 3]
    assert len(won) == 1 and rows(c.read("a"), "k") == [(won[0],)] and c.version() == 3
    assert not [p.name for p in (tmp_path / "x/commits").iterdir() if p.name.startswith(".0") and not p.name.endswith(".crc")]


SPECS = [
    Table("brand", "name", "brand_id", required=True),
    Table("item", "code", "item_id", {"brand_id": ("brand", "brand"), "twin_id": ("twin", "brand")}, {"brand_id"}, "city"),
]


def feeds(spark, brands, items):
    return {
        "brand": spark.createDataFrame([(b,) for b in brands], "name string"),
        "item": spark.createDataFrame(items, "code string, brand string, twin string, city string"),
    }


def test_loads_keep_ids_and_protected_rows(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "x"))
    load(c, SPECS, feeds(spark, "ABCD", [("i1", "A", "B", "x"), ("i2", "B", None, "y"), ("i3", "C", "nowhere", "y"), ("i4", "Z", None, "x")]))
    brand = {r.name: r.brand_id for r in c.read("brand").collect()}
    item = {r.code: r for r in c.read("item").collect()}
    assert set(item) == {"i1", "i2", "i3"}  # i4's brand is in no source
    assert item["i1"].brand_id == brand["A"] and item["i1"].twin_id == brand["B"] and item["i3"].twin_id is None
    used = spark.createDataFrame([(item["i2"].item_id,)], "id long")
    # A's item goes, B's is protected, C's is out of scope; B and C stay for their items
    load(c, SPECS, feeds(spark, ["A", "E"], [("i5", "E", "D", "x")]), {"item": used}, {"item": ["x"]})
    # and D for the new item that names it
    assert {(r.name, r.active) for r in c.read("brand").collect()} == {("A", True), ("E", True), ("B", False), ("C", False), ("D", False)}
    assert {(r.code, r.active) for r in c.read("item").collect()} == {("i5", True), ("i2", True), ("i3", True)}
    load(c, SPECS, feeds(spark, ["A", "C"], [("i3", "C", None, "y")]), {"item": used}, {"item": ["x", "y"]})
    assert {(r.code, r.active) for r in c.read("item").collect()} == {("i3", True), ("i2", False)}
    now = {r.name: r for r in c.read("brand").collect()}
    assert {n: r.active for n, r in now.items()} == {"A": True, "C": True, "B": False}
    assert now["C"].brand_id == brand["C"] and now["B"].brand_id == brand["B"]
    ids = [r.brand_id for r in now.values()]
    assert len(set(ids)) == len(ids)


def test_a_load_that_fails_changes_nothing(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "x"))
    load(c, SPECS, feeds(spark, "AB", [("i1", "A", None, "x")]))
    for bad, checks in ((feeds(spark, [], [("i1", "A", None, "x")]), None), (feeds(spark, "A", [("i1", "A", None, None)]), {"item": {"city": F.col("city").isNotNull()}})):
        with pytest.raises(Rejected):
            load(c, SPECS, bad, checks=checks)
    assert c.version() == 1 and rows(c.read("brand"), "name") == [("A",), ("B",)]
