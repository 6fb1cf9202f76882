import os
import random

import pytest
from pyspark.sql import functions as F

from quern import sources as S, streaming as ST


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_lines_with_torn_lines(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"k": 1, "s": "a"}\n{"k": 2, "s": \n\n{"k": 3, "s": "c"}\n')
    rows, torn = S.read_json_lines(spark, path, "k long, s string")
    assert sorted(r.k for r in rows.collect()) == [1, 3] and torn.count() == 1


def test_typed_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, \"b\"", True, ["x", "y"]), (2, None, False, [])], "k long, s string, b boolean, t array<string>")
    S.write_csv(df, str(tmp_path / "out"))
    got = S.read_csv_typed(spark, str(tmp_path / "out"), "k long, s string, b boolean, t string").orderBy("k").collect()
    assert [(r.k, r.s, r.b, r.t) for r in got] == [(1, 'a, "b"', True, "x;y"), (2, None, False, None)]
    assert S.read_csv_text(spark, str(tmp_path / "out")).dtypes[0] == ("k", "string")


def test_products_tree_and_dictionary(spark, tmp_path):
    write(tmp_path / "shop.json", '{"products": [{"handle": "a", "title": "one"}, {"handle": "a", "title": "two"}, {"handle": "b", "title": "three"}]}')
    got = S.read_products(spark, str(tmp_path / "shop.json"), "handle: string, title: string")
    assert sorted((r.handle, r.title) for r in got.collect()) == [("a", "one"), ("b", "three")]
    tree = S.read_tree(spark, write(tmp_path / "tree.json", '{"f": {"berry": ["black", "blue"]}, "n": {}}'))
    assert {(r.key, r.parent, r.level) for r in tree.collect()} == {("f", None, 1), ("n", None, 1), ("f>berry", "f", 2), ("f>berry>black", "f>berry", 3), ("f>berry>blue", "f>berry", 3)}
    assert [r.column for r in S.data_dictionary(tree).orderBy("position").collect()] == ["key", "parent", "level", "name"]
    assert S.find_files(spark, str(tmp_path), "tree.json").count() == 1


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "é")], "k long, s string")
    S.write_jsonl(df, str(tmp_path / "o"))
    assert sorted(map(tuple, S.read_jsonl(spark, str(tmp_path / "o"), df.schema).collect())) == [(1, "a"), (2, "é")]


def test_page_facts(spark):
    html = "<title>T &amp; u</title><table><tr><th>Origin</th><td>Kenya <b>AA</b></td></tr><tr><th>Origin<td>second</table><dl><dt>Roast<dd>light</dl>"
    df = spark.createDataFrame([(1, html), (2, None)], "k long, h string")
    assert sorted((r.k, r.field, r.value) for r in S.page_facts(df, "k", "h").collect()) == [(1, "origin", "Kenya AA"), (1, "roast", "light"), (1, "title", "T & u")]


def test_product_blocks_and_labelled_runs(spark):
    def facts(block):
        parser = S._Facts()
        parser.feed(f"<script type='application/ld+json'>{block}</script><p>x")
        parser.close()
        return parser.products

    assert facts('{"@type": "Product", "name": "A &amp; b<br/>c", "offers": {"price": 5}}') == [("product.name", "A & b c"), ("product.price", "5")]
    assert facts('{"@type": "ProductGroup", "name": "G", "hasVariant": [{"description": "d", "offers": {"price": "7"}}, {"description": "e"}]}') == [
        ("product.name", "G"), ("product.description", "d"), ("product.price", "7"),
    ]
    for odd in ("not json", "[1]", '{"@type": "Offer"}', '{"@type": "Product", "offers": []}', '{"@type": "ProductGroup", "hasVariant": ["x"]}'):
        assert facts(odd) == []
    text = "Origin Country : Kenya Farm: x Process: washed Origin: second Delivery free"
    df = spark.createDataFrame([(text,), ("Process : \u00a0 Origin x\ny Process: z",), ("none",), (None,)], "t string")
    got = [r.m for r in df.select(S.labelled_runs(F.col("t"), {"Origin": "origin", "Process": "process"}, ("Farm", "Delivery")).alias("m")).collect()]
    assert got == [{"origin": "Kenya", "process": "washed"}, {"origin": "x\ny", "process": "z"}, {}, None]
    graph = '{"@graph": [{"@type": "Offer"}, {"@type": ["Thing", "Product"], "name": "P", "offers": [{"x": 1}, {"lowPrice": 3}]}]}'
    assert facts(graph) == facts(f"[{graph}]") == [("product.name", "P"), ("product.price", "3")]


def test_logs(spark):
    df = spark.createDataFrame([('x {"evt": "a", "n": "1"} y',), ("plain",), ('{"other": 1}',), (None,)], "value string")
    assert [(r.evt, r.fields["n"]) for r in ST.parsed_logs(df).collect()] == [("a", "1")]


def stream(spark, tmp_path, df, build, mode):
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = build(source).writeStream.outputMode(mode).format("memory").queryName(f"q{abs(hash(str(tmp_path)))}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(query.name).collect()


def events(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").limit(400)
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"), (F.col("event_type") == "error").alias("failed"), F.floor("value").alias("ms"), (F.col("event_id") % 3).alias("cards"), (F.col("event_id") % 2).alias("fallbacks"))


def test_daily_intake_stream_equals_batch(spark, sf, tmp_path):
    df = events(spark, sf)
    got = {(r.user_id, r.day_start): (round(r.known, 6), r.unknown) for r in stream(spark, tmp_path, df.union(df), lambda s: ST.daily_intake(s, 400.0), "update")}
    want = {(r.user_id, r.day_start): (round(r.known, 6), r.unknown) for r in ST.daily_intake(df, 400.0).collect()}
    assert got == want and all(d.hour == 15 for _, d in want)


def test_request_kpis_stream_equals_batch(spark, sf, tmp_path):
    df = events(spark, sf)
    rows = stream(spark, tmp_path, df, lambda s: ST.request_kpis(s, "1 day"), "update")
    got = {r.start: (r.n, r.errors, r.fallback_rate) for r in rows}
    assert got == {r.start: (r.n, r.errors, r.fallback_rate) for r in ST.request_kpis(df, "1 day").collect()}


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_window_percentiles_of_a_stream_are_within_the_bound(spark, tmp_path, accuracy):
    """Five micro-batches, windows that go on over several of them, an event behind the watermark, repeated events."""
    rng = random.Random(5)
    rows = [(i, 60 * rng.randrange(0, 40), round(rng.lognormvariate(5, 1), 3), rng.random() < 0.1) for i in range(6000)]
    arrival = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 500))
    batches = [arrival[n * 1500 : n * 1500 + 1500] for n in range(4)]
    late = (-1, 0, 1e9, True)  # comes when the watermark is far beyond it
    batches[1] += batches[0][-5:]  # sent again, not long after
    batches += [[(-2, 100_000, 1.0, False)], [late, (-3, 200_000, 1.0, False)]]
    for n, part in enumerate(batches):
        df = spark.createDataFrame(part, "event_id long, s long, ms double, failed boolean").withColumn("ts", F.timestamp_seconds(1_700_000_000 - 1_700_000_000 % 3600 + F.col("s")))
        df = df.withColumn("cards", F.lit(1)).withColumn("fallbacks", F.lit(0))
        df.coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        (f,) = (tmp_path / f"part{n}").glob("*.parquet")
        f.rename(tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_000_000 + n, 1_000_000 + n))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = ST.request_kpis(source, "5 minutes", "10 minutes", accuracy)
    query = told.writeStream.outputMode("append").format("memory").queryName(f"k{accuracy}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = {r.start: r for r in spark.table(f"k{accuracy}").collect()}
    base = min(got)
    values = {}
    for _, s, ms, failed in rows:
        values.setdefault(s // 300, []).append((ms, failed))
    assert len([g for g in got if (g - base).total_seconds() < 2400]) == len(values) == 8
    for w, own in values.items():
        r = next(r for g, r in got.items() if (g - base).total_seconds() == 300 * w)
        assert (r.n, r.errors) == (len(own), sum(f for _, f in own))
        ordered = sorted(m for m, _ in own)
        for p, v in ((0.5, r.p50), (0.95, r.p95)):
            rank = ordered.index(v) + 1
            assert abs(rank - p * len(own)) <= len(own) / accuracy + 1
