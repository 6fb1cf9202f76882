"""Hand-worked feeds: three of one reviewing site, cupping tables of two layouts, a listing, and all of them together."""

from pyspark.sql import functions as F

from quern.functions import rules as N, text as T
from quern.operators import feeds as FD

FIRST = FD.Layout(
    {"url": "url", "name": "title", "roaster": "roaster", "origin": "coffee_origin", "roast": "roast_level", "acid": "acidity", "body": "body", "rating": "rating", "summary": "blind"},
    texts=("blind", "notes", "bottom"), subs=("aroma", "flavor"),
)
SECOND = FD.Layout(
    {"url": "slug", "name": "name", "roaster": "roaster", "origin": "origin", "roast": "roast", "acid": "acid", "body": "body", "rating": "rating", "summary": "desc_1"},
    texts=("desc_1", "desc_2"), subs=("aroma",),
)
THIRD = FD.Layout({"name": "name", "roaster": "roaster", "roast": "roast", "rating": "rating", "summary": "desc_1"}, texts=("desc_1",), places=("origin_1", "origin_2"))


def feed(spark, columns, *rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"`{c}` string" for c in columns) + ", n long")
    return df


def test_three_feeds_of_one_site(spark):
    a = feed(
        spark, ["url", "title", "roaster", "coffee_origin", "roast_level", "acidity", "body", "rating", "blind", "notes", "bottom", "aroma", "flavor"],
        ("u/1", "Gesha One", "Red", "Caranavi, Bolivia", "Medium-Light", "9", "8", "93", "Floral.", "Washed process.", "Great.", "9", " "),
        ("u/2", "Decaf Two", "Blue", "Huila, Colombia", None, "7", "8", "90", "Cocoa.", "Swiss Water decaffeinated.", None, "8", "8"),
        (None, "No url", "x", None, None, None, None, None, "lost", None, None, None, None), ("u/1", "Gesha One", "Red", None, "Light", "9", "x", "93", "Later.", None, None, None, None),
    )
    b = feed(
        spark, ["slug", "name", "roaster", "origin", "roast", "acid", "body", "rating", "desc_1", "desc_2", "aroma"],
        ("u/1", "Other name", "Red", "Peru", "Dark", "1", "6", "50", "d1", "d2", "7"), ("u/2", None, None, None, "Dark roast", None, None, None, None, None, None),
        ("u/3", "Three", "Lu", "Nyeri, Kenya", "Light", "8", "7", "91", "Black currant.", "natural process", "9"),
    )
    c = feed(
        spark, ["name", "roaster", "roast", "origin_1", "origin_2", "rating", "desc_1"],
        ("three", "LU", "Dark", "Peru", None, "1", "dup"), ("Four", "A.R.", "Medium", "Panama", "Ethiopia", "95", "dark chocolate"), ("Five", None, None, None, None, None, None),
    )
    laid = [FD.laid_out(df, layout, "n") for df, layout in ((a, FIRST), (b, SECOND), (c, THIRD))]
    entities, reviews = FD.review_feed(*laid, "site", "s", "2026-01-01")
    by = {r.key: r for r in entities.collect()}
    assert set(by) == {"s:u/1", "s:u/2", "s:u/3", "s:a.r.|four", "s:|five"}
    one, two, three, four, five = (by[k] for k in ("s:u/1", "s:u/2", "s:u/3", "s:a.r.|four", "s:|five"))
    # the last row of a URL counts, and the second feed fills what it lacks
    assert (one.name, one.origin_country, one.roast_level, one.flavor_summary) == ("Gesha One", "Peru", "light", "Later.")
    assert (two.is_decaf, two.decaf_process, two.roast_level, two.origin_country) == (True, "swiss-water", "dark", "Colombia")
    assert (three.origin_country, three.process, three.roast_level, three.flavor_summary) == ("Kenya", "natural", "light", "Black currant.")
    assert (four.origin_country, four.origin_region, four.roast_level, four.acidity) == ("Panama", "Panama, Ethiopia", "medium", None)
    assert (five.name, five.source_url, five.origin_country, five.attr_label_source) == ("Five", None, None, {})
    # acidity 9, 7, 8 are thirds; body 6 (filled), 8, 7
    assert [(x.acidity, x.body) for x in (one, two, three)] == [(5, 2), (2, 5), (4, 4)]
    assert one.attr_label_source == {"acidity": "review_score", "body": "review_score"}
    told = {r.coffee_key: r for r in reviews.collect()}
    assert set(told) == {"s:u/1", "s:u/2", "s:u/3", "s:a.r.|four"}
    assert told["s:u/2"].text == "Cocoa.\nSwiss Water decaffeinated." and told["s:u/2"].sub_scores == {"aroma": 8.0, "flavor": 8.0} and told["s:u/2"].rating == 90.0
    assert told["s:a.r.|four"].sub_scores == {} and told["s:u/1"].key == "review:s:u/1"


def test_cupping_tables_and_a_listing(spark):
    old = feed(spark, ["Country.of.Origin", "Farm.Name", "Acidity", "Body", "Processing.Method", "Company"], ("Ethiopia", "f", "8.75", "8.5", "Washed / Wet", "x"), ("Mexico", None, "7.0", "7.2", "Natural / Dry", "Descafeinadores"))
    new = feed(spark, ["Country of Origin", "Farm Name", "Acidity", "Mouthfeel", "Altitude"], ("Colombia", "El P", "8.58", "8.25", "1,700-1,900"), (None, None, None, None, "3500"))
    files = {
        "a": (old, FD.Layout({"country": "Country.of.Origin", "farm": "Farm.Name", "acid": "Acidity", "body": "Body", "process": "Processing.Method", "company": "Company"}), "u1"),
        "b": (new, FD.Layout({"country": "Country of Origin", "farm": "Farm Name", "acid": "Acidity", "body": "Mouthfeel", "altitude": "Altitude"}), "u2"),
    }
    by = {r.key: r for r in FD.cupping_feed(files, "n", "cup", "2026-01-01").collect()}
    assert set(by) == {"cup:a:0", "cup:a:1", "cup:b:0", "cup:b:1"}
    assert [by[k].acidity for k in sorted(by)] == [5, 2, 4, None] and by["cup:b:1"].name == "sample" and by["cup:b:1"].attr_label_source == {}
    assert (by["cup:b:0"].name, by["cup:b:0"].altitude_m, by["cup:b:1"].altitude_m) == ("Colombia El P", 1800, None)
    assert by["cup:a:1"].is_decaf is False and by["cup:a:1"].process == "natural"
    shop = feed(spark, ["id", "title", "roast", "notes", "link"], ("14", "Bolivia Natural", "Unknown", "Sweet > Honey > Honey; Fruity > Berry > Blueberry", "u1"), ("15", None, "dark", None, "l"))
    listing = FD.listing_feed(shop, FD.Layout({"id": "id", "name": "title", "roast": "roast", "notes": "notes", "url": "link"}), "n", "shop", "2026-01-02")
    rows = {r.key: r for r in listing.collect()}
    assert rows["shop:14"].flavor_tags == ["honey", "blueberry"] and rows["shop:14"].roast_level is None and rows["shop:15"].name == "(unknown)"
    # the shop's u1 belongs to the cupping feed; one feed may be left out
    entities, _, counts = FD.normalised([FD.cupping_feed(files, "n", "cup", "d"), listing], [])
    assert {r.key for r in entities.collect()} == set(by) | {"shop:15"}
    assert sorted((r.source, r["read"], r.kept) for r in counts.collect()) == [("cup", 4, 4), ("shop", 2, 1)]
    entities, _, _ = FD.normalised([FD.cupping_feed(files, "n", "cup", "d"), listing], [], lambda s: s == "cup")
    assert {r.key for r in entities.collect()} == {"shop:14", "shop:15"}


def test_altitudes_and_slugs(spark):
    texts = ["1,950-2,050m", "1,066m", "1600~2000 masl", "1850.0", "190164", "0-1500", None, "none", "1001 1002"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.a for r in df.select("i", N.altitude(F.col("t")).alias("a")).orderBy("i").collect()] == [2000, 1066, 1800, 1850, None, 1500, None, None, 1002]
    s = spark.createDataFrame([("매머드 익스프레스",), ("매머드익스프레스",), ("a b",), ("ab",)], "n string").select(T.slug(F.col("n"), {"매머드 익스프레스": "mm"}, "k-").alias("s"))
    got = [r.s for r in s.collect()]
    assert got[:2] == ["mm", "mm"] and got[2] == got[3] != "mm"
