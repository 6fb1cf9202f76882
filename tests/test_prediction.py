"""Hand-worked predictions: what each layer adds, and what a degraded query leaves out."""

from pyspark.sql import functions as F

from quern.operators import dictionary as D, prediction as P


def test_layers(spark):
    near = [(q, i, s) for q in (1, 2, 3, 4) for i, s in ((10, 0.9), (11, 0.8), (12, 0.7), (13, 0.6))] + [(5, 10, 0.9), (5, 11, 0.8)]
    items = [(10, 4.0, 2.0), (11, 4.0, 2.0), (12, 5.0, 2.0), (13, 4.0, 3.0), (14, None, None)]
    tags = [(10, "Lemon"), (10, "rose"), (11, "lemon"), (12, "lemon"), (13, "cocoa"), (14, "cocoa"), (14, "rose"), (15, "rose")]
    queries = [(1, "plain", None, False), (2, "bright and heavy, rose", 1.5, False), (3, "plain", 1.5, False), (4, "plain", 1.5, True), (5, "cocoa", None, False), (6, None, None, False)]
    rules = [("cocoa", "rose", 0.5, 2.0), ("cocoa", "lemon", 0.5, 1.5), ("rose", "cocoa", 0.4, 2.0)]
    rates = [("lemon", 0.4), ("rose", 0.6), ("cocoa", 0.3)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tagged = frame([(q, i, 0.5) for q in (1, 3, 4) for i in (13, 14, 15)] + [(9, 10, 0.5)], "query long, neighbor long, similarity double")
    out = P.predict(
        frame(queries, "query long, text string, model_acidity double, bad boolean"), frame(near, "query long, neighbor long, similarity double"), tagged,
        frame(items, "neighbor long, acidity double, body double"), frame(tags, "neighbor long, tag string"), frame(rates, "tag string, base double"),
        frame(rules, "a string, b string, share double, lift double"), ["acidity", "body"], {"acidity": (r"\bbright\b", r"\bflat\b"), "body": (r"\bheavy\b", r"\bthin\b")},
        D.WholeWords(["lemon", "rose", "cocoa"]), F.col("bad"), target=3,
    )
    got = {r.query: r for r in out.collect()}
    said = {q: [(x.tag, x.origin) for x in r.tags] for q, r in got.items()}
    # 0.9, 0.8, 0.7, 0.6 with 4, 4, 5, 4 and 2, 2, 2, 3
    one = got[1]
    assert (one.acidity, one.acidity_from, one.body, one.body_from, one.confidence, one.n_neighbors) == (4.23, "neighbours", 2.2, "neighbours", "high", 4)
    # lemon has 3 of 4; rose 1 of 4; the tagged ones say rose (2 of 3, more rarely than its base rate wants) and cocoa (2 of 3)
    assert said[1] == [("lemon", "vote"), ("cocoa", "fill")]
    assert (got[2].acidity, got[2].acidity_from, got[2].body, got[2].body_from) == (5.0, "text", 5.0, "text")
    assert said[2] == [("rose", "text"), ("lemon", "vote"), ("cocoa", "implied")]
    assert (got[3].acidity, got[3].acidity_from) == (1.5, "model") and said[3] == said[1]
    assert (got[4].acidity, got[4].acidity_from, got[4].confidence) == (4.23, "neighbours", "low") and said[4] == [("lemon", "vote")]
    # two neighbours are too few for a mean, but vote; two implied tags are equally likely: the larger lift goes first
    assert (got[5].acidity, got[5].acidity_from, got[5].confidence, got[5].n_neighbors) == (None, None, "low", 2)
    assert said[5][:2] == [("cocoa", "text"), ("lemon", "vote")] and said[5][2:] == [("rose", "implied")]
    assert (got[6].n_neighbors, got[6].confidence, said[6]) == (0, "low", [])
