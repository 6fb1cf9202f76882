import re

from quern.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if own := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= own
        out.append((str(doc_id), len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in df.collect())


def test_equals_brute_force(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows_of(decontaminate.contamination(docs, items)) == want
    assert any(x[4] for x in want)


ITEMS = [(1, "The quick brown fox"), (1, "jumps over"), (2, "a a a a a a a a a a a a a a a"), (3, "the"), (4, None), (5, "..."),
         (None, "été à Paris"), (1, "The quick brown fox"), (10, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")]
DOCS = [(1, "THE quick, brown fox jumps over the quick brown fox"), (2, "a " * 40), (3, None), (4, ""), (None, "Été ÉTÉ été à Paris"),
        (6, "x w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (6, "x w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"),
        (7, "quick the brown w1 fox"), (8, "b " * 300 + "jumps over")]


def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'k' AS key", "2 AS pos", "'t' AS term")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS n", "'w' AS w")


def test_odd_rows(spark, odd_docs, no_docs):
    docs, items = tables(spark)
    assert rows_of(decontaminate.contamination(docs, items)) == brute(DOCS, ITEMS)
    assert rows_of(decontaminate.contamination(odd_docs, items)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], ITEMS)
    assert decontaminate.contamination(no_docs, items).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {0}


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    docs, items = tables(spark)
    assert rows_of(decontaminate.contamination(docs, items)) == brute(DOCS, ITEMS)


def test_proximity(spark):
    items = spark.createDataFrame([(1, "red apple"), (2, "green leaf tree")], "item_id long, text string")
    texts = ["red apple", "red x x apple", "red " + "x " * 20 + "apple", "apple red", "tree leaf green", "green only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    texts = decontaminate.tokenised(docs)
    rare = decontaminate.staged(decontaminate.rare_terms(items, texts), "rare")
    one, two = decontaminate.shifted_lists(decontaminate.index_of(texts, rare), rare)
    told = {r.doc_id: (bytes(r.key), r.n_near) for r in decontaminate.contamination(docs, items, slop=4).collect()}
    assert {k: n for k, (_, n) in told.items()} == {0: 1, 1: 1, 2: 0, 3: 1, 4: 1, 5: 0}
    keys = {k: d for d, (k, _) in told.items()}
    near = sorted((r.item, keys[bytes(r.key)]) for r in decontaminate.proximity_matches(one, two, 4).collect())
    assert near == [("1", 0), ("1", 1), ("1", 3), ("2", 4)]
    exact = sorted((r.item, keys[bytes(r.key)], r.start) for r in decontaminate.exact_matches(one, two).collect())
    assert exact == [("1", 0, 0)]


def test_clean(spark):
    docs, items = tables(spark)
    bad = [r.contaminated for r in decontaminate.contamination(docs, items).collect()]
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and left.count() == bad.count(False)


def test_sql_of_the_query(spark, sf):
    """The registered SQL, with its proximity counts, on the smallest tables."""
    import duckdb

    from quern.llm import queries

    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, sf)
        columns = sorted(got.columns)
        want = c.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


def test_too_many_terms_to_broadcast_give_the_same(spark, sf, docs, odd_docs, monkeypatch):
    """Bare postings that meet the terms by a shuffle, contexts cut from the texts afterwards."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    tables = [docs, odd_docs.select("doc_id", "text").union(docs.limit(20).select("doc_id", "text"))]
    told = lambda t: sorted((tuple(map(str, r)) for r in decontaminate.contamination(t, items).drop("key").collect()))
    small = [told(t) for t in tables]
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert [told(t) for t in tables] == small
    assert any("True" in r for r in small[0])
