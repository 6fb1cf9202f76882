"""Queries: joins and nearest neighbours."""

from pyspark.sql import functions as F

from ..operators import aggregates as A, dictionary as D, joins as J, neighbors as NB, prediction as P
from .base import Registry

registry = Registry()
query = registry.add


@query("""SELECT o_orderkey, coalesce(c.c_name, n.n_name, 'order ' || o_orderkey) AS name FROM orders o
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 LEFT JOIN nation n ON o.o_custkey % 40 = n.n_nationkey""")
def tasting_names(t):
    """A name for every order: the customer's, else a nation's, else its number."""
    c = t("customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    n = F.broadcast(t("nation").select("n_nationkey", "n_name"))
    o = t("orders").select("o_orderkey", "o_custkey")
    joined = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, o.o_custkey % 40 == F.col("n_nationkey"), "left")
    return joined.select("o_orderkey", F.coalesce("c_name", "n_name", F.concat(F.lit("order "), "o_orderkey")).alias("name"))


@query("SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AS has_rich FROM nation")
def brand_has_menu(t):
    has = t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("h", F.lit(True))
    return t("nation").join(has, "n_nationkey", "left").select("n_nationkey", F.col("h").isNotNull().alias("has_rich"))


@query("SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w NOT IN ('red', 'blue', 'bolt', 'gear', 'ring', 'rod')")
def missing_names(t):
    """Words without a translation."""
    words = t("part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    known = words.sparkSession.createDataFrame([(w,) for w in ("red", "blue", "bolt", "gear", "ring", "rod")], "word string")
    return words.join(known, "word", "left_anti")


@query("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def orphan_children(t):
    """Lines without a finished order, counted by order."""
    return J.orphans(t("lineitem").select("l_orderkey"), t("orders").where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS bal FROM customer),
    r AS (SELECT s_nationkey AS c_nationkey, max(s_acctbal) AS ref FROM supplier GROUP BY 1)
    SELECT c_custkey, coalesce(bal, ref) AS bal, bal IS NULL AND ref IS NOT NULL AS filled FROM m LEFT JOIN r USING (c_nationkey)""")
def reference_fill(t):
    main = t("customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("bal"))
    ref = t("supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("bal"))
    return J.fill_from(main, ref, ["c_nationkey"], "bal").select("c_custkey", "bal", "filled")


@query("""WITH l AS (SELECT p_partkey, p_brand, p_type FROM part WHERE p_size > 40),
    r AS (SELECT p_brand, p_type AS r_type, max(p_retailprice) AS price FROM part WHERE p_size <= 10 GROUP BY 1, 2),
    j AS (SELECT l.p_partkey, price, CASE WHEN r_type = p_type THEN 0 WHEN r_type = 'STANDARD' THEN 1 WHEN r_type = 'PROMO' THEN 2 WHEN r_type IS NOT NULL THEN 3 END AS rk FROM l LEFT JOIN r USING (p_brand))
    SELECT p_partkey, arg_min(price, rk * 1000000 + price) AS matched, CAST(min(rk) AS INT) AS match_rank FROM j GROUP BY p_partkey""")
def fallback_join(t):
    """A price for large parts: of the same type, else STANDARD, else PROMO, else any of the brand."""
    left = t("part").where("p_size > 40").select("p_partkey", "p_brand", "p_type")
    right = t("part").where("p_size <= 10").groupBy("p_brand", F.col("p_type").alias("r_type")).agg(F.max("p_retailprice").alias("price"))
    rank = F.when(F.col("r.r_type") == F.col("l.p_type"), 0).when(F.col("r.r_type") == "STANDARD", 1).when(F.col("r.r_type") == "PROMO", 2).when(F.col("r.r_type").isNotNull(), 3)
    return J.fallback_join(left, right, ["p_brand"], rank, "price").select("p_partkey", "matched", "match_rank")


@query("""WITH x AS (SELECT *, regexp_replace(p_name, '^(old|new) ', '') AS k, p_name LIKE 'old %' AS swap FROM part)
    SELECT p_partkey FROM x WHERE NOT swap OR NOT EXISTS (SELECT 1 FROM x y WHERE NOT y.swap AND y.p_brand = x.p_brand AND y.k = x.k)""")
def twin_antijoin(t):
    key = F.regexp_replace("p_name", "^(old|new) ", "")
    return J.without_twins(t("part").select("p_partkey", "p_brand", "p_name"), "p_brand", key, F.col("p_name").like("old %")).select("p_partkey")


@query("""WITH i AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents),
    n AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM benchmark),
    c AS (SELECT doc_id, item_id, len(n.w) AS k FROM i JOIN n ON list_has_all(i.w, n.w) WHERE len(n.w) >= 3)
    SELECT doc_id, item_id, CAST(k AS INT) AS shared FROM (SELECT *, max(k) OVER (PARTITION BY doc_id) AS m, count(*) OVER (PARTITION BY doc_id, k) AS same FROM c) WHERE k = m AND same = 1""")
def token_containment(t):
    """The benchmark item of which a document contains all words, if one item is ahead."""
    return J.contained_names(t("documents"), "text", "doc_id", t("benchmark").select("item_id", F.col("text").alias("name")), "name", "item_id", 3)


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS bal FROM customer WHERE c_custkey % 5 <> 0),
    b AS (SELECT c_custkey AS k, 'other' AS name, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 3 <> 0)
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, coalesce(a.bal, b.bal) AS bal FROM a FULL JOIN b ON a.k = b.k""")
def fill_missing_merge(t):
    c = t("customer")
    a = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("bal"))
    b = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.lit("other").alias("name"), (F.col("c_acctbal") + 1).alias("bal"))
    return J.fill_missing_merge(a, b, ["k"])


_FEEDS = """f AS (SELECT p_partkey AS i, CASE WHEN p_partkey % 4 <> 3 THEN 'u' || (p_partkey % 700) END AS url, p_brand AS g, p_name AS n, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS v, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS w FROM part),
    a AS (SELECT url, arg_max(g, i) AS g, arg_max(n, i) AS n, arg_max({v: v}, i).v AS v, arg_max({w: w}, i).w AS w FROM f WHERE i % 4 = 0 GROUP BY url),
    b AS (SELECT url, arg_min(g, i) AS g, arg_min(n, i) AS n, arg_min(v, i) FILTER (v IS NOT NULL) AS v, arg_min(w, i) FILTER (w IS NOT NULL) AS w FROM f WHERE i % 4 IN (1, 2) GROUP BY url),
    ab AS (SELECT coalesce(a.url, b.url) AS url, coalesce(a.g, b.g) AS g, coalesce(a.n, b.n) AS n, coalesce(a.v, b.v) AS v, coalesce(a.w, b.w) AS w FROM a FULL JOIN b ON a.url = b.url),
    k AS (SELECT lower(g) AS lg, lower(n) AS ln, max(url) AS url FROM ab GROUP BY 1, 2), c AS (SELECT * FROM f WHERE i % 4 = 3),
    fills AS (SELECT lower(g) AS lg, lower(n) AS ln, arg_min(v, i) FILTER (v IS NOT NULL) AS v, arg_min(w, i) FILTER (w IS NOT NULL) AS w FROM c GROUP BY 1, 2),
    gaps AS (SELECT k.url, fills.v, fills.w FROM k JOIN fills ON k.lg = fills.lg AND k.ln = fills.ln),
    fresh AS (SELECT arg_max(g, i) AS g, arg_max(n, i) AS n, arg_max({v: v}, i).v AS v, arg_max({w: w}, i).w AS w FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.lg = lower(c.g) AND k.ln = lower(c.n)) GROUP BY lower(g), lower(n))"""


@query(f"WITH {_FEEDS} SELECT ab.url, g, n, coalesce(ab.v, gaps.v) AS v, coalesce(ab.w, gaps.w) AS w FROM ab LEFT JOIN gaps ON gaps.url = ab.url UNION ALL SELECT NULL, g, n, v, w FROM fresh")
def three_feed_merge(t):
    """Feeds merged by URL, and by group and name where there is none."""
    k = F.col("p_partkey")
    rows = t("part").select(
        F.when(k % 4 != 3, F.concat(F.lit("u"), (k % 700).cast("string"))).alias("url"), F.col("p_brand").alias("g"), F.col("p_name").alias("n"),
        F.when(k % 3 == 0, F.col("p_size")).alias("v"), F.when(k % 2 == 0, F.col("p_type")).alias("w"), k.alias("i"),
    )
    return J.three_feed_merge(rows.where("i % 4 = 0"), rows.where("i % 4 IN (1, 2)"), rows.where("i % 4 = 3"), "url", "g", "n", "i")


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS p, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS s FROM orders), q AS (SELECT * FROM p WHERE o_orderkey % 100 = 0),
    j AS (SELECT q.o_orderkey AS query, x.o_orderkey AS neighbor FROM q JOIN p x ON (q.p IS NULL OR q.p = x.p) AND (q.s IS NULL OR q.s = x.s) AND q.o_orderkey <> x.o_orderkey)
    SELECT query, neighbor, CAST(1.0 AS DOUBLE) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY neighbor) AS r FROM j) WHERE r <= 50""")
def fallback_pool(t):
    """The first fifty rows of the same class, all as near: neighbours for rows without a vector."""
    k = F.col("o_orderkey")
    rows = t("orders").select(k, F.when(k % 7 != 0, F.col("o_orderpriority")).alias("p"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("s"))
    return J.class_pool(rows, rows.where("o_orderkey % 100 = 0"), ["p", "s"], "o_orderkey")


@query("""SELECT doc_id, a.quality AS first_quality, b.quality AS second_quality, a.toxic AS first_toxic, b.toxic AS second_toxic FROM labels a
    JOIN (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 4 <> 0) b USING (doc_id)""")
def labelled_pairs(t):
    """Two annotators' labels of the same documents."""
    k = F.col("doc_id")
    other = t("labels").where("doc_id % 4 <> 0").withColumn("quality", F.when(k % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return J.labelled_pairs(t("labels"), other, "doc_id", ["quality", "toxic"])


@query("""WITH x AS (SELECT p_partkey, p_brand || split_part(p_name, ' ', 2) AS b, p_size, p_partkey % 2 = 0 AS flag FROM part)
    SELECT p_partkey, flag AND b NOT IN (SELECT b FROM x WHERE p_size > 48) AS flag FROM x""")
def sibling_disable(t):
    rows = t("part").withColumn("flag", F.col("p_partkey") % 2 == 0)
    base = F.concat("p_brand", F.element_at(F.split("p_name", " "), 2))
    return J.disable_siblings(rows, base, F.col("p_size") > 48, "flag").select("p_partkey", "flag")


KNN_SQL = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
    s AS (SELECT q.vec_id AS query, p.vec_id AS neighbor, q.label = p.label AS preferred, list_dot_product(q.e, p.e) / (q.n * p.n) AS sim
          FROM u q JOIN u p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0)"""


@query(KNN_SQL + """ SELECT query, neighbor, rank, round(sim, 6) AS similarity FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS INT) AS rank FROM s) WHERE rank <= 10""")
def knn_cosine(t):
    """The ten nearest vectors of every query vector (ids divisible by 100)."""
    v = t("embeddings").select("vec_id", "embedding")
    return J.knn(v.where("vec_id % 100 = 0"), v, key="vec_id", vector="embedding", k=10).withColumn("similarity", F.round("similarity", 6))


#: The same with every vector as a query.
ALL_KNN_SQL = KNN_SQL.replace(" WHERE q.vec_id % 100 = 0", "")


@query(ALL_KNN_SQL + """, m AS (SELECT query, count(*) FILTER (preferred) AS c FROM s GROUP BY query),
    f AS (SELECT s.* FROM s JOIN m USING (query) WHERE preferred OR c < 5)
    SELECT query, neighbor, rank, round(sim, 6) AS similarity FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS INT) AS rank FROM f) WHERE rank <= 10""")
def knn_filtered_fallback(t):
    """Every vector's neighbours with its own label where there are five, else any."""
    v = t("embeddings").select("vec_id", "embedding", "label")
    near = J.knn(v, v, key="vec_id", vector="embedding", k=10, prefer="label", block=16384)
    return near.withColumn("similarity", F.round("similarity", 6))


@query(KNN_SQL + """, o AS (SELECT * FROM s WHERE NOT preferred) SELECT query, neighbor, rank, round(sim, 6) AS similarity FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS INT) AS rank FROM o) WHERE rank <= 10""")
def knn_other_groups(t):
    """The nearest vectors of other labels: the query's own group is left out."""
    v = t("embeddings").select("vec_id", "embedding", "label")
    near = J.knn(v.where("vec_id % 100 = 0"), v, key="vec_id", vector="embedding", k=10, exclude="label")
    return near.withColumn("similarity", F.round("similarity", 6))


@query(KNN_SQL + """, o AS (SELECT * FROM s WHERE NOT preferred), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS rank FROM o),
    p AS (SELECT query, sum(greatest(sim, 0.01) * l.label) / sum(greatest(sim, 0.01)) AS pred FROM r JOIN u l ON l.vec_id = neighbor WHERE rank <= 10 GROUP BY query)
    SELECT query, round(pred, 6) AS pred, label FROM p JOIN u ON query = vec_id""")
def knn_other_groups_eval(t):
    """What the nearest vectors of other labels say of a query's label, by a search that is pruned with pivots."""
    v = t("embeddings").select("vec_id", "embedding", "label")
    near = NB.pruned_knn(v.where("vec_id % 100 = 0"), v, key="vec_id", vector="embedding", k=10, exclude="label", pivots=32)
    w = F.greatest("similarity", F.lit(0.01))
    told = near.join(v.select(F.col("vec_id").alias("neighbor"), F.col("label").alias("l")), "neighbor").groupBy("query").agg((F.sum(w * F.col("l")) / F.sum(w)).alias("pred"))
    return told.join(v.select(F.col("vec_id").alias("query"), "label"), "query").select("query", F.round("pred", 6).alias("pred"), "label")


_VOTE_SQL = """(SELECT query, list(tag ORDER BY worth DESC, tag)[1:5] AS tags FROM (
        SELECT n.query, tag, count(*) / CAST(any_value(c.c) AS DOUBLE) AS share, any_value(base) AS base, count(*) / CAST(any_value(c.c) AS DOUBLE) * ln(1 / greatest(any_value(base), 1e-6)) AS worth
        FROM {0} n JOIN tg ON tg.k = n.neighbor JOIN (SELECT query, count(*) AS c FROM {0} GROUP BY 1) c ON c.query = n.query JOIN rates USING (tag) GROUP BY 1, 2)
        WHERE share >= greatest(0.3, 1.2 * base) GROUP BY query)"""
_NEAR_SQL = "(SELECT query, neighbor, sim FROM (SELECT s.*, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS r FROM s {}) WHERE r <= 10)"


@query(KNN_SQL + f""", it AS (SELECT vec_id AS k, label, CASE WHEN vec_id % 4 <> 0 THEN 1 + label % 5 END AS a, CASE WHEN vec_id % 3 <> 0 THEN 1 + (label * 2) % 5 END AS b FROM embeddings),
    tg AS (SELECT k, unnest(CASE WHEN k % 2 = 0 THEN ['t' || label, 'u' || (label % 3)] ELSE ['t' || label, 'w' || (k % 7)] END) AS tag FROM it WHERE k % 5 < 3),
    rates AS (SELECT tag, count(*) / CAST((SELECT count(DISTINCT k) FROM tg) AS DOUBLE) AS base FROM tg GROUP BY 1),
    near AS {_NEAR_SQL.format("")}, tnear AS {_NEAR_SQL.format("WHERE neighbor IN (SELECT k FROM tg)")},
    w AS (SELECT near.*, greatest(sim, 0.01) AS w, a, b FROM near JOIN it ON k = neighbor),
    st AS (SELECT query, count(*) AS n, CASE WHEN count(a) >= 3 THEN sum(w * a) / sum(w) FILTER (a IS NOT NULL) END AS ma, CASE WHEN count(b) >= 3 THEN sum(w * b) / sum(w) FILTER (b IS NOT NULL) END AS mb,
        sum(w * a * a) / sum(w) FILTER (a IS NOT NULL) AS qa, sum(w * b * b) / sum(w) FILTER (b IS NOT NULL) AS qb FROM w GROUP BY 1),
    sd AS (SELECT *, sqrt(greatest(qa - ma * ma, 0)) AS da, sqrt(greatest(qb - mb * mb, 0)) AS db FROM st), vt AS {_VOTE_SQL.format("near")}, ft AS {_VOTE_SQL.format("tnear")},
    q AS (SELECT vec_id AS query, label, vec_id % 200 = 0 AS said, vec_id % 300 = 0 AS degraded, CASE WHEN vec_id % 400 = 0 THEN 2.5 END AS model FROM embeddings WHERE vec_id % 100 = 0),
    x AS (SELECT q.*, coalesce(n, 0) AS n, ma, mb, da, db, coalesce(vt.tags, []) AS vote, coalesce(ft.tags, []) AS fill, CASE WHEN said THEN ['t' || label, 'u1'] ELSE [] END AS own FROM q LEFT JOIN sd USING (query) LEFT JOIN vt USING (query) LEFT JOIN ft USING (query)),
    y AS (SELECT *, CASE WHEN degraded OR len(vote) >= 2 THEN vote ELSE list_concat(vote, list_filter(fill, lambda z: NOT list_contains(vote, z))[1:2 - len(vote)]) END AS filled FROM x),
    o AS (SELECT *, CASE WHEN said THEN list_concat(own, list_filter(filled, lambda z: NOT list_contains(own, z)))[1:5] ELSE filled END AS shown FROM y),
    pr AS (SELECT a.tag AS a, b.tag AS b, count(*) AS n_ab FROM tg a JOIN tg b ON a.k = b.k AND a.tag <> b.tag GROUP BY 1, 2), c AS (SELECT tag, count(*) AS n FROM tg GROUP BY 1), tot AS (SELECT count(DISTINCT k) AS t FROM tg),
    ru AS (SELECT a, b, n_ab / CAST(ca.n AS DOUBLE) AS share, n_ab / CAST(ca.n AS DOUBLE) / (cb.n / CAST(t AS DOUBLE)) AS lift FROM pr JOIN c ca ON ca.tag = a JOIN c cb ON cb.tag = b, tot WHERE ca.n >= 5 AND n_ab >= 3),
    im AS (SELECT query, b, max(ROW(share, lift)) AS x, any_value(3 - len(shown)) AS room FROM (SELECT query, shown, unnest(own) AS a FROM o WHERE said AND len(shown) < 3) JOIN ru USING (a) WHERE share >= 0.1 AND lift >= 1.0 AND NOT list_contains(shown, b) GROUP BY 1, 2),
    ik AS (SELECT query, list(b ORDER BY r) AS more FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY x DESC, b) AS r FROM im) WHERE r <= room GROUP BY 1),
    z AS (SELECT *, coalesce(more, []) AS implied, CASE WHEN said THEN 5.0 WHEN NOT degraded AND model IS NOT NULL THEN model ELSE round(ma, 2) END AS acidity, CASE WHEN said THEN 1.0 ELSE round(mb, 2) END AS body,
        CASE WHEN degraded OR n < 3 OR (da IS NULL AND db IS NULL) THEN 1 WHEN list_avg(list_filter([da, db], lambda e: e IS NOT NULL)) <= 0.7 THEN 3 WHEN list_avg(list_filter([da, db], lambda e: e IS NOT NULL)) <= 1.2 THEN 2 ELSE 1 END AS lvl FROM o LEFT JOIN ik USING (query))
    SELECT query, CAST(n AS BIGINT) AS n_neighbors, ['low', 'medium', 'high'][least(lvl, 3 - (acidity IS NULL)::INT - (body IS NULL)::INT)] AS confidence, CAST(acidity AS DOUBLE) AS acidity, CAST(body AS DOUBLE) AS body,
        CASE WHEN said THEN 'text' WHEN NOT degraded AND model IS NOT NULL THEN 'model' WHEN ma IS NOT NULL THEN 'neighbours' END AS acidity_from, CASE WHEN said THEN 'text' WHEN mb IS NOT NULL THEN 'neighbours' END AS body_from,
        array_to_string(list_transform(list_concat(shown, implied), lambda e: e || ':' || CASE WHEN list_contains(own, e) THEN 'text' WHEN list_contains(vote, e) THEN 'vote' WHEN list_contains(shown, e) THEN 'fill' ELSE 'implied' END), ',') AS tags FROM z""")
def layered_predictions(t):
    """Attributes and tags of query vectors: neighbours, a model, what a text says, and tags filled up twice."""
    k, label = F.col("vec_id"), F.col("label")
    v = t("embeddings").select(k, "embedding", label, (k % 5 < 3).alias("has"))
    items = v.select(k.alias("neighbor"), F.when(k % 4 != 0, 1 + label % 5).cast("double").alias("acidity"), F.when(k % 3 != 0, 1 + (label * 2) % 5).cast("double").alias("body"))
    word = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    tags = v.where("has").select(k.alias("neighbor"), F.explode(F.array(word("t", label), F.when(k % 2 == 0, word("u", label % 3)).otherwise(word("w", k % 7)))).alias("tag"))
    said = F.when(k % 200 == 0, F.concat(F.lit("bright, thin: notes of "), word("t", label), F.lit(" and u1"))).otherwise("nothing is said")
    queries = v.where("vec_id % 100 = 0").select(k.alias("query"), "embedding", said.alias("text"), F.when(k % 400 == 0, 2.5).alias("model_acidity"), (k % 300 == 0).alias("degraded"))
    asked = queries.select(F.col("query").alias("vec_id"), "embedding")
    near = J.knn(asked, v.select("vec_id", "embedding"), key="vec_id", vector="embedding", k=10)
    tagged = J.knn(asked, v.where("has").select("vec_id", "embedding"), key="vec_id", vector="embedding", k=10)
    total = tags.agg(F.countDistinct("neighbor").alias("total"))
    rules = A.association_rules(A.cooccurrence(tags, "neighbor", "tag").crossJoin(F.broadcast(total)), F.col("total"), share=0.1, lift=1.0).select("a", "b", "share", "lift")
    tagger = D.AsWritten({**{f"t{i}": f"t{i}" for i in range(10)}, "u1": "u1"})
    told = P.predict(
        queries.drop("embedding"), near, tagged, items, tags, A.base_rates(tags, "neighbor", "tag"), rules, ["acidity", "body"],
        {"acidity": (r"\bbright\b", r"\bflat\b"), "body": (r"\bfull body\b", r"\bthin\b")}, tagger, F.col("degraded"), target=3,
    )
    return told.withColumn("tags", F.array_join(F.transform("tags", lambda x: F.concat_ws(":", x["tag"], x["origin"])), ","))


JACCARD_SQL = """x AS (SELECT p_partkey AS k, p_brand AS g, p_retailprice, list_distinct(list_concat(string_split(p_name, ' '), [p_type])) AS f FROM part),
    s AS (SELECT a.k AS query, b.k AS neighbor, len(list_intersect(a.f, b.f)) / CAST(len(a.f) + len(b.f) - len(list_intersect(a.f, b.f)) AS DOUBLE) AS sim
          FROM x a JOIN x b ON a.g <> b.g),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS INT) AS rank FROM s WHERE sim > 0)"""


def _jaccard(t):
    f = F.concat(F.split("p_name", " "), F.array("p_type"))
    return J.jaccard_neighbors(t("part").select("p_partkey", "p_brand", "p_name", "p_type"), "p_partkey", "p_brand", f, 5)


@query(f"WITH {JACCARD_SQL} SELECT query, neighbor, rank, round(sim, 6) AS similarity FROM r WHERE rank <= 5")
def knn_jaccard(t):
    """The five parts of other brands with the most shared words."""
    return _jaccard(t).withColumn("similarity", F.round("similarity", 6))


@query("""WITH b AS (SELECT l_orderkey AS k, o_custkey % 7 AS g, list_distinct(list('p' || l_partkey) || list('f' || l_returnflag) || list('s' || l_linestatus)) AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
    i AS (SELECT k, g, len(f) AS n, unnest(f) AS x FROM b), c AS (SELECT q.k AS query, t.k AS neighbor, count(*) / CAST(any_value(q.n) + any_value(t.n) - count(*) AS DOUBLE) AS sim FROM i q JOIN i t ON q.x = t.x AND q.g <> t.g WHERE q.k % 100 = 0 GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS INT) AS rank FROM c) SELECT query, neighbor, rank, round(sim, 6) AS similarity FROM r WHERE rank <= 3""")
def knn_baskets(t):
    """The three most similar baskets of other customers' groups, for every hundredth order; flags are in half of all baskets."""
    lines = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7).alias("g")), "l_orderkey")
    words = F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("f"), "l_returnflag"), F.concat(F.lit("s"), "l_linestatus"))
    baskets = lines.groupBy("l_orderkey", "g").agg(F.array_distinct(F.flatten(F.collect_list(words))).alias("f"))
    near = J.jaccard_neighbors(baskets, "l_orderkey", "g", F.col("f"), 3, few=0, asks=F.col("l_orderkey") % 100 == 0)
    return near.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {JACCARD_SQL}, p AS (SELECT query, avg(p_retailprice) AS pred, stddev_pop(p_retailprice) AS sd, count(*) AS n FROM r JOIN x ON neighbor = x.k WHERE rank <= 5 GROUP BY query),
    tot AS (SELECT sum(p_retailprice) AS s, count(*) AS n FROM x), grp AS (SELECT g, sum(p_retailprice) AS s, count(*) AS n FROM x GROUP BY g)
    SELECT CASE WHEN sd <= 20 THEN 'high' WHEN sd <= 30 THEN 'medium' ELSE 'low' END AS level, CAST(count(*) AS BIGINT) AS n, round(avg(abs(pred - p_retailprice)), 4) AS mae,
           round(avg(abs((tot.s - grp.s) / (tot.n - grp.n) - p_retailprice)), 4) AS mean_mae
    FROM p JOIN x ON p.query = x.k JOIN grp ON grp.g = x.g, tot WHERE p.n >= 3 GROUP BY 1""")
def jaccard_knn_eval(t):
    """Neighbours' mean price against the mean of other brands, by the neighbours' spread."""
    part = t("part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("g"), F.col("p_retailprice").alias("v"))
    near = _jaccard(t).join(part.select(F.col("k").alias("neighbor"), F.col("v").alias("nv")), "neighbor")
    pred = near.groupBy(F.col("query").alias("k")).agg(F.avg("nv").alias("pred"), F.stddev_pop("nv").alias("sd"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    groups = part.groupBy("g").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("c"))
    everything = groups.agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    means = groups.crossJoin(F.broadcast(everything)).select("g", ((F.col("ts") - F.col("s")) / (F.col("tc") - F.col("c"))).alias("lgo"))
    rows = pred.join(part, "k").join(means, "g")
    level = F.when(F.col("sd") <= 20, "high").when(F.col("sd") <= 30, "medium").otherwise("low")
    return rows.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("v"))), 4).alias("mae"), F.round(F.avg(F.abs(F.col("lgo") - F.col("v"))), 4).alias("mean_mae")
    )


@query(KNN_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS rank FROM s),
    p AS (SELECT query, sum(greatest(sim, 0.01) * l.label) / sum(greatest(sim, 0.01)) AS pred FROM r JOIN u l ON l.vec_id = neighbor WHERE rank <= 10 GROUP BY query)
    SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(floor(pred + 0.5) = label AS INT)), 6) AS exact, round(avg(CAST(abs(pred - label) <= 1 AS INT)), 6) AS within_1, round(avg(abs(pred - label)), 4) AS mae
    FROM p JOIN u ON query = vec_id""")
def loo_knn_eval(t):
    """Leave-one-out evaluation of the neighbours' weighted mean as a prediction of the label."""
    v = t("embeddings").select("vec_id", "embedding", "label")
    near = J.knn(v.where("vec_id % 100 = 0"), v.drop("label"), key="vec_id", vector="embedding", k=10)
    labels = v.select("vec_id", "label")
    w = F.greatest("similarity", F.lit(0.01))
    pred = near.join(labels.withColumnRenamed("vec_id", "neighbor"), "neighbor").groupBy(F.col("query").alias("vec_id")).agg((F.sum(w * F.col("label")) / F.sum(w)).alias("pred"))
    rows = pred.join(labels, "vec_id")
    err = F.abs(F.col("pred") - F.col("label"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.floor(F.col("pred") + 0.5) == F.col("label")).cast("int")), 6).alias("exact"),
        F.round(F.avg((err <= 1).cast("int")), 6).alias("within_1"), F.round(F.avg(err), 4).alias("mae"),
    )


@query(KNN_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS rank FROM s),
    j AS (SELECT query, greatest(sim, 0.01) AS w, l.label AS v FROM r JOIN u l ON l.vec_id = neighbor WHERE rank <= 10),
    m AS (SELECT query, sum(w * v) / sum(w) AS mean FROM j GROUP BY query)
    SELECT query, CAST(count(*) AS BIGINT) AS n, round(any_value(mean), 6) AS mean, round(sqrt(sum(w * (v - mean) * (v - mean)) / sum(w)), 6) AS std FROM j JOIN m USING (query) GROUP BY query""")
def weighted_neighbor_stats(t):
    """Similarity-weighted mean and deviation of the neighbours' labels."""
    v = t("embeddings").select("vec_id", "embedding", "label")
    near = J.knn(v.where("vec_id % 100 = 0"), v.drop("label"), key="vec_id", vector="embedding", k=10)
    rows = near.join(v.select(F.col("vec_id").alias("neighbor"), F.col("label").cast("double").alias("v")), "neighbor")
    n = rows.groupBy("query").agg(F.count("*").alias("n"))
    stats = A.weighted_stats(rows, "query", "similarity", ["v"]).join(n, "query")
    return stats.select("query", "n", F.round("v", 6).alias("mean"), F.round("v_std", 6).alias("std"))


@query(KNN_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS rank FROM s)
    SELECT query, round(coalesce(sum(CASE WHEN neighbor % 3 <> 0 THEN greatest(sim, 0.01) END), 0), 6) AS support FROM r WHERE rank <= 10 GROUP BY query""")
def neighbor_support(t):
    """How much similarity stands behind a value: the neighbours that have one."""
    v = t("embeddings").select("vec_id", "embedding")
    near = J.knn(v.where("vec_id % 100 = 0"), v, key="vec_id", vector="embedding", k=10)
    rows = near.withColumn("v", F.when(F.col("neighbor") % 3 != 0, 1))
    return A.weighted_support(rows, ["query"], "similarity", "v").withColumn("support", F.round("support", 6))


@query(KNN_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS rank FROM s), l AS (SELECT vec_id, CAST(label AS DOUBLE) AS a, CASE WHEN vec_id % 3 <> 0 THEN label * 2.0 END AS b FROM u),
    j AS (SELECT query, greatest(sim, 0.01) AS w, a, b FROM r JOIN l ON l.vec_id = neighbor WHERE rank <= 10),
    m AS (SELECT query, count(a) >= 3 AS ea, count(b) >= 3 AS eb, sum(w * a) / sum(CASE WHEN a IS NOT NULL THEN w END) AS ma, sum(w * b) / sum(CASE WHEN b IS NOT NULL THEN w END) AS mb FROM j GROUP BY query),
    d AS (SELECT query, any_value(ea) AS ea, any_value(eb) AS eb, sqrt(sum(w * (a - ma) * (a - ma)) / sum(CASE WHEN a IS NOT NULL THEN w END)) AS sa, sqrt(sum(w * (b - mb) * (b - mb)) / sum(CASE WHEN b IS NOT NULL THEN w END)) AS sb FROM j JOIN m USING (query) GROUP BY query),
    k AS (SELECT query, list_avg(list_filter([CASE WHEN ea THEN sa END, CASE WHEN eb THEN sb END], lambda x: x IS NOT NULL)) AS spread FROM d)
    SELECT query, CASE WHEN spread <= 0.7 THEN 'high' WHEN spread <= 1.2 THEN 'medium' ELSE 'low' END AS confidence FROM k""")
def neighbor_confidence(t):
    """A confidence from how far the neighbours' values spread."""
    v = t("embeddings").select("vec_id", "embedding", "label")
    near = J.knn(v.where("vec_id % 100 = 0"), v.drop("label"), key="vec_id", vector="embedding", k=10)
    labels = v.select(F.col("vec_id").alias("neighbor"), F.col("label").cast("double").alias("a"), F.when(F.col("vec_id") % 3 != 0, F.col("label") * 2.0).alias("b"))
    return A.weighted_stats(near.join(labels, "neighbor"), "query", "similarity", ["a", "b"]).select("query", "confidence")
