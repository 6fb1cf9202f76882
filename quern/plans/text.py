"""Queries: text jobs, linear models, folds, logs."""

from pyspark.sql import functions as F

from .. import sources as S
from ..functions import text as T
from ..operators import aggregates as A, dictionary as D, learning as L, profiles as PR, ranking as R, tagger as G
from ..streaming import parsed_logs
from .base import Registry, planted, planted_sql

registry = Registry()
query = registry.add



VOCABULARY = [("hot", "warm"), ("red", "warm"), ("cold", "cool"), ("blue", "cool"), ("bolt", "metal"), ("gear", "metal"), ("old", "aged")]
_VOCABULARY_SQL = "v AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in VOCABULARY) + ") AS v(term, tag))"


def _table(t, rows, schema):
    return t("part").sparkSession.createDataFrame(rows, schema)


@query(f"""WITH {_VOCABULARY_SQL}, c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', 'ish, ') WHEN 2 THEN p_name || '. prose' ELSE p_name || 's / Cold|red' END AS t FROM part),
    w AS (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(t, '[ ,/|]+'), lambda x: x <> '')) AS w, unnest(range(len(list_filter(regexp_split_to_array(t, '[ ,/|]+'), lambda x: x <> '')))) AS i FROM c WHERE t NOT LIKE '%.%'),
    h AS (SELECT p_partkey, i, tag FROM w JOIN v ON term = CASE WHEN w IN (SELECT term FROM v) THEN w ELSE regexp_replace(w, '(ish|s)$', '') END WHERE term <> 'old'),
    f AS (SELECT p_partkey, tag, min(i) AS i FROM h GROUP BY 1, 2) SELECT p_partkey, string_agg(tag, ',' ORDER BY i) AS tags FROM f GROUP BY 1""")
def token_tagger(t):
    """Vocabulary words that are whole tokens of short cards, endings aside."""
    k, name = F.col("p_partkey"), F.col("p_name")
    card = F.when(k % 4 == 0, name).when(k % 4 == 1, F.replace(name, F.lit(" "), F.lit("ish, "))).when(k % 4 == 2, F.concat(name, F.lit(". prose"))).otherwise(F.concat(name, F.lit("s / Cold|red")))
    found = G.card_tags(t("part").select("p_partkey", card.alias("t")), "p_partkey", "t", _table(t, VOCABULARY, "term string, tag string"), ["ish", "s"], ["old"])
    return found.select("p_partkey", F.array_join("tags", ",").alias("tags"))


PROSE = {"the": "t1", "there": "t2", "re": "t3", "er": "t4", "with": "t5", "and": "t6", "erand": "t7"}


@query("""WITH v AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in PROSE.items()) + """) AS v(term, tag)), p AS (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS s FROM benchmark),
    h AS (SELECT item_id, s, s + length(term) AS e, tag FROM p JOIN v ON substr(text, s, length(term)) = term),
    k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.item_id = h.item_id AND o.s <= h.s AND h.e <= o.e AND (o.s < h.s OR h.e < o.e))), f AS (SELECT item_id, tag, min(s) AS s FROM k GROUP BY 1, 2)
    SELECT b.item_id, coalesce(string_agg(tag, ',' ORDER BY s), '') AS tags FROM benchmark b LEFT JOIN f ON f.item_id = b.item_id GROUP BY 1""")
def prose_tagger(t):
    """Vocabulary words as written, of hits that lie in one another the longest."""
    return D.tag_text(t("benchmark"), "item_id", "text", D.AsWritten(PROSE)).select("item_id", F.array_join("tags", ",").alias("tags"))


@query("""WITH g AS (SELECT p_partkey, p_size % 6 AS filled, CASE WHEN p_size % 6 < 5 AND p_partkey % 2 = 0 THEN 1 ELSE 0 END AS half, p_partkey % 3 AS form, p_size / 10.0 AS num FROM part)
    SELECT p_partkey, CASE WHEN form = 0 THEN round(least(5.0, greatest(1.0, filled + half * 0.5)), 2) END AS acidity_dots, CASE WHEN form = 1 THEN round(least(5.0, greatest(1.0, num)), 2) END AS body_number FROM g""")
def gauge_patterns(t):
    """Readings of five dots and of numbers from 0 to 5; a run of six dots is none."""
    n, k = (F.col("p_size") % 6).cast("int"), F.col("p_partkey")
    half = F.when((n < 5) & (k % 2 == 0), 1).otherwise(0)
    dots = F.concat(F.repeat(F.lit("●"), n), F.repeat(F.lit("◐"), half), F.repeat(F.lit("○"), 5 - n - half))
    number = F.format_number(F.col("p_size") / 10, 1)
    text = F.when(k % 3 == 0, F.concat(F.lit("Body ●●●●●● x 산미 Acidity: "), dots)).when(k % 3 == 1, F.concat(F.lit("바디감 "), number, F.lit("│단맛 9"))).otherwise("none")
    by_dots, by_number = G.gauges(text, {"acidity": "산미|신맛|acidity", "body": "바디감|바디|body", "sweetness": "단맛|sweetness"})
    return t("part").select("p_partkey", G.gauge_value(by_dots["acidity"]).alias("acidity_dots"), G.gauge_value(by_number["body"]).alias("body_number"))


@query("""WITH x AS (SELECT p_partkey, p_size * 2 AS score, p_partkey % 5 AS form, p_name FROM part)
    SELECT p_partkey, form <> 1 AS words_ok, form <> 2 AS length_ok, form <> 3 AS numbers_ok, form <> 4 OR false AS condition_ok,
        NOT (form = 0 AND score < 40) AS polarity_ok FROM x""")
def text_constraints(t):
    """Generated sentences against what they were made from; the SQL states which of five forms breaks which rule."""
    k, score = F.col("p_partkey"), F.col("p_size") * 2
    form = F.pmod(k, F.lit(5))
    base = F.concat(F.lit("Good "), F.col("p_name"), F.lit(" of 1,500 at "), score.cast("string"), F.lit("."))
    text = (
        F.when(form == 0, base).when(form == 1, F.concat(F.lit("Fine excellent "), F.col("p_name"), F.lit("."))).when(form == 2, F.repeat(F.lit("of. "), 80))
        .when(form == 3, F.concat(F.col("p_name"), F.lit(" of 77777."))).otherwise(F.concat(F.col("p_name"), F.lit(" at.")))
    )
    words = F.concat(F.split("p_name", " "), F.array(*[F.lit(x) for x in ("good", "of", "at", "fine")]))
    needed = F.when(form == 4, F.array(F.lit("milk"))).otherwise(F.array().cast("array<string>"))
    checks = G.explanation_checks(text, F.array(F.lit(1500.0)), words, needed, score, "Good", "Bad")
    return t("part").select("p_partkey", *[c.alias(f"{n}_ok") for n, c in checks.items()])


_PUSHES = [("warm", "acidity", -0.4), ("cool", "acidity", 0.8), ("cool>blue", "acidity", 1.0), ("metal", "body", 0.7), ("metal>bolt", "body", 0.2)]


@query(f"""WITH {_VOCABULARY_SQL}, p AS (SELECT * FROM (VALUES {", ".join(map(str, _PUSHES))}) AS p(node, attribute, push)), w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part),
    h AS (SELECT p_partkey, term, a.attribute, coalesce((SELECT push FROM p WHERE node = tag || '>' || term AND p.attribute = a.attribute), (SELECT push FROM p WHERE node = tag AND p.attribute = a.attribute)) AS push FROM w JOIN v USING (term), (SELECT DISTINCT attribute FROM p) a),
    m AS (SELECT p_partkey, attribute, avg(push) AS m FROM h WHERE push IS NOT NULL GROUP BY 1, 2),
    x AS (SELECT p_partkey, 'acidity' AS attribute, CASE WHEN p_name LIKE '%ring%' THEN 0.6 ELSE 0 END + CASE WHEN p_name LIKE '%small%' THEN -0.6 ELSE 0 END AS t FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE '%small%'),
    b AS (SELECT coalesce(m.p_partkey, x.p_partkey) AS p_partkey, coalesce(m.attribute, x.attribute) AS attribute, m, t FROM m FULL JOIN x ON m.p_partkey = x.p_partkey AND m.attribute = x.attribute)
    SELECT p_partkey, attribute, round(least(5.0, greatest(1.0, 3 + 2 * coalesce(m, 0) + coalesce(t, 0))), 2) AS label FROM b WHERE m IS NOT NULL OR t <> 0""")
def weak_labels(t):
    """Weak labels from tags, by the place of each in a taxonomy, and from the wording."""
    tags = t("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("tag")).distinct()
    paths = _table(t, [(a, f"{b}>{a}") for a, b in VOCABULARY], "tag string, head string")
    pushes = _table(t, _PUSHES, "node string, attribute string, push double")
    return G.weak_labels(t("part"), "p_partkey", "p_name", tags, paths, pushes, [("acidity", "ring", 0.6), ("acidity", "small", -0.6)])


@query("""WITH c AS (SELECT p_partkey, p_type AS tag FROM part UNION ALL SELECT p_partkey, split_part(p_name, ' ', 1) FROM part), k AS (SELECT * FROM (VALUES ('small', 'body', 2.0), ('large', 'body', 4.5), ('hot', 'body', 4.5), ('red', 'sweet', 4.0)) AS k(tag, attribute, value)),
    m AS (SELECT p_partkey, attribute, min(value) AS value FROM c JOIN k ON lower(c.tag) = k.tag GROUP BY 1, 2 HAVING count(DISTINCT value) = 1), l AS (SELECT p_partkey, 'body' AS attribute, p_size / 10.0 AS value FROM part WHERE p_size % 2 = 0)
    SELECT p_partkey, attribute, round(avg(value), 2) AS label FROM (SELECT * FROM m UNION ALL SELECT * FROM l) GROUP BY 1, 2""")
def intensity_labels(t):
    """Labels of stores' own tags, where these agree, averaged with labelled lines."""
    tags = t("part").select("p_partkey", F.explode(F.array("p_type", F.element_at(F.split("p_name", " "), 1))).alias("tag"))
    config = _table(t, [("Small", "body", 2.0), ("LARGE", "body", 4.5), ("hot", "body", 4.5), ("red", "sweet", 4.0)], "tag string, attribute string, value double")
    lines = t("part").where("p_size % 2 = 0").select("p_partkey", F.lit("body").alias("attribute"), (F.col("p_size") / 10).alias("value"))
    return G.averaged_labels(tags, "p_partkey", config, lines)


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%hot%' AND p_name LIKE '%bolt%' THEN 3.5 WHEN p_name LIKE '%hot%' THEN 5.0 WHEN p_name LIKE '%bolt%' THEN 2.0 END AS value,
    CASE WHEN p_name = 'hot bolt' THEN 4.0 WHEN p_name LIKE '%hot%' THEN 5.0 WHEN p_name LIKE '%bolt%' THEN 2.0 END AS phrase FROM part""")
def lexicon_values(t):
    """Mean values of a lexicon's words, and of its phrases before them."""
    words = {"hot": 5.0, "bolt": 2.0}
    one = G.score_text(t("part"), "p_partkey", "p_name", lambda x: G.lexicon_mean(x, words)).withColumnRenamed("score", "value")
    two = G.score_text(t("part"), "p_partkey", "p_name", lambda x: G.lexicon_mean(x, words, {"hot bolt": 4.0})).withColumnRenamed("score", "phrase")
    return one.join(two, "p_partkey")


@query("""WITH x AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(text), '(with|from|this)', 1)) AS a, list_distinct(regexp_extract_all(lower(text), '(with|from|avec|von)', 1)) AS b FROM documents)
    SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (list_sort(a) <> list_sort(b)) AS BIGINT) AS changed, CAST(sum(len(list_filter(b, lambda v: NOT list_contains(a, v)))) AS BIGINT) AS gained, CAST(sum(len(list_filter(a, lambda v: NOT list_contains(b, v)))) AS BIGINT) AS lost FROM x GROUP BY lang""")
def before_after_diff(t):
    """What another vocabulary adds and loses, by language."""
    tags = lambda p: F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({p})"), F.lit(1)))
    return G.tag_changes(t("documents"), ["lang"], tags("with|from|this"), tags("with|from|avec|von"))


@query("""WITH g AS (SELECT p_type, count(*) AS n, count(*) FILTER (p_name LIKE '%hot%') AS base, count(*) FILTER (p_name LIKE '%hot%' OR p_name LIKE '%bolt%') AS wider, row_number() OVER (ORDER BY p_type) - 1 AS i FROM part GROUP BY 1),
    x AS (SELECT w.h, sum(base) / CAST(sum(n) AS DOUBLE) AS base, sum(wider) / CAST(sum(n) AS DOUBLE) AS wider FROM g, (SELECT unnest(range(64)) AS h) w WHERE bit_count(w.h) = 3 AND (w.h >> i) & 1 = 0 GROUP BY w.h)
    SELECT CAST(count(*) AS BIGINT) AS splits, round(avg(base), 6) AS base_mean, round(avg(wider), 6) AS wider_mean, round(quantile_cont(base, 0.05), 6) AS base_p5, round(quantile_cont(base, 0.95), 6) AS base_p95,
        round(quantile_cont(wider, 0.05), 6) AS wider_p5, round(quantile_cont(wider, 0.95), 6) AS wider_p95 FROM x""")
def group_halves(t):
    """Readable shares over all ways to leave half of the groups out."""
    hot, bolt = F.col("p_name").contains("hot"), F.col("p_name").contains("bolt")
    counts = t("part").groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(hot).alias("hot"), F.count_if(hot | bolt).alias("any"))
    out = G.half_splits(counts, "n", {"base": "hot", "wider": "any"})
    return out.select("splits", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("""WITH x AS (SELECT page_id FROM pages) SELECT page_id, 'product.name' AS field, 'Item & ' || page_id AS value FROM x UNION ALL SELECT page_id, 'product.price', CAST(page_id * 3 AS VARCHAR) FROM x WHERE page_id % 3 <> 1
    UNION ALL SELECT page_id, 'origin', 'Kenya ' || page_id FROM x UNION ALL SELECT page_id, 'roastlevel', 'light' FROM x WHERE page_id % 2 = 0""")
def product_facts(t):
    """Products of JSON-LD blocks and labelled cells, put in front of each page."""
    k = F.col("page_id").cast("string")
    plain = F.concat(F.lit('{"@type": "Product", "name": "Item &amp;<br/> '), k, F.lit('", "offers": {"price": '), (F.col("page_id") * 3).cast("string"), F.lit("}}"))
    group = F.concat(F.lit('{"@type": "ProductGroup", "name": "Item & '), k, F.lit('", "hasVariant": [{"offers": {"price": '), (F.col("page_id") * 3).cast("string"), F.lit("}}]}"))
    bare = F.concat(F.lit('{"@type": "Product", "name": "Item & '), k, F.lit('"}'))
    block = F.when(F.col("page_id") % 3 == 0, plain).when(F.col("page_id") % 3 == 1, bare).otherwise(group)
    cells = F.concat(F.lit("<table><tr><th>Ori gin</th><td>Kenya "), k, F.lit("</td></tr><tr><th>Origin<td>other</table>"), F.when(F.col("page_id") % 2 == 0, "<dl><dt>Roast level<dd> light </dl>").otherwise(""))
    page = F.concat(F.lit("<script type='application/ld+json'>not json</script><script type='application/ld+json'>"), block, F.lit("</script>"), cells, F.coalesce("html", F.lit("")))
    facts = S.page_facts(t("pages").select("page_id", page.alias("html")), "page_id", "html")
    return facts.where(F.col("field").isin("product.name", "product.price", "origin", "roastlevel"))


@query("""SELECT p_partkey, 'region' AS field, 'Nyeri ' || p_size AS value FROM part UNION ALL SELECT p_partkey, 'process', p_name FROM part WHERE p_partkey % 2 = 0""")
def labelled_runs(t):
    """Runs of label and value in flowing text, each ending at the next label."""
    text = F.concat(F.lit("Sold by x. 지역 Region : Nyeri "), F.col("p_size").cast("string"), F.lit(" 품종 SL28 "), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("가공 : "), F.col("p_name"), F.lit(" 배송 free 지역: other"))).otherwise("가공 :"))
    return S.text_runs(t("part").select("p_partkey", text.alias("t")), "p_partkey", "t", {"지역": "region", "가공": "process"}, ("품종", "배송"))


@query(None)
def page_facts(t):
    """Label-value facts of every page."""
    return S.page_facts(t("pages"), "page_id", "html")


@query("""SELECT p_partkey, round(0.02 * p_size - 0.5 * CAST(p_type = 'SMALL' AS INT) + 0.3 * CAST(p_type = 'PROMO' AS INT), 6) AS score,
    array_to_string(list_transform(list_sort(list_filter([{a: -abs(0.02 * p_size), n: 'size'}, {a: -abs(0.5 * CAST(p_type = 'SMALL' AS INT)), n: 'small'}, {a: -abs(0.3 * CAST(p_type = 'PROMO' AS INT)), n: 'promo'}], lambda x: x.a <= -0.05)), lambda x: x.n), ',') AS top FROM part""")
def linear_contributions(t):
    """A linear score and what contributes most to it."""
    features = {"size": F.col("p_size").cast("double"), "small": (F.col("p_type") == "SMALL").cast("double"), "promo": (F.col("p_type") == "PROMO").cast("double")}
    score, top = L.contributions({"size": 0.02, "small": -0.5, "promo": 0.3}, features, 0.05, 3)
    return t("part").select("p_partkey", F.round(score, 6).alias("score"), F.array_join(top, ",").alias("top"))


REGIONS = {"north": ["Brand#1", "Brand#2", "Brand#3"], "south": ["Brand#4", "Brand#5"], "east": ["Brand#6", "Brand#7", "Brand#8", "Brand#9"]}
BRANDS = ["Brand#1", "Brand#4", "Brand#6", "Brand#7", "Brand#9"]
SIZES = {"size_lt12": (0, 12), "size_12_16": (12, 16), "size_16_20": (16, 20), "size_ge20": (20, 10_000)}
TYPES = ["SMALL", "MEDIUM", "LARGE", "PROMO"]
NOTE_KINDS = ["warm", "cool", "metal", "aged", "none"]


def _features():
    """Name -> column of an item's features: places, sizes, kinds, wording, note categories, the neighbours' value."""
    brand, size, kind, name, k = F.col("p_brand"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_size")), F.col("p_type"), F.col("p_name"), F.col("p_partkey")
    region = F.lit(None).cast("string")
    for r, brands in REGIONS.items():
        region = F.when(brand.isin(brands), r).otherwise(region)
    kinds = F.create_map(*[F.lit(x) for kv in VOCABULARY for x in kv])
    notes = F.transform(F.split(F.concat_ws(" ", name, name, name), " "), lambda w: F.coalesce(F.try_element_at(kinds, w), F.lit("none")))
    one = lambda c: c.cast("double")
    return (
        L.indicators(region, list(REGIONS), "region_") | {"elsewhere": one(region.isNull())} | L.indicators(brand, BRANDS, "brand_") | L.bands(size, SIZES)
        | L.indicators(kind, TYPES, "type_") | {"word_ring": one(name.rlike(r"(?i)\bring\b")), "word_hot_cold": one(name.rlike(r"(?i)\b(hot|cold)\b")), "decaf": one(kind == "SMALL")}
        | {"decaf_water": one((kind == "SMALL") & (k % 2 == 0)), "decaf_other": one((kind == "SMALL") & (k % 4 == 1))} | L.capped_counts(notes, NOTE_KINDS, "notes_", 2)
        | {"nbr": L.centred(F.when(k % 5 != 0, F.col("p_size") / 10))}
    )


def _features_sql() -> dict[str, str]:
    size = "CASE WHEN p_partkey % 6 <> 0 THEN p_size END"
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    out = {f"region_{r}": f"p_brand IN ({listed(b)})" for r, b in REGIONS.items()}
    out["elsewhere"] = f"p_brand NOT IN ({listed([x for b in REGIONS.values() for x in b])})"
    out |= {f"brand_{b}": f"p_brand = '{b}'" for b in BRANDS} | {n: f"coalesce({size} >= {a} AND {size} < {b}, false)" for n, (a, b) in SIZES.items()}
    out |= {f"type_{x}": f"p_type = '{x}'" for x in TYPES} | {"word_ring": "p_name LIKE '%ring%'", "word_hot_cold": "regexp_matches(p_name, '\\b(hot|cold)\\b')", "decaf": "p_type = 'SMALL'"}
    out |= {"decaf_water": "p_type = 'SMALL' AND p_partkey % 2 = 0", "decaf_other": "p_type = 'SMALL' AND p_partkey % 4 = 1"}
    out = {k: f"CAST({v} AS INT)" for k, v in out.items()}
    for kind in NOTE_KINDS:
        words = [a for a, b in VOCABULARY if b == kind]
        test = f"x IN ({listed(words)})" if words else f"x NOT IN ({listed([a for a, _ in VOCABULARY])})"
        out[f"notes_{kind}"] = f"least(2, 3 * len(list_filter(string_split(p_name, ' '), lambda x: {test})))"
    return out | {"nbr": "CASE WHEN p_partkey % 5 <> 0 THEN round(p_size / 10.0 - 3, 4) ELSE 0 END"}


@query("SELECT p_partkey, " + ", ".join(f'CAST({v} AS DOUBLE) AS "{k}"' for k, v in _features_sql().items()) + " FROM part")
def feature_encoding(t):
    """Interpretable features of an item, one column each."""
    return t("part").select("p_partkey", *[c.alias(n) for n, c in _features().items()])


@query("""SELECT vec_id, round(least(5.0, greatest(1.0, 3 + list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * (i % 9 - 4) / 4)))), 6) AS score FROM embeddings""")
def batch_linear_score(t):
    """A dot product with fixed weights over the whole vector, cut off at the scale's ends."""
    terms = F.transform("embedding", lambda x, i: x.cast("double") * ((i + 1) % 9 - 4) / 4)
    score = 3 + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return t("embeddings").select("vec_id", F.round(L.clamp(score, 1.0, 5.0), 6).alias("score"))


_CELLS = [("1", "1", "1"), ("1", "l_quantity", "l_quantity"), ("1", "l_discount", "l_discount"), ("1", "y", "l_tax"), ("l_quantity", "l_quantity", "l_quantity * l_quantity"), ("l_quantity", "l_discount", "l_quantity * l_discount"),
          ("l_quantity", "y", "l_quantity * l_tax"), ("l_discount", "l_discount", "l_discount * l_discount"), ("l_discount", "y", "l_discount * l_tax"), ("y", "y", "l_tax * l_tax")]


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{i}' AS i, '{j}' AS j, round(sum(CAST({e} AS DOUBLE)), 3) AS s FROM lineitem GROUP BY l_returnflag" for i, j, e in _CELLS))
def ridge_gram(t):
    """The Gram matrices of a linear model by group."""
    return L.gram(t("lineitem"), ["l_quantity", "l_discount"], "l_tax", "l_returnflag").withColumn("s", F.round("s", 3))


@query("""WITH s AS (SELECT c_mktsegment, c_nationkey, sum(c_acctbal) AS s, count(*) AS n FROM customer GROUP BY 1, 2)
    SELECT c_mktsegment, c_nationkey, round((sum(s) OVER w - s) / (sum(n) OVER w - n), 4) AS others_mean FROM s WINDOW w AS (PARTITION BY c_mktsegment)""")
def leave_group_out_mean(t):
    return L.others_mean(t("customer"), ["c_nationkey"], ["c_mktsegment"], "c_acctbal").withColumn("others_mean", F.round("others_mean", 4))


@query("SELECT c_nationkey, round(sum(c_acctbal - 4500) / (count(*) + 10), 4) AS \"offset\" FROM customer GROUP BY 1")
def shrunken_group_offsets(t):
    return L.group_offsets(t("customer"), "c_nationkey", F.col("c_acctbal") - 4500, 10.0).withColumn("offset", F.round("offset", 4))


_PULL = "(r - 3) / 2"
_STEP = f"""least(5.0, greatest(1.0, CASE WHEN {{v}} IS NULL OR r = 3 THEN {{p}} WHEN r > 3 THEN {{p}} + {_PULL} * ({{v}} - {{p}}) / (f.i + 2)
    ELSE {{p}} + {_PULL} * sign({{v}} - {{p}}) * greatest(0, 1 - abs({{v}} - {{p}}) / 2) / (f.i + 2) END))"""


@query(f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CAST(1 + event_id % 5 AS DOUBLE) AS r, 1 + least(value, 80) / 20 AS v, CASE WHEN event_id % 4 <> 0 THEN CAST(1 + event_id % 5 AS DOUBLE) END AS b,
        CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.5 END AS share, CASE WHEN event_id % 17 = 0 THEN -0.5 WHEN event_id % 19 = 0 THEN 0.5 ELSE 0 END AS said, CASE WHEN event_id % 23 = 0 THEN 0.3 ELSE 0 END AS liked, CASE WHEN event_id % 29 = 0 THEN -0.3 ELSE 0 END AS disliked FROM events),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(3.0 AS DOUBLE) AS p, CAST(3.0 AS DOUBLE) AS q, CAST(0.0 AS DOUBLE) AS w, CAST(0 AS BIGINT) AS moved FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT user_id, i + 1, p2, q2, w2, moved + CAST(abs(p2 - p) >= 0.05 AS INT) + CAST(abs(q2 - q) >= 0.05 AS INT) + CAST(abs(w2 - w) >= 0.05 AS INT) FROM (
        SELECT f.*, least(5.0, greatest(1.0, {_STEP.format(p="p", v="v")} + said)) AS p2, {_STEP.format(p="q", v="b")} AS q2,
            least(1.0, greatest(-1.0, least(1.0, greatest(-1.0, least(1.0, greatest(-1.0, w + {_PULL} * share / (f.i + 2))) + liked)) + disliked)) AS w2 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
    SELECT user_id, max(i) AS events, round(arg_max(p, i), 6) AS acidity, round(arg_max(q, i), 6) AS body, round(arg_max(w, i), 6) AS fruity, CAST(max(moved) AS BIGINT) AS changes FROM f GROUP BY user_id""")
def profile_fold(t):
    """Each user's profile after all rated events, in order: two attributes, a category, and how many changes were told."""
    h = PR.history(_rated(t), "user_id", ["ts", "event_id"], ["acidity", "body"])
    last = h.groupBy("user_id").agg(F.max("n").alias("events"), F.max_by(F.struct("wants", "likes"), "n").alias("p"), F.sum(F.size("changes")).alias("changes"))
    # to whole millionths: rounding the decimals that a number is written with goes another way where it lies on a half
    rounded = lambda x: F.round(x * 1e6) / 1e6
    return last.select(
        "user_id", "events", rounded(F.col("p.wants")["acidity"]).alias("acidity"), rounded(F.col("p.wants")["body"]).alias("body"),
        rounded(F.coalesce(F.try_element_at("p.likes", F.lit("fruity")), F.lit(0.0))).alias("fruity"), "changes",
    )


def _rated(t):
    k = F.col("event_id")
    said = F.when(k % 17 == 0, "lower").when(k % 19 == 0, "higher")
    body = F.when(k % 4 != 0, (1 + k % 5).cast("double"))
    return t("events").select(
        "user_id", "ts", "event_id", (1 + k % 5).alias("rating"), F.create_map(F.lit("acidity"), 1 + F.least("value", F.lit(80.0)) / 20, F.lit("body"), body).alias("values"),
        F.create_map(F.lit("fruity"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.5)).alias("shares"), F.create_map(F.lit("acidity"), said).alias("signals"),
        F.when(k % 23 == 0, F.array(F.lit("fruity"))).alias("liked"), F.when(k % 29 == 0, F.array(F.lit("fruity"))).alias("disliked"),
    )


def _lines(t):
    """Log lines made of the events: some without an object, some of another kind."""
    body = F.concat(
        F.lit('ts=1 {"evt":"'), F.col("event_type"), F.lit('","ms":"'), F.floor("value").cast("string"), F.lit('","fb_late":"'), (F.col("event_id") % 3).cast("string"), F.lit('","fb_lost":"'), (F.col("event_id") % 2).cast("string"), F.lit('"}')
    )
    return t("events").select("event_id", F.when(F.col("event_id") % 11 == 0, "plain text").otherwise(body).alias("value"))


LOG_SQL = "l AS (SELECT event_id, event_type AS evt, CAST(floor(value) AS BIGINT) AS ms, event_id % 3 AS late, event_id % 2 AS lost FROM events WHERE event_id % 11 <> 0)"


@query(f"WITH {LOG_SQL} SELECT evt, CAST(count(*) AS BIGINT) AS n, CAST(sum(ms) AS BIGINT) AS ms FROM l GROUP BY evt")
def log_parse(t):
    return parsed_logs(_lines(t)).groupBy("evt").agg(F.count("*").alias("n"), F.sum(F.col("fields")["ms"].cast("long")).alias("ms"))


@query(f"""WITH {LOG_SQL} SELECT CAST(count(*) AS BIGINT) AS requests, round(count(*) FILTER (evt = 'error') / CAST(count(*) AS DOUBLE), 6) AS error_rate, round(count(*) FILTER (evt = 'purchase') / CAST(nullif(count(*) FILTER (evt = 'view'), 0) AS DOUBLE), 6) AS buys_per_view,
    round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95 FROM l""")
def log_kpis(t):
    evt = F.col("evt")
    rows = parsed_logs(_lines(t)).withColumn("ms", F.col("fields")["ms"].cast("double"))
    counts = rows.agg(
        F.count("*").alias("requests"), F.round(F.count_if(evt == "error") / F.count("*"), 6).alias("error_rate"),
        F.round(F.count_if(evt == "purchase") / F.nullif(F.count_if(evt == "view"), F.lit(0)), 6).alias("buys_per_view"),
    )
    times = R.exact_percentiles(rows, [], "ms", {"p50": 0.5, "p95": 0.95})
    return counts.crossJoin(times.select(F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95")))


@query(f"""WITH {LOG_SQL}, c AS (SELECT 'late' AS counter, late AS v FROM l WHERE event_id % 4 <> 0 AND lost + late > 0 UNION ALL SELECT 'lost', lost FROM l WHERE event_id % 4 <> 0 AND lost + late > 0),
    o AS (SELECT lost + late AS fb, least(lost + late, greatest(0, 3 - event_id % 3)) AS before, ms < 40 AS fast FROM l WHERE event_id % 4 = 0 AND lost + late > 0),
    i AS (SELECT 'inferred_before_token_' || CASE WHEN fast THEN 'fast_error' ELSE 'timeout' END AS counter, before AS v FROM o WHERE before > 0 UNION ALL SELECT 'inferred_after_token', fb - before FROM o WHERE fb > before)
    SELECT counter, CAST(sum(v) AS BIGINT) AS total FROM (SELECT * FROM c UNION ALL SELECT * FROM i) GROUP BY 1""")
def dynamic_counters(t):
    """Counters whose names only the data knows; rows without any are inferred from cards, first tokens and the deadline."""
    k = F.col("event_id")
    rows = t("events").select(
        ((k % 3) + (k % 2)).alias("fallback"), F.lit(3).alias("cards"), (k % 3).cast("int").alias("tokens"), F.floor("value").alias("ms_total"),
        F.when(k % 4 != 0, F.create_map(F.lit("fb_late"), k % 3, F.lit("fb_lost"), k % 2)).alias("counters"),
    ).where(k % 11 != 0)
    return A.fallback_causes(rows, "fallback", "counters", "cards", "tokens", "ms_total", deadline=40)


FLAVOURS = [
    "notes of lemon, blueberries and a berry", "Orange blossom then orange; STONE FRUIT", "a peachy cherry (cherries), peaches", "lemongrass, xlemon lemonx berry-like",
    "black tea and tea, teas", "dark chocolate / chocolate: milk chocolate", "no such words", "레몬, 블루 베리, 감초", "wood smoke; woods", "Cherry cherry blossom BERRIES",
]
TERMS = ["berry", "blueberry", "lemon", "orange", "peach", "cherry", "black tea", "tea", "chocolate", "dark chocolate", "floral", "woody", "smoky"]
ALIASES = {"stone fruit": "peach", "peachy": "peach", "orange blossom": "floral", "wood smoke": "smoky", "woods": "woody", "mint": "none"}


def _chosen_sql() -> str:
    """The dictionary's words one after another, long ones first: each takes its first free place in every document."""
    words = D.WholeWords(TERMS, ALIASES).words
    order = sorted(range(len(words.words)), key=lambda i: (-len(words.words[i]), i))
    steps, at = [], "s0"
    for n, i in enumerate(order, 1):
        word, tag, size = words.words[i], words.tags[i], len(words.words[i])
        start = f"CAST(coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) AS INT) + (k - 1) * {size}"
        free = f"NOT list_bool_or(list_transform(acc, lambda a: a.s <= h AND h + {size} <= a.e))"
        steps.append(f"""h{n} AS (SELECT doc_id, low, acc, CASE WHEN contains(low, '{word}') THEN string_split(low, '{word}') ELSE [''] END AS p FROM {at}),
            f{n} AS (SELECT doc_id, low, acc, list_filter(list_transform(range(1, len(p)), lambda k: CASE WHEN (k = 1 AND p[k] = '' OR regexp_matches(right(p[k], 1), '[^a-z]'))
                AND (k + 1 = len(p) AND p[k + 1] = '' OR regexp_matches(left(p[k + 1], 1), '[^a-z]')) THEN {start} END), lambda h: h IS NOT NULL AND coalesce({free}, true)) AS o FROM h{n}),
            s{n} AS MATERIALIZED (SELECT doc_id, low, CASE WHEN len(o) = 0 OR coalesce(list_bool_or(list_transform(acc, lambda a: contains(a.t, '{tag}'))), false) THEN acc
                ELSE list_append(acc, {{'s': o[1], 'e': o[1] + {size}, 't': '{tag}'}}) END AS acc FROM f{n})""")
        at = f"s{n}"
    start = "s0 AS (SELECT doc_id, lower(t) AS low, CAST([] AS STRUCT(s INT, e INT, t VARCHAR)[]) AS acc FROM x)"
    return f"WITH {planted_sql(FLAVOURS)}, {start}, {', '.join(steps)} SELECT doc_id, array_to_string(list_transform(list_sort(acc), lambda a: a.t)[1:6], ',') AS tags FROM {at}"


@query(_chosen_sql())
def dictionary_tagger(t):
    """Vocabulary terms of every document, their plurals and aliases, as whole words, longer ones first."""
    return D.tag_text(planted(t, FLAVOURS), "doc_id", "t", D.WholeWords(TERMS, ALIASES)).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("""SELECT p_partkey, array_to_string(CASE WHEN p_partkey % 2 = 0 THEN list_filter([CASE WHEN p_name LIKE '%hot%' THEN 'hot' END, CASE WHEN p_name LIKE '%bolt%' THEN 'bolt' END], lambda x: x IS NOT NULL) ELSE ['t'] END, ',') AS tags FROM part""")
def note_tagger(t):
    """Terms inside note words; a blocked word never counts, a one-letter term must be a whole note."""
    text = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.lit("shotgun, T; tea"))
    found = D.tag_text(t("part").select("p_partkey", text.alias("t")), "p_partkey", "t", D.Notes(["hot", "bolt", "t"], ["shotgun"]))
    return found.select("p_partkey", F.array_join("tags", ",").alias("tags"))


@query("""WITH x AS (SELECT p_partkey, p_name, p_partkey % 3 = 0 AS neg FROM part), h AS (SELECT *, CASE WHEN p_name LIKE 'hot%' THEN 1.0 WHEN p_name LIKE 'red%' THEN 0.5 END AS up FROM x)
    SELECT p_partkey, round(CASE WHEN up IS NOT NULL THEN least(5.0, 3 + CASE WHEN neg THEN 0.15 ELSE 1 END * up) WHEN p_name LIKE '%bolt%' THEN 2.0 END, 6) AS score FROM h""")
def lexicon_scores(t):
    """Labels pushed by the wording; a negation damps a push, low words count only without high ones."""
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("not "), "p_name")).otherwise(F.col("p_name"))
    scored = G.score_text(t("part").select("p_partkey", text.alias("t")), "p_partkey", "t", lambda x: G.pushed_label(x, {r"\bhot\b": 1.0, r"\bred\b": 0.5}, {r"\bbolt\b": -1.0}))
    return scored.withColumn("score", F.round("score", 6))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN p_name || '. Ring of it!' ELSE 'Ring of it!' END AS snippet, substr(p_name || '. Ring of it! None.', 1, 5) AS start FROM part""")
def snippets(t):
    """The sentences with a keyword, else the text's start."""
    text = F.concat("p_name", F.lit(". Ring of it! None."))
    return t("part").select("p_partkey", T.snippet(text, ["ring"], 5).alias("snippet"), T.snippet(text, ["zebra"], 5).alias("start"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size * 1000.0 ELSE p_size * 1.0 END AS grams, p_partkey * 1000 + 500 AS price, replace(p_name, ' ', '') AS name, CASE WHEN p_brand = 'Brand#1' THEN 'one' ELSE 'b-' || substr(sha1(p_brand), 1, 8) END AS slug,
    p_size % 3 = 0 AS list, CASE WHEN p_size > 10 THEN p_size * 10.0 / p_size END AS serving FROM part""")
def amounts_and_keys(t):
    """Weights, prices, matching names, group keys, note lists, amounts per serving."""
    s, k = F.col("p_size"), F.col("p_partkey")
    weight = F.concat(s.cast("string"), F.when(s % 2 == 0, " kg").otherwise("g"))
    price = F.concat(F.format_number(k * 1000 + 500, 0), F.lit(" won"))
    notes = F.when(s % 3 == 0, F.concat_ws(", ", "p_name", "p_type")).otherwise(F.concat("p_name", F.lit(", a sentence.")))
    return t("part").select(
        "p_partkey", T.grams(weight).alias("grams"), T.price(price).alias("price"), T.match_name(F.concat(F.initcap("p_name"), F.lit(" (L)"))).alias("name"),
        T.slug(F.col("p_brand"), {"Brand#1": "one"}, "b-").alias("slug"), T.is_note_list(notes).alias("list"),
        T.per_serving(s.cast("double"), F.when(s > 10, s).otherwise(0).cast("double"), F.lit(10.0)).alias("serving"),
    )
