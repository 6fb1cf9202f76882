"""Queries: filters, scalar rules, ranks."""

from pyspark.sql import functions as F

from ..functions import rules as N, text as T, vectors as V
from ..operators import filters as O, ranking as R
from .base import Registry, planted, planted_sql, quoted

registry = Registry()
query = registry.add

#: Profiles against which items are checked: limits, preferred attributes and liked kinds.
PROFILES = """(1, 'decaf_only', true, NULL, 2.0, 3.0, 0.5, -0.25), (2, 'low', true, NULL, 3.0, 1.0, 0.0, 0.0),
    (3, 'any', false, 120, 4.0, 2.0, -0.5, 1.0), (4, 'any', true, 60, 1.0, 5.0, 1.0, 0.25)"""
COLUMNS = "profile, rule, milk_ok, remaining, want_a, want_b, warm, cool"
PROFILE_SQL = f"profiles AS (SELECT * FROM (VALUES {PROFILES}) AS v({COLUMNS}))"
ITEMS_SQL = """items AS (
    SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, p_type = 'SMALL' AS decaf, p_type = 'PROMO' AS option,
           CASE WHEN p_partkey % 7 <> 0 THEN p_size * 4 END AS mg, p_name LIKE '%plate%' AS milk,
           CASE WHEN p_partkey % 5 <> 0 THEN CAST(1 + p_size % 5 AS DOUBLE) END AS a, CASE WHEN p_partkey % 3 <> 0 THEN CAST(1 + p_partkey % 5 AS DOUBLE) END AS b
    FROM part)"""
REASON_SQL = """CASE WHEN rule = 'decaf_only' AND NOT (decaf OR option) THEN 'decaf_only'
         WHEN rule = 'decaf_only' AND decaf AND mg > 30 THEN 'decaf_over_limit'
         WHEN rule = 'low' AND NOT (decaf OR option) AND coalesce(mg > 100, true) THEN 'low_limit'
         WHEN rule = 'low' AND decaf AND mg > 100 THEN 'decaf_over_low'
         WHEN remaining IS NOT NULL AND coalesce(mg > remaining, true) THEN 'daily_budget'
         WHEN NOT milk_ok AND milk THEN 'milk' END"""
SWAP_SQL = "option AND NOT decaf AND (rule = 'decaf_only' OR (rule = 'low' AND NOT coalesce(mg <= 100, false)))"
#: Words of a name that have a kind; the rest has none.
KINDS = {"hot": "warm", "red": "warm", "cold": "cool", "blue": "cool"}


def items(t):
    k, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    words = F.split("p_name", " ")
    of = lambda c: sum((F.when(w.isin([x for x, y in KINDS.items() if y == c]), 1.0).otherwise(0.0) for w in (words[0], words[1])), F.lit(0.0))
    return t("part").select(
        "*", (kind == "SMALL").alias("decaf"), (kind == "PROMO").alias("option"), F.when(k % 7 != 0, size * 4).alias("mg"),
        F.col("p_name").contains("plate").alias("milk"), F.when(k % 5 != 0, (1 + size % 5).cast("double")).alias("a"),
        F.when(k % 3 != 0, (1 + k % 5).cast("double")).alias("b"), of("warm").alias("has_warm"), of("cool").alias("has_cool"),
    )


def profiled(t):
    """Every item for every profile: four profiles, a fixed table."""
    rows = items(t)
    profiles = rows.sparkSession.sql(f"SELECT * FROM VALUES {PROFILES} AS v({COLUMNS})")
    rule, decaf, option, mg, milk = (F.col(c) for c in ("rule", "decaf", "option", "mg", "milk"))
    reason = O.first_reason(O.intake_rules(rule, decaf, option, mg, F.col("remaining"), milk, F.col("milk_ok")))
    weights = {c: F.col(c).cast("double") for c in ("warm", "cool")}
    wanted = {"a": F.col("want_a").cast("double"), "b": F.col("want_b").cast("double")}
    score = O.fit_score({"a": F.col("a"), "b": F.col("b")}, wanted, {c: F.col(f"has_{c}") for c in weights}, weights, halved={"a": milk})
    return (
        rows.crossJoin(F.broadcast(profiles)).withColumn("reason", reason).withColumn("swap", O.needs_swap(rule, decaf, option, mg))
        .withColumn("score", F.round(score, 6))
    )


_SHARE = "CAST(list_sum([CASE WHEN w IN ({}) THEN 1 ELSE 0 END FOR w IN string_split(p_name, ' ')]) AS DOUBLE)"
_WARM, _COOL = _SHARE.format("'hot', 'red'"), _SHARE.format("'cold', 'blue'")
_COSINE = f"(warm * {_WARM} + cool * {_COOL}) / nullif(sqrt(CAST(warm * warm + cool * cool AS DOUBLE)) * sqrt({_WARM} * {_WARM} + {_COOL} * {_COOL}), 0)"
_WEIGHT_A = "CASE WHEN a IS NULL THEN 0 WHEN milk THEN 0.5 ELSE 1 END"
_NEAR = f"""(coalesce(CASE WHEN milk THEN 0.5 ELSE 1 END * (1 - abs(want_a - a) / 4), 0) + coalesce(1 - abs(want_b - b) / 4, 0))
    / nullif(CAST({_WEIGHT_A} + CASE WHEN b IS NULL THEN 0 ELSE 1 END AS DOUBLE), 0)"""
SCORE_SQL = f"""round(coalesce(CAST(0.6 AS DOUBLE) * ({_NEAR}) + CAST(0.4 AS DOUBLE) * (({_COSINE}) + 1) / 2, {_NEAR}, (({_COSINE}) + 1) / 2, 0.5), 6)"""


@query(f"WITH {PROFILE_SQL}, {ITEMS_SQL} SELECT profile, p_partkey, {REASON_SQL} AS reason FROM items, profiles")
def hard_filter(t):
    """The first failing limit of every item and profile, NULL where it passes."""
    return profiled(t).select("profile", "p_partkey", "reason")


@query(f"""WITH {PROFILE_SQL}, {ITEMS_SQL}, ok AS (SELECT * FROM items, profiles WHERE {REASON_SQL} IS NULL)
    SELECT profile, p_partkey, mg, place FROM (
        SELECT profile, p_partkey, mg, row_number() OVER (PARTITION BY profile ORDER BY mg NULLS LAST, p_name, p_partkey) AS place FROM ok)
    WHERE place <= 5""")
def filter_sql_topn(t):
    """The five passing items of each profile with the least content, unknown ones last."""
    ok = profiled(t).where("reason IS NULL")
    return R.top_k(ok, ["profile"], [F.col("mg").asc_nulls_last(), F.col("p_name"), F.col("p_partkey")], 5, "place").select(
        "profile", "p_partkey", "mg", "place"
    )


@query(f"""WITH {PROFILE_SQL}, {ITEMS_SQL}, ok AS (
        SELECT profile, p_brand, p_partkey, {SCORE_SQL} AS score, mg FROM items, profiles WHERE {REASON_SQL} IS NULL)
    SELECT profile, p_brand, p_partkey, score, place FROM (
        SELECT *, row_number() OVER (PARTITION BY profile, p_brand ORDER BY score DESC, mg NULLS LAST, p_partkey) AS place FROM ok)
    WHERE place <= 3""")
def topk_per_group(t):
    """Each profile's best three items of every brand that pass its limits."""
    ok = profiled(t).where("reason IS NULL")
    order = [F.col("score").desc(), F.col("mg").asc_nulls_last(), F.col("p_partkey")]
    return R.top_k(ok, ["profile", "p_brand"], order, 3, "place").select("profile", "p_brand", "p_partkey", "score", "place")


@query(f"WITH {PROFILE_SQL}, {ITEMS_SQL} SELECT profile, p_partkey, {SCORE_SQL} AS score FROM items, profiles")
def fit_score(t):
    """How well each item fits each profile: attributes and kinds, blended."""
    return profiled(t).select("profile", "p_partkey", "score")


@query(f"""WITH {PROFILE_SQL}, {ITEMS_SQL}, x AS (SELECT *, {REASON_SQL} AS reason, {SWAP_SQL} AS swap FROM items, profiles)
    SELECT profile, p_type, CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS passed, CAST(count(*) FILTER (swap) AS BIGINT) AS swaps,
           CAST(count(*) FILTER (reason IS NULL AND (
                (rule = 'decaf_only' AND NOT (decaf OR (option AND swap))) OR (decaf AND ((rule = 'decaf_only' AND mg > 30) OR (rule = 'low' AND mg > 100)))
                OR (rule = 'low' AND NOT (decaf OR option OR coalesce(mg <= 100, false))) OR (NOT milk_ok AND milk)
                OR (remaining IS NOT NULL AND coalesce(mg > remaining, true)))) AS BIGINT) AS violations
    FROM x GROUP BY profile, p_type""")
def violation_sweep(t):
    """Items that pass the limits but fail an independently written check, by profile and kind: none should."""
    ok = F.col("reason").isNull()
    return profiled(t).groupBy("profile", "p_type").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(ok).alias("passed"), F.count_if("swap").alias("swaps"),
        F.count_if(ok & O.served_badly()).alias("violations"),
    )


@query(f"""WITH {PROFILE_SQL}, {ITEMS_SQL}, x AS (SELECT *, CASE WHEN p_partkey % 9 <> 0 THEN milk END AS label FROM items, profiles)
    SELECT profile, p_partkey, CASE WHEN rule = 'decaf_only' AND NOT decaf THEN 'not decaf' WHEN rule = 'decaf_only' AND mg > 30 THEN 'decaf over limit'
        WHEN rule = 'low' AND (mg IS NULL OR mg > 100) THEN 'over low limit or unknown' WHEN NOT milk_ok AND (label IS NULL OR label) THEN 'milk or no label' END AS why FROM x""")
def raw_violations(t):
    """The strict rules on raw rows, where a missing milk label counts against an item."""
    label = F.when(F.col("p_partkey") % 9 != 0, F.col("milk"))
    why = O.raw_violation(F.col("rule"), F.col("decaf"), F.col("mg"), label, F.col("milk_ok"))
    return profiled(t).select("profile", "p_partkey", why.alias("why"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(replace(lower(p_name), ' ', ''), 'gear|rod') THEN 'drive'
    WHEN regexp_matches(replace(lower(p_name), ' ', ''), 'bolt|ring') THEN 'join' WHEN regexp_matches(replace(lower(p_name), ' ', ''), 'redw|dplate') THEN 'panel'
    ELSE 'other' END AS family FROM part""")
def keyword_family(t):
    ladder = [("drive", ["gear", "rod"]), ("join", ["bolt", "ring"]), ("panel", ["redw", "dplate"])]
    return t("part").select("p_partkey", T.keyword_class(F.col("p_name"), ladder, "other").alias("family"))


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%cold r%' OR p_brand ILIKE '%cold r%' OR p_type = 'SMALL'
    ORDER BY p_name ILIKE '%cold r%' DESC, length(p_name), p_partkey LIMIT 300""")
def search_ranked(t):
    """The first 300 hits of a query that also stands for a kind."""
    found = O.search_ranked(
        t("part"), "cold r", name="p_name", also=["p_brand"], key="p_partkey", limit=300, synonyms={"cold r": "SMALL"}, synonym_of="p_type"
    )
    return found.select("p_partkey", "p_name", "p_brand")


@query("""SELECT 'small' AS rule, min(p_partkey) FILTER (p_size < 5) AS p_partkey FROM part UNION ALL
    SELECT 'promo', min(p_partkey) FILTER (p_type = 'PROMO') FROM part UNION ALL
    SELECT 'red', min(p_partkey) FILTER (list_has_any(string_split(p_name, ' '), ['red', 'hot'])) FROM part""")
def first_per_rule(t):
    rules = [
        ("small", F.col("p_size") < 5), ("promo", F.col("p_type") == "PROMO"),
        ("red", F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("hot")))),
    ]
    return O.first_per_rule(t("part"), rules, "p_partkey")


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN p_size / 10.0 END AS v, 3.0 AS want, p_size * 2 AS pct FROM part)
    SELECT p_partkey, CASE WHEN v IS NULL THEN NULL WHEN v <= 1.5 THEN 'very low' WHEN v < 2.5 THEN 'low' WHEN v < 3.5 THEN 'medium' WHEN v < 4.5 THEN 'high' ELSE 'very high' END AS band,
        CASE WHEN abs(v - want) <= 0.5 THEN 'similar' WHEN v IS NOT NULL THEN concat(CASE WHEN abs(v - want) <= 1.5 THEN 'slightly ' ELSE 'much ' END, CASE WHEN v > want THEN 'stronger' ELSE 'weaker' END) END AS gap,
        CASE WHEN pct >= 80 THEN 'high' WHEN pct >= 50 THEN 'medium' ELSE 'low' END AS fit FROM x""")
def attr_bands(t):
    """A value in words, its distance from what is wanted in words, and the level of a percentage."""
    value = F.when(F.col("p_size") % 9 != 0, F.col("p_size").cast("decimal(4,1)") / 10)
    band = O.band(value, [1.5, 2.5, 3.5, 4.5], ["very low", "low", "medium", "high", "very high"])
    return t("part").select("p_partkey", band.alias("band"), O.gap(value, F.lit(3)).alias("gap"), O.fit_level(F.col("p_size") * 2).alias("fit"))


@query("""WITH x AS (SELECT p_partkey, ['low', 'medium', 'high'][1 + p_size % 3] AS level,
        CAST(p_partkey % 3 = 0 AS INT) + CAST(p_partkey % 5 = 0 AS INT) AS missing FROM part)
    SELECT p_partkey, level, ['low', 'medium', 'high'][least(list_position(['low', 'medium', 'high'], level),
        CASE WHEN missing >= 2 THEN 1 WHEN missing = 1 THEN 2 ELSE 3 END)] AS capped FROM x""")
def confidence_cap(t):
    level = F.element_at(F.array(*[F.lit(x) for x in O.LEVELS]), 1 + F.col("p_size") % 3)
    missing = (F.col("p_partkey") % 3 == 0).cast("int") + (F.col("p_partkey") % 5 == 0).cast("int")
    return t("part").select("p_partkey", level.alias("level"), O.cap_confidence(level, missing).alias("capped"))


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS gauge, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 END AS cue,
        CASE WHEN p_partkey % 2 = 0 THEN p_size + 2 END AS model FROM part)
    SELECT p_partkey, coalesce(gauge, cue, model) AS value, CASE WHEN gauge IS NOT NULL THEN 'gauge' WHEN cue IS NOT NULL THEN 'cue'
        WHEN model IS NOT NULL THEN 'model' END AS value_source FROM x""")
def precedence_coalesce(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    value, source = O.precedence([("gauge", F.when(k % 5 == 0, s)), ("cue", F.when(k % 3 == 0, s + 1)), ("model", F.when(k % 2 == 0, s + 2))])
    return t("part").select("p_partkey", value.alias("value"), source.alias("value_source"))


@query("""SELECT doc_id, map_extract_value(MAP {'avec': 'fr', 'nicht': 'de', 'para': 'es', 'with': 'en', 'the': 'en'},
        nullif(regexp_extract(lower(text), '(?:^|[^a-z])(avec|nicht|para|with|the)(?:$|[^a-z])', 1), '')) AS entry FROM documents""")
def leftmost_dictionary(t):
    words = {"avec": "fr", "nicht": "de", "para": "es", "with": "en", "the": "en"}
    return t("documents").select("doc_id", T.leftmost_entry(F.col("text"), words).alias("entry"))


@query("""WITH x AS (SELECT p_partkey, regexp_extract_all(p_size || '-' || (p_size + p_partkey % 50) || ' m', '(\\d+)', 1)[1:2] AS n FROM part)
    SELECT p_partkey, CASE WHEN (CAST(n[1] AS DOUBLE) + CAST(n[2] AS DOUBLE)) / 2 BETWEEN 10 AND 60 THEN (CAST(n[1] AS DOUBLE) + CAST(n[2] AS DOUBLE)) / 2 END AS middle FROM x""".replace("\\\\d", "\\d"))
def range_midpoint(t):
    text = F.concat(F.col("p_size"), F.lit("-"), F.col("p_size") + F.col("p_partkey") % 50, F.lit(" m"))
    return t("part").select("p_partkey", T.range_midpoint(text, 10, 60).alias("middle"))


@query("SELECT c_custkey, round(least(5.0, greatest(1.0, 1 + c_acctbal * 4.0 / 9000)), 6) AS scaled, CAST(floor(least(5.0, greatest(1.0, 1 + c_acctbal * 4.0 / 9000)) + 0.5) AS BIGINT) AS whole FROM customer")
def rescale_clip(t):
    scaled = T.rescale(F.col("c_acctbal"), 0, 9000)
    return t("customer").select("c_custkey", F.round(scaled, 6).alias("scaled"), T.round_half_up(scaled).alias("whole"))


@query("""SELECT p_partkey, array_to_string(list_distinct_ordered, ';') AS leaves FROM (
    SELECT p_partkey, CASE WHEN p_type = split_part(p_name, ' ', 1) THEN [p_type] ELSE [split_part(p_name, ' ', 2), p_type] END AS list_distinct_ordered FROM part)""")
def path_leaf_tags(t):
    text = F.concat(F.col("p_brand"), F.lit(">"), F.element_at(F.split("p_name", " "), 1), F.lit(">"), F.element_at(F.split("p_name", " "), 2), F.lit("; "), F.col("p_type"))
    return t("part").select("p_partkey", F.array_join(T.path_leaves(text), ";").alias("leaves"))


@query("""WITH x AS (SELECT doc_id, nullif(regexp_extract(lower(text), '(avec|with|mit)', 1), '') AS hi, nullif(regexp_extract(lower(text), '(sur|from|von)', 1), '') AS lo FROM documents)
    SELECT doc_id, CASE WHEN hi IS NOT NULL AND lo IS NOT NULL THEN NULL WHEN hi IS NOT NULL THEN 5 WHEN lo IS NOT NULL THEN 1 END AS value,
        CASE WHEN NOT (hi IS NOT NULL AND lo IS NOT NULL) THEN coalesce(hi, lo) END AS words FROM x""")
def text_cues(t):
    value, words = T.text_cue(F.col("text"), "avec|with|mit", "sur|from|von")
    return t("documents").select("doc_id", value.alias("value"), words.alias("words"))


@query("SELECT p_partkey, concat_ws(' | ', nullif(trim(p_name), ''), CASE WHEN p_size > 10 THEN p_type END, p_brand) AS composed FROM part")
def compose_text(t):
    parts = [F.col("p_name"), F.when(F.col("p_size") > 10, F.col("p_type")).otherwise(" "), F.col("p_brand")]
    return t("part").select("p_partkey", T.compose(*parts).alias("composed"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding[1:16], lambda v: CAST(v AS DOUBLE)) AS h FROM embeddings)
    SELECT vec_id, round(h[1] / sqrt(list_dot_product(h, h)), 6) AS first, round(h[16] / sqrt(list_dot_product(h, h)), 6) AS last FROM x""")
def vector_truncate(t):
    unit = V.unit_prefix(F.col("embedding"), 16)
    return t("embeddings").select("vec_id", F.round(unit[0], 6).alias("first"), F.round(unit[15], 6).alias("last"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN p_size / 2.0 ELSE p_size * 1.0 END AS body,
    CASE WHEN p_type = 'SMALL' THEN 'decaf' ELSE 'main' END AS origin FROM part""")
def struct_inherit(t):
    main = F.struct((F.col("p_size") * 1.0).cast("double").alias("body"), F.lit("main").alias("origin"))
    other = F.struct((F.col("p_size") / 2.0).cast("double").alias("body"), F.lit("decaf").alias("origin"))
    return t("part").select("p_partkey", O.struct_or_else(F.col("p_type") == "SMALL", main, other).alias("s")).select("p_partkey", "s.*")


@query("""WITH x AS (SELECT p_partkey, p_size AS base, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 END AS model, CASE WHEN p_partkey % 6 = 0 THEN p_size + 2 END AS cue FROM part)
    SELECT p_partkey, coalesce(cue, model, base) AS value, CASE WHEN cue IS NOT NULL THEN 'cue' WHEN model IS NOT NULL THEN 'model' ELSE 'base' END AS evidence FROM x""")
def layer_override(t):
    """Later layers replace earlier ones where they have a value; the evidence of the winner alone stays."""
    k, s = F.col("p_partkey"), F.col("p_size")
    value, layer = O.precedence([("cue", F.when(k % 6 == 0, s + 2)), ("model", F.when(k % 4 == 0, s + 1)), ("base", s)])
    evidence = F.array(F.lit("cue"), F.lit("model"), F.lit("base"))
    return t("part").select("p_partkey", value.alias("value"), F.filter(evidence, lambda e: e == layer)[0].alias("evidence"))


@query("""SELECT p_brand, CASE WHEN count(DISTINCT CASE WHEN p_size > 45 THEN p_type END) = 1 THEN min(CASE WHEN p_size > 45 THEN p_type END) END AS only_type FROM part GROUP BY p_brand""")
def single_or_null(t):
    kinds = F.collect_set(F.when(F.col("p_size") > 45, F.col("p_type")))
    return t("part").groupBy("p_brand").agg(T.single_or_null(kinds).alias("only_type"))


@query("SELECT p_partkey, replace(replace(replace(p_name, 'widget', 'part'), 'large', 'big'), 'red', 'rot') AS renamed FROM part")
def dict_replace(t):
    return t("part").select("p_partkey", T.dict_replace(F.col("p_name"), {"red": "rot", "large": "big", "widget": "part"}).alias("renamed"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN abs(p_size / 10.0 - 2) <= 0.5 THEN 'size' END, CASE WHEN abs(p_retailprice / 200 - 4.7) <= 0.1 THEN 'price' END], lambda x: x IS NOT NULL), ',') AS matches,
    array_to_string(list_filter([CASE WHEN abs(p_size / 10.0 - 2) > 0.5 THEN 'size' END, CASE WHEN abs(p_retailprice / 200 - 4.7) > 0.1 THEN 'price' END], lambda x: x IS NOT NULL), ',') AS misses FROM part""")
def match_points(t):
    values = {"size": F.col("p_size") / 10.0, "price": F.col("p_retailprice") / 200}
    matches, misses = O.match_points(values, {"size": 2, "price": 4.7}, {"size": 0.5, "price": 0.1})
    return t("part").select("p_partkey", F.array_join(matches, ",").alias("matches"), F.array_join(misses, ",").alias("misses"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN greatest(w, 0.5) WHEN w > 0 THEN 0.0 ELSE w END AS building,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN greatest(-w, 0.5) WHEN -w > 0 THEN 0.0 ELSE -w END AS machinery
    FROM (SELECT c_custkey, c_mktsegment, CAST((c_custkey % 9) - 4 AS DOUBLE) / 4 AS w FROM customer)""")
def weights_edit(t):
    """Chosen categories weigh at least 0.5, others lose positive weights and keep negative ones."""
    w = ((F.col("c_custkey") % 9) - 4).cast("double") / 4
    weights = F.create_map(F.lit("BUILDING"), w, F.lit("MACHINERY"), -w)
    edited = O.edited_weights(weights, F.array("c_mktsegment"))
    return t("customer").select("c_custkey", edited["BUILDING"].alias("building"), edited["MACHINERY"].alias("machinery"))


@query("""SELECT o_orderpriority, date_diff('day', max(o_orderdate), DATE '2002-01-01') AS age, date_diff('day', max(o_orderdate), DATE '2002-01-01') <= 6 AS fresh FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority""")
def snapshot_freshness(t):
    """Age of each feed's last snapshot; static feeds are left out."""
    last = t("orders").where("o_orderstatus <> 'P'").groupBy("o_orderpriority").agg(F.max(F.to_date("o_orderdate")).alias("d"))
    age = F.datediff(F.lit("2002-01-01").cast("date"), "d").cast("long")
    return last.select("o_orderpriority", age.alias("age"), (age <= 6).alias("fresh"))


@query("""WITH r AS (SELECT c_mktsegment, c_custkey, c_acctbal, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS a,
        count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WHERE c_custkey % 11 <> 0)
    SELECT c_custkey, CAST(least(5, greatest(1, ceil(a / n * 5 - 1e-9))) AS INT) AS quintile FROM r UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 11 = 0""")
def quintile_rank(t):
    rows = t("customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")))
    return R.quintile(rows, ["c_mktsegment"], "c_acctbal").select("c_custkey", "quintile")


_WORTH = "round(CAST(0.7 AS DOUBLE) * round_even(score * 100, 0) / 100 - (1 - CAST(0.7 AS DOUBLE)) * {}, 9)"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY worth DESC, mg NULLS LAST, p_name, p_partkey) = 1"
_NEAR_TO = "({0}.a * {1}.a + {0}.b * {1}.b) / (sqrt(0.0 + {0}.a * {0}.a + {0}.b * {0}.b) * sqrt(0.0 + {1}.a * {1}.a + {1}.b * {1}.b))"


@query(f"""WITH x AS (SELECT p_brand, p_partkey, p_name, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 4 END AS mg, p_retailprice / 1000 AS score, CAST(p_size AS DOUBLE) AS a, CAST(51 - p_size AS DOUBLE) AS b FROM part),
    c1 AS (SELECT *, {_WORTH.format("0")} AS worth FROM x {_FIRST}),
    r2 AS (SELECT x.*, greatest(0.0, {_NEAR_TO.format("x", "c1")}) AS near FROM x JOIN c1 USING (p_brand) WHERE x.p_partkey <> c1.p_partkey),
    c2 AS (SELECT *, {_WORTH.format("near")} AS worth FROM r2 {_FIRST}),
    r3 AS (SELECT r2.* REPLACE (greatest(r2.near, {_NEAR_TO.format("r2", "c2")}) AS near) FROM r2 JOIN c2 USING (p_brand) WHERE r2.p_partkey <> c2.p_partkey),
    c3 AS (SELECT *, {_WORTH.format("near")} AS worth FROM r3 {_FIRST})
    SELECT p_brand, p_partkey, round(worth, 6) AS worth, 1 AS place FROM c1 UNION ALL SELECT p_brand, p_partkey, round(worth, 6), 2 FROM c2
    UNION ALL SELECT p_brand, p_partkey, round(worth, 6), 3 FROM c3""")
def mmr_top3(t):
    """Three items a brand, each new one unlike those before; equal worth goes to less content, then the name."""
    size, k = F.col("p_size"), F.col("p_partkey")
    rows = t("part").select(
        "p_brand", "p_partkey", "p_name", F.when(k % 7 != 0, size * 4).alias("mg"), (F.col("p_retailprice") / 1000).alias("score"),
        size.cast("double").alias("a"), (51 - size).cast("double").alias("b"),
    )
    ties = [F.col("mg").asc_nulls_last(), F.col("p_name")]
    return R.diverse_top_k(rows, ["p_brand"], "p_partkey", "score", ["a", "b"], ties=ties).withColumn("worth", F.round("worth", 6))


@query("""WITH x AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, page_id % 5 AS src FROM pages),
    o AS (SELECT host, arg_min(src, src * 100000000 + page_id) AS owner FROM x WHERE host <> '' GROUP BY host)
    SELECT page_id, x.host, src FROM x LEFT JOIN o ON x.host = o.host WHERE x.host = '' OR src = owner""")
def url_owner_dedupe(t):
    rows = t("pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), (F.col("page_id") % 5).alias("src"))
    return R.owned_by_first(rows, "host", "src", ["src", "page_id"])


@query("SELECT l_orderkey, arg_min(l_partkey, l_shipdate::VARCHAR || lpad(l_partkey::VARCHAR, 12, '0') || lpad(l_suppkey::VARCHAR, 12, '0')) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def first_by_key(t):
    rows = t("lineitem").select("l_orderkey", "l_shipdate", "l_partkey", "l_suppkey")
    return R.first_by(rows, ["l_orderkey"], [F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey")]).select("l_orderkey", "l_partkey")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_by_key(t):
    return R.last_by(t("events").select("user_id", "event_type", "event_id"), ["user_id"], [F.col("event_id")])


@query("SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def recent_n(t):
    return R.top_k(t("events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5).select("user_id", "event_id", "rn")


@query("""SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42:' || p_partkey), p_partkey) AS rn FROM part) WHERE rn <= 10""")
def hash_sample(t):
    """Ten rows of every brand by hash of the key."""
    return R.hash_sample(t("part").select("p_brand", "p_partkey"), "p_partkey", 10, ["p_brand"])


@query("""WITH x AS (SELECT p_partkey, p_type = 'SMALL' AS small, md5('42:' || p_partkey) AS place FROM part),
    f AS (SELECT p_partkey, 0 AS turn, place FROM x WHERE small ORDER BY place, p_partkey LIMIT 10),
    r AS (SELECT p_partkey, 1 AS turn, place FROM x WHERE p_partkey NOT IN (SELECT p_partkey FROM f))
    SELECT p_partkey FROM (SELECT * FROM f UNION ALL SELECT * FROM r) ORDER BY turn, place, p_partkey LIMIT 50""")
def quota_sample(t):
    """Fifty rows by hash of the key, up to ten small ones first."""
    return R.quota_sample(t("part").select("p_partkey", "p_type"), "p_partkey", 50, F.col("p_type") == "SMALL", 10).select("p_partkey")


@query("""SELECT p_brand, p_partkey, p_size, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS place,
    count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_type = 'SMALL') WHERE place <= 3""")
def evidence_ranking(t):
    rows = t("part").where("p_type = 'SMALL'")
    return R.top_k(rows, ["p_brand"], [F.col("p_size").desc(), F.col("p_retailprice").desc(), F.col("p_partkey")], 3, "place").select("p_brand", "p_partkey", "p_size", "place")


@query("""SELECT p_type AS source, CAST(count(*) AS BIGINT) AS candidates, CAST(count(*) FILTER (p_size > 10 AND p_partkey % 3 <> 0) AS BIGINT) AS with_evidence,
    CAST(count(*) FILTER (p_size > 10 AND p_partkey % 3 <> 0 AND p_partkey % 2 = 0) AS BIGINT) AS by_rule, CAST(count(*) FILTER (p_size > 10 AND p_partkey % 3 <> 0 AND p_partkey % 2 = 1) AS BIGINT) AS by_text
    FROM part GROUP BY p_type""")
def evidence_counts(t):
    """Candidates of a probe, those with evidence, and what the evidence is, by source."""
    k = F.col("p_partkey")
    evidence = F.when((F.col("p_size") > 10) & (k % 3 != 0), F.when(k % 2 == 0, "rule").otherwise("text"))
    return O.evidence_counts(t("part").select(F.col("p_type").alias("source"), evidence.alias("evidence")), "source", "evidence", ["rule", "text"])


@query("""WITH x AS (SELECT p_brand, p_partkey, abs(p_size - 25) AS err FROM part)
    SELECT p_brand, p_partkey, err, CASE WHEN best <= 3 THEN 'best' ELSE 'worst' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY err, p_partkey) AS best,
        row_number() OVER (PARTITION BY p_brand ORDER BY err DESC, p_partkey) AS worst FROM x) WHERE best <= 3 OR worst <= 2""")
def best_worst(t):
    rows = t("part").select("p_brand", "p_partkey", F.abs(F.col("p_size") - 25).alias("err"))
    return R.best_and_worst(rows, ["p_brand"], "err", "p_partkey")


ANSWERS = ["Fully Washed", "Natural / Dry", "pulped natural honey", "who knows", "carbonic maceration", "wet hulled", "SEMI-LAVADO"]


def _answer_sql():
    ladder = lambda text, steps: "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}', 'i') THEN '{n}'" for n, p in steps) + " END"
    return f"""WITH {planted_sql(ANSWERS)}, m AS (SELECT doc_id, t, [{quoted(ANSWERS)}][1 + (doc_id * 3) % 7] AS a FROM x), v AS (SELECT doc_id, {ladder("t", N.PROSE_PROCESSES)} AS rule, CASE WHEN doc_id % 4 <> 0 THEN {ladder("a", N.LABEL_PROCESSES)} END AS model FROM m)
        SELECT doc_id, coalesce(rule, model) AS process, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN model IS NOT NULL THEN 'model' END AS origin FROM v"""


@query(_answer_sql())
def merged_answers(t):
    """What rules read from whole texts; a model's answer fills a gap once it is one of the names that results carry."""
    said = F.element_at(F.array(*[F.lit(x) for x in ANSWERS]), (1 + (F.col("doc_id") * 3) % 7).cast("int"))
    rows = planted(t, ANSWERS).select("doc_id", N.ladder(F.col("t"), N.PROSE_PROCESSES).alias("rule"), F.when(F.col("doc_id") % 4 != 0, said).alias("answer"))
    process, origin = O.merged_answer(F.col("rule"), F.col("answer"), lambda a: N.ladder(a, N.LABEL_PROCESSES))
    return rows.select("doc_id", process.alias("process"), origin.alias("origin"))
