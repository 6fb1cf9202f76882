"""Queries: aggregation, quality, votes and associations, evaluation."""

from pyspark.sql import Window, functions as F

from ..functions import text as T, vectors as V
from ..operators import aggregates as A, ranking as R
from .base import Registry

registry = Registry()
query = registry.add



@query("""SELECT p_brand, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (p_size > 25) AS BIGINT) AS large, CAST(count(*) FILTER (p_type = 'PROMO') AS BIGINT) AS promo,
    CAST(count(DISTINCT p_name) AS BIGINT) AS names FROM part GROUP BY p_brand""")
def coverage_counts(t):
    return t("part").groupBy("p_brand").agg(
        F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large"), F.count_if(F.col("p_type") == "PROMO").alias("promo"), F.countDistinct("p_name").alias("names")
    )


@query("""WITH x AS (SELECT CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 7 <> 0 THEN source END AS source, CASE WHEN doc_id % 5 = 0 THEN [] WHEN doc_id % 4 <> 0 THEN [lang] END AS tags FROM documents)
    SELECT 'lang' AS "column", round(avg(CAST(lang IS NULL AS INT)), 6) AS missing FROM x UNION ALL SELECT 'source', round(avg(CAST(source IS NULL AS INT)), 6) FROM x
    UNION ALL SELECT 'tags', round(avg(CAST(tags IS NULL OR len(tags) = 0 AS INT)), 6) FROM x""")
def missing_rates(t):
    k = F.col("doc_id")
    tags = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 4 != 0, F.array("lang"))
    rows = t("documents").select(F.when(k % 3 != 0, F.col("lang")).alias("lang"), F.when(k % 7 != 0, F.col("source")).alias("source"), tags.alias("tags"))
    return A.missing_rates(rows, ["lang", "source", "tags"]).withColumn("missing", F.round("missing", 6))


@query("""SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (n_chars = 0 OR text IS NULL OR n_chars < 100) AS BIGINT) AS failed FROM documents GROUP BY source""")
def source_report(t):
    """Rows and failed rows of each source."""
    return A.source_report(t("documents"), "source", (F.col("n_chars") == 0) | F.col("text").isNull() | (F.col("n_chars") < 100))


TAGS_SQL = "tags AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ') || [p_type]) AS tag FROM part)"


def _tags(t):
    return t("part").select("p_partkey", F.posexplode(F.concat(F.split("p_name", " "), F.array("p_type"))).alias("pos", "tag"))


@query(f"WITH {TAGS_SQL} SELECT lower(tag) AS tag, CAST(count(DISTINCT p_partkey) AS BIGINT) AS n, round(count(DISTINCT p_partkey) / CAST((SELECT count(DISTINCT p_partkey) FROM tags) AS DOUBLE), 6) AS base FROM tags GROUP BY 1")
def tag_base_rates(t):
    return A.base_rates(_tags(t), "p_partkey", "tag").withColumn("base", F.round("base", 6))


@query("""SELECT user_id, CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, round(coalesce(sum(CASE WHEN event_id % 10 <> 0 THEN value END), 0), 4) AS known,
    CAST(count(*) FILTER (event_id % 10 = 0) AS BIGINT) AS unknown, round(400 - coalesce(sum(CASE WHEN event_id % 10 <> 0 THEN value END), 0), 4) AS remaining FROM events WHERE event_type = 'purchase' GROUP BY 1, 2""")
def daily_budget(t):
    """What each user took in a day of Seoul, known and unknown, and what remains of 400."""
    v = F.when(F.col("event_id") % 10 != 0, F.col("value"))
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Seoul"))
    known = F.coalesce(F.sum(v), F.lit(0.0))
    return t("events").where("event_type = 'purchase'").groupBy("user_id", day.cast("string").alias("day")).agg(
        F.round(known, 4).alias("known"), F.count_if(v.isNull()).alias("unknown"), F.round(400 - known, 4).alias("remaining")
    )


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ') || [p_type]) AS tag FROM part), k AS (SELECT * FROM (VALUES ('hot', 'warm'), ('red', 'warm'), ('cold', 'cool'), ('promo', 'trade')) v(tag, category)),
    j AS (SELECT p_partkey, category FROM w JOIN k ON lower(w.tag) = k.tag)
    SELECT p_partkey, category, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY p_partkey) AS DOUBLE), 6) AS share FROM j GROUP BY 1, 2""")
def category_vector(t):
    """The shares of categories among an item's tags; tags without one are ignored."""
    kinds = F.create_map(*[F.lit(x) for x in ("hot", "warm", "red", "warm", "cold", "cool", "promo", "trade")])
    tags = F.concat(F.split("p_name", " "), F.array("p_type"))
    return t("part").select("p_partkey", F.explode(V.category_shares(tags, kinds)).alias("category", "share")).withColumn("share", F.round("share", 6))


@query("""WITH w AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS whole, CAST(count(*) AS BIGINT) AS turns FROM conversations GROUP BY conv_id),
    c AS (SELECT conv_id, turns, whole, unnest(range(CAST(greatest(ceil(length(whole) / 1000.0), 1) AS INT))) AS chunk FROM w)
    SELECT conv_id, CAST(chunk AS INT) AS chunk, md5(substr(whole, 1 + CAST(chunk AS INT) * 1000, 1000)) AS digest, turns FROM c""")
def concat_by_parent(t):
    """Each conversation's turns in order as one text, in chunks of a thousand characters."""
    rows = t("conversations").select("conv_id", "turn", "text")
    n = rows.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return A.concat_chunks(rows, ["conv_id"], ["turn", "text"], "text", most=1000).join(n, "conv_id").select("conv_id", "chunk", F.md5("text").alias("digest"), "turns")


@query("""WITH a AS (SELECT p_brand, p_type, median(CASE WHEN p_size < 40 AND p_partkey % 2 = 0 THEN p_size END) AS own FROM part GROUP BY 1, 2),
    b AS (SELECT p_brand, median(CASE WHEN p_size < 40 AND p_partkey % 2 = 0 THEN p_size END) AS wider FROM part GROUP BY 1)
    SELECT p_brand, p_type, round_even(coalesce(own, wider), 0) AS median, CASE WHEN own IS NOT NULL THEN 'own' WHEN wider IS NOT NULL THEN 'wider' ELSE 'none' END AS basis FROM a JOIN b USING (p_brand)""")
def median_fallback(t):
    rows = t("part").withColumn("v", F.when((F.col("p_size") < 40) & (F.col("p_partkey") % 2 == 0), F.col("p_size")))
    return A.median_or(rows, ["p_brand", "p_type"], ["p_brand"], "v")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(t):
    found = R.exact_percentiles(t("events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


RATIO_SQL = """r AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 10 <> 0 THEN l_extendedprice / l_quantity / 1000 END AS ratio FROM lineitem)"""


@query(f"""WITH {RATIO_SQL} SELECT l_returnflag, round(median(ratio), 6) AS median_ratio, round(avg(CAST(abs(ratio - 1) <= 0.1 AS INT)), 6) AS within_10,
    round(avg(CAST(abs(ratio - 1) <= 0.25 AS INT)), 6) AS within_25, round(count(ratio) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM r GROUP BY 1""")
def ratio_crosscheck(t):
    return A.ratio_check(_ratios(t), ["l_returnflag"], "ratio")


@query(f"""WITH {RATIO_SQL}, x AS (SELECT l_returnflag, l_orderkey, l_linenumber, max(round(abs(ratio - 1), 6)) AS off FROM r WHERE ratio IS NOT NULL GROUP BY ALL)
    SELECT l_returnflag, l_orderkey, l_linenumber, off, place FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY off DESC, l_orderkey, l_linenumber) AS place FROM x) WHERE place <= 5""")
def ratio_worst(t):
    """The five ratios of each group that are farthest off."""
    off = _ratios(t).where("ratio IS NOT NULL").groupBy("l_returnflag", "l_orderkey", "l_linenumber").agg(F.max(F.round(F.abs(F.col("ratio") - 1), 6)).alias("off"))
    return R.top_k(off, ["l_returnflag"], [F.desc("off"), F.col("l_orderkey"), F.col("l_linenumber")], 5, "place")


def _ratios(t):
    ratio = F.when(F.col("l_partkey") % 10 != 0, F.col("l_extendedprice") / F.col("l_quantity") / 1000)
    return t("lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", ratio.alias("ratio"))


@query("""WITH f AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2), n AS (SELECT l_orderkey, string_agg(l_returnflag, ';' ORDER BY first, l_returnflag) AS flags FROM f GROUP BY 1)
    SELECT l_orderkey, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount, any_value(flags) AS flags FROM lineitem JOIN n USING (l_orderkey) GROUP BY 1""")
def panel_means(t):
    """Means over a panel, and the distinct notes in the order they were first seen."""
    return A.panel_means(t("lineitem"), ["l_orderkey"], {"quantity": "l_quantity", "discount": "l_discount"}, "l_returnflag", "l_linenumber", "flags")


@query("""SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS good, CAST(count(*) FILTER (toxic = 0) AS BIGINT) AS safe,
    round(avg(CAST(quality = 1 AND toxic = 0 AS INT)), 6) AS both_rate, round(avg(CAST((quality = 1) = (toxic = 0) AS INT)), 6) AS agree, round(quantile_cont(n_chars, 0.95), 4) AS p95 FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def quality_summary(t):
    good, safe = F.col("quality") == 1, F.col("toxic") == 0
    rows = t("labels").join(t("documents").select("doc_id", "lang", "n_chars"), "doc_id")
    p95 = R.exact_percentiles(rows, ["lang"], "n_chars", {"p95": 0.95}).select("lang", F.round("p95", 4).alias("p95"))
    return rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_if(safe).alias("safe"), F.round(F.avg((good & safe).cast("int")), 6).alias("both_rate"),
        F.round(F.avg((good == safe).cast("int")), 6).alias("agree"),
    ).join(p95, "lang")


_LANES_SQL = ", ".join(f"lower(lpad(to_hex(CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT AS HUGEINT)) % 1152921504606846976 AS BIGINT)), 15, '0')) AS s{i}" for i in range(4))


@query(f"""WITH k AS (SELECT DISTINCT p_brand, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part), s AS (SELECT p_brand, count(*) AS n, {_LANES_SQL} FROM k GROUP BY 1)
    SELECT p_brand, concat_ws('-', n, s0, s1, s2, s3) AS fingerprint FROM s""")
def id_fingerprint(t):
    """The digest of each brand's ids: the sum of the digests of two parts."""
    parts = [A.fingerprint(t("part").where(f"p_partkey % 2 = {i}"), ["p_brand"], "p_partkey") for i in (0, 1)]
    return A.merged_fingerprints(parts[0].unionByName(parts[1]), ["p_brand"])


@query("""SELECT p_brand, p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY
    CASE p_type WHEN 'STANDARD' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 9 END, CASE WHEN p_partkey % 4 <> 0 THEN p_size END NULLS LAST, p_partkey) AS rn FROM part) WHERE rn = 1""")
def default_variant(t):
    rank = F.when(F.col("p_type") == "STANDARD", 0).when(F.col("p_type") == "LARGE", 1).when(F.col("p_type") == "MEDIUM", 2).otherwise(9)
    size = F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).asc_nulls_last()
    return R.top_k(t("part"), ["p_brand", "p_name"], [rank, size, F.col("p_partkey")], 1).select("p_brand", "p_name", "p_partkey")


@query("SELECT p_brand, p_type, arg_min(p_partkey, CAST(p_size AS BIGINT) * 100000000 + p_partkey) AS p_partkey, max(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END) AS largest FROM part GROUP BY 1, 2")
def argmin_pick(t):
    return t("part").groupBy("p_brand", "p_type").agg(
        F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("p_partkey"), F.max(F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice"))).alias("largest")
    )


PAIRS_SQL = f"""{TAGS_SQL}, n AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag),
    pairs AS (SELECT a.tag AS a, b.tag AS b, count(*) AS n_ab FROM tags a JOIN tags b USING (p_partkey) WHERE a.tag <> b.tag GROUP BY 1, 2),
    c AS (SELECT a, b, CAST(na.n AS BIGINT) AS n_a, CAST(nb.n AS BIGINT) AS n_b, CAST(n_ab AS BIGINT) AS n_ab FROM pairs JOIN n na ON na.tag = a JOIN n nb ON nb.tag = b),
    rules AS (SELECT *, n_ab / CAST(n_a AS DOUBLE) AS share, n_ab / CAST(n_a AS DOUBLE) / (n_b / CAST((SELECT count(DISTINCT p_partkey) FROM tags) AS DOUBLE)) AS lift FROM c)"""


def _rules(t, share, lift):
    tags = _tags(t)
    total = tags.agg(F.countDistinct("p_partkey").alias("total"))
    pairs = A.cooccurrence(tags, "p_partkey", "tag").crossJoin(F.broadcast(total))
    return A.association_rules(pairs, F.col("total"), share=share, lift=lift).drop("total")


@query(f"WITH {PAIRS_SQL} SELECT * FROM c")
def cooccurrence(t):
    return A.cooccurrence(_tags(t), "p_partkey", "tag")


@query(f"WITH {PAIRS_SQL} SELECT a, b, n_ab, round(share, 6) AS share, round(lift, 6) AS lift FROM rules WHERE n_a >= 5 AND n_ab >= 3 AND share >= 0.15 AND lift >= 1.02")
def association_rules(t):
    return _rules(t, 0.15, 1.02).select("a", "b", "n_ab", F.round("share", 6).alias("share"), F.round("lift", 6).alias("lift"))


@query(f"""WITH {PAIRS_SQL}, r AS (SELECT * FROM rules WHERE n_a >= 5 AND n_ab >= 3 AND share >= 0.12 AND lift >= 1.0), given AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS tag, 0 AS pos FROM part UNION ALL SELECT p_partkey, p_type, 1 FROM part),
    near AS (SELECT p_partkey, b FROM given JOIN (SELECT * FROM (VALUES ('hot', 'ring'), ('ring', 'hot'), ('PROMO', 'gear'), ('gear', 'PROMO')) v(a, b)) ON a = tag),
    i AS (SELECT g.p_partkey, r.b, r.a, share, lift, pos FROM given g JOIN r ON r.a = g.tag WHERE NOT EXISTS (SELECT 1 FROM given o WHERE o.p_partkey = g.p_partkey AND o.tag = r.b) AND NOT EXISTS (SELECT 1 FROM near o WHERE o.p_partkey = g.p_partkey AND o.b = r.b)),
    x AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY p_partkey, b ORDER BY share DESC, lift DESC, pos) = 1)
    SELECT p_partkey, b AS implied, a AS because, round(share, 6) AS share, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY share DESC, lift DESC, b) AS INT) AS rank FROM x) WHERE rank <= 3""")
def implied_tags(t):
    """What an item's given tags imply, the tag that implies it best, and nothing of a branch that is there already."""
    given = t("part").select("p_partkey", F.posexplode(F.array(F.element_at(F.split("p_name", " "), 1), F.col("p_type"))).alias("pos", "tag"))
    related = given.sparkSession.createDataFrame([("hot", "ring"), ("gear", "PROMO")], "a string, b string")
    return A.best_antecedent(_rules(t, 0.12, 1.0), given, "p_partkey", "tag", "pos", 3, related).withColumn("share", F.round("share", 6))


_FILL_SQL = """f AS (SELECT string_split(p_name, ' ') AS truth, CASE WHEN p_partkey % 3 <> 0 THEN [split_part(p_name, ' ', 1)] ELSE [] END AS own, [CASE WHEN p_size > 25 THEN split_part(p_name, ' ', 2) ELSE 'rod' END, 'hot', 'gear'] AS vote FROM part),
    w AS (SELECT truth, 'own' AS candidate, own AS tags FROM f UNION ALL SELECT truth, 'own+vote', CASE WHEN len(own) = 0 OR list_contains(vote, own[1]) THEN (list_concat(own, list_filter(vote, lambda x: NOT list_contains(own, x))))[1:3] ELSE list_concat(own, vote)[1:3] END FROM f
        UNION ALL SELECT truth, 'own|vote', CASE WHEN len(own) > 0 THEN own ELSE vote END FROM f UNION ALL SELECT truth, 'vote^1', vote[1:1] FROM f UNION ALL SELECT truth, 'vote^2', vote[1:2] FROM f),
    u AS (SELECT truth, candidate, CASE WHEN tags[1] = tags[2] THEN list_concat([tags[1]], tags[3:]) WHEN tags[1] = tags[3] THEN tags[1:2] WHEN tags[2] = tags[3] THEN tags[1:2] ELSE tags END AS tags FROM w),
    c AS (SELECT candidate, sum(len(list_intersect(truth, tags))) AS tp, sum(len(tags)) AS g, sum(len(list_distinct(truth))) AS h, avg(len(tags)) AS shown, avg(CAST(len(tags) > 0 AS INT)) AS tagged FROM u GROUP BY 1)"""


@query(f"""WITH {_FILL_SQL} SELECT candidate, round(tp / CAST(g AS DOUBLE), 6) AS precision, round(tp / CAST(h AS DOUBLE), 6) AS recall, round(2 * tp / CAST(g + h AS DOUBLE), 6) AS f1, round(shown, 6) AS tags_shown, round(tagged, 6) AS share_tagged FROM c""")
def tag_fill_grid(t):
    """Ways to fill missing tags: one source, two, the other only where the first has none, and at most so many of a vote."""
    word = lambda i: F.element_at(F.split("p_name", " "), i)
    own = F.when(F.col("p_partkey") % 3 != 0, F.array(word(1))).otherwise(F.array().cast("array<string>"))
    vote = F.array(F.when(F.col("p_size") > 25, word(2)).otherwise("rod"), F.lit("hot"), F.lit("gear"))
    rows = t("part").select(F.split("p_name", " ").alias("truth"), own.alias("own"), vote.alias("vote"))
    a, b = F.col("own"), F.col("vote")
    ways = {"own": a, "own+vote": A.filled(a, b, 3), "own|vote": A.fallen_back(a, b), "vote^1": F.slice(b, 1, 1), "vote^2": F.slice(b, 1, 2)}
    return A.fill_grid(rows, F.col("truth"), ways)


GATES = {"shares": [0.1, 0.15, 0.2, 0.4], "lifts": [0.9, 1.0, 1.1, 1.3]}


@query(f"""WITH {TAGS_SQL}, v AS (SELECT p_brand, p_partkey FROM part WHERE p_size > 40), c AS (SELECT p_brand, count(*) AS c FROM v GROUP BY 1),
    b AS (SELECT tag, count(*) / CAST((SELECT count(DISTINCT p_partkey) FROM tags) AS DOUBLE) AS base FROM (SELECT DISTINCT p_partkey, lower(tag) AS tag FROM tags) GROUP BY 1),
    s AS (SELECT v.p_brand, tag, count(*) / CAST(any_value(c) AS DOUBLE) AS share FROM v JOIN c USING (p_brand) JOIN (SELECT DISTINCT p_partkey, lower(tag) AS tag FROM tags) t ON t.p_partkey = v.p_partkey GROUP BY 1, 2),
    r AS (SELECT DISTINCT p_brand, lower(tag) AS tag FROM tags JOIN part ON tags.p_partkey = part.p_partkey WHERE p_size <= 5),
    x AS (SELECT s.share, s.share / base AS lift, r.tag IS NOT NULL AS hit FROM s JOIN b USING (tag) LEFT JOIN r ON r.p_brand = s.p_brand AND r.tag = s.tag),
    g AS (SELECT CAST(min_share AS DOUBLE) AS min_share, CAST(min_lift AS DOUBLE) AS min_lift FROM (SELECT unnest({GATES["shares"]}) AS min_share), (SELECT unnest({GATES["lifts"]}) AS min_lift)),
    k AS (SELECT min_share, min_lift, count(*) FILTER (share >= min_share AND lift >= min_lift) AS n, count(*) FILTER (share >= min_share AND lift >= min_lift AND hit) AS tp, (SELECT count(*) FROM r) AS p FROM g, x GROUP BY 1, 2)
    SELECT min_share, min_lift, CAST(n AS BIGINT) AS n, round(coalesce(tp / CAST(nullif(n, 0) AS DOUBLE), 0), 6) AS precision, round(coalesce(tp / CAST(nullif(p, 0) AS DOUBLE), 0), 6) AS recall, round(coalesce(2 * tp / CAST(nullif(n + p, 0) AS DOUBLE), 0), 6) AS f1 FROM k""")
def gate_grid(t):
    """What a vote of each brand's large parts says of its small ones' tags, for every pair of gates on share and lift."""
    tags = _tags(t).select("p_partkey", F.lower("tag").alias("tag")).distinct()
    part = t("part").select("p_partkey", "p_brand", "p_size")
    voters = part.where("p_size > 40")
    votes = voters.join(tags, "p_partkey").groupBy("p_brand", "tag").agg(F.count(F.lit(1)).alias("v"))
    rates = A.base_rates(_tags(t).withColumn("tag", F.lower("tag")), "p_partkey", "tag").select("tag", "base")
    share = votes.join(voters.groupBy("p_brand").agg(F.count(F.lit(1)).alias("c")), "p_brand").withColumn("share", F.col("v") / F.col("c"))
    true = part.where("p_size <= 5").join(tags, "p_partkey").select("p_brand", "tag").distinct().withColumn("right", F.lit(True))
    rows = share.join(rates, "tag").withColumn("lift", F.col("share") / F.col("base")).join(true, ["p_brand", "tag"], "left").withColumn("right", F.coalesce("right", F.lit(False)))
    return A.gate_scores(rows, "share", "lift", "right", true.count(), **GATES)


@query("SELECT p_partkey, array_to_string((CASE WHEN list_contains(string_split(p_name, ' '), p_type) THEN string_split(p_name, ' ') ELSE list_concat(string_split(p_name, ' '), [p_type]) END)[1:2], ',') AS tags FROM part")
def ordered_tag_union(t):
    return t("part").select("p_partkey", F.array_join(A.filled(F.split("p_name", " "), F.array("p_type"), 2), ",").alias("tags"))


@query("""SELECT p_partkey, array_to_string(CASE WHEN len(own) >= 3 THEN own ELSE list_concat(own, list_filter(['red', p_type, 'extra'], lambda x: NOT list_contains(own, x))[1:greatest(3 - len(own), 0)]) END, ',') AS tags
    FROM (SELECT p_partkey, p_type, string_split(p_name, ' ') AS own FROM part)""")
def tag_topup(t):
    tags = A.topped_up(F.split("p_name", " "), F.array(F.lit("red"), F.col("p_type"), F.lit("extra")), 3)
    return t("part").select("p_partkey", F.array_join(tags, ",").alias("tags"))


@query(f"""WITH {TAGS_SQL}, q AS (SELECT a.p_brand AS query, b.p_partkey AS n FROM (SELECT DISTINCT p_brand FROM part) a JOIN part b USING (p_brand) WHERE b.p_size > 40),
    v AS (SELECT query, tag, count(*) / CAST(max(c) AS DOUBLE) AS share FROM (SELECT q.query, tag, (SELECT count(*) FROM q q2 WHERE q2.query = q.query) AS c FROM q JOIN tags ON tags.p_partkey = q.n) GROUP BY 1, 2),
    b AS (SELECT lower(tag) AS tag, count(*) / CAST((SELECT count(DISTINCT p_partkey) FROM tags) AS DOUBLE) AS base FROM tags GROUP BY 1),
    k AS (SELECT query, v.tag, share, share * ln(1 / greatest(coalesce(base, 0), 1e-6)) AS worth FROM v LEFT JOIN b USING (tag) WHERE share >= greatest(0.1, 1.1 * coalesce(base, 0)))
    SELECT query, tag, round(share, 6) AS share, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY worth DESC, tag) AS INT) AS rank FROM k) WHERE rank <= 5""")
def tag_vote_lift(t):
    """Tags over-represented among each brand's large parts."""
    tags = _tags(t).select("p_partkey", "tag").distinct()
    voters = t("part").where("p_size > 40").select(F.col("p_brand").alias("query"), "p_partkey")
    votes = voters.join(tags, "p_partkey").join(voters.groupBy("query").agg(F.count("*").alias("c")), "query")
    rates = A.base_rates(_tags(t), "p_partkey", "tag")
    return A.vote_tags(votes, "query", "tag", F.col("c"), rates, 0.1, 1.1).select("query", "tag", F.round("share", 6).alias("share"), "rank")


@query("""WITH v AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), m AS (SELECT p_brand, sqrt(sum(n * n)) AS len FROM v GROUP BY 1)
    SELECT a.p_brand, round(sum(a.n * b.n) / (ma.len * mb.len), 6) AS cosine FROM v a JOIN v b ON a.p_type = b.p_type AND b.p_brand = 'Brand#1' JOIN m ma ON ma.p_brand = a.p_brand JOIN m mb ON mb.p_brand = 'Brand#1' GROUP BY a.p_brand, ma.len, mb.len""")
def sparse_cosine(t):
    """Each brand's type profile against one brand's."""
    n = t("part").groupBy("p_brand", "p_type").agg(F.count("*").cast("double").alias("n"))
    maps = n.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("m"))
    one = maps.where("p_brand = 'Brand#1'").select(F.col("m").alias("other"))
    return maps.crossJoin(F.broadcast(one)).select("p_brand", F.round(V.sparse_cosine(F.col("m"), F.col("other")), 6).alias("cosine"))


SETS_SQL = """s AS (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS truth, [split_part(p_name, ' ', 1 + CAST(p_partkey % 2 AS INT)), CASE WHEN p_partkey % 3 = 0 THEN 'red' ELSE 'gear' END] AS guess FROM part),
    c AS (SELECT *, len(list_intersect(truth, guess)) AS tp, len(list_distinct(guess)) AS g, len(list_distinct(truth)) AS h FROM s)"""


def _sets(t):
    word = F.element_at(F.split("p_name", " "), (1 + F.col("p_partkey") % 2).cast("int"))
    guess = F.array(word, F.when(F.col("p_partkey") % 3 == 0, "red").otherwise("gear"))
    return t("part").select("p_partkey", "p_brand", F.split("p_name", " ").alias("truth"), guess.alias("guess"))


def _prf_sql(group):
    return f"""SELECT {group} round(sum(tp) / CAST(sum(g) AS DOUBLE), 6) AS precision, round(sum(tp) / CAST(sum(h) AS DOUBLE), 6) AS recall,
        round(coalesce(2 * (sum(tp) / CAST(sum(g) AS DOUBLE)) * (sum(tp) / CAST(sum(h) AS DOUBLE)) / nullif(sum(tp) / CAST(sum(g) AS DOUBLE) + sum(tp) / CAST(sum(h) AS DOUBLE), 0), 0), 6) AS f1 FROM c"""


@query(f"WITH {SETS_SQL} {_prf_sql('')}")
def micro_prf(t):
    sums = _sets(t).select(*A.set_counts(F.col("truth"), F.col("guess"))).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select(*A.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query(f"WITH {SETS_SQL} {_prf_sql('p_brand,')} GROUP BY p_brand")
def category_prf(t):
    rows = _sets(t).select("p_brand", *A.set_counts(F.col("truth"), F.col("guess")))
    sums = rows.groupBy("p_brand").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select("p_brand", *A.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query(f"WITH {SETS_SQL} SELECT p_brand, round(avg(tp / CAST(g + h - tp AS DOUBLE)), 6) AS jaccard FROM c GROUP BY p_brand")
def jaccard_by_origin(t):
    j = F.size(F.array_intersect("truth", "guess")) / F.size(F.array_union("truth", "guess"))
    return _sets(t).groupBy("p_brand").agg(F.round(F.avg(j), 6).alias("jaccard"))


PRED_SQL = "p AS (SELECT *, CASE WHEN p_partkey % 10 <> 0 THEN 1 + (p_size + p_partkey % 3) % 5 END AS pred, CASE WHEN p_partkey % 7 <> 0 THEN 1 + p_size % 5 END AS truth FROM part)"
AGREE_SQL = """CAST(count(pred - truth) AS BIGINT) AS n, round(avg(CAST(abs(pred - truth) = 0 AS INT)), 6) AS exact, round(avg(CAST(abs(pred - truth) <= 1 AS INT)), 6) AS within_1, round(avg(abs(pred - truth)), 6) AS mae"""


def _pred(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    return t("part").select("*", F.when(k % 10 != 0, 1 + (s + k % 3) % 5).alias("pred"), F.when(k % 7 != 0, 1 + s % 5).alias("truth"))


@query(f"WITH {PRED_SQL} SELECT p_type, {AGREE_SQL} FROM p GROUP BY p_type")
def ordinal_agreement(t):
    return _pred(t).groupBy("p_type").agg(*A.agreement(F.col("pred"), F.col("truth")))


@query(f"""WITH {PRED_SQL} SELECT p_type, CAST(count(*) FILTER (pred IS NULL AND truth IS NOT NULL) AS BIGINT) AS only_second, CAST(count(*) FILTER (pred IS NOT NULL AND truth IS NULL) AS BIGINT) AS only_first,
    CAST(count(*) FILTER (pred IS NULL AND truth IS NULL) AS BIGINT) AS neither, {AGREE_SQL},
    round(count(*) FILTER (pred = truth) / CAST(count(pred) AS DOUBLE), 6) AS precision, round(count(*) FILTER (pred = truth) / CAST(count(truth) AS DOUBLE), 6) AS recall,
    round(2 * count(*) FILTER (pred = truth) / CAST(count(pred) + count(truth) AS DOUBLE), 6) AS f1 FROM p GROUP BY p_type""")
def annotator_agreement(t):
    """Two annotators: which side has no value, ordinal agreement, and the second as truth of the first."""
    return A.annotators(_pred(t), ["p_type"], F.col("pred"), F.col("truth"))


@query(f"WITH {PRED_SQL} SELECT p_type, round(avg(CAST(pred IS NOT NULL AS INT)), 6) AS coverage, {AGREE_SQL}, round(avg(CASE WHEN truth IS NOT NULL THEN CAST(abs(3 - truth) <= 1 AS INT) END), 6) AS constant_within_1 FROM p GROUP BY p_type")
def coverage_metrics(t):
    constant = F.avg(F.when(F.col("truth").isNotNull(), (F.abs(3 - F.col("truth")) <= 1).cast("int")))
    return _pred(t).groupBy("p_type").agg(
        F.round(F.avg(F.col("pred").isNotNull().cast("int")), 6).alias("coverage"), *A.agreement(F.col("pred"), F.col("truth")), F.round(constant, 6).alias("constant_within_1")
    )


@query(f"""WITH {PRED_SQL}, x AS (SELECT *, 1 + p_size % 4 AS other FROM p WHERE pred IS NOT NULL AND truth IS NOT NULL)
    SELECT p_type, CAST(count(*) AS BIGINT) AS n, round(avg(abs(pred - truth)), 6) AS mae_a, round(avg(abs(other - truth)), 6) AS mae_b, round(avg(abs(3 - truth)), 6) AS mae_constant FROM x GROUP BY p_type""")
def paired_metrics(t):
    """Two models and a constant on the rows that both answer."""
    rows = _pred(t).where("pred IS NOT NULL AND truth IS NOT NULL").withColumn("other", 1 + F.col("p_size") % 4)
    mae = lambda c: F.round(F.avg(F.abs(c - F.col("truth"))), 6)
    return rows.groupBy("p_type").agg(F.count("*").alias("n"), mae(F.col("pred")).alias("mae_a"), mae(F.col("other")).alias("mae_b"), mae(F.lit(3)).alias("mae_constant"))


@query(f"""WITH {PRED_SQL}, m AS (SELECT p_brand, avg(pred) - avg(truth) AS shift FROM p WHERE pred IS NOT NULL AND truth IS NOT NULL GROUP BY 1)
    SELECT p_brand, CAST(count(*) AS BIGINT) AS n, round(avg(abs(pred - shift - truth)), 6) AS mae, round(avg(CAST(pred IS NOT NULL AS INT)), 6) >= 0.9 AS go FROM p JOIN m USING (p_brand) WHERE truth IS NOT NULL GROUP BY p_brand""")
def recentered_agreement(t):
    """Agreement after the mean difference is taken out, and whether coverage suffices."""
    both = F.col("pred").isNotNull() & F.col("truth").isNotNull()
    shift = _pred(t).where(both).groupBy("p_brand").agg((F.avg("pred") - F.avg("truth")).alias("shift"))
    rows = _pred(t).where("truth IS NOT NULL").join(shift, "p_brand")
    return rows.groupBy("p_brand").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("shift") - F.col("truth"))), 6).alias("mae"), (F.round(F.avg(F.col("pred").isNotNull().cast("int")), 6) >= 0.9).alias("go")
    )


@query(f"""WITH {PRED_SQL}, r AS (SELECT p_type, rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY p_type ORDER BY p_partkey % 13) + (count(*) OVER (PARTITION BY p_type, p_partkey % 13) - 1) / 2.0 AS b FROM p)
    SELECT p_type, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY p_type""")
def spearman(t):
    return A.spearman(t("part").select("p_type", "p_size", (F.col("p_partkey") % 13).alias("m")), ["p_type"], "p_size", "m")


@query(f"""WITH {PRED_SQL}, r AS (SELECT p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS a, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey % 13, p_partkey) AS b FROM p)
    SELECT p_type, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY p_type""")
def spearman_ordinal(t):
    """Rank correlation with ties in the order of keys."""
    rows = t("part").select("p_type", "p_size", (F.col("p_partkey") % 13).alias("m"), "p_partkey")
    return A.spearman(rows, ["p_type"], "p_size", "m", ordinal_by="p_partkey")


@query("""WITH x AS (SELECT p_size AS threshold, p_partkey % 3 = 0 AS pos FROM part), t AS (SELECT DISTINCT threshold FROM x)
    SELECT t.threshold, CAST(count(*) FILTER (x.threshold >= t.threshold AND pos) AS BIGINT) AS tp, CAST(count(*) FILTER (x.threshold >= t.threshold AND NOT pos) AS BIGINT) AS fp,
    CAST(count(*) FILTER (x.threshold < t.threshold AND pos) AS BIGINT) AS fn, CAST(count(*) FILTER (x.threshold < t.threshold AND NOT pos) AS BIGINT) AS tn FROM x, t GROUP BY t.threshold""")
def threshold_sweep(t):
    return A.threshold_sweep(t("part").select("p_size", (F.col("p_partkey") % 3 == 0).alias("pos")), "p_size", F.col("pos"))


@query("""WITH x AS (SELECT p_size AS threshold, p_size > 25 AND p_partkey % 3 <> 0 AS pos FROM part), t AS (SELECT DISTINCT threshold FROM x),
    s AS (SELECT t.threshold, count(*) FILTER (x.threshold >= t.threshold AND pos) AS tp, count(*) FILTER (x.threshold >= t.threshold AND NOT pos) AS fp,
    count(*) FILTER (x.threshold < t.threshold AND pos) AS fn, count(*) FILTER (x.threshold < t.threshold AND NOT pos) AS tn FROM x, t GROUP BY t.threshold)
    SELECT threshold, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn
    FROM s ORDER BY (tp + tn) DESC, threshold LIMIT 1""")
def best_threshold(t):
    """The threshold with the best accuracy, the lowest of equal ones, and its confusion matrix."""
    pos = (F.col("p_size") > 25) & (F.col("p_partkey") % 3 != 0)
    return A.best_threshold(A.threshold_sweep(t("part").select("p_size", pos.alias("pos")), "p_size", F.col("pos"))).withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH x AS (SELECT p_type, p_size / 50.0 AS score, p_partkey % 3 = 0 AS pos FROM part), c AS (SELECT p_type, g AS threshold, count(*) FILTER (pos AND score >= g) AS tp, count(*) FILTER (NOT pos AND score >= g) AS fp,
    count(*) FILTER (pos AND score < g) AS fn FROM x, (VALUES (0.2), (0.4), (0.6), (0.8)) b(g) GROUP BY 1, 2), f AS (SELECT *, 2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE) AS f1 FROM c)
    SELECT p_type, CAST(threshold AS DOUBLE) AS threshold, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY f1 DESC, threshold) = 1""")
def tag_thresholds(t):
    """Each tag's own threshold: the one with the best F1."""
    rows = t("part").select("p_type", (F.col("p_size") / 50).alias("score"), (F.col("p_partkey") % 3 == 0).alias("pos"))
    return A.f1_thresholds(rows, ["p_type"], "score", F.col("pos"), [0.2, 0.4, 0.6, 0.8]).withColumn("f1", F.round("f1", 6))


@query("""WITH x AS (SELECT p_brand, p_size AS threshold, p_partkey % 3 = 0 AS pos FROM part), c AS (SELECT b.g AS threshold, count(*) FILTER (pos AND threshold >= g) AS tp, count(*) FILTER (NOT pos AND threshold >= g) AS fp,
    count(*) FILTER (pos AND threshold < g) AS fn FROM x, (VALUES (10), (20), (30), (40)) b(g) GROUP BY 1)
    SELECT threshold, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1, row_number() OVER (ORDER BY 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) DESC, threshold) = 1 AS best FROM c""")
def f1_threshold_sweep(t):
    """F1 at each threshold of a grid, and which is best (the lowest of equal ones)."""
    pos = F.col("p_partkey") % 3 == 0
    rows = t("part").select(pos.alias("pos"), "p_size", F.explode(F.array(*[F.lit(g) for g in (10, 20, 30, 40)])).alias("threshold"))
    over = F.col("p_size") >= F.col("threshold")
    c = rows.groupBy("threshold").agg(F.count_if(F.col("pos") & over).alias("tp"), F.count_if(~F.col("pos") & over).alias("fp"), F.count_if(F.col("pos") & ~over).alias("fn"))
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.select("threshold", F.round(f1, 6).alias("f1"), (F.row_number().over(Window.orderBy(f1.desc(), "threshold")) == 1).alias("best"))


@query(f"""WITH {PRED_SQL}, x AS (SELECT *, least(p_size / 10.0, 4) AS support FROM p WHERE truth IS NOT NULL)
    SELECT CAST(rule AS DOUBLE) AS rule, round(avg(CAST(pred IS NOT NULL AND support >= rule AS INT)), 6) AS coverage, round(avg(CASE WHEN pred IS NOT NULL AND support >= rule THEN CAST(abs(pred - truth) <= 1 AS INT) END), 6) AS accuracy
    FROM x, (VALUES (0), (1), (2), (3)) r(rule) GROUP BY rule""")
def abstention_sweep(t):
    """Coverage and accuracy when answers with little support are withheld."""
    rows = _pred(t).withColumn("support", F.least(F.col("p_size") / 10.0, F.lit(4.0)))
    return A.abstention(rows, "pred", "truth", "support", [0, 1, 2, 3])


@query(f"""WITH {PRED_SQL}, x AS (SELECT * FROM p WHERE pred IS NOT NULL AND truth IS NOT NULL), r AS (SELECT p_brand, pred, truth,
        rank() OVER (PARTITION BY p_brand ORDER BY pred) + (count(*) OVER (PARTITION BY p_brand, pred) - 1) / 2.0 AS a, rank() OVER (PARTITION BY p_brand ORDER BY truth) + (count(*) OVER (PARTITION BY p_brand, truth) - 1) / 2.0 AS b FROM x),
    b AS (SELECT p_brand, count(*) AS n, avg(CAST(abs(pred - truth) <= 1 AS INT)) AS w, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS rho FROM r GROUP BY p_brand)
    SELECT p_brand, CAST(n AS BIGINT) AS n, round(w, 6) AS within_1, rho, CASE WHEN n < 10 THEN 'low' WHEN w >= 0.75 AND coalesce(rho, 0) >= 0.3 THEN 'high' WHEN w >= 0.55 AND coalesce(rho, 0) > 0 THEN 'medium' ELSE 'low' END AS level FROM b""")
def calibration_levels(t):
    """A confidence level for each bucket: by the share within one and the rank correlation; small buckets are low."""
    return A.calibration(_pred(t), ["p_brand"], "pred", "truth")


@query(f"""WITH {PRED_SQL}, o AS (SELECT p_brand, p_size, CASE p_type WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'STANDARD' THEN 3 WHEN 'LARGE' THEN 4 END AS c FROM p), x AS (SELECT * FROM o WHERE c IS NOT NULL),
    r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY c) + (count(*) OVER (PARTITION BY p_brand, c) - 1) / 2.0 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS b FROM x)
    SELECT p_brand, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY p_brand""")
def ordinal_convention(t):
    """Rank correlation of a value with the order of named levels; names without a place are left out."""
    return A.ordinal_correlation(t("part"), ["p_brand"], "p_type", ["SMALL", "MEDIUM", "STANDARD", "LARGE"], "p_size")


@query("""SELECT p_brand, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN p_partkey % 7 <> 0 THEN p_size END) AS BIGINT) AS known, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS kinds FROM part GROUP BY 1""")
def group_inventory(t):
    rows = t("part").withColumn("mg", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")))
    return A.inventory(rows, ["p_brand"], "mg", "p_type").withColumn("kinds", F.array_join("kinds", ","))


@query("""WITH w AS (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w, p_partkey FROM part), v AS (SELECT DISTINCT p_brand, p_partkey, w FROM w WHERE w IN ('hot', 'bolt', 'gear'))
    SELECT p_brand, round((SELECT count(DISTINCT p_partkey) FROM v WHERE v.p_brand = p.p_brand) / CAST(count(*) AS DOUBLE), 6) AS share FROM part p GROUP BY p_brand""")
def readable_share(t):
    """The share of rows of which a vocabulary reads at least one word, by group."""
    words = t("part").sparkSession.createDataFrame([("hot",), ("bolt",), ("gear",)], "term string")
    return A.readable_share(t("part"), ["p_brand"], F.split("p_name", " "), words, "p_partkey").withColumn("share", F.round("share", 6))


@query("""WITH w AS (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS term FROM part) SELECT term, string_agg(p_brand, ',' ORDER BY p_brand) AS groups FROM w WHERE term IN ('hot', 'bolt', 'gear') GROUP BY 1""")
def term_groups(t):
    """The groups in which each vocabulary term occurs."""
    words = t("part").sparkSession.createDataFrame([("hot",), ("bolt",), ("gear",)], "term string")
    return A.term_groups(t("part"), "p_brand", F.split("p_name", " "), words).select("term", F.array_join("groups", ",").alias("groups"))


@query("""WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (text ILIKE '%license%') AS hit FROM documents GROUP BY source)
    SELECT CAST(count(*) AS BIGINT) AS stores, CAST(count(*) FILTER (hit > 0) AS BIGINT) AS with_any, round(sum(hit) / CAST(sum(n) AS DOUBLE), 6) AS rate FROM s""")
def scan_yield(t):
    """How many sources mention a word at all, and the share of documents that do."""
    s = t("documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").ilike("%license%")).alias("hit"))
    return s.agg(F.count("*").alias("stores"), F.count_if(F.col("hit") > 0).alias("with_any"), F.round(F.sum("hit") / F.sum("n"), 6).alias("rate"))
