"""Queries: snapshots, merges, gates. Old and new versions are made of one table by fixed rules."""

from pyspark.sql import functions as F

from ..operators import feeds as FD, filters as O, merge as M
from .base import Registry

registry = Registry()
query = registry.add

OLD = "o AS (SELECT c_custkey AS k, c_nationkey AS g, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS v, c_mktsegment AS s, c_custkey % 4 <> 0 AS active FROM customer WHERE c_custkey % 7 <> 0)"
NEW = "n AS (SELECT c_custkey AS k, c_nationkey AS g, CASE WHEN c_custkey % 8 <> 0 THEN c_acctbal * CASE WHEN c_custkey % 10 = 0 THEN 1.5 ELSE 1 END END AS v, CASE WHEN c_custkey % 13 = 0 THEN 'OTHER' ELSE c_mktsegment END AS s, true AS active FROM customer WHERE c_custkey % 5 <> 0 AND c_nationkey < 20)"
BOTH = f"WITH {OLD}, {NEW}"


def _old(t):
    c, k = t("customer"), F.col("c_custkey")
    return c.where(k % 7 != 0).select(
        k.alias("k"), F.col("c_nationkey").alias("g"), F.when(k % 9 != 0, F.col("c_acctbal")).alias("v"), F.col("c_mktsegment").alias("s"), (k % 4 != 0).alias("active")
    )


def _new(t):
    c, k = t("customer"), F.col("c_custkey")
    value = F.when(k % 8 != 0, F.col("c_acctbal") * F.when(k % 10 == 0, 1.5).otherwise(1.0))
    return c.where((k % 5 != 0) & (F.col("c_nationkey") < 20)).select(
        k.alias("k"), F.col("c_nationkey").alias("g"), value.alias("v"), F.when(k % 13 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("s"), F.lit(True).alias("active")
    )


@query("SELECT o_orderpriority, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS snapshot FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def latest_snapshot(t):
    manifest = t("orders").select("o_orderpriority", F.to_date("o_orderdate").cast("string").alias("snapshot"), (F.col("o_orderstatus") == "F").alias("ok"))
    return O.latest_ok_snapshot(manifest, "o_orderpriority", "snapshot", "ok")


@query("SELECT s_suppkey AS k, s_name AS name, 0 AS src_rank, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, 1, c_mktsegment FROM customer")
def feed_union(t):
    a = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    b = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return M.union_in_order([a, b]).select("k", "name", "src_rank", "segment")


@query(f"{BOTH} SELECT k, g, v, s, active FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)")
def upsert_merge(t):
    return M.upsert(_old(t), _new(t), ["k"])


RETIRE = """CASE WHEN n.k IS NULL AND r.k IS NULL THEN 'delete' WHEN n.k IS NULL AND o.active THEN 'retire' WHEN n.k IS NOT NULL AND NOT o.active THEN 'reactivate' ELSE 'keep' END AS action"""
REFS = """r AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000 UNION SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90
    UNION SELECT conv_id FROM conversations WHERE turn = 0 UNION SELECT s_suppkey FROM supplier)"""


def _refs(t):
    """Keys that four tables refer to."""
    return M.protected_keys(
        (t("orders").where("o_totalprice > 400000"), "o_custkey"), (t("events").where("event_type = 'purchase' AND value > 90"), "user_id"),
        (t("conversations").where("turn = 0"), "conv_id"), (t("supplier"), "s_suppkey"), key="k",
    )


@query(f"{BOTH}, {REFS} SELECT o.k, {RETIRE} FROM o LEFT JOIN n ON o.k = n.k LEFT JOIN r ON o.k = r.k")
def retire_missing(t):
    return M.retire_plan(_old(t), _new(t), "k", "active", _refs(t))


@query(f"WITH {REFS} SELECT k FROM r")
def protected_ids(t):
    return _refs(t)


@query(f"{BOTH}, {REFS} SELECT o.k, {RETIRE} FROM o LEFT JOIN n ON o.k = n.k LEFT JOIN r ON o.k = r.k WHERE o.g IN (SELECT g FROM n)")
def scoped_retire(t):
    new = _new(t)
    return M.retire_plan(M.scoped(_old(t), new, "g"), new, "k", "active", _refs(t))


LABELS = """h AS (SELECT DISTINCT p_name AS name, 'hand' AS label FROM part WHERE p_size = 50), d AS (SELECT DISTINCT p_name AS name, 'derived' AS label FROM part WHERE p_size = 49),
    l AS (SELECT * FROM h UNION ALL SELECT * FROM d WHERE name NOT IN (SELECT name FROM h))"""


@query(f"WITH {LABELS} SELECT p_partkey, l.label IS NULL AS needs_review, l.label FROM part LEFT JOIN l ON p_name = name")
def needs_review(t):
    """Rows whose name has no label; hand-made labels win over derived ones."""
    of = lambda size, label: t("part").where(F.col("p_size") == size).select("p_name").distinct().withColumn("label", F.lit(label))
    labels = M.merged_labels(of(50, "hand"), of(49, "derived"), "p_name", "label")
    return t("part").join(labels, "p_name", "left").select("p_partkey", F.col("label").isNull().alias("needs_review"), "label")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, max(p_partkey) AS part_id FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 GROUP BY ALL""")
def resolved_ids(t):
    """Ids for natural keys, NULL for what the dimension doesn't know."""
    dimension = t("part").where("p_size > 10").select("p_partkey", F.col("p_partkey").alias("key"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    return M.resolve_ids(lines, "l_partkey", dimension, "key", "p_partkey", "part_id")


KIND = """CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'removed' WHEN (o.v IS NULL) <> (n.v IS NULL) OR coalesce(abs(n.v - o.v) > 0.2 * abs(o.v), false) THEN 'flagged'
    WHEN o.s IS DISTINCT FROM n.s OR o.v IS DISTINCT FROM n.v THEN 'changed' ELSE 'same' END"""


@query(f"{BOTH} SELECT coalesce(o.k, n.k) AS k, {KIND} AS kind FROM o FULL JOIN n ON o.k = n.k")
def snapshot_diff(t):
    return M.diff(_old(t), _new(t), ["k"], ["s", "v"], "v")


_OLD = "o2 AS (SELECT k, s, v, active AS flag, CASE WHEN k % 6 = 0 THEN '' ELSE s END AS text, CASE WHEN k % 17 <> 0 THEN [s] END AS tags, CASE WHEN k % 19 <> 0 THEN 1 END AS vec FROM o)"
_NEW = "n2 AS (SELECT k, s, v, k % 3 = 0 AS flag, CASE WHEN k % 6 = 0 THEN NULL ELSE s END AS text, CASE WHEN k % 2 = 0 THEN [s] ELSE [] END AS tags FROM n)"


@query(f"""{BOTH}, {_OLD}, {_NEW} SELECT n2.k, CASE WHEN o2.k IS NULL THEN 'new' ELSE 'changed' END AS kind FROM n2 LEFT JOIN o2 ON o2.k = n2.k
    WHERE o2.k IS NULL OR o2.s IS DISTINCT FROM n2.s OR (n2.v IS NOT NULL AND o2.v IS DISTINCT FROM n2.v) OR (n2.flag AND NOT o2.flag)
        OR nullif(o2.text, '') IS DISTINCT FROM nullif(n2.text, '') OR (len(n2.tags) > 0 AND o2.tags IS DISTINCT FROM n2.tags) OR o2.vec IS NULL""")
def diff_todo(t):
    """What has to be computed again. A value the new version lacks is no change: it may have been filled in."""
    k, s = F.col("k"), F.col("s")
    old = _old(t).select(
        "k", "s", "v", F.col("active").alias("flag"), F.when(k % 6 == 0, "").otherwise(s).alias("text"), F.when(k % 17 != 0, F.array(s)).alias("tags"), F.when(k % 19 != 0, 1).alias("vec")
    )
    new = _new(t).select(
        "k", "s", "v", (k % 3 == 0).alias("flag"), F.when(k % 6 != 0, s).alias("text"), F.when(k % 2 == 0, F.array(s)).otherwise(F.array().cast("array<string>")).alias("tags")
    )
    return M.todo(old, new, "k", ["s"], ["v"], "flag", "text", "vec", "tags")


@query(f"""{BOTH} SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN CASE WHEN o.active THEN 'retire' ELSE 'none' END
    WHEN o.g IS DISTINCT FROM n.g OR o.s IS DISTINCT FROM n.s OR o.v IS DISTINCT FROM n.v OR NOT o.active THEN 'update' ELSE 'none' END AS action FROM o FULL JOIN n ON o.k = n.k""")
def hash_sync_plan(t):
    return M.sync_plan(_new(t), _old(t), "k", ["g", "s", "v"], "active")


@query(f"""{BOTH}, d AS (SELECT coalesce(o.k, n.k) AS k, {KIND} AS kind FROM o FULL JOIN n ON o.k = n.k)
    SELECT n.k, CASE WHEN kind = 'same' THEN 'old ' || o.s ELSE 'made ' || n.s END AS made FROM n JOIN d USING (k) LEFT JOIN o ON o.k = n.k""")
def incremental_reuse(t):
    """Unchanged rows take their old result, the rest is made anew."""
    d = M.diff(_old(t), _new(t), ["k"], ["s", "v"], "v")
    old = _old(t).select("k", F.concat(F.lit("old "), "s").alias("was"))
    rows = _new(t).join(d, "k").join(old, "k", "left")
    return rows.select("k", F.when(F.col("kind") == "same", F.col("was")).otherwise(F.concat(F.lit("made "), "s")).alias("made"))


@query(f"""{BOTH}, a AS (SELECT g, count(*) AS before FROM o GROUP BY g), b AS (SELECT g, count(*) AS after FROM n GROUP BY g)
    SELECT coalesce(a.g, b.g) AS g, CAST(coalesce(before, 0) AS BIGINT) AS before, CAST(coalesce(after, 0) AS BIGINT) AS after,
    coalesce(before, 0) >= 5 AND coalesce(after, 0) < 0.5 * coalesce(before, 0) AS fails FROM a FULL JOIN b ON a.g = b.g""")
def size_gates(t):
    return M.size_gates(_old(t), _new(t), "g")


@query(f"""{BOTH}, x AS (SELECT o.k, o.g % 3 AS "table", n.k IS NULL AS gone FROM o LEFT JOIN n ON o.k = n.k)
    SELECT CAST("table" AS INT) AS "table", CAST(count(*) AS BIGINT) AS current, CAST(count(*) FILTER (gone) AS BIGINT) AS removed, count(*) FILTER (gone) / CAST(count(*) AS DOUBLE) > 0.2 AS fails FROM x GROUP BY 1""")
def removal_gates(t):
    """Tables that would lose more than a fifth of their rows."""
    return M.removal_gate(_old(t), _new(t), "k", (F.col("g") % 3).cast("int"))


@query("""SELECT n_name, CAST(count(s_suppkey) AS BIGINT) AS n, count(s_suppkey) = 0 AS fails FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1""")
def empty_source_guard(t):
    """Sources that brought nothing."""
    rows = t("supplier").where("s_acctbal > 5000").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name")
    return M.empty_sources(t("nation"), rows, "n_name")


@query("""WITH m AS (SELECT p_brand AS name, CASE WHEN p_brand < 'Brand#2' THEN 'violations' ELSE 'accuracy' END AS kind, CASE WHEN p_brand < 'Brand#2' THEN CAST(count(*) FILTER (p_size > 50) AS DOUBLE) WHEN p_brand <> 'Brand#3' THEN avg(CAST(p_size > 20 AS INT)) END AS value,
        count(*) FILTER (p_type <> 'SMALL') AS checked, CASE WHEN p_brand <> 'Brand#4' THEN avg(CAST(p_size > 20 + p_partkey % 3 - 1 AS INT)) + 0.02 END AS baseline FROM part GROUP BY p_brand)
    SELECT name, coalesce(CASE WHEN kind = 'violations' THEN value = 0 AND checked > 0 ELSE value IS NOT NULL AND coalesce(value >= baseline - 0.02 - 1e-9, true) END, false) AS ok FROM m""")
def metric_gates(t):
    """No violations of something checked; accuracy not below its baseline by more than a tolerance."""
    size, k, brand = F.col("p_size"), F.col("p_partkey"), F.col("p_brand")
    rate = lambda c: F.avg(c.cast("int"))
    m = t("part").groupBy(brand.alias("name")).agg(
        F.count_if(size > 50).cast("double").alias("bad"), rate(size > 20).alias("share"), F.count_if(F.col("p_type") != "SMALL").alias("checked"),
        (rate(size > 20 + k % 3 - 1) + 0.02).alias("base"),
    )
    bad = F.col("name") < "Brand#2"
    return M.metric_gates(m.select(
        "name", F.when(bad, "violations").otherwise("accuracy").alias("kind"), F.when(bad, F.col("bad")).when(F.col("name") != "Brand#3", F.col("share")).alias("value"),
        "checked", F.when(F.col("name") != "Brand#4", F.col("base")).alias("baseline"),
    ))


@query("""WITH m AS (SELECT p_brand, p_type, avg(p_size) AS a, avg(p_size + p_partkey % 3 - 1) AS b FROM part GROUP BY 1, 2)
    SELECT p_brand, bool_or(b - a >= 0.01) AND NOT bool_or(b - a < -0.005) AS promote, CAST(count(*) FILTER (b - a >= 0.01) AS BIGINT) AS better, CAST(count(*) FILTER (b - a < -0.005) AS BIGINT) AS worse FROM m GROUP BY 1""")
def promotion_rule(t):
    m = t("part").groupBy("p_brand", "p_type").agg(F.avg("p_size").alias("a"), F.avg(F.col("p_size") + F.col("p_partkey") % 3 - 1).alias("b"))
    return m.groupBy("p_brand").agg(*M.promotes(m, "a", "b"))


CACHE = "c AS (SELECT p_partkey, sha1(CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE p_name END) AS hash, CASE WHEN p_partkey % 9 = 0 THEN 'failed' ELSE 'ok' END AS status, p_type AS answer FROM part WHERE p_partkey % 4 <> 0)"
STATE = "CASE WHEN c.hash IS NULL THEN 'missing' WHEN c.hash <> sha1(p.p_name) THEN 'stale' WHEN c.status <> 'ok' THEN 'failed' ELSE 'hit' END"


def _cache(t):
    k = F.col("p_partkey")
    return t("part").where(k % 4 != 0).select(
        k, F.sha1(F.when(k % 6 == 0, "x").otherwise(F.col("p_name"))).alias("hash"), F.when(k % 9 == 0, "failed").otherwise("ok").alias("status"), F.col("p_type").alias("answer")
    )


@query(f"WITH {CACHE} SELECT p.p_partkey, {STATE} AS state FROM part p LEFT JOIN c USING (p_partkey)")
def cache_hit_miss(t):
    return M.cache_state(t("part"), _cache(t), "p_partkey", "p_name")


@query(f"""WITH {CACHE}, s AS (SELECT p.p_partkey, {STATE} AS state FROM part p LEFT JOIN c USING (p_partkey)), o AS (SELECT *, row_number() OVER (PARTITION BY state <> 'hit' ORDER BY p_partkey) AS r FROM s)
    SELECT p_partkey, state, CASE WHEN state = 'hit' THEN 'reuse' WHEN r <= 100 THEN 'call' ELSE 'later' END AS action FROM o""")
def enrichment_calls(t):
    """What a run over the cache reuses, and its first hundred calls, failed rows tried again."""
    return M.calls(t("part"), _cache(t), "p_partkey", "p_name", retry=True, most=100)


@query(f"""WITH {CACHE} SELECT p.p_partkey, coalesce(CASE WHEN p_size > 30 THEN 'BIG' END, CASE WHEN {STATE} = 'hit' AND c.answer IN ('PROMO', 'SMALL') THEN c.answer END) AS kind,
    CASE WHEN p_size > 30 THEN 'rule' WHEN {STATE} = 'hit' AND c.answer IN ('PROMO', 'SMALL') THEN 'cache' END AS origin FROM part p LEFT JOIN c USING (p_partkey)""")
def fill_from_cache(t):
    """Rules first; cached answers fill the gaps, if they are current and in the vocabulary."""
    state = M.cache_state(t("part"), _cache(t), "p_partkey", "p_name").where("state = 'hit'")
    answers = state.join(_cache(t), "p_partkey").where(F.col("answer").isin("PROMO", "SMALL")).select("p_partkey", "answer")
    value, origin = O.precedence([("rule", F.when(F.col("p_size") > 30, "BIG")), ("cache", F.col("answer"))])
    return t("part").join(answers, "p_partkey", "left").select("p_partkey", value.alias("kind"), origin.alias("origin"))


@query("""WITH k AS (SELECT * FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) SELECT c_mktsegment, CAST(count(DISTINCT c_custkey) AS BIGINT) AS parents, CAST(count(o_orderkey) AS BIGINT) AS children
    FROM k LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def variant_build(t):
    """Rows left when two sources are restricted, with their children."""
    orders = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    parents, children = M.variant(t("customer"), orders, "c_custkey", "c_mktsegment", ["BUILDING", "MACHINERY"])
    n = children.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))
    return parents.join(n, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("parents"), F.coalesce(F.sum("n"), F.lit(0)).alias("children"))


@query("""SELECT p_partkey AS key, replace(p_name, ' ', ';') AS tags, CASE WHEN p_type = 'SMALL' THEN 'true' ELSE 'false' END AS decaf, CASE p_type WHEN 'SMALL' THEN 'source-s' WHEN 'PROMO' THEN 'source-p' END AS source
    FROM part WHERE p_type IN ('SMALL', 'PROMO') ORDER BY key""")
def export_projection(t):
    """Allowed columns of allowed sources, under their public names, ordered by key."""
    names = F.create_map(F.lit("SMALL"), F.lit("source-s"), F.lit("PROMO"), F.lit("source-p"))
    return t("part").where(F.col("p_type").isin("SMALL", "PROMO")).select(
        F.col("p_partkey").alias("key"), F.array_join(F.split("p_name", " "), ";").alias("tags"), (F.col("p_type") == "SMALL").cast("string").alias("decaf"), names[F.col("p_type")].alias("source")
    ).orderBy("key")


@query("""WITH r AS (SELECT s_nationkey AS n_nationkey, s_name AS item FROM supplier WHERE s_acctbal > 6000)
    SELECT * FROM r UNION ALL SELECT n_nationkey, d FROM nation, (VALUES ('hot'), ('iced')) v(d) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM r)""")
def default_rows(t):
    rows = t("supplier").where("s_acctbal > 6000").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("item"))
    return M.default_rows(t("nation"), rows, "n_nationkey", ["hot", "iced"], "item")


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_size + 100 WHEN p_type = 'LARGE' THEN NULL ELSE p_size END AS body, CASE WHEN p_type = 'PROMO' THEN 'relabelled' WHEN p_type = 'LARGE' THEN NULL ELSE 'own' END AS label FROM part""")
def label_policy(t):
    """Labels overwritten, withdrawn or left, by source."""
    kind = F.col("p_type")
    body = M.label_policy(kind, F.col("p_size"), {"PROMO": F.col("p_size") + 100, "LARGE": None})
    label = M.label_policy(kind, F.lit("own"), {"PROMO": F.lit("relabelled"), "LARGE": None})
    return t("part").select("p_partkey", body.alias("body"), label.alias("label"))


CUP_SQL = """f AS (SELECT doc_id, doc_id % 2 AS v, [ 'Ethiopia', 'Kenya (Nyeri)', 'romania', ' ', 'Sumatra', '콜롬비아' ][1 + doc_id % 6] AS country, CASE WHEN doc_id % 5 <> 0 THEN source END AS region,
        [ 'Washed / Wet', 'Natural / Dry', 'Double Anaerobic Washed', 'Other' ][1 + doc_id % 4] AS process, ['1,950-2,050m', '1600', '190164', 'none', '0-1500 m'][1 + doc_id % 5] AS altitude,
        CASE WHEN doc_id % 9 <> 0 THEN CAST(n_chars % 97 AS VARCHAR) ELSE '' END AS acid, CAST(n_chars % 13 AS VARCHAR) AS body, CASE WHEN doc_id % 8 = 0 THEN 'Decaf Ltd, swiss water' ELSE 'owner' END AS owner FROM documents)"""


@query(f"""WITH {CUP_SQL}, x AS (SELECT *, TRY_CAST(acid AS DOUBLE) AS a, TRY_CAST(body AS DOUBLE) AS b FROM f),
    ra AS (SELECT doc_id, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / count(*) OVER () AS p FROM x WHERE a IS NOT NULL),
    rb AS (SELECT doc_id, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / count(*) OVER () AS p FROM x WHERE b IS NOT NULL),
    e AS (SELECT x.*, CASE WHEN ra.p IS NOT NULL THEN CAST(least(5, greatest(1, ceil(ra.p * 5 - 1e-9))) AS INT) END AS acidity, CASE WHEN rb.p IS NOT NULL THEN CAST(least(5, greatest(1, ceil(rb.p * 5 - 1e-9))) AS INT) END AS bodied FROM x LEFT JOIN ra USING (doc_id) LEFT JOIN rb USING (doc_id))
    SELECT 'cup:' || CASE WHEN v = 0 THEN 'old' ELSE 'new' END || ':' || doc_id AS key, coalesce(nullif(concat_ws(' ', nullif(trim(country), ''), region), ''), 'sample') AS name,
        CASE doc_id % 6 WHEN 0 THEN 'Ethiopia' WHEN 1 THEN 'Kenya' WHEN 4 THEN 'Indonesia' WHEN 5 THEN 'Colombia' END AS origin_country,
        CASE doc_id % 4 WHEN 0 THEN 'washed' WHEN 1 THEN 'natural' WHEN 2 THEN 'anaerobic' END AS process, acidity, bodied AS body,
        CASE doc_id % 5 WHEN 0 THEN 2000 WHEN 1 THEN 1600 WHEN 4 THEN 1500 END AS altitude_m, CASE WHEN doc_id % 8 = 0 THEN 'swiss-water' END AS decaf_process,
        coalesce(array_to_string(list_filter([CASE WHEN acidity IS NOT NULL THEN 'acidity' END, CASE WHEN bodied IS NOT NULL THEN 'body' END], lambda q: q IS NOT NULL), ','), '') AS labelled FROM e""")
def cupping_entities(t):
    """Two cupping tables of different columns, dotted ones too, as entities of one feed, made of the documents' numbers."""
    k, n = F.col("doc_id"), F.col("n_chars")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (1 + k % len(xs)).cast("int"))
    rows = t("documents").select(
        k.alias("i"), pick(["Ethiopia", "Kenya (Nyeri)", "romania", " ", "Sumatra", "콜롬비아"]).alias("Country of Origin"), F.when(k % 5 != 0, F.col("source")).alias("Region"),
        pick(["Washed / Wet", "Natural / Dry", "Double Anaerobic Washed", "Other"]).alias("Processing Method"), pick(["1,950-2,050m", "1600", "190164", "none", "0-1500 m"]).alias("Altitude"),
        F.when(k % 9 != 0, (n % 97).cast("string")).otherwise("").alias("Acidity"), (n % 13).cast("string").alias("Body"), F.when(k % 8 == 0, "Decaf Ltd, swiss water").otherwise("owner").alias("Owner"),
    )
    spaced = {"country": "Country of Origin", "region": "Region", "process": "Processing Method", "acid": "Acidity", "body": "Body", "owner": "Owner", "altitude": "Altitude"}
    dotted = {f: c.replace(" ", ".") for f, c in spaced.items()}
    old = rows.where("i % 2 = 0").toDF(*[c.replace(" ", ".") for c in rows.columns])
    files = {"old": (old, FD.Layout(dotted), "u1"), "new": (rows.where("i % 2 = 1"), FD.Layout(spaced), "u2")}
    e = FD.cupping_feed(files, "i", "cup", "2026-01-01")
    return e.select("key", "name", "origin_country", "process", "acidity", "body", "altitude_m", "decaf_process", F.array_join(F.array_sort(F.map_keys("attr_label_source")), ",").alias("labelled"))
