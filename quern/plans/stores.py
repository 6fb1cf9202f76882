"""Queries: formats written to the shared folder and read back, versions, batch twins of the streams."""

from pyspark.sql import functions as F

from .. import sources as S, streaming as ST
from ..operators import catalog as C
from ..storage import scratch
from .base import Registry

registry = Registry()
query = registry.add


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS p_size FROM part")
def json_lines(t):
    """Rows as JSON lines of a fixed schema, and back."""
    rows = t("part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"))
    path = scratch(rows.sparkSession, "lines")
    S.write_jsonl(rows, path)
    return S.read_jsonl(rows.sparkSession, path, rows.schema)


@query("SELECT CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey END AS p_partkey, p_partkey % 9 <> 0 AS whole FROM part")
def torn_lines(t):
    """Lines of which every ninth is cut short: whole rows, and the torn ones set aside."""
    line = F.to_json(F.struct("p_partkey", "p_name"))
    lines = t("part").select(F.when(F.col("p_partkey") % 9 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value"))
    path = scratch(lines.sparkSession, "torn")
    lines.write.text(path)
    rows, torn = S.read_json_lines(lines.sparkSession, path, "p_partkey long, p_name string")
    return rows.select("p_partkey", F.lit(True).alias("whole")).unionByName(torn.select(F.lit(None).cast("long").alias("p_partkey"), F.lit(False).alias("whole")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name || ', "' || p_type || '"' END AS label, p_size > 25 AS large, replace(p_name, ' ', ';') AS words FROM part""")
def typed_csv(t):
    """A CSV export read with typed cells: an empty cell is NULL, quotes and commas survive."""
    label = F.when(F.col("p_partkey") % 5 != 0, F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')))
    rows = t("part").select("p_partkey", label.alias("label"), (F.col("p_size") > 25).alias("large"), F.split("p_name", " ").alias("words"))
    path = scratch(rows.sparkSession, "csv")
    S.write_csv(rows, path)
    return S.read_csv_typed(rows.sparkSession, path, "p_partkey long, label string, large boolean, words string")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_mktsegment END), '') AS segment FROM customer")
def text_csv(t):
    """A CSV read as text and cleaned: nothing is inferred."""
    rows = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("segment"))
    path = scratch(rows.sparkSession, "csv")
    S.write_csv(rows, path)
    return S.read_csv_text(rows.sparkSession, path).select("c_custkey", F.nullif(F.trim("segment"), F.lit("")).alias("segment"))


@query("SELECT p_brand AS store, replace(p_name, ' ', '-') AS handle, arg_min(p_type, p_partkey) AS title FROM part GROUP BY 1, 2")
def store_feeds(t):
    """One feed of products a store, found by their names; of equal handles the first counts."""
    product = F.struct(F.replace("p_name", F.lit(" "), F.lit("-")).alias("handle"), F.col("p_type").alias("title"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", product.alias("p")))), lambda x: x["p"])
    feeds = t("part").groupBy(F.col("p_brand").alias("store")).agg(F.to_json(F.struct(listed.alias("products"))).alias("value"))
    spark, path = feeds.sparkSession, scratch(feeds.sparkSession, "feeds")
    feeds.repartition("store").write.partitionBy("store").text(path)
    assert S.find_files(spark, path, "*.txt").limit(1).count() == 1
    rows = S.read_products(spark, f"{path}/store=*", "handle: string, title: string")
    store = F.url_decode(F.regexp_extract("file", "store=([^/]+)/", 1))
    return rows.select(F.url_decode(store).alias("store"), "handle", "title")


@query("""WITH x AS (SELECT DISTINCT p_type AS a, split_part(p_name, ' ', 1) AS b, split_part(p_name, ' ', 2) AS c FROM part)
    SELECT a AS key, NULL AS parent, 1 AS level, a AS name FROM x UNION SELECT a || '>' || b, a, 2, b FROM x UNION SELECT a || '>' || b || '>' || c, a || '>' || b, 3, c FROM x""")
def tree_rows(t):
    """A tree of nested objects as rows of its three levels."""
    word = lambda i: F.element_at(F.split("p_name", " "), i)
    rows = t("part").select(F.col("p_type").alias("a"), word(1).alias("b"), word(2).alias("c")).distinct()
    two = rows.groupBy("a", "b").agg(F.collect_list("c").alias("leaves"))
    one = two.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "leaves"))).alias("m"))
    text = one.select(F.to_json(F.create_map("a", "m")).alias("value"))
    path = scratch(text.sparkSession, "tree")
    text.repartition(text.count()).write.option("maxRecordsPerFile", 1).text(path)
    return S.read_tree(text.sparkSession, path)


@query("SELECT p_partkey AS code, p_retailprice AS price, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS size FROM part")
def wide_sheet(t):
    """Three columns of a wide text table by position; what is no number is NULL."""
    size = F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("string")).otherwise("n/a")
    filler = [F.lit("x").alias(f"f{i}") for i in range(60)]
    wide = t("part").select(*filler[:20], F.col("p_partkey").cast("string").alias("a"), *filler[20:40], F.col("p_retailprice").cast("string").alias("b"), *filler[40:], size.alias("c"))
    return S.wide_rows(wide, {"code": (20, "bigint"), "price": (41, "double"), "size": (62, "int")})


@query("""WITH n AS (SELECT * FROM nation), c AS (SELECT c_custkey, n_name AS parent, c_mktsegment AS seg, c_custkey % 5 AS m FROM customer JOIN nation ON c_nationkey = n_nationkey),
    two AS (SELECT * FROM c WHERE m IN (1, 2, 3)), one AS (SELECT * FROM c WHERE m NOT IN (3)),
    o AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 AS m FROM orders), o1 AS (SELECT o.* FROM o JOIN one ON o_custkey = c_custkey WHERE o.m <> 0), o2 AS (SELECT o.* FROM o JOIN two ON o_custkey = c_custkey WHERE o.m <> 1),
    paid AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'purchase'),
    left_o AS (SELECT o_orderkey AS k, o_custkey AS parent, true AS active FROM o2),
    left_c AS (SELECT c_custkey AS k, parent, true AS active FROM two UNION ALL
        SELECT c_custkey, parent, seg <> 'MACHINERY' AND seg <> 'BUILDING' FROM one WHERE c_custkey NOT IN (SELECT c_custkey FROM two)
            AND (seg NOT IN ('MACHINERY', 'BUILDING') OR c_custkey IN (SELECT k FROM paid) OR c_custkey IN (SELECT parent FROM left_o)))
    SELECT 'customer' AS tab, CAST(k AS BIGINT) AS k, parent, active FROM left_c UNION ALL SELECT 'orders', CAST(k AS BIGINT), CAST(parent AS VARCHAR), active FROM left_o
    UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), NULL, true FROM n""")
def published_version(t):
    """Three tables loaded twice, each load one commit: the second one scoped to two segments, with customers kept for their
    purchases; then a load with a failing check and one with an empty source, which change nothing."""
    spark = t("part").sparkSession
    catalog = C.Catalog(spark, scratch(spark, "catalog"))
    specs = [
        C.Table("nation", "n_nationkey", "nation_id", required=True),
        C.Table("customer", "c_custkey", "customer_id", {"nation_id": ("c_nationkey", "nation")}, {"nation_id"}, "c_mktsegment", required=True),
        C.Table("orders", "o_orderkey", "order_id", {"customer_id": ("o_custkey", "customer")}, {"customer_id"}),
    ]
    customers = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = t("orders").select("o_orderkey", "o_custkey")
    feeds = lambda a, b: {"nation": t("nation").select("n_nationkey", "n_name"), "customer": customers.where(a), "orders": orders.where(b)}
    C.load(catalog, specs, feeds("c_custkey % 5 <> 3", "o_orderkey % 3 <> 0"))
    bought = t("events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey")).join(catalog.read("customer"), "c_custkey").select("customer_id")
    C.load(catalog, specs, feeds("c_custkey % 5 in (1, 2, 3)", "o_orderkey % 3 <> 1"), {"customer": bought}, {"customer": ["MACHINERY", "BUILDING"]})
    for bad, checks in ((feeds("true", "true"), {"customer": {"no such": F.col("c_custkey") < 0}}), (feeds("false", "true"), None)):
        try:
            C.load(catalog, specs, bad, checks=checks)
        except C.Rejected:
            continue
        raise AssertionError("committed")
    nation, customer, order = (catalog.read(n) for n in ("nation", "customer", "orders"))
    rows = lambda df, name, k, parent: df.select(F.lit(name).alias("tab"), F.col(k).cast("long").alias("k"), F.col(parent).cast("string").alias("parent"), "active")
    named = customer.join(nation.select("nation_id", "n_name"), "nation_id")
    owned = order.join(customer.select("customer_id", "c_custkey"), "customer_id")
    whole = nation.withColumn("none", F.lit(None).cast("string"))
    return rows(named, "customer", "c_custkey", "n_name").unionByName(rows(owned, "orders", "o_orderkey", "c_custkey")).unionByName(rows(whole, "nation", "n_nationkey", "none"))


@query("""WITH e AS (SELECT user_id, date_trunc('day', ts + INTERVAL 9 HOUR) - INTERVAL 9 HOUR AS s, CASE WHEN event_id % 10 <> 0 THEN value END AS v FROM events WHERE event_type = 'purchase')
    SELECT user_id, strftime(s, '%Y-%m-%d %H:%M') AS day_start, round(coalesce(sum(v), 0), 4) AS known, CAST(count(*) FILTER (v IS NULL) AS BIGINT) AS unknown, round(400 - coalesce(sum(v), 0), 4) AS remaining FROM e GROUP BY 1, 2""")
def daily_intake(t):
    """The budget stream's batch twin, on events that all come twice."""
    e = t("events").where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"))
    days = ST.daily_intake(e.union(e), 400.0)
    return days.select("user_id", F.date_format("day_start", "yyyy-MM-dd HH:mm").alias("day_start"), F.round("known", 4).alias("known"), "unknown", F.round("remaining", 4).alias("remaining"))


@query("""WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type = 'error' AS failed, floor(value) AS ms, event_id % 3 AS cards, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS fb FROM events)
    SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(failed AS INT)), 6) AS error_rate, round(sum(fb) / CAST(nullif(sum(cards), 0) AS DOUBLE), 6) AS fallback_rate,
        round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95 FROM e GROUP BY 1""")
def request_windows(t):
    """The request statistics' batch twin by hour, with exact percentiles."""
    k = F.col("event_id")
    e = t("events").select(
        k, F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"), F.floor("value").alias("ms"), (k % 3).alias("cards"), F.when(k % 3 == 2, 1).otherwise(0).alias("fallbacks")
    )
    rates = ST.request_kpis(e, "1 hour").select("start", "n", F.round("error_rate", 6).alias("error_rate"), F.round("fallback_rate", 6).alias("fallback_rate"))
    exact = ST.window_percentiles(e, "1 hour").select("start", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))
    return rates.join(exact, "start").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("""SELECT CAST(ordinal_position AS INT) AS position, column_name AS "column", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' END AS type, true AS nullable
    FROM (SELECT row_number() OVER () AS ordinal_position, column_name, column_type AS data_type FROM (DESCRIBE SELECT * FROM documents))""")
def column_dictionary(t):
    """Numbered definitions of a table's columns."""
    return S.data_dictionary(t("documents"))
