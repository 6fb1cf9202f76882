"""Queries: fitted models judged on groups they did not see. The SQL solves the same two-feature ridges in closed form."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import aggregates as A, joins as J, learning as L, tagmodels as TM
from .base import Registry
from .joins import ALL_KNN_SQL, KNN_SQL

registry = Registry()
query = registry.add

ROWS_SQL = """rows AS (SELECT p_partkey AS k, p_brand AS g, p_type AS origin, p_size / CAST(10 AS DOUBLE) AS x, CAST(p_partkey % 7 AS DOUBLE) AS z,
        CASE WHEN p_partkey % 10 < 5 THEN 'gauge' WHEN p_partkey % 10 < 8 THEN 'A' ELSE 'B' END AS kind,
        least(5.0, greatest(1.0, 1 + p_size / CAST(15 AS DOUBLE) + ((p_partkey * 7) % 11 - 5) * CAST(0.25 AS DOUBLE) + (p_partkey % 7) * CAST(0.1 AS DOUBLE))) AS y,
        CASE WHEN p_partkey % 4 <> 0 THEN 3 + (p_size - 25) / CAST(20 AS DOUBLE) END AS weak FROM part)"""
CELLS_SQL = """cells AS (SELECT g, kind, count(*) AS n, sum(x) AS sx, sum(z) AS sz, sum(y) AS sy, sum(x * x) AS sxx, sum(x * z) AS sxz, sum(z * z) AS szz, sum(x * y) AS sxy, sum(z * y) AS szy
    FROM rows GROUP BY g, kind), groups AS (SELECT DISTINCT g FROM rows)"""


def _rows(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    y = 1 + size / 15 + ((k * 7) % 11 - 5) * 0.25 + (k % 7) * 0.1
    kind = F.when(k % 10 < 5, "gauge").when(k % 10 < 8, "A").otherwise("B")
    return t("part").select(
        k.alias("k"), F.col("p_brand").alias("g"), F.col("p_type").alias("origin"), (size / 10).alias("x"), (k % 7).cast("double").alias("z"), kind.alias("kind"),
        L.clamp(y, 1.0, 5.0).alias("y"), F.when(k % 4 != 0, 3 + (size - 25) / 20).alias("weak"),
    )


def _solved(keys: str, source: str) -> str:
    """CTEs m and f: the weights w0, w1, w2 for each of ``keys``. ``source``: FROM clause over ways w, cells c and the folds."""
    weight = "(CASE c.kind WHEN 'gauge' THEN 1.0 WHEN 'A' THEN wa ELSE wb END)::DOUBLE"
    mean = "sum(c.sy) FILTER (c.kind = '{0}') / sum(c.n) FILTER (c.kind = '{0}')"
    shift = "coalesce(CASE WHEN c.kind = 'B' THEN shift END, 0)"
    sums = ", ".join(f"sum({weight} * c.s{a}) AS s{a}" for a in ("x", "z", "xx", "xz", "zz"))
    on = " AND ".join(f"h.{k} = {e}" for k, e in (x.split(" AS ")[::-1] for x in keys.split(", ")))
    names = ", ".join(x.split(" AS ")[1] for x in keys.split(", "))
    return f"""h AS (SELECT {keys}, {mean.format("B")} - {mean.format("gauge")} AS shift {source} GROUP BY {", ".join(x.split(" AS ")[0] for x in keys.split(", "))}),
    m AS (SELECT {keys}, any_value(alpha) AS alpha, any_value(use_x) AS use_x, any_value(use_z) AS use_z, sum({weight} * c.n) AS n, {sums}, sum({weight} * (c.sy - {shift} * c.n)) AS sy,
        sum({weight} * (c.sxy - {shift} * c.sx)) AS sxy, sum({weight} * (c.szy - {shift} * c.sz)) AS szy {source.replace(" WHERE ", f" JOIN h ON {on} WHERE ")} GROUP BY {", ".join(x.split(" AS ")[0] for x in keys.split(", "))}),
    d AS (SELECT {names}, n, sx, sz, sy, use_x, use_z, sxx - sx * sx / n + alpha AS a, sxz - sx * sz / n AS b, szz - sz * sz / n + alpha AS c, sxy - sx * sy / n AS d, szy - sz * sy / n AS e FROM m),
    w AS (SELECT *, CASE WHEN use_x AND use_z THEN (d * c - b * e) / (a * c - b * b) WHEN use_x THEN d / a ELSE 0 END AS w1, CASE WHEN use_x AND use_z THEN (a * e - b * d) / (a * c - b * b) WHEN use_z THEN e / c ELSE 0 END AS w2 FROM d),
    f AS (SELECT {names}, (sy - w1 * sx - w2 * sz) / n AS w0, w1, w2 FROM w)"""


_WAYS = "ways AS (SELECT * FROM (VALUES {}) AS v(place, name, alpha, wa, wb, use_x, use_z))"
_HELD = _solved("w.name AS name, o.g AS held", "FROM ways w, groups o JOIN cells c ON c.g <> o.g WHERE true")
_PRED = "least(5.0, greatest(1.0, f.w0 + f.w1 * r.x + f.w2 * r.z))"
_SCORES = "CAST(count(*) AS BIGINT) AS n, round(avg(abs(pred - y)), 6) AS mae, round(avg(CAST(abs(pred - y) <= 1 AS INT)), 6) AS within_1"
ALPHAS = "(0, '1', 1.0, 0, 0, true, true), (1, '300', 300.0, 0, 0, true, true), (2, '9000', 9000.0, 0, 0, true, true)"
RECIPES = "(0, 'base', 1.0, 0, 0, true, true), (1, '+A', 1.0, 0.5, 0, true, true), (2, '+B', 1.0, 0, 0.3, true, true), (3, '+A+B', 1.0, 0.5, 0.3, true, true)"
SUBSETS = "(0, 'all', 1.0, 0, 0, true, true), (1, 'x', 1.0, 0, 0, true, false), (2, 'z', 1.0, 0, 0, false, true)"
_ALPHAS = [L.Candidate(str(a), float(a), {"gauge": 1.0}) for a in (1, 300, 9000)]
_RECIPES = [
    L.Candidate("base", 1.0, {"gauge": 1.0}), L.Candidate("+A", 1.0, {"gauge": 1.0, "A": 0.5}),
    L.Candidate("+B", 1.0, {"gauge": 1.0, "B": 0.3}, ("B",)), L.Candidate("+A+B", 1.0, {"gauge": 1.0, "A": 0.5, "B": 0.3}, ("B",)),
]
_SUBSETS = [L.Candidate("all", 1.0, {"gauge": 1.0}), L.Candidate("x", 1.0, {"gauge": 1.0}, features=("x",)), L.Candidate("z", 1.0, {"gauge": 1.0}, features=("z",))]


def _nested_sql(ways: str, order: str) -> str:
    """The candidate that is best inside each held-out group's rest, and its errors outside."""
    inner = _solved("w.name AS name, o.g AS outside, i.g AS inside", "FROM ways w, groups o, groups i JOIN cells c ON c.g <> o.g AND c.g <> i.g WHERE o.g <> i.g")
    rename = lambda sql, s: sql.replace("h AS (", f"h{s} AS (").replace("JOIN h ON", f"JOIN h{s} h ON").replace("m AS (", f"m{s} AS (").replace("FROM m)", f"FROM m{s})").replace("    d AS (", f"    d{s} AS (").replace("FROM d)", f"FROM d{s})").replace("    w AS (", f"    w{s} AS (").replace("FROM w)", f"FROM w{s})").replace("    f AS (", f"    f{s} AS (")
    return f"""WITH {ROWS_SQL}, {CELLS_SQL}, {_WAYS.format(ways)}, {rename(inner, 1)}, {rename(_HELD, 2)},
    s AS (SELECT f.name, f.outside, round(avg(abs({_PRED} - y)), 9) AS mae, round(avg(CAST(abs({_PRED} - y) <= 1 AS INT)), 9) AS near FROM rows r JOIN f1 f ON f.inside = r.g WHERE r.kind = 'gauge' GROUP BY 1, 2),
    p AS (SELECT s.outside AS g, s.name FROM s JOIN ways USING (name) QUALIFY row_number() OVER (PARTITION BY outside ORDER BY {order}, place) = 1),
    o AS (SELECT r.g, p.name AS candidate, y, {_PRED} AS pred FROM rows r JOIN p ON p.g = r.g JOIN f2 f ON f.held = r.g AND f.name = p.name WHERE r.kind = 'gauge')
    SELECT g, candidate, {_SCORES} FROM o GROUP BY g, candidate"""


def _scored(rows, *keys):
    error = F.abs(F.col("pred") - F.col("y"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(error), 6).alias("mae"), F.round(F.avg((error <= 1).cast("int")), 6).alias("within_1"))


@query(_nested_sql(ALPHAS, "mae"))
def nested_ridge(t):
    """Ridge by group: the strength chosen on the other groups, the errors on a group no part of it saw."""
    return _scored(L.nested(_rows(t), ["x", "z"], "y", "g", _ALPHAS, "kind"), "g", "candidate")


@query(_nested_sql(RECIPES, "near DESC, mae"))
def nested_recipes(t):
    """The recipe of label sources that is best on the other groups, judged on the one left out."""
    return _scored(L.nested(_rows(t), ["x", "z"], "y", "g", _RECIPES, "kind", by="within_1"), "g", "candidate")


def _held_sql(ways: str, select: str, where: str = "r.kind = 'gauge'") -> str:
    return f"WITH {ROWS_SQL}, {CELLS_SQL}, {_WAYS.format(ways)}, {_HELD}, p AS (SELECT f.name AS candidate, r.*, {_PRED} AS pred FROM rows r JOIN f ON f.held = r.g WHERE {where}) {select}"


def _held(t, candidates):
    rows = _rows(t)
    return L.held_out(rows.where("kind = 'gauge'"), L.Grams(rows, ["x", "z"], "y", "g", "kind"), "g", candidates)


@query(_held_sql(RECIPES, f"SELECT candidate, {_SCORES} FROM p GROUP BY candidate"))
def recipe_ablation(t):
    """Label sources added with weights, weak labels shifted to the gauges' mean; each group predicted from the others."""
    return _scored(_held(t, _RECIPES), "candidate")


@query(_held_sql(SUBSETS, f"SELECT candidate, {_SCORES} FROM p GROUP BY candidate"))
def subset_ablation(t):
    """What each feature is worth on groups left out."""
    return _scored(_held(t, _SUBSETS), "candidate")


@query(_held_sql(SUBSETS, """SELECT candidate, rule, round(avg(CAST(told AS INT)), 6) AS coverage, round(avg(CASE WHEN told THEN CAST(abs(pred - y) <= 1 AS INT) END), 6) AS within_1, round(avg(CASE WHEN told THEN abs(pred - y) END), 6) AS mae
    FROM (SELECT *, 'always' AS rule, true AS told FROM p UNION ALL SELECT *, 'has weak', weak IS NOT NULL FROM p UNION ALL SELECT *, 'near weak', coalesce(abs(pred - weak) <= 1, false) FROM p) GROUP BY 1, 2"""))
def recipe_answers(t):
    """Recipes with and without a feature, under rules that withhold answers."""
    rules = {"always": F.lit(True), "has weak": F.col("weak").isNotNull(), "near weak": F.abs(F.col("pred") - F.col("weak")) <= 1}
    return L.answered(_held(t, _SUBSETS), rules, "pred", "y", ["candidate"])


def _offset_sql() -> str:
    """Five rounds of offsets and weights, each from the sums by group."""
    base = f"WITH {ROWS_SQL}, {CELLS_SQL}, c AS (SELECT * FROM cells WHERE kind = 'gauge'), o0 AS (SELECT g, CAST(0 AS DOUBLE) AS off FROM c)"
    for i in range(6):
        base += f""", t{i} AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sz) AS sz, sum(sy - off * n) AS sy, sum(sxx) AS sxx, sum(sxz) AS sxz, sum(szz) AS szz, sum(sxy - off * sx) AS sxy, sum(szy - off * sz) AS szy FROM c JOIN o{i} USING (g)),
    d{i} AS (SELECT *, sxx - sx * sx / n + 1 AS a, sxz - sx * sz / n AS b, szz - sz * sz / n + 1 AS cc, sxy - sx * sy / n AS d, szy - sz * sy / n AS e FROM t{i}),
    w{i} AS (SELECT (d * cc - b * e) / (a * cc - b * b) AS w1, (a * e - b * d) / (a * cc - b * b) AS w2, (sy - (d * cc - b * e) / (a * cc - b * b) * sx - (a * e - b * d) / (a * cc - b * b) * sz) / n AS w0 FROM d{i}),
    o{i + 1} AS (SELECT g, (sy - w0 * n - w1 * sx - w2 * sz) / (n + 10) AS off FROM c, w{i})"""
    return base + ' SELECT g, round(off, 6) AS "offset" FROM o6'


@query(_offset_sql())
def group_offset_ridge(t):
    """Weights and shrunken group offsets, fitted in turn."""
    rows = _rows(t).where("kind = 'gauge'")
    found = L.Grams(rows, ["x", "z"], "y", "g").offsets(L.Candidate("offsets", 1.0, shrink=10.0))
    return found.withColumn("offset", F.round("offset", 6))


_AVERAGE_RANKS = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0"
_RHO = "round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 6) AS rho"


@query(f"""WITH {ROWS_SQL}, k AS (SELECT * FROM rows WHERE kind = 'gauge'), pool AS (SELECT avg(weak) AS m FROM rows WHERE kind = 'B'), tot AS (SELECT sum(y) AS s, count(*) AS n FROM k),
    gs AS (SELECT g, sum(y) AS s, count(*) AS n FROM k GROUP BY g), os AS (SELECT origin, sum(y) AS s, count(*) AS n FROM k GROUP BY 1), go AS (SELECT g, origin, sum(y) AS s, count(*) AS n FROM k GROUP BY 1, 2),
    h AS (SELECT k.*, (tot.s - gs.s) / (tot.n - gs.n) AS others, os.n - go.n AS m, (os.s - go.s) / nullif(os.n - go.n, 0) AS same FROM k JOIN gs USING (g) JOIN os USING (origin) JOIN go USING (g, origin), tot WHERE weak IS NOT NULL),
    c AS (SELECT weak - (pool.m - others) AS c, CASE WHEN h.m >= 2 THEN same ELSE others END AS base, y, 1 AS one FROM h, pool), r AS (SELECT *, {_AVERAGE_RANKS.format("one", "c")} AS ra, {_AVERAGE_RANKS.format("one", "y")} AS rb FROM c)
    SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(abs(c - y) <= 1 AS INT)), 6) AS weak_within_1, round(avg(CAST(abs(base - y) <= 1 AS INT)), 6) AS origin_within_1, {_RHO},
        avg(CAST(abs(c - y) <= 1 AS INT)) > avg(CAST(abs(base - y) <= 1 AS INT)) AS beats FROM r""")
def weak_label_gate(t):
    """Weak labels against the mean of the origin in other groups."""
    rows = _rows(t)
    pool = rows.where("kind = 'B'").agg(F.avg("weak")).first()[0]
    return L.weak_gate(rows.where("kind = 'gauge'"), "g", "origin", "y", "weak", pool if pool is not None else 3.0)


_ALL = _solved("w.name AS name", "FROM ways w, cells c WHERE true")


def _transfer_sql(model: str, source: str) -> str:
    return f"""{model}, q AS (SELECT r.origin AS store, r.{source[0]} AS y, {_PRED} AS pred FROM rows r, f WHERE {source[1]}), v AS (SELECT store, avg(y) AS m FROM q GROUP BY 1),
    k AS (SELECT *, round(pred, 6) AS p FROM q JOIN v USING (store)), r AS (SELECT *, {_AVERAGE_RANKS.format("store", "p")} AS ra, {_AVERAGE_RANKS.format("store", "y")} AS rb FROM k)
    SELECT store, {_SCORES}, round(avg(abs(m - y)), 6) AS mean_mae, {_RHO} FROM r GROUP BY store"""


@query(_transfer_sql(f"WITH {ROWS_SQL}, {CELLS_SQL}, {_WAYS.format(RECIPES.split(', (1')[0])}, {_ALL}", ("y", "kind = 'A'")))
def transfer_by_store(t):
    """A model of one label source on another's labels, by store."""
    rows = _rows(t)
    weights = L.Grams(rows, ["x", "z"], "y", "g", "kind").fit(_RECIPES[0])
    return L.transfer(rows.where("kind = 'A'").withColumnRenamed("origin", "store"), weights, ["x", "z"], "y", "store")


@query(_transfer_sql(f"WITH {ROWS_SQL}, f AS (SELECT CAST(1.5 AS DOUBLE) AS w0, CAST(0.6 AS DOUBLE) AS w1, CAST(0.05 AS DOUBLE) AS w2)", ("weak", "weak IS NOT NULL")))
def foreign_scale(t):
    """A shipped model on labels of a foreign scale: its errors, those of the mean, and the rank correlation."""
    return L.transfer(_rows(t).withColumnRenamed("origin", "store"), [1.5, 0.6, 0.05], ["x", "z"], "weak", "store")


@query(f"""WITH {ROWS_SQL}, tot AS (SELECT sum(y) AS s, count(*) AS n FROM rows), gs AS (SELECT g, sum(y) AS s, count(*) AS n FROM rows GROUP BY g),
    p AS (SELECT r.g, y, coalesce(weak, (tot.s - gs.s) / (tot.n - gs.n)) AS pred FROM rows r JOIN gs USING (g), tot) SELECT g, {_SCORES} FROM p GROUP BY g""")
def filled_predictions(t):
    """Predictions, filled with the other groups' mean where there is none."""
    rows = L.or_others_mean(_rows(t), "weak", "y", "g").withColumn("pred", F.col("filled"))
    return _scored(rows, "g")


@query(None)
def vector_model_pick(t):
    """The ridge strength on embeddings that is best on held-out folds."""
    v = t("embeddings").select("embedding", "label", F.pmod(F.xxhash64("vec_id"), F.lit(5)).alias("fold"))
    return L.pick_vector_model(v, "embedding", "label", "fold", [0.1, 1.0, 10.0, 1e9])


def _tagged(t):
    size, k = F.col("p_size"), F.col("p_partkey")
    tags = F.concat(F.split("p_name", " "), F.when(size > 25, F.array(F.lit("bulky"))).otherwise(F.array().cast("array<string>")))
    return t("part").select(k.alias("k"), (size / 50).alias("size"), (F.pmod(k, F.lit(10)) / 10).alias("digit"), tags.alias("tags"), F.pmod(F.crc32("p_brand"), F.lit(3)).alias("fold"))


@query(None)
def tag_models(t):
    """One-versus-rest models of all words of names, on groups they did not see; each fold's threshold from models that saw neither
    it nor the rows it was picked on."""
    rows = _tagged(t)
    words = [r.tag for r in rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n >= 30").select("tag").collect()]
    told = TM.decided_tags(rows, "k", ["size", "digit"], "tags", "fold", words, [0.1, 0.15, 0.2, 0.3, 0.5])
    sums = told.groupBy("fold", "threshold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for c, n in zip(A.set_counts(F.col("truth"), F.col("tags")), ("tp", "fp", "fn"), strict=True)])
    return sums.select("fold", "threshold", "n", *A.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query(None)
def boosted_baseline(t):
    """Feature importances of a boosted regression, and its error on rows it did not see beside the mean's."""
    rows = t("part").select((F.col("p_size") / 1).alias("size"), (F.col("p_partkey") % 10).cast("double").alias("digit"), "p_retailprice", "p_brand")
    importance, errors = L.boosted_baseline(rows, ["size", "digit"], "p_retailprice", F.pmod(F.crc32("p_brand"), F.lit(4)) == 0)
    return importance.crossJoin(F.broadcast(errors)).select("feature", *[F.round(c, 6).alias(c) for c in ("importance", "mae", "mean_mae")])


SETS_SQL = """s AS (SELECT p_type, string_split(p_name, ' ') AS truth, [split_part(p_name, ' ', 1 + CAST(p_partkey % 2 AS INT)), CASE WHEN p_partkey % 3 = 0 THEN 'red' ELSE 'gear' END] AS model,
        CASE WHEN p_type <> 'SMALL' THEN [split_part(p_name, ' ', 1), CASE WHEN p_size > 30 THEN split_part(p_name, ' ', 2) ELSE 'rod' END] ELSE ['none'] END AS vote FROM part),
    c AS (SELECT p_type, sum(len(list_intersect(truth, model))) AS tm, sum(len(list_distinct(model))) AS gm, sum(len(list_intersect(truth, vote))) AS tv, sum(len(list_distinct(vote))) AS gv, sum(len(list_distinct(truth))) AS h FROM s GROUP BY 1)"""


@query(f"""WITH {SETS_SQL}, f AS (SELECT p_type, round(2 * tm / CAST(gm + h AS DOUBLE), 6) AS model_f1, round(2 * tv / CAST(gv + h AS DOUBLE), 6) AS vote_f1 FROM c) SELECT *, model_f1 >= vote_f1 + 0.05 - 1e-9 AS ship FROM f""")
def category_feasibility(t):
    """Whether a model's tags beat the vote's by enough, by category."""
    word = lambda i: F.element_at(F.split("p_name", " "), i)
    k = F.col("p_partkey")
    rows = t("part").select(
        "p_type", F.split("p_name", " ").alias("truth"), F.array(word((1 + k % 2).cast("int")), F.when(k % 3 == 0, "red").otherwise("gear")).alias("model"),
        F.when(F.col("p_type") != "SMALL", F.array(word(F.lit(1)), F.when(F.col("p_size") > 30, word(F.lit(2))).otherwise("rod"))).otherwise(F.array(F.lit("none"))).alias("vote"),
    )

    def f1(guess):
        sums = rows.select("p_type", *A.set_counts(F.col("truth"), F.col(guess))).groupBy("p_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        return sums.select("p_type", *A.prf(F.col("tp"), F.col("fp"), F.col("fn")))

    return L.ships(f1("model"), f1("vote"), "p_type")


def _near(t, where="true"):
    v = t("embeddings").select("vec_id", "embedding", "label")
    return J.knn(v.where("vec_id % 100 = 0"), v.where(where).drop("label"), key="vec_id", vector="embedding", k=10), v


_VARIANT = """r{0} AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS rank FROM s WHERE {1}),
    p{0} AS (SELECT query, sum(greatest(sim, 0.01) * l.label) / sum(greatest(sim, 0.01)) AS pred FROM r{0} JOIN u l ON l.vec_id = neighbor WHERE rank <= 10 GROUP BY query)"""
_PICK = "SELECT '{1}' AS variant, CAST(count(*) AS BIGINT) AS n, round(avg(abs(pred - label)), 4) AS mae, true AS same_targets FROM p{0} JOIN u ON query = vec_id"


@query(KNN_SQL + f", {_VARIANT.format(0, 'true')}, {_VARIANT.format(1, 'neighbor % 2 = 0')} {_PICK.format(0, 'full')} UNION ALL {_PICK.format(1, 'open')}")
def compare_variants(t):
    """Pools compared on identical targets, which their fingerprints prove."""
    out = []
    for name, where in (("full", "true"), ("open", "vec_id % 2 = 0")):
        near, v = _near(t, where)
        rows = near.join(v.select(F.col("vec_id").alias("neighbor"), F.col("label").cast("double").alias("a")), "neighbor")
        w = F.greatest("similarity", F.lit(0.01))
        pred = rows.groupBy(F.col("query").alias("vec_id")).agg((F.sum(w * F.col("a")) / F.sum(w)).alias("pred"))
        out.append((name, pred.join(v.select("vec_id", "label"), "vec_id")))
    return A.compare_variants(dict(out), "vec_id", "pred", "label").withColumn("mae", F.round("mae", 4))


@query(KNN_SQL + " SELECT 'knn' AS run, CAST(count(*) AS BIGINT) AS n, true AS identical FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS rank FROM s) WHERE rank <= 10")
def repeated_run(t):
    """Two runs over differently dealt rows give the same neighbours."""
    dealt = lambda n: (lambda name: t(name).repartition(n))
    runs = [_near(dealt(n))[0].withColumn("similarity", F.round("similarity", 9)) for n in (3, 5)]
    return L.same_result("knn", *runs)


@query(ALL_KNN_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS rank FROM s), j AS (SELECT query, greatest(sim, 0.01) AS w, CAST(l.label AS DOUBLE) AS v FROM r JOIN u l ON l.vec_id = neighbor WHERE rank <= 10),
    m AS (SELECT query, sum(w * v) / sum(w) AS pred FROM j GROUP BY query), d AS (SELECT query, any_value(pred) AS pred, round(sqrt(sum(w * (v - pred) * (v - pred)) / sum(w)), 9) AS spread FROM j JOIN m USING (query) GROUP BY query)
    SELECT CASE WHEN spread <= 0.7 THEN 'high' WHEN spread <= 1.2 THEN 'medium' ELSE 'low' END AS confidence, query % 3 AS source, CAST(count(*) AS BIGINT) AS n, round(avg(abs(pred - label)), 4) AS mae, round(avg(CAST(abs(pred - label) <= 1 AS INT)), 6) AS within_1
    FROM d JOIN u ON vec_id = query GROUP BY 1, 2""")
def loo_by_confidence(t):
    """Leave-one-out errors of all vectors, by the neighbours' agreement and by source."""
    v = t("embeddings").select("vec_id", "embedding", "label")
    near = J.knn(v, v.drop("label"), key="vec_id", vector="embedding", k=10, block=16384)
    labels = v.select(F.col("vec_id").alias("neighbor"), F.col("label").cast("double").alias("pred"))
    stats = A.weighted_stats(near.join(labels, "neighbor"), "query", "similarity", ["pred"])
    rows = stats.join(v.select(F.col("vec_id").alias("query"), F.col("label").alias("y")), "query")
    out = _scored(rows, "confidence", (F.col("query") % 3).alias("source"))
    return out.withColumn("mae", F.round("mae", 4))


@query("""WITH a AS (SELECT item_id, length(text) <= 300 AS short, NOT regexp_matches(text, '[0-9]') AS plain FROM benchmark)
    SELECT item_id, short AND plain AS ok, CASE WHEN item_id % 3 = 0 THEN item_id % 2 = 0 ELSE coalesce(CASE WHEN item_id % 4 <> 0 THEN short END, short AND plain) END AS ok_before FROM a""")
def rescored_rows(t):
    """Saved judgements under a new check; what was recorded first stays beside it."""
    k, text = F.col("item_id"), F.col("text")
    short = F.length("text") <= 300
    saved = t("benchmark").select(k, text, F.when(k % 4 != 0, short).alias("ok"), F.when(k % 3 == 0, k % 2 == 0).alias("ok_before"))
    return A.rescored(saved, {"ok": short & ~text.rlike("[0-9]")}).select("item_id", "ok", "ok_before")


_NET_SQL = """x AS (SELECT vec_id, unnest(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS v, unnest(range(64)) AS i FROM embeddings),
    h AS (SELECT vec_id, j, greatest(sum(v * (((i * 7 + j * 3) % 11) - 5) / 2.0) + 0.1 * j, 0) AS v FROM x, (SELECT unnest(range(8)) AS j) GROUP BY 1, 2),
    o AS (SELECT vec_id, k, 1 / (1 + exp(-(sum(v * (((j * 5 + k * 2) % 7) - 3) / 2.0) - 0.2 * k))) AS p FROM h, (SELECT unnest(range(6)) AS k) GROUP BY 1, 2)"""


@query(f"""WITH {_NET_SQL} SELECT vec_id, 'tag' || k AS tag, round(p, 6) AS p, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS INT) AS rank FROM o WHERE p >= 0.5) WHERE rank <= 3""")
def network_tags(t):
    """Labels of a two-layer network over whole vectors: at least a threshold, at most three."""
    i, j, k = np.arange(64)[:, None], np.arange(8), np.arange(6)
    one = (((i * 7 + j * 3) % 11) - 5) / 2.0
    two = (((np.arange(8)[:, None] * 5 + k * 2) % 7) - 3) / 2.0
    layers = [(one, 0.1 * j, "relu"), (two, -0.2 * k, "sigmoid")]
    found = L.network_tags(t("embeddings"), "vec_id", "embedding", layers, [f"tag{n}" for n in range(6)], 0.5, 3)
    return found.withColumn("p", F.round("p", 6))
