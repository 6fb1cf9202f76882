"""Predicates with reasons, rule tables, ranked search, layered values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import like_escaped


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that fails (is true), NULL if none does; the order matters."""
    out = F
    for name, failed in rules:
        out = out.when(F.coalesce(failed, F.lit(False)), name)
    return out.otherwise(F.lit(None).cast("string"))


#: Most of an item that low-intake guests get, and most of one sold as free of it.
LOW, FREE = 100, 30


def intake_rules(
    rule: Column, decaf: Column, option: Column, mg: Column, remaining: Column, milk: Column, milk_ok: Column, low: float = LOW, free: float = FREE
) -> list[tuple[str, Column]]:
    """Hard limits on what an item may hold, in the order reasons are told. ``option``: it can be ordered decaf.

    An unknown amount fails the budget, and the low limit unless the item is or can be decaf. An item sold as decaf
    that holds much anyway fails both rules.
    """
    capable = decaf | option
    return [
        ("decaf_only", (rule == "decaf_only") & ~capable),
        ("decaf_over_limit", (rule == "decaf_only") & decaf & (mg > free)),
        ("low_limit", (rule == "low") & ~capable & F.coalesce(mg > low, F.lit(True))),
        ("decaf_over_low", (rule == "low") & decaf & (mg > low)),
        ("daily_budget", remaining.isNotNull() & F.coalesce(mg > remaining, F.lit(True))),
        ("milk", ~milk_ok & milk),
    ]


def needs_swap(rule: Column, decaf: Column, option: Column, mg: Column, low: float = LOW) -> Column:
    """Whether the decaf version has to be ordered: always for decaf-only guests, else only if the item isn't low by itself."""
    low_enough = F.coalesce(mg <= low, F.lit(False))
    return option & ~decaf & ((rule == "decaf_only") | ((rule == "low") & ~low_enough))


def served_badly(low: float = LOW, free: float = FREE) -> Column:
    """A check of served items that is written apart from ``intake_rules``, as one SQL condition over the columns rule,
    decaf, option, swap (ordered decaf), mg, remaining, milk and milk_ok."""
    return F.expr(f"""
        CASE rule
            WHEN 'decaf_only' THEN NOT (decaf OR (option AND swap)) OR (decaf AND ifnull(mg, 0) > {free})
            WHEN 'low' THEN CASE WHEN decaf THEN ifnull(mg, 0) > {low} WHEN option THEN false ELSE mg IS NULL OR mg > {low} END
            ELSE false
        END
        OR (milk AND NOT milk_ok)
        OR (remaining IS NOT NULL AND (mg IS NULL OR mg > remaining))""")


def raw_violation(rule: Column, decaf: Column, mg: Column, milk: Column, milk_ok: Column, low: float = LOW, free: float = FREE) -> Column:
    """The reason a raw row breaks the strict rules (no decaf orders; a missing milk label counts as milk), NULL if none."""
    return first_reason([
        ("not decaf", (rule == "decaf_only") & ~decaf),
        ("decaf over limit", (rule == "decaf_only") & (mg > free)),
        ("over low limit or unknown", (rule == "low") & F.coalesce(mg > low, F.lit(True))),
        ("milk or no label", ~milk_ok & F.coalesce(milk, F.lit(True))),
    ])


def item_flags(name_says_decaf: Column, mg: Column, shot: Column, category_listed: Column, trace: float = 15) -> tuple[Column, Column]:
    """(decaf, decaf option) of a menu row: decaf by name or by a trace of caffeine; an option where the group lists the
    category and the item has a shot to swap."""
    decaf = name_says_decaf | F.coalesce(mg <= trace, F.lit(False))
    return decaf, shot & category_listed & ~decaf


def product_filter(df: DataFrame, config: DataFrame, key: str, excluded: str) -> DataFrame:
    """Rows that their store's config accepts. ``df``: key, type, tags, title; ``config``: a row per key with types (array),
    type_pattern, require_tag, exclude_tags (array), each NULL where it doesn't apply. Titles matching ``excluded``
    never pass. A store without a row has no rules but that."""
    c, lower = config.alias("c"), lambda xs: F.transform(xs, F.lower)
    ok = lambda x: F.coalesce(x, F.lit(True))
    kind = F.coalesce(F.col("d.type"), F.lit(""))
    tags = lower(F.coalesce("d.tags", F.array().cast("array<string>")))
    passes = (
        ok((F.size("c.types") <= 0) | F.array_contains("c.types", kind)) & ok(F.regexp_like(kind, F.col("c.type_pattern")))
        & ok(F.array_contains(tags, F.lower("c.require_tag"))) & ok(~F.arrays_overlap(tags, lower(F.col("c.exclude_tags"))))
        & ~F.coalesce(F.col("d.title").rlike(excluded), F.lit(False))
    )
    return df.alias("d").join(c, F.col(f"d.{key}") == F.col(f"c.{key}"), "left").where(passes).select("d.*")


def wanted_rows(df: DataFrame, *, only: list[str] | None = None, without: list[str] | None = None, source: str = "source",
                present: list[str] | None = None, tagged: str | None = None) -> DataFrame:
    """Rows by what is asked for: of some sources, not of others, with attributes present, with at least one tag."""
    rules = []
    if only is not None:
        rules.append(F.col(source).isin(only))
    if without:
        rules.append(~F.coalesce(F.col(source).isin(without), F.lit(False)))
    rules += [F.col(c).isNotNull() for c in present or []]
    if tagged:
        rules.append(F.size(F.coalesce(tagged, F.array().cast("array<string>"))) > 0)
    return df.where(reduce(lambda a, r: a & r, rules, F.lit(True)))


def served(df: DataFrame, active: str, review: str | None = None) -> DataFrame:
    """The rows that browsing shows: active ones that wait for no review. Look-ups by id read the whole table."""
    shown = F.coalesce(F.col(active), F.lit(False))
    return df.where(shown & ~F.coalesce(F.col(review), F.lit(False)) if review else shown)


def exact_name_match(inputs: DataFrame, text: str, input_key: str, names: DataFrame, key: str, name: str, group: str) -> DataFrame:
    """(input, key): the smallest key whose name, or group and name, is the text, case and extra blanks aside."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    alone = names.select(key, F.lower(name).alias("__n"))
    both = names.select(key, F.lower(F.concat_ws(" ", F.coalesce(group, F.lit("")), name)).alias("__n"))
    known = alone.unionByName(both).groupBy("__n").agg(F.min(key).alias(key))
    asked = inputs.select(input_key, plain(F.col(text)).alias("__n")).where("__n != ''")
    return asked.join(known, "__n").select(input_key, key)


def search_ranked(
    df: DataFrame, query: str, *, name: str, also: list[str], key: str, limit: int, synonyms: dict[str, str] | None = None, synonym_of: str | None = None
) -> DataFrame:
    """Rows that contain ``query``: hits in the name first, then shorter names, then the key.

    A query that ``synonyms`` knows also finds the rows whose ``synonym_of`` is what it stands for.
    """
    pattern = like_escaped(query)
    hit = F.col(name).ilike(pattern)
    anywhere = reduce(lambda a, c: a | F.col(c).ilike(pattern), also, hit)
    meant = (synonyms or {}).get(query.strip().lower())
    if meant and synonym_of:
        anywhere = anywhere | (F.col(synonym_of) == meant)
    return df.where(anywhere).orderBy(F.coalesce(hit, F.lit(False)).desc(), F.length(name), F.col(key)).limit(limit)


def first_per_rule(df: DataFrame, rules: list[tuple[str, Column]], key: str) -> DataFrame:
    """(rule, key): each rule's smallest key, in one pass."""
    found = df.agg(*[F.min(F.when(p, F.col(key))).alias(n) for n, p in rules])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias(key)) for n, _ in rules]))
    return found.select(pairs.alias("x")).select("x.*")


def band(value: Column, bounds: list[float], labels: list[str]) -> Column:
    """The label of the first bound the value lies under (the first bound belongs to its band), the last label above all;
    NULL stays."""
    out = F.when(value.isNull(), F.lit(None).cast("string")).when(value <= bounds[0], labels[0])
    for b, label in zip(bounds[1:], labels[1:], strict=False):
        out = out.when(value < b, label)
    return out.otherwise(labels[len(bounds)])


def gap(value: Column, wanted: Column, near: float = 0.5, some: float = 1.5) -> Column:
    """How a value differs from what is wanted, in words."""
    d = value - wanted
    size = F.when(F.abs(d) <= some, "slightly").otherwise("much")
    return F.when(F.abs(d) <= near, "similar").when(d.isNotNull(), F.concat_ws(" ", size, F.when(d > 0, "stronger").otherwise("weaker")))


def fit_level(percent: Column) -> Column:
    return F.when(percent >= 80, "high").when(percent >= 50, "medium").when(percent.isNotNull(), "low")


def fit_score(
    values: dict[str, Column], wanted: dict[str, Column], shares: dict[str, Column], weights: dict[str, Column], halved: dict[str, Column] | None = None,
    attributes: float = 0.6, flavors: float = 0.4,
) -> Column:
    """How well an item fits a preference: closeness of the known attributes and cosine of the flavours, blended.

    An attribute counts half where ``halved`` says so; unknown ones are left out. Flavours are a number for each of few kinds
    (what the item has, what is liked), so the cosine is plain arithmetic. Without attributes or without a cosine the other
    part is the score, without both it is 0.5. The scale's span is 4.
    """
    weight = {a: F.when((halved or {}).get(a, F.lit(False)), 0.5).otherwise(1.0) for a in values}
    known = {a: F.when(v.isNotNull(), weight[a]).otherwise(0.0) for a, v in values.items()}
    close = {a: F.coalesce(weight[a] * (1 - F.abs(wanted[a] - v) / 4), F.lit(0.0)) for a, v in values.items()}
    total = lambda parts: reduce(lambda a, c: a + c, parts.values())
    near = total(close) / F.nullif(total(known), F.lit(0.0))
    product = lambda a, b: reduce(lambda x, y: x + y, (a[k] * b[k] for k in a))
    taste = (product(weights, shares) / F.nullif(F.sqrt(product(weights, weights)) * F.sqrt(product(shares, shares)), F.lit(0.0)) + 1) / 2
    return F.coalesce(attributes * near + flavors * taste, near, taste, F.lit(0.5))


LEVELS = ["low", "medium", "high"]


def cap_confidence(level: Column, missing: Column) -> Column:
    """A level, at most medium with one value missing and low with more."""
    names = F.array(*[F.lit(x) for x in LEVELS])
    most = F.when(missing >= 2, 1).when(missing == 1, 2).otherwise(3)
    return names[F.least(F.array_position(names, level).cast("int"), most) - 1]


def precedence(layers: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value, name) of the first layer with a value."""
    source = F
    for name, value in layers:
        source = source.when(value.isNotNull(), name)
    return F.coalesce(*[v for _, v in layers]), source.otherwise(F.lit(None).cast("string"))


def merged_answer(rule: Column, answer: Column, normaliser: Callable[[Column], Column]) -> tuple[Column, Column]:
    """(value, origin): a rule's value, else a model's answer as the normaliser names it. An answer it doesn't know is none."""
    return precedence([("rule", rule), ("model", normaliser(answer))])


def evidence_counts(rows: DataFrame, source: str, evidence: str, kinds: list[str]) -> DataFrame:
    """(source, candidates, with_evidence, by_<kind>): candidates of each source, those with any evidence, and those of each kind."""
    by = [F.count_if(F.col(evidence) == k).alias(f"by_{k}") for k in kinds]
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("candidates"), F.count(evidence).alias("with_evidence"), *by)


def latest_ok_snapshot(manifest: DataFrame, source: str, snapshot: str, ok: str) -> DataFrame:
    """Each source's newest successful snapshot."""
    return manifest.where(F.col(ok)).groupBy(source).agg(F.max(snapshot).alias(snapshot))


def support_bucket(cue: Column, notes: Column, facts: list[Column]) -> Column:
    """What a value rests on: the text's own words, note words, a known fact, or little."""
    some = F.size(F.coalesce(notes, F.array().cast("array<string>"))) > 0
    return F.when(cue.isNotNull(), "cue").when(some, "notes").when(F.coalesce(*facts).isNotNull(), "facts").otherwise("sparse")


def calibrated_confidence(df: DataFrame, key: str, attribute: str, value: str, bucket: str, levels: DataFrame) -> DataFrame:
    """(key, confidence): the lowest level of a key's attributes that have a value, low if none has.

    A stated value ("cue") is high; other buckets take the level that ``levels`` (attribute, bucket, level) lists, else
    that of the attribute's bucket "*", else low.
    """
    names = F.array(*[F.lit(x) for x in LEVELS])
    table = levels.groupBy(attribute).agg(F.map_from_entries(F.collect_list(F.struct(bucket, "level"))).alias("__t"))
    listed = F.coalesce(F.try_element_at("__t", F.col(bucket)), F.try_element_at("__t", F.lit("*")), F.lit("low"))
    level = F.when(F.col(bucket) == "cue", "high").otherwise(listed)
    place = F.when(F.col(value).isNotNull(), F.array_position(names, level))
    rated = df.join(table, attribute, "left").groupBy(key).agg(F.coalesce(F.min(place), F.lit(1)).alias("__p"))
    return rated.select(key, F.element_at(names, F.col("__p").cast("int")).alias("confidence"))


def value_origin(source: Column, enriched: Column, by_rule: Column, model_ok: Column) -> Column:
    """Where a value comes from: the source, nowhere, a rule, a model's good answer, or unknown."""
    return (
        F.when(source.isNotNull(), "source").when(enriched.isNull(), "none").when(by_rule, "rule").when(model_ok, "model").otherwise("unknown")
    )


def struct_or_else(flag: Column, main: Column, other: Column) -> Column:
    """The other struct where the flag holds, else the main one."""
    return F.when(F.coalesce(flag, F.lit(False)), other).otherwise(main)


def ordered_window(keys: list[str], order: list[Column]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def match_points(values: dict[str, Column], wanted: dict[str, Column | float], near: dict[str, float]) -> tuple[Column, Column]:
    """(matches, misses): the names of what lies within reach of what is wanted, and of what doesn't; unknown values are neither."""
    told = F.array(*[F.struct(F.lit(n).alias("n"), (F.abs(v - wanted[n]) <= near[n]).alias("ok")) for n, v in values.items()])
    names = lambda test: F.transform(F.filter(told, test), lambda x: x["n"])
    return names(lambda x: x["ok"]), names(lambda x: ~x["ok"])


def edited_weights(weights: Column, chosen: Column, least: float = 0.5) -> Column:
    """A preference map after an edit: chosen keys (an array) weigh at least ``least``, others lose positive weights and keep negative ones."""
    return F.transform_values(weights, lambda k, v: F.when(F.array_contains(chosen, k), F.greatest(v, F.lit(least))).when(v > 0, 0.0).otherwise(v))
