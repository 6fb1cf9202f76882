"""Feeds of rated items as entities and reviews: column layouts, one normalisation, precedence between feeds.

A layout names the columns of one feed's file; whatever their names, dotted ones too, a laid-out feed has the same columns as every
other, so feeds are merged, normalised and ranked as one table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as N, text as T
from . import ranking as R
from .joins import three_feed_merge

ENTITY = [
    "key", "name", "roaster", "origin_country", "origin_region", "process", "roast_level", "is_decaf", "decaf_process", "acidity", "body", "flavor_tags",
    "flavor_summary", "altitude_m", "variety", "attr_label_source", "source", "source_url", "collected_at",
]
KINDS = {"is_decaf": "boolean", "acidity": "int", "body": "int", "altitude_m": "int", "flavor_tags": "array<string>", "attr_label_source": "map<string,string>"}


@dataclass(frozen=True)
class Layout:
    """Where a feed has its fields: field -> column, or columns that are joined. ``texts`` are joined by line feeds, ``places`` by
    commas, ``subs`` are further scores by name."""

    fields: dict[str, str]
    texts: tuple[str, ...] = ()
    places: tuple[str, ...] = ()
    subs: tuple[str, ...] = field(default=())


def _own(df: DataFrame, name: str | None) -> Column:
    """A column by its exact name, blanks and empty cells as NULL; NULL if the feed lacks it."""
    return T.clean(F.col(f"`{name}`").cast("string")) if name in df.columns else F.lit(None).cast("string")


def laid_out(df: DataFrame, layout: Layout, order: str) -> DataFrame:
    """url, roaster, name, origin, roast, acid, body, rating, summary, text, subs and ``i`` (the feed's ``order``)."""
    get = lambda f: _own(df, layout.fields.get(f))
    places = [_own(df, c) for c in layout.places] or [get("origin")]
    subs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c), T.number(_own(df, c)).alias("v")) for c in layout.subs]), lambda x: x["v"].isNotNull())) if layout.subs else F.lit(None)
    subs = subs.cast("map<string,double>")
    return df.select(
        get("url").alias("url"), get("roaster").alias("roaster"), get("name").alias("name"), F.nullif(F.concat_ws(", ", *places), F.lit("")).alias("origin"), get("roast").alias("roast"),
        T.number(get("acid")).alias("acid"), T.number(get("body")).alias("body"), T.number(get("rating")).alias("rating"), get("summary").alias("summary"),
        N.join_text(*[_own(df, c) for c in layout.texts]).alias("text") if layout.texts else F.lit(None).cast("string").alias("text"),
        F.when(F.size(subs) > 0, subs).alias("subs"), F.col(order).cast("long").alias("i"),
    )


def _entities(rows: DataFrame, **columns: Column) -> DataFrame:
    """The columns of an entity; those that a feed doesn't tell are NULL."""
    return rows.select(*[columns.get(c, F.lit(None)).cast(KINDS.get(c, "string")).alias(c) for c in ENTITY], "__i")


def _ranked(rows: DataFrame, label: str) -> tuple[DataFrame, Column]:
    """acidity and body as quintiles of the feed's scores, and the map of which of them has a value."""
    for score, out in (("acid", "__acidity"), ("body", "__body")):
        rows = R.quintile(rows, [], score, out)
    told = F.array(*[F.struct(F.lit(n), F.when(F.col(c).isNotNull(), F.lit(label)).alias("v")) for n, c in (("acidity", "__acidity"), ("body", "__body"))])
    return rows, F.map_from_entries(F.filter(told, lambda x: x["v"].isNotNull()))


def review_feed(first: DataFrame, second: DataFrame, third: DataFrame, source: str, prefix: str, collected_at: str) -> tuple[DataFrame, DataFrame]:
    """(entities, reviews) of three laid-out feeds of one reviewing site.

    They are merged by ``three_feed_merge``: the second feed fills the first's gaps by URL, the third those of the same roaster and
    name, and both add what is new. Scores become quintiles among all merged rows. A row with a text gives a review.
    """
    merged = three_feed_merge(first, second, third, "url", "roaster", "name", "i")
    identity = F.concat(F.lower(F.coalesce("roaster", F.lit(""))), F.lit("|"), F.lower(F.coalesce("name", F.lit(""))))
    rows = merged.withColumn("__key", F.concat(F.lit(f"{prefix}:"), F.coalesce("url", identity)))
    rows, sources = _ranked(rows, "review_score")
    decaf, process = N.decaf(F.col("name"), F.col("text"))
    entities = _entities(
        rows.withColumn("__i", F.lit(0)), key=F.col("__key"), name=F.coalesce("name", F.lit("(unknown)")), roaster=F.col("roaster"), origin_country=N.country(F.col("origin")), origin_region=F.col("origin"),
        process=N.ladder(F.col("text"), N.PROSE_PROCESSES), roast_level=N.roast(F.col("roast")), is_decaf=decaf, decaf_process=process, acidity=F.col("__acidity"), body=F.col("__body"),
        attr_label_source=sources, flavor_summary=F.col("summary"), source=F.lit(source), source_url=F.col("url"), collected_at=F.lit(collected_at),
    )
    reviews = rows.where(F.col("text").isNotNull()).select(
        F.concat(F.lit("review:"), "__key").alias("key"), F.col("__key").alias("coffee_key"), "text", "rating", F.coalesce("subs", F.from_json(F.lit("{}"), "map<string,double>")).alias("sub_scores"),
        F.lit(source).alias("source"), F.col("url").alias("source_url"), F.lit(collected_at).alias("collected_at"),
    )
    return entities, reviews


def cupping_feed(files: dict[str, tuple[DataFrame, Layout, str]], order: str, source: str, collected_at: str) -> DataFrame:
    """Entities of cupping tables: file -> (rows, layout, where it is from). Layouts name country, region, farm, process, acid, body,
    owner, company, altitude and variety. A row's key is its file and its number (``order``, from 0); scores become quintiles
    among the rows of all files."""
    parts = []
    for name, (df, layout, url) in files.items():
        get = lambda f, df=df, layout=layout: _own(df, layout.fields.get(f)).alias(f)
        told = [get(f) for f in ("country", "region", "farm", "process", "owner", "company", "altitude", "variety")]
        scores = [T.number(_own(df, layout.fields.get(f))).alias(f) for f in ("acid", "body")]
        parts.append(df.select(F.concat(F.lit(f"{source}:{name}:"), F.col(order).cast("string")).alias("__key"), *told, *scores, F.lit(url).alias("url"), F.col(order).cast("long").alias("__i")))
    rows, sources = _ranked(reduce(DataFrame.unionByName, parts), f"{source}_quality")
    decaf, process = N.decaf(F.col("owner"), F.col("company"), F.col("farm"))
    return _entities(
        rows, key=F.col("__key"), name=F.coalesce(F.nullif(F.concat_ws(" ", "country", "region", "farm"), F.lit("")), F.lit("sample")), origin_country=N.country(F.col("country")),
        origin_region=F.col("region"), process=N.ladder(F.col("process"), N.LABEL_PROCESSES), is_decaf=decaf, decaf_process=process, acidity=F.col("__acidity"), body=F.col("__body"),
        attr_label_source=sources, altitude_m=N.altitude(F.col("altitude")), variety=F.col("variety"), source=F.lit(source), source_url=F.col("url"), collected_at=F.lit(collected_at),
    )


def listing_feed(df: DataFrame, layout: Layout, order: str, source: str, collected_at: str) -> DataFrame:
    """Entities of a shop listing: ids, titles, labels and paths of tasting notes, of which the leaves are tags."""
    get = lambda f: _own(df, layout.fields.get(f))
    title, notes = F.coalesce(get("name"), F.lit("(unknown)")), get("notes")
    decaf, process = N.decaf(title, notes)
    return _entities(
        df.withColumn("__i", F.col(order).cast("long")), key=F.concat(F.lit(f"{source}:"), get("id")), name=title, roaster=get("roaster"), origin_country=N.country(get("country")), origin_region=get("region"),
        process=N.ladder(get("process"), N.LABEL_PROCESSES), roast_level=N.roast(get("roast")), is_decaf=decaf, decaf_process=process,
        flavor_tags=T.path_leaves(F.lower(notes)), flavor_summary=notes, source=F.lit(source), source_url=get("url"), collected_at=F.lit(collected_at),
    )


def normalised(feeds: list[DataFrame], reviews: list[DataFrame], excluded: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, reviews, counts) of all feeds, in the order of their precedence.

    Of a URL that several sources have, the first feed's entities stay; of equal keys the first row. Reviews follow their
    entities. ``excluded(source)`` leaves whole sources out. counts: (source, read, kept).
    """
    placed = [df.withColumn("__feed", F.lit(i)) for i, df in enumerate(feeds)]
    every = reduce(DataFrame.unionByName, placed)
    if excluded is not None:
        every = every.where(~F.coalesce(excluded(F.col("source")), F.lit(False)))
    owned = R.owned_by_first(every, "source_url", "source", ["__feed", "__i", "key"])
    entities = R.first_by(owned, ["key"], [F.col("__feed"), F.col("__i")]).drop("__feed", "__i")
    told = reduce(DataFrame.unionByName, reviews) if reviews else None
    kept = R.first_by(told.join(entities.select(F.col("key").alias("coffee_key")), "coffee_key", "left_semi"), ["key"], [F.col("text")]) if reviews else None
    counts = every.groupBy("source").agg(F.count(F.lit(1)).alias("read")).join(entities.groupBy("source").agg(F.count(F.lit(1)).alias("kept")), "source", "left")
    return entities, kept, counts.select("source", "read", F.coalesce("kept", F.lit(0)).alias("kept"))
