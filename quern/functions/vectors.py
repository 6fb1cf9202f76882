"""Column functions over dense vectors (arrays) and sparse ones (maps)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; NULL where one is all zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit_prefix(a: Column, size: int) -> Column:
    """The first ``size`` numbers, scaled to length one; NULL where they are all zero."""
    head = F.slice(a, 1, size)
    length = F.nullif(norm(head), F.lit(0.0))
    return F.transform(head, lambda x: x.cast("double") / length)


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps from key to weight; NULL where one has no length."""
    length = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    shared = F.aggregate(
        F.map_keys(a), F.lit(0.0), lambda s, k: s + F.coalesce(F.try_element_at(a, k) * F.try_element_at(b, k), F.lit(0.0))
    )
    return shared / F.nullif(length(a) * length(b), F.lit(0.0))


def category_shares(tags: Column, categories: Column) -> Column:
    """A map from category to its share of the tags that have one. ``categories`` maps tags, in lower case, to categories."""
    known = F.array_compact(F.transform(tags, lambda t: F.try_element_at(categories, F.lower(t))))
    share = lambda k: lambda c: F.size(F.filter(k, lambda x: x == c)) / F.size(k)
    shares = lambda k: F.map_from_arrays(F.array_distinct(k), F.transform(F.array_distinct(k), share(k)))
    return F.transform(F.array(known), shares)[0]  # looked up once


def merged_maps(base: Column, extra: Column) -> Column:
    """Both maps' entries; the base's value stays where both have a key."""
    return F.map_from_entries(F.concat(F.map_entries(base), F.filter(F.map_entries(extra), lambda e: ~F.map_contains_key(base, e["key"]))))
