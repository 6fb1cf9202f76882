"""Column functions over text: dictionary look-ups, cues, ranges, cleaning."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F


def clean(text: Column) -> Column:
    """Trimmed text, NULL if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def number(text: Column) -> Column:
    """A double, NULL where the text isn't one."""
    return F.trim(text).try_cast("double")


def keyword_class(text: Column, ladder: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """The first class of ``ladder`` one of whose words occurs in the text, blanks and case ignored."""
    squeezed = F.regexp_replace(F.lower(text), r"\s+", "")
    out = F
    for name, words in ladder:
        pattern = "|".join(re.escape(w) for w in words)
        out = out.when(squeezed.rlike(pattern), name)
    return out.otherwise(F.lit(default))


def leftmost_entry(text: Column, entries: dict[str, str], parts: dict[str, str] | None = None) -> Column:
    """The value of the dictionary word that occurs first; of words at one place, the first listed.

    Words of ``entries`` have no Latin letter beside them; those of ``parts``, in scripts that write words on to each
    other, may stand anywhere. The text's case is ignored, keys are lower case.
    """
    spelled = lambda words: "|".join(re.escape(k) for k in words)
    pattern = f"(?<![a-z])(?:{spelled(entries)})(?![a-z])" + (f"|{spelled(parts)}" if parts else "")
    found = F.nullif(F.regexp_extract(F.lower(text), f"({pattern})", 1), F.lit(""))
    pairs = [F.lit(x) for kv in {**(parts or {}), **entries}.items() for x in kv]
    return F.create_map(*pairs)[found]


def range_midpoint(text: Column, least: float, most: float) -> Column:
    """The mean of a text's first two numbers (or its only one) if it lies within bounds."""
    numbers = F.slice(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), 1, 2)
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x.try_cast("double"))
    middle = F.when(F.size(numbers) > 0, total / F.size(numbers))
    return F.when(middle.between(least, most), middle)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def rescale(x: Column, low: float, high: float, to_low: float = 1.0, to_high: float = 5.0) -> Column:
    """A linear change of scale, cut off at its ends."""
    return F.when(x.isNotNull(), F.least(F.lit(to_high), F.greatest(F.lit(to_low), to_low + (x - low) * (to_high - to_low) / (high - low))))


def path_leaves(text: Column, most: int = 6) -> Column:
    """Distinct last parts of paths a>b>c that are separated by ; or |."""
    paths = F.transform(F.split(text, r"[;|]"), lambda p: F.trim(F.element_at(F.split(p, ">"), -1)))
    return F.slice(F.array_distinct(F.filter(paths, lambda p: p != "")), 1, most)


def text_cue(text: Column, high: str, low: str, high_value: int = 5, low_value: int = 1) -> tuple[Column, Column]:
    """(value, matched words): high or low where exactly one of the patterns matches."""
    up, down = (F.nullif(F.regexp_extract(F.lower(text), f"({p})", 1), F.lit("")) for p in (high, low))
    both = up.isNotNull() & down.isNotNull()
    value = F.when(both, F.lit(None).cast("int")).when(up.isNotNull(), high_value).when(down.isNotNull(), low_value)
    return value, F.when(~both, F.coalesce(up, down))


def compose(*parts: Column, separator: str = " | ") -> Column:
    """Parts that are not empty, joined."""
    return F.concat_ws(separator, *[clean(p) for p in parts])


def dict_replace(text: Column, entries: dict[str, str]) -> Column:
    """Replace every key, longer keys first."""
    ordered = sorted(entries.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ordered, text)


def single_or_null(values: Column) -> Column:
    """The only distinct non-null value of an array, else NULL."""
    distinct = F.array_distinct(F.array_compact(values))
    return F.when(F.size(distinct) == 1, distinct[0])


def snippet(text: Column, words: list[str], most: int) -> Column:
    """The distinct sentences with one of the words, or else the text's start."""
    pattern = "(?iu)" + "|".join(re.escape(w) for w in words)
    kept = F.array_distinct(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s.rlike(pattern)))
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), F.substring(text, 1, most))


def like_escaped(query: str) -> str:
    """A query as a LIKE pattern in which % and _ stand for themselves."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", query) + "%"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def amount(text: Column) -> tuple[Column, Column]:
    """(number, unit) of a text such as "355 ml"."""
    found = r"([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)"
    return number(F.nullif(F.regexp_extract(text, found, 1), F.lit(""))), F.nullif(F.lower(F.regexp_extract(text, found, 2)), F.lit(""))


def per_serving(value: Column, basis: Column, serving: Column) -> Column:
    """A value given per basis amount, scaled to a serving; NULL without a basis."""
    return value * serving / F.nullif(basis, F.lit(0))


def grams(text: Column) -> Column:
    """A weight in grams; kilograms are converted."""
    n, unit = amount(text)
    return F.when(unit == "kg", n * 1000).when(unit == "g", n)


def price(text: Column) -> Column:
    """The first number of a price text, separators of thousands left out."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, r"([0-9][0-9,]*)", 1), F.lit("")), ",", "").try_cast("long")


def match_name(text: Column) -> Column:
    """A name for matching: lower case, without brackets' contents, blanks and punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\([^)]*\)|\[[^\]]*\]", ""), r"[\s\p{Punct}]+", "")


def slug(name: Column, known: dict[str, str], prefix: str) -> Column:
    """A known name's key, or a prefix and the name's hash; blanks don't count in a name."""
    bare = F.regexp_replace(name, r"\s+", "")
    pairs = [F.lit(x) for k, v in known.items() for x in (re.sub(r"\s+", "", k), v)]
    listed = F.create_map(*pairs)[bare] if pairs else F.lit(None).cast("string")
    return F.coalesce(listed, F.concat(F.lit(prefix), F.substring(F.sha1(bare), 1, 8)))


def is_note_list(text: Column, most: int = 24) -> Column:
    """Whether a text is a list of short notes and no prose."""
    parts = F.split(text, ",")
    return (F.size(parts) > 1) & ~text.contains(".") & F.forall(parts, lambda p: F.length(F.trim(p)).between(1, most))
