"""Predictions in layers, as one plan: neighbours, a model, what the text says outright, and tags to fill up with.

Each layer is a table or an expression by query; no layer drops or reorders what an earlier one put in front. What a value or a
tag rests on is told beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import text_cue
from .aggregates import topped_up, vote_tags, weighted_stats
from .dictionary import tag_text
from .filters import cap_confidence, precedence

#: Fewest neighbours, tags below which a vote is filled up, tags that co-occurrence fills up to, and the most that are shown.
LEAST, FILL_TO, TARGET, MOST = 3, 2, 2, 5


def voted(near: DataFrame, tags: DataFrame, rates: DataFrame, share: float = 0.3, lift: float = 1.2) -> DataFrame:
    """(query, voted): each query's tags by the vote of its neighbours, best first. ``tags``: neighbor, tag."""
    size = near.groupBy("query").agg(F.count(F.lit(1)).alias("voters"))
    votes = near.select("query", "neighbor").join(tags.select("neighbor", F.lower("tag").alias("tag")).distinct(), "neighbor").join(size, "query")
    ranked = vote_tags(votes, "query", "tag", F.col("voters"), rates, share, lift, MOST)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"])
    return ranked.groupBy("query").agg(listed.alias("voted"))


def implied(given: DataFrame, rules: DataFrame, target: int = TARGET) -> DataFrame:
    """(query, implied): up to ``target`` less the tags shown so far, what the query's own tags imply and is not shown.

    ``given``: query, own (tags of its text) and shown. ``rules``: a, b, share, lift, as gated. Of the tags that imply one the
    best counts (share, then lift); tags go by that too, then by name.
    """
    asked = given.where((F.size("own") > 0) & (F.size("shown") < target))
    met = asked.select("query", "shown", F.explode("own").alias("a")).join(rules, "a").where(~F.array_contains("shown", F.col("b")))
    best = met.groupBy("query", "b").agg(F.max(F.struct("share", "lift")).alias("x"), (F.lit(target) - F.first(F.size("shown"))).alias("room"))
    order = Window.partitionBy("query").orderBy(F.desc("x.share"), F.desc("x.lift"), "b")
    kept = best.withColumn("r", F.row_number().over(order)).where("r <= room")
    return kept.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "b"))), lambda x: x["b"]).alias("implied"))


def predict(
    queries: DataFrame, near: DataFrame, tagged: DataFrame, items: DataFrame, tags: DataFrame, rates: DataFrame, rules: DataFrame, attributes: list[str],
    cues: dict[str, tuple[str, str]], tagger, degraded: Column | None = None, target: int = TARGET,
) -> DataFrame:
    """(query, n_neighbors, confidence, each attribute, <attribute>_from, tags): predictions for ``queries`` (query, text and a model's
    ``model_<attribute>``).

    ``near`` and ``tagged`` (query, neighbor, similarity): the nearest items, and the nearest that have tags. ``items`` (neighbor and
    attributes), ``tags`` (neighbor, tag), ``rates`` (tag, base), ``rules`` of co-occurrence.

    An attribute is what the text says of it (``cues``: patterns for high and low), else the model's, else the neighbours' weighted
    mean. Tags: the neighbours' vote, filled up to two from the vote of tagged items; the text's own tags go before them, at
    most five in all; what these imply fills up to ``target``. Confidence comes from the spread among neighbours, is low with fewer
    than three, and is capped by missing attributes. A ``degraded`` query has neighbours without true similarities: neither
    model nor fill is used, and its confidence is low.
    """
    off = F.lit(False) if degraded is None else F.coalesce(degraded, F.lit(False))
    base = queries.withColumn("__off", off)
    spread = weighted_stats(near.join(items.select("neighbor", *attributes), "neighbor"), "query", "similarity", attributes, least=LEAST)
    spread = spread.select("query", *[F.col(a).alias(f"near_{a}") for a in attributes], F.col("confidence").alias("level"))
    n = near.groupBy("query").agg(F.count(F.lit(1)).alias("n_neighbors"))
    own = tag_text(queries, "query", "text", tagger).select("query", F.transform("tags", F.lower).alias("own"))
    none = F.array().cast("array<string>")
    rows = base.join(spread, "query", "left").join(n, "query", "left").join(own, "query", "left")
    rows = rows.join(voted(near, tags, rates), "query", "left").join(voted(tagged, tags, rates).withColumnRenamed("voted", "fill"), "query", "left")
    vote, text = F.coalesce("voted", none), F.coalesce("own", none)
    filled = F.when(F.col("__off"), vote).otherwise(topped_up(vote, F.coalesce("fill", none), FILL_TO))
    shown = F.when(F.size(text) > 0, F.slice(F.array_distinct(F.concat(text, filled)), 1, MOST)).otherwise(filled)
    rows = rows.withColumn("own", text).withColumn("voted", vote).withColumn("shown", shown)
    rows = rows.join(implied(rows.select("query", "own", "shown"), rules, target), "query", "left")
    whole = F.concat("shown", F.coalesce("implied", none))
    origin = lambda t: F.when(F.array_contains("own", t), "text").when(F.array_contains("voted", t), "vote").when(F.array_contains("shown", t), "fill").otherwise("implied")
    out, values = [], []
    for a in attributes:
        said, _ = text_cue(F.col("text"), *cues[a]) if a in cues else (F.lit(None), None)
        model = F.when(~F.col("__off"), F.col(f"model_{a}").cast("double")) if f"model_{a}" in queries.columns else F.lit(None).cast("double")
        value, source = precedence([("text", said.cast("double")), ("model", model), ("neighbours", F.round(f"near_{a}", 2))])
        out += [value.alias(a), source.alias(f"{a}_from")]
        values.append(value)
    missing = sum((F.when(v.isNull(), 1).otherwise(0) for v in values), F.lit(0))
    level = F.when(F.col("__off") | (F.coalesce("n_neighbors", F.lit(0)) < LEAST), "low").otherwise(F.coalesce("level", F.lit("low")))
    told = F.transform(whole, lambda t: F.struct(t.alias("tag"), origin(t).alias("origin")))
    return rows.select("query", F.coalesce("n_neighbors", F.lit(0)).alias("n_neighbors"), cap_confidence(level, missing).alias("confidence"), *out, told.alias("tags"))
