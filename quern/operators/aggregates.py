"""Aggregations: rates, medians with fall-backs, votes, associations, agreement scores."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import average_ranks, exact_percentiles, running_counts, same_keys


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing): the share of NULLs and empty arrays of each column, in one pass."""
    kinds = dict(df.dtypes)
    gone = lambda c: F.col(c).isNull() | (F.size(c) == 0) if kinds[c].startswith("array") else F.col(c).isNull()
    rates = df.agg(*[F.avg(gone(c).cast("int")).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns]))
    return rates.select(pairs.alias("x")).select("x.*")


def base_rates(tags: DataFrame, key: str, tag: str) -> DataFrame:
    """(tag, n, base): rows with each tag over the rows with any. ``tags`` has a row per key and tag."""
    distinct = tags.select(key, F.lower(tag).alias(tag)).where(F.col(tag).isNotNull()).distinct()
    total = distinct.agg(F.countDistinct(key).alias("total"))
    counts = distinct.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(total)).select(tag, "n", (F.col("n") / F.col("total")).alias("base"))


def vote_tags(votes: DataFrame, query: str, tag: str, voters: Column, rates: DataFrame, least: float = 0.3, lift: float = 1.2, k: int = 5) -> DataFrame:
    """Tags that enough of a query's neighbours have, and more than the base rate makes likely.

    ``votes`` has a row per query, neighbour and distinct tag; ``voters`` is the number of neighbours.
    Kept: share >= max(least, lift * base); ranked by share * ln(1 / base), then the tag.
    """
    shares = votes.groupBy(query, tag).agg((F.count(F.lit(1)) / F.max(voters)).alias("share"))
    rated = shares.join(rates.select(tag, "base"), tag, "left").withColumn("base", F.coalesce("base", F.lit(0.0)))
    kept = rated.where(F.col("share") >= F.greatest(F.lit(least), lift * F.col("base")))
    worth = F.col("share") * F.log(1 / F.greatest("base", F.lit(1e-6)))
    order = Window.partitionBy(query).orderBy(F.col("worth").desc(), tag)
    return kept.withColumn("worth", F.round(worth, 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cooccurrence(tags: DataFrame, key: str, tag: str) -> DataFrame:
    """(a, b, n_a, n_b, n_ab): rows with both of two different tags.

    A self-join on the key: its cost is the square of the tags per row, which are few; the pairs
    are counted on the map side before they are shuffled.
    """
    rows = tags.select(key, tag).distinct()
    counts = rows.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))
    pairs = rows.groupBy(key).agg(F.collect_list(tag).alias("ts"))
    pairs = pairs.select(F.explode("ts").alias("a"), "ts").select("a", F.explode("ts").alias("b")).where("a <> b")
    both = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    return both.join(counts.select(F.col(tag).alias("a"), F.col("n").alias("n_a")), "a").join(counts.select(F.col(tag).alias("b"), F.col("n").alias("n_b")), "b")


def association_rules(pairs: DataFrame, rows: int | Column, support: int = 5, both: int = 3, share: float = 0.3, lift: float = 1.2) -> DataFrame:
    """Pairs a -> b that clear the gates, with share = P(b | a) and lift."""
    s = F.col("n_ab") / F.col("n_a")
    total = F.lit(rows) if isinstance(rows, int) else rows
    out = pairs.withColumn("share", s).withColumn("lift", s / (F.col("n_b") / total))
    return out.where((F.col("n_a") >= support) & (F.col("n_ab") >= both) & (F.col("share") >= share) & (F.col("lift") >= lift))


def best_antecedent(rules: DataFrame, given: DataFrame, key: str, tag: str, pos: str, k: int = 3, related: DataFrame | None = None) -> DataFrame:
    """For each key, what its tags imply and it lacks: the best antecedent of each consequent (share, then
    lift, then the earlier tag), the ``k`` best consequents.

    ``related`` (a, b) lists tags of one branch, in either order: a consequent that is related to a tag of the key says nothing new
    and is left out.
    """
    implied = given.select(key, F.col(tag).alias("a"), pos).join(rules, "a")
    new = implied.join(given.select(key, F.col(tag).alias("b")), [key, "b"], "left_anti")
    if related is not None:
        both = related.select("a", "b").unionByName(related.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        near = given.select(key, F.col(tag).alias("a")).join(both, "a").select(key, "b").distinct()
        new = new.join(near, [key, "b"], "left_anti")
    best = new.groupBy(key, "b").agg(F.max(F.struct("share", "lift", (-F.col(pos)).alias("p"), "a")).alias("x"))
    order = Window.partitionBy(key).orderBy(F.desc("x.share"), F.desc("x.lift"), "b")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, F.col("b").alias("implied"), F.col("x.a").alias("because"), F.col("x.share").alias("share"), "rank")


def fill_grid(df: DataFrame, truth: Column, ways: dict[str, Column]) -> DataFrame:
    """(candidate, precision, recall, f1, tags_shown, share_tagged) of ways to fill tags, each an array column, in one pass."""
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.array_distinct(c).alias("tags")) for n, c in ways.items()]))
    rows = df.select(truth.alias("__truth"), listed.alias("x")).select("__truth", "x.*")
    counted = rows.select("candidate", F.size("tags").alias("n"), *set_counts(F.col("__truth"), F.col("tags")))
    sums = counted.groupBy("candidate").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.round(F.avg("n"), 6).alias("tags_shown"), F.round(F.avg((F.col("n") > 0).cast("int")), 6).alias("share_tagged")
    )
    return sums.select("candidate", *prf(F.col("tp"), F.col("fp"), F.col("fn")), "tags_shown", "share_tagged")


def gate_scores(rows: DataFrame, share: str, lift: str, right: str, positives: int, shares: list[float], lifts: list[float]) -> DataFrame:
    """(min_share, min_lift, n, precision, recall, f1) of every cell of a grid of gates, from one pass over candidates.

    A row is a candidate (its share, its lift, whether it is ``right``) that each cell lets through whose gates it clears;
    ``positives`` is what could have been right in all. Rows are counted by how many gates of either kind they clear,
    at most (shares + 1) * (lifts + 1) counts, which are then added up along both axes.
    """
    shares, lifts = sorted(shares), sorted(lifts)
    cleared = lambda c, gates: sum((F.when(F.col(c) >= g, 1).otherwise(0) for g in gates), F.lit(0))
    counts = rows.groupBy(cleared(share, shares).alias("i"), cleared(lift, lifts).alias("j")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(right)).alias("tp"))
    spark = rows.sparkSession
    cells = spark.createDataFrame([(i, j, s, g) for i, s in enumerate(shares, 1) for j, g in enumerate(lifts, 1)], "i int, j int, min_share double, min_lift double")
    grid = cells.join(counts, ["i", "j"], "left").select("i", "j", "min_share", "min_lift", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "tp")])
    along = lambda own, other: Window.partitionBy(own).orderBy(F.col(other).desc()).rowsBetween(Window.unboundedPreceding, 0)
    for own, other in (("i", "j"), ("j", "i")):
        grid = grid.select("i", "j", "min_share", "min_lift", *[F.sum(c).over(along(own, other)).alias(c) for c in ("n", "tp")])
    return grid.select("min_share", "min_lift", "n", *prf(F.col("tp"), F.col("n") - F.col("tp"), F.lit(positives) - F.col("tp")))


def filled(own: Column, other: Column, most: int) -> Column:
    """One way's tags, filled up from another's to ``most``; the order stays."""
    return F.slice(F.array_distinct(F.concat(own, other)), 1, most)


def fallen_back(own: Column, other: Column) -> Column:
    """One way's tags or, where it has none, another's."""
    return F.when(F.size(own) > 0, own).otherwise(other)


def concat_chunks(df: DataFrame, keys: list[str], order: list[str], text: str, separator: str = "\n", most: int = 1 << 20) -> DataFrame:
    """(keys, chunk, text): each key's texts in order, joined, and cut into chunks of ``most`` characters, numbered from 0.

    The keys' rows come sorted and are streamed: a task holds one chunk and one row, however long a key's text is. NULL texts
    are left out; a key whose texts are all empty has one empty chunk.
    """
    rows = df.where(F.col(text).isNotNull()).select(*keys, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(text).alias("__t"))
    places = [f"__o{i}" for i in range(len(order))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, number, started = None, [], 0, 0, False
        out: list[tuple] = []

        def cut(last: bool) -> None:
            nonlocal held, size, number
            whole, at = "".join(held), 0
            while len(whole) - at > most:  # a chunk is cut when more follows it
                out.append((*now, number, whole[at : at + most]))
                number, at = number + 1, at + most
            if last:
                out.append((*now, number, whole[at:]))
            held, size = ([], 0) if last else ([whole[at:]], len(whole) - at)

        def table() -> pa.RecordBatch:
            kinds = [*key_types, pa.int32(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [*keys, "chunk", "text"])

        key_types = None
        for batch in batches:
            key_types = [batch.schema.field(k).type for k in keys]
            for *key, t in zip(*[batch.column(k).to_pylist() for k in keys], batch.column("__t"), strict=True):
                if not started or key != now:
                    if started:
                        cut(True)
                    now, number, started, first = key, 0, True, True
                piece = ("" if first else separator) + t.as_py()
                first = False
                held.append(piece)
                size += len(piece)
                if size > most:
                    cut(False)
                if sum(len(x[-1]) for x in out[-64:]) > most or len(out) > 4096:
                    yield table()
                    out.clear()
        if started:
            cut(True)
        if out:
            yield table()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *places).mapInArrow(run, f"{fields}, chunk int, text string")


#: Sums of a digest, and the hexadecimal digits of a value's SHA-256 that each of them takes.
LANES, DIGITS = 4, 15


def fingerprint(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A digest of each key's distinct values: equal sets have equal ones, in any order.

    The values' hashes are added up modulo 2^60 in four lanes, beside their number. So a key's state is five numbers whatever
    its size, sums are combined before the shuffle, and the digest of two disjoint sets is the sum of theirs
    (``merged_fingerprints``). NULL values are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("string").alias("__v")).distinct()
    lane = lambda i: F.conv(F.substring(F.sha2("__v", 256), 1 + DIGITS * i, DIGITS), 16, 10).cast("decimal(38,0)")
    sums = [(F.sum(lane(i)) % F.lit(1 << 4 * DIGITS).cast("decimal(38,0)")).cast("long").alias(f"__s{i}") for i in range(LANES)]
    return _spelled(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *sums), keys)


def _spelled(sums: DataFrame, keys: list[str]) -> DataFrame:
    hexed = lambda c: F.lower(F.lpad(F.hex(c), DIGITS, "0"))
    digest = F.concat_ws("-", F.col("__n").cast("string"), *[hexed(F.coalesce(F.col(f"__s{i}"), F.lit(0).cast("long"))) for i in range(LANES)])
    return sums.select(*keys, digest.alias("fingerprint"))


def merged_fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    """The digests of each key's parts as one. ``df``: the keys and ``fingerprint`` of disjoint parts."""
    parts = F.split("fingerprint", "-")
    lane = lambda i: F.conv(parts[1 + i], 16, 10).cast("decimal(38,0)")
    sums = [(F.sum(lane(i)) % F.lit(1 << 4 * DIGITS).cast("decimal(38,0)")).cast("long").alias(f"__s{i}") for i in range(LANES)]
    return _spelled(df.groupBy(*keys).agg(F.sum(parts[0].cast("long")).alias("__n"), *sums), keys)


def median_or(df: DataFrame, fine: list[str], coarse: list[str], value: str) -> DataFrame:
    """Each fine key's median, else its coarse key's, half-even to whole numbers."""
    keys = df.select(*fine).distinct()
    a = exact_percentiles(df, fine, value, {"own": 0.5}).drop("n").alias("a")
    b = exact_percentiles(df, coarse, value, {"wider": 0.5}).drop("n").alias("b")
    joined = keys.alias("k").join(a, same_keys("k", "a", fine), "left").join(b, same_keys("k", "b", coarse), "left").select("k.*", "own", "wider")
    note = F.when(F.col("own").isNotNull(), "own").when(F.col("wider").isNotNull(), "wider").otherwise("none")
    return joined.select(*fine, F.bround(F.coalesce("own", "wider")).alias("median"), note.alias("basis"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1 of summed counts; a zero denominator gives 0."""
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = safe(tp, tp + fp), safe(tp, tp + fn)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 6).alias("f1")]


def set_counts(truth: Column, guess: Column) -> list[Column]:
    """True and false positives and false negatives of two tag arrays."""
    hit = F.size(F.array_intersect(truth, guess))
    return [hit.alias("tp"), (F.size(F.array_distinct(guess)) - hit).alias("fp"), (F.size(F.array_distinct(truth)) - hit).alias("fn")]


def agreement(pred: Column, truth: Column) -> list[Column]:
    """n, exact, within one, mean absolute error, of rows with a truth and a prediction."""
    both = pred.isNotNull() & truth.isNotNull()
    err = F.when(both, F.abs(pred - truth))
    return [
        F.count(err).alias("n"), F.round(F.avg((err == 0).cast("int")), 6).alias("exact"),
        F.round(F.avg((err <= 1).cast("int")), 6).alias("within_1"), F.round(F.avg(err), 6).alias("mae"),
    ]


def spearman(df: DataFrame, group: list[str], a: str, b: str, ordinal_by: str | None = None) -> DataFrame:
    """Rank correlation by group, of rows with both values; ties at their mean or, with ``ordinal_by`` (a number of its own for
    each row of a group), in that order."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if ordinal_by:
        ranked = ordinal_ranks(ordinal_ranks(rows, group, a, ordinal_by, "__a"), group, b, ordinal_by, "__b")
    else:
        ranked = average_ranks(average_ranks(rows, group, a, "__a"), group, b, "__b")
    # NULL where one side doesn't vary
    rho = F.covar_pop("__a", "__b") / F.nullif(F.stddev_pop("__a") * F.stddev_pop("__b"), F.lit(0.0))
    return ranked.groupBy(*group).agg(F.round(rho, 6).alias("rho"), F.count(F.lit(1)).alias("n"))


def ordinal_ranks(df: DataFrame, group: list[str], value: str, position: str, out: str) -> DataFrame:
    """Add ``out``: the rank in the group, ties in the order of ``position``. Rows below a value and places among equal ones are both
    running counts, so that no task holds a group's rows, nor those of one value."""
    below = running_counts(df, group, value, {"n": F.count(F.lit(1))}).select(*group, value, (F.col("upto_n") - F.col("n")).alias("__below")).alias("b")
    told = df.select(*group, value, F.col(position).alias("__at"))
    place = running_counts(told, [*group, value], "__at", {"n": F.count(F.lit(1))}).select(*group, value, "__at", F.col("upto_n").alias("__place")).alias("p")
    a = df.withColumn("__at", F.col(position)).alias("a")
    on = same_keys("a", "b", group) & (F.col(f"a.{value}") == F.col(f"b.{value}"))
    at = same_keys("a", "p", [*group, "__at"]) & (F.col(f"a.{value}") == F.col(f"p.{value}"))
    return a.join(below, on).join(place, at).select(*[f"a.{c}" for c in df.columns], (F.col("__below") + F.col("__place")).alias(out))


def threshold_sweep(df: DataFrame, value: str, truth: Column) -> DataFrame:
    """Per distinct threshold: tp, fp, fn, tn of value >= threshold, from running counts of the distinct values."""
    c = running_counts(df, [], value, {"pos": F.count_if(truth), "neg": F.count_if(~truth)})
    tp, fp = F.col("all_pos") - F.col("upto_pos") + F.col("pos"), F.col("all_neg") - F.col("upto_neg") + F.col("neg")
    return c.select(F.col(value).alias("threshold"), tp.alias("tp"), fp.alias("fp"), (F.col("all_pos") - tp).alias("fn"), (F.col("all_neg") - fp).alias("tn"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold of ``threshold_sweep`` with the best accuracy, the lowest of equal ones."""
    accuracy = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    best = swept.withColumn("accuracy", accuracy).agg(F.max(F.struct("accuracy", (-F.col("threshold")).alias("t"), "tp", "fp", "fn", "tn")).alias("b"))
    return best.select((-F.col("b.t")).alias("threshold"), "b.accuracy", "b.tp", "b.fp", "b.fn", "b.tn")


def weighted_stats(df: DataFrame, query: str, similarity: str, values: list[str], floor: float = 0.01, least: int = 3) -> DataFrame:
    """Per query: each value's similarity-weighted mean and population deviation, and a confidence.

    Weights are at least ``floor``; NULL values are left out, and fewer than ``least`` give NULL. The
    confidence comes from the mean of the deviations: high up to 0.7, medium up to 1.2, else low. Each
    value takes its sums of w, w*v and w*v*v about its group's first value in one aggregation.
    """
    w = F.greatest(F.col(similarity), F.lit(floor))
    shifts = df.groupBy(query).agg(*[F.first(v, ignorenulls=True).alias(f"__s_{v}") for v in values])
    rows = df.join(shifts, query).withColumn("__w", w)
    sums = []
    for v in values:
        d = F.col(v) - F.col(f"__s_{v}")
        has = F.when(F.col(v).isNotNull(), F.col("__w"))
        sums += [F.sum(has).alias(f"__w_{v}"), F.sum(has * d).alias(f"__a_{v}"), F.sum(has * d * d).alias(f"__b_{v}"), F.count(v).alias(f"__n_{v}"), F.first(f"__s_{v}").alias(f"__o_{v}")]
    out = rows.groupBy(query).agg(*sums)
    columns = [F.col(query)]
    for v in values:
        enough = F.col(f"__n_{v}") >= least
        mean = F.col(f"__a_{v}") / F.col(f"__w_{v}")
        spread = F.sqrt(F.greatest(F.col(f"__b_{v}") / F.col(f"__w_{v}") - mean * mean, F.lit(0.0)))
        columns += [F.when(enough, F.col(f"__o_{v}") + mean).alias(v), F.when(enough, spread).alias(f"{v}_std")]
    stats = out.select(*columns)
    known = F.array_compact(F.array(*[F.col(f"{v}_std") for v in values]))
    average = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    level = F.when(average <= 0.7, "high").when(average <= 1.2, "medium").otherwise("low")
    return stats.withColumn("confidence", level)


def source_report(df: DataFrame, source: str, failed: Column) -> DataFrame:
    """(source, n, failed): rows of each source, and those that failed."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failed"))


def ratio_check(df: DataFrame, group: list[str], ratio: str) -> DataFrame:
    """(group, median_ratio, within_10, within_25, coverage) of a ratio that should be one; NULL is no match."""
    off = F.abs(F.col(ratio) - 1)
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    rates = df.groupBy(*group).agg(share(off <= 0.1).alias("within_10"), share(off <= 0.25).alias("within_25"), share(F.col(ratio).isNotNull()).alias("coverage"))
    medians = exact_percentiles(df, group, ratio, {"median_ratio": 0.5})
    return rates.join(medians, group, "left").select(*group, F.round("median_ratio", 6).alias("median_ratio"), "within_10", "within_25", "coverage")


def panel_means(df: DataFrame, keys: list[str], means: dict[str, str], note: str, order: str, out: str) -> DataFrame:
    """Each key's means and its distinct notes in the order they were first seen, joined by semicolons."""
    averages = df.groupBy(*keys).agg(*[F.round(F.avg(c), 6).alias(n) for n, c in means.items()])
    first = df.where(F.col(note).isNotNull()).groupBy(*keys, note).agg(F.min(order).alias("__at"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("__at", note))), lambda x: x[note])
    return averages.join(first.groupBy(*keys).agg(F.array_join(listed, ";").alias(out)), keys, "left")


def f1_thresholds(df: DataFrame, tags: list[str], score: str, truth: Column, grid: list[float]) -> DataFrame:
    """(tags, threshold, f1): of a grid the threshold with the best F1 for each tag, the lowest of equal ones."""
    rows = df.withColumn("__truth", truth).withColumn("threshold", F.explode(F.array(*[F.lit(g) for g in grid])))
    over = F.col(score) >= F.col("threshold")
    c = rows.groupBy(*tags, "threshold").agg(
        F.count_if(F.col("__truth") & over).alias("tp"), F.count_if(~F.col("__truth") & over).alias("fp"), F.count_if(F.col("__truth") & ~over).alias("fn")
    )
    f1 = 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    best = c.withColumn("f1", f1).groupBy(*tags).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(*tags, (-F.col("b.t")).alias("threshold"), "b.f1")


def annotators(df: DataFrame, group: list[str], first: Column, second: Column) -> DataFrame:
    """Agreement of two annotators by group: which side has no value, ordinal agreement, precision, recall and F1 of the
    first with the second as truth."""
    same = F.coalesce(first == second, F.lit(False))
    hit, said, told = F.count_if(same), F.count(first), F.count(second)
    rows = df.groupBy(*group).agg(
        F.count_if(first.isNull() & second.isNotNull()).alias("only_second"), F.count_if(first.isNotNull() & second.isNull()).alias("only_first"),
        F.count_if(first.isNull() & second.isNull()).alias("neither"), *agreement(first, second), hit.alias("__tp"), (said - hit).alias("__fp"), (told - hit).alias("__fn"),
    )
    return rows.select("*", *prf(F.col("__tp"), F.col("__fp"), F.col("__fn"))).drop("__tp", "__fp", "__fn")


def calibration(
    df: DataFrame, bucket: list[str], pred: str, truth: str, high: float = 0.75, medium: float = 0.55, rho: float = 0.3, least: int = 10
) -> DataFrame:
    """(bucket, n, within_1, rho, level): a confidence level from residuals. High also needs rank information; a bucket of
    fewer than ``least`` rows is low."""
    rows = df.where(F.col(pred).isNotNull() & F.col(truth).isNotNull())
    near = rows.groupBy(*bucket).agg(F.avg((F.abs(F.col(pred) - F.col(truth)) <= 1).cast("int")).alias("w"))
    both = near.join(spearman(rows, bucket, pred, truth), bucket)
    order = F.coalesce("rho", F.lit(0.0))
    level = (
        F.when(F.col("n") < least, "low").when((F.col("w") >= high) & (order >= rho), "high").when((F.col("w") >= medium) & (order > 0), "medium").otherwise("low")
    )
    return both.select(*bucket, "n", F.round("w", 6).alias("within_1"), "rho", level.alias("level"))


def ordinal_correlation(df: DataFrame, group: list[str], name: str, order: list[str], value: str) -> DataFrame:
    """Rank correlation of ``value`` with the place of a name in ``order``; other names are left out."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(name))
    return spearman(df.withColumn("__place", F.nullif(place, F.lit(0))), group, "__place", value)


def inventory(df: DataFrame, group: list[str], value: str, kind: str) -> DataFrame:
    """(group, n, known, kinds): rows, rows with a value, the sorted distinct kinds (a vocabulary, so few)."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("known"), F.array_sort(F.collect_set(kind)).alias("kinds"))


def readable_share(df: DataFrame, group: list[str], tokens: Column, vocabulary: DataFrame, key: str) -> DataFrame:
    """(group, share): rows of which a vocabulary (term) reads at least one token, over all rows."""
    known = df.select(key, F.explode(F.array_distinct(tokens)).alias("term")).join(vocabulary, "term").select(key).distinct().withColumn("__read", F.lit(1))
    return df.join(known, key, "left").groupBy(*group).agg(F.avg(F.coalesce("__read", F.lit(0))).alias("share"))


def term_groups(df: DataFrame, group: str, tokens: Column, vocabulary: DataFrame) -> DataFrame:
    """(term, groups): the sorted groups in which each vocabulary term occurs."""
    found = df.select(group, F.explode(tokens).alias("term")).join(vocabulary, "term").distinct()
    return found.groupBy("term").agg(F.array_sort(F.collect_set(group)).alias("groups"))


def weighted_support(df: DataFrame, key: list[str], similarity: str, value: str, floor: float = 0.01) -> DataFrame:
    """(key, support): the neighbours' similarities, at least ``floor`` each, summed where they have a value."""
    return df.groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.greatest(F.col(similarity), F.lit(floor)))), F.lit(0.0)).alias("support"))


def compare_variants(variants: dict[str, DataFrame], key: str, pred: str, truth: str) -> DataFrame:
    """(variant, n, mae, same_targets): predictions of several variants; whether all were made for the same keys, by fingerprint."""
    scored = None
    for name, df in variants.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(pred) - F.col(truth))).alias("mae"))
        row = one.crossJoin(fingerprint(df, [], key)).select(F.lit(name).alias("variant"), "n", "mae", "fingerprint")
        scored = row if scored is None else scored.unionByName(row)
    kinds = scored.agg(F.countDistinct("fingerprint").alias("__k"))
    return scored.crossJoin(F.broadcast(kinds)).select("variant", "n", "mae", (F.col("__k") == 1).alias("same_targets"))


def rescored(saved: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Saved rows with each check's column (and <check>_before) made anew; the first recorded result stays in <check>_before,
    the new one where nothing was recorded."""
    kept = {f"{n}_before": F.coalesce(F.col(f"{n}_before"), F.col(n), c) for n, c in checks.items()}
    return saved.withColumns(kept).withColumns(checks)


def fallback_causes(df: DataFrame, fallback: str, counters: str, cards: str, tokens: str, ms: str, deadline: int, prefix: str = "fb_") -> DataFrame:
    """(counter, total): why requests fell back. Rows with counters (a map, names with ``prefix``) tell; older rows have none, so as many
    fallbacks as cards lack a first token are counted as before it, fast errors if the request ended before the deadline, and
    the rest as after it. Rows without fallbacks say nothing."""
    rows = df.where(F.col(fallback) > 0)
    own = F.map_filter(F.coalesce(counters, F.create_map().cast("map<string,bigint>")), lambda k, v: k.startswith(prefix))
    told = rows.where(F.size(own) > 0).select(F.explode(own).alias("counter", "v")).select(F.regexp_replace("counter", f"^{prefix}", "").alias("counter"), F.col("v").cast("long").alias("v"))
    before = F.least(F.col(fallback), F.greatest(F.lit(0), F.col(cards) - F.col(tokens)))
    when = F.concat(F.lit("inferred_before_token_"), F.when(F.coalesce(ms, F.lit(0)) < deadline, "fast_error").otherwise("timeout"))
    parts = F.array(F.struct(when.alias("counter"), before.cast("long").alias("v")), F.struct(F.lit("inferred_after_token").alias("counter"), (F.col(fallback) - before).cast("long").alias("v")))
    inferred = rows.where(F.size(own) == 0).select(F.explode(parts).alias("x")).select("x.*").where("v > 0")
    return told.unionByName(inferred).groupBy("counter").agg(F.sum("v").alias("total"))


def topped_up(own: Column, extra: Column, least: int) -> Column:
    """Tags, and as many others as they lack to ``least``; none is dropped or moved."""
    return F.concat(own, F.slice(F.array_except(extra, own), 1, F.greatest(F.lit(least) - F.size(own), F.lit(0))))


def abstention(df: DataFrame, pred: str, truth: str, support: str, rules: list[float]) -> DataFrame:
    """(rule, coverage, accuracy): answers whose support reaches a rule, of rows with a truth; accuracy is within one."""
    rows = df.where(F.col(truth).isNotNull()).withColumn("rule", F.explode(F.array(*[F.lit(float(r)) for r in rules])))
    told = F.col(pred).isNotNull() & (F.col(support) >= F.col("rule"))
    right = F.when(told, (F.abs(F.col(pred) - F.col(truth)) <= 1).cast("int"))
    return rows.groupBy("rule").agg(F.round(F.avg(told.cast("int")), 6).alias("coverage"), F.round(F.avg(right), 6).alias("accuracy"))
