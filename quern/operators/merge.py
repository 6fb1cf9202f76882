"""Snapshots: upserts, retirements, diffs, sync plans, gates, caches. Inputs are whole versions; outputs
are new ones or plans of actions. Keys are natural keys, one row each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def changed(columns: list[str], old: str = "o", new: str = "n") -> Column:
    """Whether any of the columns differs, NULLs being equal to each other."""
    return ~reduce(lambda a, c: a & F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")), columns, F.lit(True))


def _sides(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    return old.withColumn("__old", F.lit(True)).alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), on, "full")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new version's rows, and the old ones it doesn't have. Doing it twice changes nothing."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def retire_plan(old: DataFrame, new: DataFrame, key: str, active: str, protected: DataFrame) -> DataFrame:
    """(key, action): delete rows that are gone, retire those still referenced, reactivate returning ones."""
    refs = protected.select(F.col(key)).distinct().withColumn("__ref", F.lit(True))
    both = _sides(old, new, [key]).where("o.__old")
    rows = both.select(F.col(f"o.{key}").alias(key), F.col(f"o.{active}").alias(active), F.col("n.__new").alias("here")).join(refs, key, "left")
    gone = F.col("here").isNull()
    action = (
        F.when(gone & F.col("__ref").isNull(), "delete").when(gone & F.col(active), "retire").when(~gone & ~F.col(active), "reactivate").otherwise("keep")
    )
    return rows.select(key, action.alias("action"))


def scoped(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """The old rows of groups that are in this run: only they may lose rows."""
    return old.join(new.select(group).distinct(), group, "left_semi")


def diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], value: str | None = None, jump: float = 0.2) -> DataFrame:
    """(keys, kind): new, removed, flagged (``value`` moved by more than ``jump`` or came or went), changed, same."""
    rows = _sides(old, new, keys)
    kind = F.when(F.col("o.__old").isNull(), "new").when(F.col("n.__new").isNull(), "removed")
    if value:
        a, b = F.col(f"o.{value}"), F.col(f"n.{value}")
        kind = kind.when((a.isNull() != b.isNull()) | F.coalesce(F.abs(b - a) > jump * F.abs(a), F.lit(False)), "flagged")
    kind = kind.when(changed(columns), "changed").otherwise("same")
    return rows.select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], kind.alias("kind"))


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns in the order of their names; each value is written with its length, NULL without one, so that
    no two different rows are written alike."""
    written = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~")) for c in sorted(columns)]
    return F.sha2(F.concat(*written), 256)


def sync_plan(source: DataFrame, target: DataFrame, key: str, columns: list[str], active: str) -> DataFrame:
    """(key, action) by row hashes only: insert, update (also of a retired row that comes back), retire, none."""
    a = source.select(key, row_hash(columns).alias("h"))
    b = target.select(key, row_hash(columns).alias("h"), active)
    rows = _sides(b, a, [key])
    action = (
        F.when(F.col("o.__old").isNull(), "insert").when(F.col("n.__new").isNull(), F.when(F.col(f"o.{active}"), "retire").otherwise("none"))
        .when((F.col("o.h") != F.col("n.h")) | ~F.col(f"o.{active}"), "update").otherwise("none")
    )
    return rows.select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), action.alias("action"))


def size_gates(old: DataFrame, new: DataFrame, group: str, least: int = 5, share: float = 0.5) -> DataFrame:
    """(group, before, after, fails): groups of at least ``least`` rows that shrink below ``share``."""
    a, b = old.groupBy(group).agg(F.count(F.lit(1)).alias("before")), new.groupBy(group).agg(F.count(F.lit(1)).alias("after"))
    both = a.join(b, group, "full").select(group, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.withColumn("fails", (F.col("before") >= least) & (F.col("after") < share * F.col("before")))


def promotes(metrics: DataFrame, old: str, new: str, gain: float = 0.01, loss: float = 0.005) -> list[Column]:
    """Aggregates: promote if some metric gains and none loses more than allowed."""
    d = F.col(new) - F.col(old)
    return [(F.bool_or(d >= gain) & ~F.bool_or(d < -loss)).alias("promote"), F.count_if(d >= gain).alias("better"), F.count_if(d < -loss).alias("worse")]


def cache_state(rows: DataFrame, cache: DataFrame, key: str, text: str) -> DataFrame:
    """(key, state): hit (same content hash), failed, stale or missing."""
    c = cache.select(key, F.col("hash").alias("__hash"), F.col("status").alias("__status"))
    same = F.col("__hash") == F.sha1(text)
    state = F.when(F.col("__hash").isNull(), "missing").when(~same, "stale").when(F.col("__status") != "ok", "failed").otherwise("hit")
    return rows.join(c, key, "left").select(key, state.alias("state"))


def calls(rows: DataFrame, cache: DataFrame, key: str, text: str, retry: bool = False, most: int | None = None) -> DataFrame:
    """(key, state, action) of an enrichment run over a cache: ``reuse`` what is current, ``call`` for what is missing or stale, and
    for what failed on the same text only with ``retry`` (else ``skip``). Of the calls only the first ``most`` by key are made;
    the rest is left for the next run (``later``)."""
    state = cache_state(rows, cache, key, text)
    wanted = F.col("state").isin("missing", "stale") | (F.lit(retry) & (F.col("state") == "failed"))
    action = F.when(F.col("state") == "hit", "reuse").when(wanted, "call").otherwise("skip")
    told = state.withColumn("action", action)
    if most is None:
        return told
    first = told.where("action = 'call'").select(key).orderBy(key).limit(most).withColumn("__now", F.lit(True))
    late = (F.col("action") == "call") & F.col("__now").isNull()
    return told.join(first, key, "left").select(key, "state", F.when(late, "later").otherwise(F.col("action")).alias("action"))



def variant(parents: DataFrame, children: DataFrame, key: str, source: str, restricted: list[str]) -> tuple[DataFrame, DataFrame]:
    """Parents of unrestricted sources, and their children."""
    kept = parents.where(~F.coalesce(F.col(source).isin(restricted), F.lit(False)))
    return kept, children.join(kept.select(key), key, "left_semi")


def default_rows(groups: DataFrame, rows: DataFrame, key: str, defaults: list[str], name: str) -> DataFrame:
    """``rows``, and one row per default name for every group that has none."""
    empty = groups.join(rows.select(key), key, "left_anti")
    made = empty.select(key, F.explode(F.array(*[F.lit(d) for d in defaults])).alias(name))
    return rows.select(key, name).unionByName(made)


def union_in_order(feeds: list[DataFrame]) -> DataFrame:
    """Feeds one after another, each row with its feed's rank: order survives shuffles."""
    ranked = [f.withColumn("src_rank", F.lit(i)) for i, f in enumerate(feeds)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def protected_keys(*referrers: tuple[DataFrame, str], key: str) -> DataFrame:
    """The distinct keys that any referring table holds; NULL protects nothing."""
    parts = [df.select(F.col(c).alias(key)) for df, c in referrers]
    return reduce(lambda a, b: a.unionByName(b), parts).where(F.col(key).isNotNull()).distinct()


def resolve_ids(df: DataFrame, natural: str, dimension: DataFrame, key: str, id_: str, out: str) -> DataFrame:
    """Add ``out``: the id that the dimension gives a natural key, NULL if it has none. ``dimension`` has a row a key."""
    return df.join(dimension.select(F.col(key).alias("__key"), F.col(id_).alias(out)), F.col(natural) == F.col("__key"), "left").drop("__key")


def merged_labels(hand: DataFrame, derived: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label): hand-made labels, and derived ones for what they don't cover."""
    return hand.select(key, label).unionByName(derived.join(hand.select(key), key, "left_anti").select(key, label))


def todo(
    old: DataFrame, new: DataFrame, key: str, fields: list[str], enrichable: list[str], flag: str, text: str, computed: str, listed: str | None = None
) -> DataFrame:
    """(key, kind): the rows to compute again, "new" or "changed".

    A row is changed if a source field differs; an enrichable field differs where the new version has a value; the flag
    comes on; the new version lists something else (``listed``, an array); the text differs, an empty one being
    none; or nothing was computed for it yet (``computed`` is NULL in the old version).
    """
    rows = _sides(old, new, [key]).where("n.__new")
    o, n = lambda c: F.col(f"o.{c}"), lambda c: F.col(f"n.{c}")
    given = reduce(lambda a, c: a | (n(c).isNotNull() & ~o(c).eqNullSafe(n(c))), enrichable, F.lit(False))
    lit = F.coalesce(n(flag), F.lit(False)) & ~F.coalesce(o(flag), F.lit(False))
    told = ~F.nullif(o(text), F.lit("")).eqNullSafe(F.nullif(n(text), F.lit("")))
    moved = changed(fields) | given | lit | told | o(computed).isNull()
    if listed:
        moved = moved | ((F.size(F.coalesce(n(listed), F.array().cast("array<string>"))) > 0) & ~o(listed).eqNullSafe(n(listed)))
    kind = F.when(F.col("o.__old").isNull(), "new").when(moved, "changed")
    return rows.select(n(key).alias(key), kind.alias("kind")).where("kind IS NOT NULL")


def removal_gate(old: DataFrame, new: DataFrame, key: str, table: Column, share: float = 0.2) -> DataFrame:
    """(table, current, removed, fails): tables of which more than ``share`` of the rows would go."""
    gone = old.select(key, table.alias("table")).join(new.select(key).withColumn("__new", F.lit(True)), key, "left")
    counts = gone.groupBy("table").agg(F.count(F.lit(1)).alias("current"), F.count_if(F.col("__new").isNull()).alias("removed"))
    return counts.withColumn("fails", F.col("removed") / F.col("current") > share)


def empty_sources(expected: DataFrame, rows: DataFrame, source: str) -> DataFrame:
    """(source, n, fails): every expected source with its number of rows; one without any must stop a load."""
    counts = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    return expected.select(source).distinct().join(counts, source, "left").select(source, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("fails"))


def metric_gates(metrics: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(name, ok) of measured metrics (name, kind, value, checked, baseline).

    kind "violations": none of more than zero checked. kind "accuracy": at most ``tolerance`` below the baseline; without
    a baseline any value will do, without a value it fails.
    """
    none = (F.col("value") == 0) & (F.col("checked") > 0)
    near = F.col("value").isNotNull() & F.coalesce(F.col("value") >= F.col("baseline") - tolerance - 1e-9, F.lit(True))
    return metrics.select("name", F.coalesce(F.when(F.col("kind") == "violations", none).otherwise(near), F.lit(False)).alias("ok"))


def label_policy(source: Column, own: Column, policies: dict[str, Column | None]) -> Column:
    """A label by its source: replaced by the policy's value, withdrawn where that is None, left for sources without a policy."""
    out = F
    for name, value in policies.items():
        out = out.when(source == name, F.lit(None) if value is None else value)
    return out.otherwise(own)
