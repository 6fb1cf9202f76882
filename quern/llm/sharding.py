"""Balanced label propagation of linked documents to shards, in DataFrame operations only.

Documents are linked through groups. Every linked document starts in a shard by hash. In each round, a
group looks at which shards its members are in, and all members move to the one most of them are in that
still has room for the rest; the moves into a shard are admitted only up to its quota. Groups too large for one
shard are dealt out to parts first. Documents without links then fill the shards up to their quotas, which are
at most one apart.

The rounds work on counts of (part, first shard), not on documents, so they are small; each is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import gapless_rank, staged

SHARDS = 8
ROUNDS = 6
#: Groups of more than this share of a quota are dealt out to parts.
PART_SHARE = 0.5
#: Classes in which a shard's incoming moves are admitted.
CLASSES = 512


def _quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _by_shard(shard: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard + 1)


def _round(state: DataFrame, quotas: list[int], swap: bool) -> DataFrame:
    """One round of moves. state: part (group, salt), first, now (shards), n.

    With ``swap``, what wishes to leave a shard counts as room in it. Should fewer leave than wished, the
    last step evicts what stands above a quota.
    """
    load = {r["now"]: r["n"] for r in state.groupBy("now").agg(F.sum("n").alias("n")).collect()}
    room = [q - load.get(s, 0) for s, q in enumerate(quotas)]
    part = ["group", "salt"]
    votes = state.groupBy(*part, "now").agg(F.sum("n").alias("votes"))
    total = staged(votes.groupBy(*part).agg(F.sum("votes").alias("members")), "totals")
    fits = [max(q, r) for q, r in zip(quotas, room, strict=True)] if swap else room
    able = votes.join(total, part).where((F.col("members") - F.col("votes")) <= _by_shard(F.col("now"), fits))
    best = able.groupBy(*part).agg(
        F.max_by("now", F.struct("votes", -F.col("now"))).alias("target"),
        F.max_by(F.col("members") - F.col("votes"), F.struct("votes", -F.col("now"))).alias("moving"),
    )
    # parts that can't move at all stay; of the rest, whole classes are let in while they fit
    wish = staged(
        best.where("moving > 0").withColumn("class", F.pmod(F.xxhash64(*part), F.lit(CLASSES)).cast("int")), "wishes"
    )
    if swap:
        leaving = state.join(wish, part).where("now != target").groupBy("now").agg(F.sum("n").alias("n")).collect()
        for r in leaving:
            room[r["now"]] += r["n"]
    upto = Window.partitionBy("target").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    classes = (
        wish.groupBy("target", "class").agg(F.sum("moving").alias("moving"))
        .withColumn("upto", F.sum("moving").over(upto))
        .where(F.col("upto") <= _by_shard(F.col("target"), room))
        .select("target", "class")
    )  # at most shards x CLASSES rows
    admitted = staged(wish.join(F.broadcast(classes), ["target", "class"]).select(*part, "target"), "admitted")
    moved = state.join(admitted, part, "left").withColumn("now", F.coalesce("target", "now")).drop("target")
    return staged(moved, "state")


def propagate(
    nodes: DataFrame, *, shards: int = SHARDS, rounds: int = ROUNDS, part_share: float = PART_SHARE
) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``nodes`` (doc_id, group and any other columns but those two).

    Nodes with an equal ``group`` are linked; a NULL group links nothing. Shards' sizes in rows are at
    most one apart, and slots are gapless from 0 in each shard. Repeated rows get a place each, NULL
    doc_ids too. An empty table gives no rows. ``nodes`` is read several times: pass a staged one.
    """
    n = nodes.count()
    quotas = _quotas(n, shards)
    most = max(1, int(quotas[0] * part_share))
    groups = staged(
        nodes.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("__size")).where("__size > 1"), "groups"
    )
    node = F.xxhash64("doc_id", "group")
    # the streamed side of this join may be one hot group: both sides are exchanged, so it can be split
    sized = nodes.join(groups, "group", "left")
    parts = F.ceil(F.col("__size") / most)
    spread = staged(
        sized.withColumn("salt", F.when(F.col("__size").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(1)), parts).cast("int")))
        .withColumn("first", F.pmod(node, F.lit(shards)).cast("int"))
        .drop("__size"),
        "spread",
    )
    linked = spread.where("salt is not null")
    state = staged(
        linked.groupBy("group", "salt", "first").agg(F.count(F.lit(1)).alias("n")).withColumn("now", F.col("first")), "state"
    )
    swap = True
    for k in range(rounds):
        swap = swap and k < rounds // 2
        before, state = state, _round(state, quotas, swap)
        if state.agg(F.sum(F.xxhash64("group", "salt", "first", "now") % 1000003)).first() == before.agg(
            F.sum(F.xxhash64("group", "salt", "first", "now") % 1000003)
        ).first():
            if not swap:
                break
            swap = False
    placed = staged(linked.join(state.drop("n"), ["group", "salt", "first"]), "placed")
    # whatever stands above a shard's quota is free again, in whole parts as far as possible
    # a large part lies in 16 buckets that follow each other
    bucket = F.pmod(F.xxhash64("group", "salt"), F.lit(64)) * 16 + F.pmod(F.xxhash64("doc_id"), F.lit(16))
    ranked = staged(gapless_rank(placed, ["now"], ["group", "salt", "doc_id"], "slot", bucket), "ranked")
    keeps = F.col("slot") < _by_shard(F.col("now"), quotas)
    kept = ranked.where(keeps).withColumn("shard", F.col("now"))
    columns = [*nodes.columns, "shard", "slot"]
    held = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    free = staged(spread.where("salt is null").select(*nodes.columns).unionByName(ranked.where(~keeps).select(*nodes.columns)), "free")
    place = gapless_rank(free, [], ["doc_id", "group"], "__place", F.xxhash64("doc_id", "group"))
    ends, starts, at = [], [], 0
    for s in range(shards):
        starts.append(at - held.get(s, 0))
        at += quotas[s] - held.get(s, 0)
        ends.append(at)
    shard = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        shard = F.when(F.col("__place") < ends[s], s).otherwise(shard)
    filled = place.withColumn("shard", shard).withColumn("slot", F.col("__place") - _by_shard(F.col("shard"), starts))
    return kept.select(*columns).unionByName(filled.select(*columns)).withColumn("slot", F.col("slot").cast("long"))


def document_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32 and group: the text's hash, so equal texts are linked.

    A NULL text has size 1 and the checksum of an empty one, and is linked with NULL texts only.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2("text", 256)), F.lit("null").cast("binary")).alias("group"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, group, shard, slot of all ``docs`` (doc_id, text)."""
    return propagate(staged(document_nodes(docs), "nodes"), shards=shards, rounds=rounds)
