"""MinHash near-duplicates by circulant permutations, banding and exact Jaccard verification.

A document's shingles are hashed into a universe of 2^32 numbers. One permutation of it scatters them; a second
one, circularly shifted by k, gives signature coordinate k: the smallest of pi(sigma(x) - k). So all
coordinates come from two permutations.

Equal sets are one node from the start, so copies cost one row each. Coordinates are cut into bands; nodes
that agree in a band meet in its bucket, and a bucket returns links among those whose signatures are alike in a
share not far below the threshold, as a spanning forest and never as pairs. The components of these links, clouds, hold every
pair that can be near. A cloud's sets are then compared exactly: intersections of one set with all others are counted at
once, and again only a spanning forest of the true links goes on. Buckets and clouds of more than a block are
dealt out in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import null_safe_key, sized, staged
from .components import connected_components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: 32 bands of 5 coordinates: a pair at similarity 0.85 is in no bucket with a chance of 7e-9.
BANDS, ROWS = 32, 5
#: Standard deviations below the threshold at which signatures still count as alike.
DEVIATIONS = 6
#: Members of a bucket, and of a cloud, that are compared in one piece; and shingles of such a piece of a cloud.
BLOCK, CLOUD_BLOCK, CLOUD_SHINGLES = 2048, 1024, 1_000_000


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word shingles; of the whole sequence where it is shorter."""
    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([h(b" ".join(words))], dtype=np.uint64)
    shingles = set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    return np.unique(np.fromiter((h(s) for s in shingles), dtype=np.uint64, count=len(shingles)))


def _scattered(x: np.ndarray) -> np.ndarray:
    """sigma: a permutation of 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signature(hashes: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The ``size`` coordinates of a non-empty set: coordinate k is the smallest pi(sigma(x) - k)."""
    shifts = np.arange(size, dtype=np.uint32)
    least = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    scattered = _scattered(hashes.astype(np.uint32))
    for at in range(0, len(hashes), 512):
        x = scattered[at : at + 512, None] - shifts
        x *= np.uint32(0x9E3779B1)  # pi: two odd factors and a shift, all of them one-to-one
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def row_key() -> Column:
    """Tells rows by doc_id and text: ids may be NULL or repeated."""
    return null_safe_key(F.col("doc_id").cast("long"), F.col("text"))


def signatures(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, key (``row_key``), n (set size), node (128-bit digest of the set), bands, coords (a byte of each
    coordinate) of every row; node, bands and coords are NULL where a text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            rows = []
            for text in batch.column(0):
                s = shingle_hashes(text.as_py(), width)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                sig = signature(s)
                bands = [xxhash.xxh64_intdigest(b.tobytes(), int(i)) for i, b in zip(salt, sig.reshape(BANDS, ROWS), strict=True)]
                rows.append((len(s), xxhash.xxh128_digest(s.tobytes()), np.array(bands, dtype=np.uint64).view(np.int64), (sig >> np.uint32(24)).astype(np.uint8).tobytes()))
            n, node, bands, coords = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(coords, pa.binary())],
                ["doc_id", "key", "n", "node", "bands", "coords"],
            )

    own = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"))
    return own.mapInArrow(run, "doc_id long, key binary, n long, node binary, bands array<long>, coords binary")


def _forest(members: list, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple]:
    """Links that connect whatever ``near`` connects; near(i, rest) tells which of the positions rest are near i."""
    links, rest = [], np.arange(len(members))
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            hit = near(x, rest)
            if hit.any():
                found = rest[hit].tolist()
                links.extend((members[x], members[y]) for y in found)
                frontier.extend(found)
                rest = rest[~hit]
    return links


def alike(rows: list[tuple], least: int) -> list[tuple]:
    """Spanning links among (node, coords) of a bucket whose coords agree in ``least`` places or more."""
    coords = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
    return _forest([r[0] for r in rows], lambda x, rest: (coords[rest] == coords[x]).sum(axis=1) >= least)


def near_sets(rows: list[tuple], num: int, den: int) -> list[tuple]:
    """Spanning links among (node, set) of a cloud with den * intersection >= num * union."""
    sets = [np.frombuffer(r[1], dtype=np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(int(flat.max()) + 1, dtype=bool)
    state = {"flat": flat, "of": np.arange(len(sets)), "starts": starts}

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        if 2 * len(rest) < len(state["of"]):  # what is linked already is counted no more
            state["flat"] = np.concatenate([flat[starts[i] : starts[i + 1]] for i in rest])
            state["of"], state["starts"] = rest, np.concatenate([[0], np.cumsum(sizes[rest])])
        own = flat[starts[x] : starts[x + 1]]
        marked[own] = True
        shared = np.add.reduceat(marked[state["flat"]].astype(np.int32), state["starts"][:-1])
        marked[own] = False
        shared = shared[np.searchsorted(state["of"], rest)].astype(np.int64)
        return den * shared >= num * (sizes[rest] + sizes[x] - shared)

    return _forest([r[0] for r in rows], near)


def _in_runs(work: Callable[[list[tuple]], list[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls ``work`` with the (node, data) rows of each run of equal (key, lo, hi), a node once; rows come sorted by them."""

    def links(found: list[tuple]) -> pa.RecordBatch:
        u, v = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != now:
                    if len(held) > 1:
                        out += work(held)
                    now, held = row[:3], []
                if not held or held[-1][0] != row[3]:
                    held.append(row[3:])
            if len(out) > 10_000:
                yield links(out)
                out = []
        if len(held) > 1:
            out += work(held)
        if out:
            yield links(out)

    return run


def _dealt(rows: DataFrame, data: str) -> DataFrame:
    """Rows (key, node, ``data``, blocks) to one task for each pair of a key's blocks, sorted by (key, lo, hi, node)."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("blocks = 1 or own != other")
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", data)
    )
    n, by = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["key", "lo", "hi"]
    return dealt.repartition(n, *by).sortWithinPartitions(*by, "node")


def clouds(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(node, cloud) of the ``nodes`` (node, bands, coords) that are alike to another; near nodes share a cloud."""
    size = BANDS * ROWS
    least = int(size * num / den - DEVIATIONS * (size * num * (den - num)) ** 0.5 / den)
    placed = nodes.select(F.explode("bands").alias("key"), "node")
    shared = staged(placed.groupBy("key").count().where("count > 1"), "buckets")
    members = staged(placed.join(shared, "key"), "members").join(nodes.select("node", "coords"), "node")
    dealt = _dealt(members.withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")), "coords")
    links = staged(dealt.mapInArrow(_in_runs(lambda rows: alike(rows, least)), "u binary, v binary"), "alike")
    return connected_components(links).withColumnRenamed("root", "cloud")


def near_links(docs: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (u, v) that connect all ``nodes`` (node, key, n, bands, coords) whose sets are near. ``key`` is the row
    of ``docs`` that has the set."""
    member = staged(clouds(nodes, num, den).join(nodes.select("node", "key", "n"), "node"), "clouds")
    return confirmed_links(docs, member, width, num, den)


def confirmed_links(docs: DataFrame, member: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (u, v) that connect all nodes of a cloud whose sets are near, among ``member`` (node, key, n, and the cloud, a
    binary), a staged table. Sets are hashed again from the texts of ``docs``, for these nodes only."""
    load = member.groupBy("cloud").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("rows") / CLOUD_BLOCK, F.col("shingles") / CLOUD_SHINGLES)).cast("int")
    member = staged(member.join(load, "cloud").select("key", "cloud", "node", blocks.alias("blocks")), "loads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # repeated rows have one key: the first of a task will do
        for batch in batches:
            at = [i for i, x in enumerate(batch.column(2).to_pylist()) if x not in seen and not seen.add(x)]
            batch = batch.take(pa.array(at, pa.int64()))
            sets = [shingle_hashes(t.as_py(), width).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())], ["key", "node", "blocks", "data"])

    texts = docs.select(row_key().alias("key"), "text").join(sized(member), "key")
    sets = texts.select("text", F.col("cloud").alias("key"), "node", "blocks").mapInArrow(run, "key binary, node binary, blocks int, data binary")
    return _dealt(sets, "data").mapInArrow(_in_runs(lambda rows: near_sets(rows, num, den)), "u binary, v binary")


def near_duplicates(docs: DataFrame, width: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    Rows are linked where den * intersection >= num * union of their sets of distinct word shingles, words being
    parted by ASCII white space and A-Z lower-cased; a text of fewer than ``width`` words has its whole sequence as
    the one shingle. component_id is the smallest doc_id reachable, and kept tells doc_id = component_id.
    Rows without words (NULL, empty, white space) are linked with nothing. A NULL doc_id is linked like any other;
    its component_id is NULL, and the row kept, only where no reachable row has an id. Repeated rows are linked and
    returned each. Other columns are ignored. An empty table gives no rows. Links are confirmed on the whole
    sets of 64-bit shingle hashes.
    """
    own = staged(signatures(docs, width), "signatures")
    firsts = [F.first(c).alias(c) for c in ("n", "bands", "coords")]
    nodes = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), *firsts)
    nodes = staged(nodes, "nodes")
    links = staged(near_links(docs, nodes, width, num, den), "links")
    roots = connected_components(links)
    linked = staged(nodes.select("node", "least").join(roots, "node"), "linked")
    least = staged(linked.groupBy("root").agg(F.min("least").alias("of_root")), "roots")
    moved = linked.join(least, "root").select("node", "of_root")
    of_node = staged(
        nodes.select("node", "least").join(moved, "node", "left").select("node", F.coalesce("of_root", "least").alias("of_node")), "components"
    )
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("of_node"))
    out = own.select("doc_id", "n", "node").join(of_node, "node", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
