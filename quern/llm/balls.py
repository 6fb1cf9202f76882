"""Near-duplicates by ball hashing of several fingerprints, confirmed on whole sets of word shingles.

At a similarity of 0.8 two 64-bit fingerprints differ in about ten bits, too many for one ball. So a set's
sketch here has ``WORDS`` times 64 bits, cut into ``BLOCKS`` blocks of ``BITS`` bits, and a pair need only be
near in one of them: every block emits itself and its variants with one unset bit set, and variants meet in a
shuffle. Blocks one bit apart always meet so, those two bits apart where each has one of the two set. With q the
chance that a bit differs, arccos(2s / (1 + s)) / pi at similarity s, the chance to meet in a block is
(1 - q)^BITS + BITS q (1 - q)^(BITS - 1) + half of C(BITS, 2) q^2 (1 - q)^(BITS - 2): 0.16 at 0.8, so 0.90 over 14
blocks, 0.97 at 0.85 and more than 0.999 at 0.9.

What meets is verified by 64 further bits that no block holds, whose distance has to be at most ``RADIUS`` (0.987 at 0.8);
a bucket gives a spanning forest of its links, never all its pairs. The components of these links are compared exactly,
set by set. So every link in the result is true, and those that are missing are counted by the chances above.

A block of b bits lets N (1 + b + b (b - 1) / 4) / 2^b unlike rows meet each row by chance, and 4 in 10^5 of them pass the
verification, as its bits are not those by which they met. ``BITS`` = 26 serves some 10^8 distinct texts: there each row has
0.16 chance links, too few to join the components into one. More texts need wider blocks, and more of them for the same recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import sized, staged
from .components import connected_components
from .minhash import confirmed_links, shingle_hashes
from .simhash import row_key, spanning_links

WORDS, BLOCKS, BITS = 6, 14, 26
#: Of the 64 bits that verify, those in which a pair that meets may differ.
RADIUS = 16
#: Rows of a bucket that are compared in one piece, and those up to which buckets are first looked through together.
BLOCK, SMALL = 2048, 32
#: Of a byte, its bits in eight lanes of a byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def sketch(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """``words`` independent 64-bit SimHashes of a set of 64-bit hashes: each bit that of the majority."""
    counts = np.zeros((words, 8, 8), dtype=np.int64)
    salts = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):  # a lane holds up to 255
        x = hashes[at : at + 255, None] + salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        lanes = _LANES[np.ascontiguousarray(x).view(np.uint8)].sum(axis=0, dtype=np.uint64)
        counts += lanes.view(np.uint8).reshape(words, 8, 8)
    return np.packbits(2 * counts > len(hashes), axis=2).reshape(words, 8).view(np.uint64).ravel()


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, key (``row_key``), n (set size), node (128-bit digest of the set), sketch and fp (64 bits more, by which what
    meets is verified) of every row; fp and sketch are NULL where a text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, fp, made = [], [], [], []
            for text in batch.column(0):
                s = shingle_hashes(text.as_py(), width)
                n.append(len(s))
                node.append(xxhash.xxh128_digest(s.tobytes()))
                whole = sketch(s, WORDS + 1) if len(s) else None
                fp.append(None if whole is None else int(whole.view(np.int64)[WORDS]))
                made.append(None if whole is None else whole[:WORDS].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(fp, pa.int64()), pa.array(made, pa.binary())],
                ["doc_id", "key", "n", "node", "fp", "sketch"],
            )

    own = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"))
    return own.mapInArrow(run, "doc_id long, key binary, n long, node binary, fp long, sketch binary")


def placed(nodes: DataFrame, variants: bool) -> DataFrame:
    """(key, fp): fp under each block of the sketch, and under its variants with an unset bit set. A key is the
    block's number and its bits. Without a column fp the sketch's first 64 bits take its place."""
    told = "fp" in nodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.left_shift(np.int64(1), np.arange(BITS, dtype=np.int64))
        numbers = np.left_shift(np.arange(BLOCKS, dtype=np.int64), BITS)
        for batch in batches:
            whole = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(-1, WORDS * 8)
            for at in range(0, len(whole), 1024):
                part = np.ascontiguousarray(whole[at : at + 1024])
                fp = batch.column(1).to_numpy(zero_copy_only=False)[at : at + 1024] if told else part.view(np.int64)[:, 0]
                bits = np.unpackbits(part, axis=1)[:, : BLOCKS * BITS].reshape(-1, BLOCKS, BITS)
                exact = bits.astype(np.int64) @ powers + numbers
                keys, rows = [exact.ravel()], [np.repeat(np.arange(len(part)), BLOCKS)]
                if variants:
                    row, block, bit = np.nonzero(bits == 0)
                    keys.append(exact[row, block] | powers[bit])
                    rows.append(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(fp[np.concatenate(rows)])], ["key", "fp"]
                )

    return nodes.select("sketch", *["fp"] * told).mapInArrow(run, "key long, fp long")


def _wider(values: DataFrame) -> DataFrame:
    """(key): distinct ``values`` (key) and their variants."""
    bits = [F.lit(1 << b) for b in range(BITS)]
    return values.select(F.explode(F.array("key", *[F.col("key").bitwiseOR(b) for b in bits])).alias("key")).distinct()


def crowded(nodes: DataFrame) -> DataFrame:
    """(key, count) of the buckets over ``BLOCK`` rows. One that large takes over BLOCK / (BITS + 1) rows from one value
    of a block, so only the buckets around such values are counted."""
    dense = placed(nodes, False).groupBy("key").count().where(F.col("count") > BLOCK // (BITS + 1)).select("key")
    around = staged(_wider(dense), "around")
    return placed(nodes, True).join(sized(around), "key").groupBy("key").count().where(F.col("count") > BLOCK)


def links_in(rows: list[np.ndarray], radius: int) -> list[tuple[int, int]]:
    """Spanning links of each run of equal (key, lo, hi); ``rows`` are these three and fp, sorted."""
    *by, fp = rows
    run = np.concatenate([[0], np.cumsum(np.logical_or.reduce([np.diff(c) != 0 for c in by]))])
    starts = np.concatenate([np.flatnonzero(np.diff(run, prepend=-1)), [len(run)]])
    sizes = np.diff(starts)
    hit = sizes > SMALL
    for lag in range(1, min(int(sizes.max()), SMALL)):
        at = np.flatnonzero(run[lag:] == run[:-lag])
        apart = np.bitwise_count((fp[at] ^ fp[at + lag]).view(np.uint64))
        hit[run[at[(apart > 0) & (apart <= radius)]]] = True
    return [x for r in np.flatnonzero(hit).tolist() for x in spanning_links(fp[starts[r] : starts[r + 1]], radius)]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``links_in`` of rows that come sorted by (key, lo, hi); the last run of a batch may go on in the next."""
    held = [np.empty(0, dtype=t) for t in (np.int64, np.int32, np.int32, np.int64)]

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        u, v = np.array(links_in(rows, RADIUS), dtype=np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        rows = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
        if len(rows[0]):
            at = int(np.argmax(np.logical_and.reduce([c == c[-1] for c in rows[:3]])))
            if at:
                yield links([x[:at] for x in rows])
            held = [x[at:] for x in rows]
    if len(held[0]):
        yield links(held)


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) among the fp of ``nodes`` (sketch and fp, not NULL) that meet and differ in ``RADIUS`` bits
    or fewer. Buckets over ``BLOCK`` rows are dealt out, a task for each pair of blocks."""
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        placed(nodes, True)
        .join(sized(staged(crowded(nodes), "crowded")), "key", "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("blocks = 1 or own != other")
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    n, by = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["key", "lo", "hi"]
    return dealt.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(_link, "u long, v long")


def _grouped(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The staged ``sketches``, and (node, root, first) of the distinct sets: ``first`` is the row with the smallest
    doc_id (NULL last), then key."""
    own = staged(sketches(docs, width), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    alike = [F.first(c).alias(c) for c in ("n", "fp", "sketch")]  # the same in all rows of a node
    nodes = staged(own.groupBy("node").agg(F.min(order).alias("first"), *alike), "nodes")
    worded = nodes.where("sketch is not null")
    links = staged(candidate_links(worded), "candidates")
    roots = connected_components(links).select(F.col("node").alias("fp"), "root")
    of = F.unhex(F.lpad(F.hex(F.coalesce("root", "fp")), 16, "0"))
    cloud = worded.join(roots, "fp", "left").select("node", "first.key", "n", of.alias("cloud"))
    cloud = staged(cloud, "sets")
    shared = cloud.groupBy("cloud").count().where("count > 1").select("cloud")
    member = staged(cloud.join(shared, "cloud"), "clouds")
    near = connected_components(staged(confirmed_links(docs, member, width, num, den), "links"))
    return own, nodes.join(near, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Rows are linked where den * intersection >= num * union of their sets of distinct word shingles, words being
    parted by ASCII white space and A-Z lower-cased; a text of fewer than ``width`` words has its whole sequence as
    the one shingle. component_id is the smallest doc_id reachable, NULL where none is. Every link found is true and equal sets
    are always linked; a pair at the threshold itself is missed with the chance that the module states.
    Rows without words (NULL, empty, white space) are one group. Repeated rows are returned each. Other columns
    are ignored. An empty table gives no rows.
    """
    own, rooted = _grouped(docs, width, num, den)
    rooted = staged(rooted.select("node", "root", "first.doc_id"), "rooted")
    least = staged(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "roots")
    of = rooted.join(least, "root").select("node", "component_id")
    return own.join(of, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The ``row_key`` (key) of one row of each group of ``near_duplicates``: that with the smallest doc_id
    (NULL last), then key. Rows alike in doc_id and text share a key."""
    _, rooted = _grouped(docs, width, num, den)
    return rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.key")
