"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most one bit (half of 3, rounded
down) in their upper or their lower 32 bits. So every distinct fingerprint is stored under both of its
halves, and emits every variant of each half within that radius; the shuffle on variants brings each
such pair together. Of two halves one bit apart, one has that bit unset, so only the variants that
set a bit are emitted, 34 rows a fingerprint on average instead of 66. Colliding fingerprints are
verified over all 64 bits, and each bucket gives a spanning forest of its links, never all its pairs.

Buckets of more than ``BLOCK`` rows are dealt out in blocks, a task for each pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import null_safe_key, staged
from .components import connected_components

SEED = 42
RADIUS = 3
#: Rows of a bucket that are compared in one piece.
BLOCK = 2048
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a whole text's word shingles; zero where it has no word."""
    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)]
    h = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, dtype=np.int64), len(shingles)
    for at in range(0, total, 65_536):
        hashes = np.array([h(x, SEED) for x in shingles[at : at + 65_536]], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def row_key() -> Column:
    """Tells rows by doc_id and text: ids may be NULL or repeated."""
    return null_safe_key(F.col("doc_id").cast("long"), F.col("text"))


def fingerprints(docs: DataFrame, width: int = 3, keyed: bool = False) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row, and its ``row_key`` if ``keyed``."""
    names = ["doc_id", "key"] if keyed else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(0).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))], [*names, "fp"])

    own = [F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key")][: len(names)]
    return docs.select("text", *own).mapInArrow(run, "doc_id long, key binary, fp long" if keyed else "doc_id long, fp long")


def _halves(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under its upper and its lower half; the key's bit 32 tells which."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32))
    return fps.select(F.explode(F.array(low, high)).alias("key"), "fp")


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): each half with one of its unset bits set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.left_shift(np.int64(1), np.arange(32, dtype=np.int64))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fp), 8192):
                part = fp[at : at + 8192]
                bare = part.view(np.uint64)
                halves = ((bare & np.uint64(0xFFFFFFFF)).astype(np.int64), (bare >> np.uint64(32)).astype(np.int64) | (1 << 32))
                for half in halves:
                    row, bit = np.nonzero((half[:, None] & bits) == 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(half[row] | bits[bit]), pa.array(part[row])], ["key", "fp"]
                    )

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Verified links that connect whatever links at ``radius`` or fewer bits connect among ``fps``."""
    links: list[tuple[int, int]] = []
    signed = lambda x: int(x) - (1 << 64 if x >> np.uint64(63) else 0)
    rest = np.unique(fps.astype(np.int64).view(np.uint64))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                links.extend((signed(x), signed(y)) for y in found)
                frontier.extend(found)
                rest = rest[~near]
    return links


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each run of equal (key, lo, hi); rows come sorted by them."""
    held: list[np.ndarray] | None = None

    def work(rows: list[np.ndarray]) -> pa.RecordBatch | None:
        key, lo, hi, fp = rows
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        many = ends - starts > 1
        links: list[tuple[int, int]] = []
        for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            if b - a == 2:
                x, y = int(fp[a]), int(fp[a + 1])
                if x != y and ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= RADIUS:
                    links.append((x, y))
            else:
                links.extend(spanning_links(fp[a:b]))
        if not links:
            return None
        u, v = zip(*links, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
        at = int(np.argmax(last))  # the last run may go on in the next batch
        held = [x[at:] for x in rows]
        if at and (out := work([x[:at] for x in rows])) is not None:
            yield out
    if held is not None and (out := work(held)) is not None:
        yield out


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) among distinct fingerprints ``fps`` (fp) that connect all within ``RADIUS`` bits."""
    exact = _halves(fps)
    # an unmatched variant is dropped in the shuffle join; the side with repeated keys is the streamed one
    hit = _variants(fps).join(exact.select("key"), "key", "left_semi")
    members = staged(exact.unionByName(hit), "members")
    hot = staged(members.groupBy("key").count().where(F.col("count") > BLOCK), "hot")
    blocks = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        members.join(hot, "key", "left")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["key", "lo", "hi"]
    return dealt.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(_link, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text).

    Fingerprints within 3 bits are linked, and component_id is the smallest doc_id reachable. NULL and
    empty texts, and those of white space only, have fingerprint zero and are linked like any other.
    A row with a NULL doc_id is kept and linked; its component_id is NULL only where no reachable row has
    an id. Repeated rows are kept each. Other columns are ignored. An empty table gives no rows.
    """
    own = staged(fingerprints(docs, width), "fingerprints")
    distinct = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = staged(fingerprint_links(distinct), "links")
    roots = connected_components(links)
    linked = staged(distinct.join(roots.withColumnRenamed("node", "fp"), "fp"), "linked")
    least = staged(linked.groupBy("root").agg(F.min("least").alias("of_root")), "roots")
    of_fp = staged(
        distinct.join(linked.join(least, "root").select("fp", "of_root"), "fp", "left").select(
            "fp", F.coalesce("of_root", "least").alias("component_id")
        ),
        "components",
    )
    return own.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, width: int = 3) -> DataFrame:
    """The ``row_key`` (key) of one row of each group of ``near_duplicates``: that with the smallest doc_id
    (NULL last), then key. Rows alike in doc_id and text share a key."""
    own = staged(fingerprints(docs, width, keyed=True), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    distinct = staged(own.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    links = staged(fingerprint_links(distinct), "links")
    roots = connected_components(links).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first")
    return rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.key")
