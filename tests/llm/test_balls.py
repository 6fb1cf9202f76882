"""Balls over several fingerprints: against brute force, the chances stated, and odd rows."""

import random
import re
from math import acos, comb, pi

import numpy as np
import pytest
from quern.llm import balls
from quern.llm.common import staged


def brute_sets(texts, width=5):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def brute_components(sets, num=80, den=100):
    """Roots by union-find over all pairs; empty sets are one group."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) * den < num * max(len(a), len(b)):
                continue
            if a == b or den * len(a & b) >= num * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def least_ids(ids, roots):
    least = {}
    for i, r in zip(ids, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    return [least[r] for r in roots]


def edited(words, least, rng):
    """A copy with words replaced one by one, as long as its similarity is ``least`` or more."""
    own = brute_sets([" ".join(words)])[0]
    out = list(words)
    while True:
        more = list(out)
        more[rng.randrange(len(more))] = f"new{rng.randrange(10**9)}"
        other = brute_sets([" ".join(more)])[0]
        if len(own & other) < least * len(own | other):
            return out
        out = more


def test_components_equal_brute_force(spark, docs):
    rows = docs.collect()
    want = least_ids([r.doc_id for r in rows], brute_components(brute_sets([r.text for r in rows])))
    got = {r.doc_id: r.component_id for r in balls.near_duplicates(docs).collect()}
    assert got == dict(zip([r.doc_id for r in rows], want, strict=True))


@pytest.mark.parametrize("similarity, recall", [(0.8, 0.87), (0.85, 0.95), (0.9, 0.99)])
def test_recall_of_near_copies_and_no_false_link(spark, similarity, recall):
    rng = random.Random(int(100 * similarity))
    rows = []
    for i in range(600):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(100, 400))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(words, similarity, rng)))]
    got = {r.doc_id: r.component_id for r in balls.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c in (d, d - d % 2) for d, c in got.items())
    assert sum(got[2 * i + 1] == 2 * i for i in range(600)) >= 600 * recall


def test_sketch_is_the_majority_and_differs_as_stated():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    mixed = [balls.sketch(x[i : i + 1]) for i in range(700)]
    bits = np.unpackbits(np.array(mixed).view(np.uint8).reshape(700, -1), axis=1)
    assert (np.unpackbits(balls.sketch(x).view(np.uint8)) == (2 * bits.sum(axis=0) > 700)).all()
    apart = []
    for _ in range(300):
        y = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = balls.sketch(y[:900]), balls.sketch(y[100:])  # 800 of 1000
        apart.append(np.bitwise_count(a ^ b).sum() / 384)
    q = acos(1.6 / 1.8) / pi
    assert abs(np.mean(apart) - q) < 0.01
    b, n = balls.BITS, balls.BLOCKS
    meet = (1 - q) ** b + b * q * (1 - q) ** (b - 1) + comb(b, 2) / 2 * q**2 * (1 - q) ** (b - 2)
    assert 0.89 < 1 - (1 - meet) ** n < 0.93


@pytest.mark.parametrize("block", [64, 2048])
def test_links_within_blocks_equal_brute_force(spark, monkeypatch, block):
    """Sketches around few centres: buckets over and under a block connect what all pairs connect."""
    monkeypatch.setattr(balls, "BLOCK", block)
    rng = random.Random(9)
    size, made = 64 * balls.WORDS, []
    for _ in range(4):
        centre = rng.getrandbits(size)
        for _ in range(150):
            x = centre
            for b in rng.sample(range(size), rng.randint(0, 40)):
                x ^= 1 << b
            made.append(x.to_bytes(size // 8, "big"))
    whole = np.frombuffer(b"".join(made), dtype=np.uint8).reshape(len(made), -1)
    fp = np.ascontiguousarray(whole).view(np.int64)[:, 0].tolist()
    bits = np.unpackbits(whole, axis=1)[:, : balls.BLOCKS * balls.BITS].reshape(len(made), balls.BLOCKS, balls.BITS).astype(int)
    root = list(range(len(made)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(made)):
        for j in range(i):
            d = np.abs(bits[i] - bits[j]).sum(axis=1)
            even = bits[i].sum(axis=1) == bits[j].sum(axis=1)
            if ((d <= 1) | (d == 2) & even).any() and ((fp[i] ^ fp[j]) & (1 << 64) - 1).bit_count() <= balls.RADIUS:
                root[max(find(i), find(j))] = min(find(i), find(j))
    df = staged(spark.createDataFrame([(bytearray(m),) for m in made], "sketch binary"), "sketches")
    assert (balls.crowded(df).count() > 0) == (block == 64)
    links = balls.candidate_links(df).collect()
    own = {f: find(i) for i, f in enumerate(fp)}
    joined = dict((f, f) for f in fp)

    def top(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for r in links:
        assert own[r.u] == own[r.v]
        joined[top(r.u)] = top(r.v)
    assert len({top(f) for f in fp}) == len(set(own.values()))


def test_unlike_texts_that_meet_by_chance_are_not_linked(spark):
    """What brings two texts together is no evidence: the bits that verify are not among those of the blocks."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(13))) for i in range(6000)]
    nodes = staged(balls.sketches(spark.createDataFrame(rows, "doc_id long, text string")), "sketches")
    met = balls.placed(nodes, True).groupBy("key").count().where("count > 1").count()
    assert met > 500 and balls.candidate_links(nodes).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted(((r.doc_id, r.component_id) for r in balls.near_duplicates(odd_docs).collect()), key=repr)
    want = [(1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 7), (8, 8), (9, 9), (-3, -3), (None, 1), (None, 3)]
    assert got == sorted(want, key=repr)
    assert balls.near_duplicates(no_docs).count() == 0
    assert balls.one_of_each(no_docs).count() == 0
    alone = spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")
    assert balls.near_duplicates(alone).first().component_id is None
