import random
import re

import pytest
import xxhash

from quern.llm import simhash
from quern.llm.common import staged
from quern.llm.components import connected_components


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: list of fingerprints -> list of root indices."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    roots = brute_components(fps)
    least = {}
    for r, k in zip(rows, roots, strict=True):
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = {r.doc_id: (f"{f:016x}", least[k]) for r, f, k in zip(rows, fps, roots, strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


@pytest.mark.parametrize("block", [16, 2048])
def test_links_of_dense_clusters(spark, monkeypatch, block):
    """Clusters around centres, at every distance, with buckets over and under a block."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps | {0, 7, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = staged(spark.createDataFrame([(s,) for s in signed], "fp long"), "fps")
    roots = {r.node: r.root for r in connected_components(staged(simhash.fingerprint_links(df), "links")).collect()}
    want = brute_components(fps)
    pairs = {}
    for s, k in zip(signed, want, strict=True):
        pairs.setdefault(k, set()).add(roots.get(s, s))
    assert all(len(v) == 1 for v in pairs.values())
    assert len({next(iter(v)) for v in pairs.values()}) == len(pairs)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 300) if i % 50 != 49] + [(5, 5), (None, 3), (7, 6)]
    df = spark.createDataFrame(edges, "u long, v long")
    roots = {r.node: r.root for r in connected_components(df).collect()}
    assert roots == {i: i // 50 * 50 for i in range(301) if i // 50 * 50 in roots and i != 300} | ({300: 300} if 300 in roots else {})


def test_odd_rows(spark, odd_docs, no_docs):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()]
    zero = "0" * 16
    assert len(got) == odd_docs.count()
    assert {x for x in got if x[1] == zero} == {(3, zero, 3), (4, zero, 3), (5, zero, 3), (None, zero, 3)}
    assert sorted(x[2] for x in got if x[0] in (1, 2)) == [1, 1, 1]
    assert simhash.near_duplicates(no_docs).count() == 0
    alone = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert simhash.near_duplicates(alone).first().component_id is None
