import random
import re

import duckdb
import numpy as np
import pytest

from quern.llm import minhash, queries
from quern.llm.common import staged


def brute_sets(texts, width=3):
    out = []
    for text in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or ({" ".join(w)} if w else set()))
    return out


def brute_roots(sets, num=85, den=100):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where.get(x, ())}:
            if den * len(s & sets[j]) >= num * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            where.setdefault(x, []).append(i)
    return [find(i) for i in range(len(sets))]


def expected(rows):
    sets = brute_sets([t for _, t in rows])
    roots = brute_roots(sets)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(r), i == least.get(r)) for (i, _), s, r in zip(rows, sets, roots, strict=True)), key=repr)


def got(df):
    return sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr)


def test_whole_table_equals_brute_force_and_sql(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == expected(rows)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(c.execute(queries.ORACLE_SQL["op12_circulant_minhash"]).fetchall(), key=repr) == got(docs)


def families(seed=1, count=30, size=14):
    """Texts around common ones, at similarities on both sides of the limit, in chains and stars."""
    rng = random.Random(seed)
    texts = []
    for f in range(count):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 5, 40, 41, 120, 400]))]
        now = base
        for _ in range(size):
            now = list(now if f % 2 else base)
            for _ in range(rng.randrange(1 + len(now) // 40)):
                now[rng.randrange(len(now))] = f"w{rng.randrange(4000)}"
            texts.append(" ".join(now))
    return texts


@pytest.mark.parametrize("block", [7, 2048])
def test_families_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "CLOUD_BLOCK", block)
    rows = list(enumerate(families()))
    want = expected(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == want
    assert 1 < sum(w[3] for w in want) < len(want)


def test_links_at_the_limit(spark):
    """Sets of 37 shared shingles and 3 or 4 own ones a side, of which 37 of 43 are enough and 36 of 44 are not."""
    rows = []
    for i in range(60):
        for shared, own in ((37, 3), (36, 4)):
            common = [f"c{i}x{shared}y{k}" for k in range(shared + 2)]
            for side in "ab":
                rows.append((len(rows), " ".join(common + [f"{side}{i}z{shared}q{k}" for k in range(own)])))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in out:
        pair = r.doc_id // 2
        assert r.n_shingles == 40
        assert r.component_id == (2 * pair if pair % 2 == 0 else r.doc_id), r


def test_signatures_estimate_similarity():
    """The share of equal coordinates is near the similarity, and coordinates are of two shifted permutations."""
    rng = np.random.default_rng(7)
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(minhash._scattered(x))) == len(x)
    for share in (0.2, 0.5, 0.85):
        hits = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
            both = int(len(pool) * share)
            side = (len(pool) - both) // 2
            a, b = pool[: both + side], np.concatenate([pool[:both], pool[both + side :]])
            real = both / len(pool)
            hits.append((minhash.signature(a) == minhash.signature(b)).mean() - real)
        assert abs(np.mean(hits)) < 0.02 and np.std(hits) < 0.06


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want = []
    sets = brute_sets([t for _, t in rows])
    for i, n, c, _ in expected(rows):
        c = c if n else i
        want.append((i, n, c, i == c))
    assert got(odd_docs) == sorted(want, key=repr)
    assert max(map(len, sets)) > 50_000
    assert minhash.near_duplicates(no_docs).count() == 0
    two = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in minhash.near_duplicates(two).orderBy("n_shingles").collect()] == [(None, 0, None, True), (None, 2, None, True), (None, 2, None, True)]


def test_many_copies_and_clouds_in_blocks(spark, monkeypatch):
    """A cloud of blocks of few shingles gives what one block gives."""
    monkeypatch.setattr(minhash, "CLOUD_SHINGLES", 300)
    rows = [(i, t) for i, t in enumerate(families(9, 6, 40))] + [(1000 + i, "the same text of eight words all over") for i in range(300)]
    df = staged(spark.createDataFrame(rows, "doc_id long, text string"), "copies")
    assert got(df) == expected(rows)
