import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from quern.llm import queries, runs


def brute_runs(w, least=6, times=4):
    """Every maximal stretch of every period, from the definition."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            smaller = any(all(w[x] == w[x + p] for x in range(start, start + length - p)) for p in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, words):
    found = brute_runs(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    longest = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[0] if found else (None,) * 3
    said = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    rest = " ".join(x for i, x in enumerate(words) if i not in dropped)
    milli = longest[1] * 1000 // longest[2] if found else None
    return (doc_id, len(found), *longest, milli, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest())


def test_runs_of_small_alphabets():
    rng = random.Random(2)
    for _ in range(1500):
        k = rng.choice([1, 2, 2, 3, 4])
        w = [bytes([97 + rng.randrange(k)]) for _ in range(rng.randrange(40))]
        if rng.random() < 0.6 and w:  # a repeated part, some of it changed
            p = w[: rng.randrange(1, len(w) + 1)]
            w = w[: rng.randrange(len(w) + 1)] + p * rng.randrange(1, 7) + w[: rng.randrange(len(w) + 1)]
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = b"z"
        for least, times in ((6, 4), (1, 2), (9, 3)):
            assert runs.word_runs(w, least, times) == brute_runs(w, least, times), (w, least, times)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 301])
def test_suffix_order(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 3, n), np.zeros(n, dtype=int), np.arange(n) % 5):
        order, lcp = runs.suffix_order(ids)
        suffixes = [tuple(ids[i:]) for i in order]
        assert suffixes == sorted(suffixes) and sorted(order) == list(range(n))
        for (a, b), h in zip(zip(suffixes, suffixes[1:], strict=False), lcp[1:], strict=True):
            assert a[:h] == b[:h] and (len(a) == h or len(b) == h or a[h] != b[h])


def cycled(doc_id, text):
    """The words of the query's documents, from the definition."""
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_query_equals_brute_force(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' WHERE len(text) < 4000").fetchall()
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    assert len(docs) > 150
    for doc_id, text in docs:
        assert got[doc_id] == expected(doc_id, [w.decode() for w in cycled(doc_id, text)])


def test_long_periodic_texts():
    for w in ([b"a"] * 30_000, [b"x%d" % (i % 700) for i in range(30_000)], [b"y%d" % (i % (i // 100 + 1)) for i in range(30_000)]):
        found = runs.word_runs(w)
        for s, n, q in found[:50]:
            assert w[s : s + n - q] == w[s + q : s + n] and n >= max(6, 4 * q)
            assert (s == 0 or w[s - 1] != w[s - 1 + q]) and (s + n == len(w) or w[s + n] != w[s + n - q])
        assert found
    assert runs.word_runs([b"a"] * 30_000) == [(0, 30_000, 1)]


def test_odd_rows(spark, odd_docs, no_docs):
    got = runs.periodic_runs(odd_docs, texts=True).collect()
    assert len(got) == odd_docs.count()
    none = hashlib.sha256(b"").hexdigest()
    for r in got:
        if r.doc_id in (3, 4, 5):
            assert tuple(r)[1:] == (0, None, None, None, None, none, none, [], "")
    nine = next(r for r in got if r.doc_id == 9)
    assert (nine.start, nine.length, nine.period, nine.exponent_milli) == (1, 1000, 1, 1_000_000)
    assert nine.collapsed == "1" * 8_000 + " +1" and [tuple(r) for r in nine.runs] == [(1, 1000, 1)]
    assert runs.periodic_runs(no_docs).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        runs.periodic_runs(no_docs, times=1)
