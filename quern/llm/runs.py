"""Periodic runs of words by Kruskal's algorithm over descending LCP values.

The suffixes of a text are sorted by prefix doubling, and neighbouring suffixes are linked in the order of
descending length of their longest common prefix (LCP). Classes of suffixes are joined by union-find, each with
the ordered set of its positions; the smaller set goes into the larger. Two positions that become neighbours in
a set at distance d while their LCP is at least d seed a run of smallest period d: a smaller period would have
put a position of the class between them before. The LCP gives the run's end, and the seed met first is the
leftmost one. Runs have at least ``least`` words and ``times`` periods, so their seeds share at least
max(least - d, (times - 1) * d) words, and classes that share fewer are never joined.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long,"
    " runs_sha256 string, collapsed_sha256 string"
)


def shared_words(least: int, times: int) -> int:
    """The fewest words that the two positions of a run's seed share."""
    return min(max(least - d, (times - 1) * d) for d in range(1, max(least, 1) + 1))


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array (lcp[i]: of the suffixes i - 1 and i in order; lcp[0] is 0) of whole numbers."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = new
        width *= 2
        if rank[order[-1]] == n - 1 or width >= n:
            break
    lcp, where, words = [0] * n, rank.tolist(), ids.tolist()
    before, h = order.tolist(), 0
    for i, r in enumerate(where):
        if r == 0:
            h = 0
            continue
        j = before[r - 1]
        while i + h < n and j + h < n and words[i + h] == words[j + h]:
            h += 1
        lcp[r] = h
        h -= h > 0
    return order, np.array(lcp, dtype=np.int64)


def word_runs(words: list[bytes], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of ``words``, by start, then period."""
    n, shared = len(words), shared_words(least, times)
    # without two positions that share so many words there is no class to join
    if n < least or len(set(zip(*(words[i:] for i in range(shared)), strict=False))) == n - shared + 1:
        return []
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    order, lcp = suffix_order(np.array(ids, dtype=np.int64))
    edges = np.flatnonzero(lcp >= shared)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    parent = list(range(n))
    places: dict[int, list[int]] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    runs: dict[tuple[int, int], tuple[int, int, int]] = {}
    suffixes = order.tolist()
    for e, level in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        a, b = find(suffixes[e - 1]), find(suffixes[e])
        large, small = places.pop(a, None) or [a], places.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b] = a
        if 16 * len(small) < len(large):
            for p in small:
                large.insert(bisect_left(large, p), p)
        else:
            large = sorted(large + small)  # two ordered stretches: one merge
        places[a], own = large, set(small)
        for p in small:
            i = bisect_left(large, p)
            for left, right in ((i - 1, i), (i, i + 1)):
                # neighbours from one of the two classes share more than this level, and were met before
                if left < 0 or right == len(large) or (large[left] in own) == (large[right] in own):
                    continue
                d = large[right] - large[left]
                if d > level or (key := (d, large[right] + level)) in runs:
                    continue
                start = large[left]
                while start and ids[start - 1] == ids[start - 1 + d]:
                    start -= 1
                runs[key] = (start, key[1] - start, d)
    return sorted((r for r in runs.values() if r[1] >= max(least, times * r[2])), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def words_of(text: str | None, doc_id: int | None = None) -> list[bytes]:
    """The text's words, parted by white space of ASCII."""
    return (text or "").encode("utf-8").split()


def periodic_runs(
    docs: DataFrame, least: int = 6, times: int = 4, words: Callable[[str | None, int | None], list[bytes]] = words_of,
    texts: bool = False,
) -> DataFrame:
    """The periodic runs of every whole text of ``docs`` (doc_id, text), one row a document.

    A run is a maximal stretch of consecutive words with smallest period q and at least max(``least``, ``times`` * q)
    words. Columns: n_runs; start, length, period and exponent_milli of the longest run (ties: smallest start, then
    period; NULL without runs); runs_sha256 over every run's ``start,length,period`` and line feed;
    collapsed_sha256 over the words left when each run keeps its first period, joined by a space; with ``texts``
    also runs (array of structs) and collapsed (that text). ``words(text, doc_id)`` gives the words to search.

    NULL and empty texts have no words and no run. NULL ids and repeated rows give a row each, other columns are
    ignored, an empty table gives no rows. Memory is linear in the longest text.
    """
    if times < 2:
        raise ValueError("a run has at least two periods")
    schema = SCHEMA + (", runs array<struct<start: long, length: long, period: long>>, collapsed string" if texts else "")
    names = [c.strip().split()[0] for c in SCHEMA.split(",")] + (["runs", "collapsed"] if texts else [])
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    if texts:
        kinds += [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]

    def one(text: str | None, doc_id: int | None) -> tuple:
        w = words(text, doc_id)
        found = word_runs(w, least, times)
        longest = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        said = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
        rest = b" ".join(collapsed(w, found))
        start, length, period = longest or (None, None, None)
        row = (
            doc_id, len(found), start, length, period, 1000 * length // period if longest else None,
            hashlib.sha256(said).hexdigest(), hashlib.sha256(rest).hexdigest(),
        )
        if texts:
            row += ([dict(zip(("start", "length", "period"), r, strict=True)) for r in found], rest.decode("utf-8"))
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t.as_py(), i.as_py()) for i, t in zip(batch.column(0), batch.column(1), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
