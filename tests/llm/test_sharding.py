import random
import zlib
from collections import Counter, defaultdict

import pytest

from quern.llm import sharding
from quern.llm.common import staged


def check(rows, shards):
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(shards)), default=0) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def cut(rows):
    """Rows that are not in the shard where most of their group is."""
    groups = defaultdict(Counter)
    for r in rows:
        groups[r.group][r.shard] += 1
    return sum(sum(c.values()) - max(c.values()) for c in groups.values())


def test_documents(docs):
    rows = sharding.shard_documents(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check(rows, 8)
    assert cut(rows) <= 2
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


@pytest.mark.parametrize("kind", ["hot", "all linked", "pairs"])
def test_linked_groups(spark, kind):
    n = 4000
    group = {
        "hot": lambda i: 0 if i % 3 == 0 else i, "all linked": lambda i: i // 7, "pairs": lambda i: i // 2 if i % 10 < 4 else None
    }[kind]
    nodes = staged(spark.createDataFrame([(i, group(i), "x") for i in range(n)], "doc_id long, group long, extra string"), "nodes")
    rows = sharding.propagate(nodes).collect()
    assert len(rows) == n
    check(rows, 8)
    if kind == "hot":  # more than two shards' worth: most of it in as few shards as hold it
        shares = Counter(r.shard for r in rows if r.group == 0)
        assert len(shares) <= 7 and sum(sorted(shares.values())[-4:]) > 0.8 * sum(shares.values())
    else:
        assert cut([r for r in rows if r.group is not None]) < (0.25 if kind == "all linked" else 0.02) * n


def least_cut(sizes, quotas):
    """The fewest rows outside their group's main shard that any placement under the quotas has, by search."""
    best = [sum(sizes)]

    def place(k, room, cut):
        if cut >= best[0]:
            return
        if k == len(sizes):
            best[0] = cut
            return
        for s in sorted(range(len(room)), key=lambda s: -room[s]):
            kept = min(sizes[k], room[s])
            # what doesn't fit its main shard goes wherever there is room: in the largest rooms left
            left, rest = list(room), sizes[k] - kept
            left[s] -= kept
            for o in sorted(range(len(left)), key=lambda o: -left[o]):
                moved = min(rest, left[o])
                left[o], rest = left[o] - moved, rest - moved
            place(k + 1, left, cut + sizes[k] - kept)

    place(0, list(quotas), 0)
    return best[0]


def test_cut_is_near_the_least(spark):
    """Small tables on which the least cut can be searched: propagation stays within a tenth of the rows of it."""
    rng = random.Random(6)
    for case in range(3):
        sizes = sorted((rng.randint(2, 9) for _ in range(9)), reverse=True)
        linked = sum(sizes)
        rows = [(i, k) for k, n in enumerate(sizes) for i in range(1000 * k, 1000 * k + n)] + [(90_000 + i, None) for i in range(linked)]
        nodes = staged(spark.createDataFrame(rows, "doc_id long, group long"), "nodes")
        got = sharding.propagate(nodes, shards=3, part_share=1.0).collect()
        check(got, 3)
        quotas = [len(rows) // 3 + (s < len(rows) % 3) for s in range(3)]
        assert cut([r for r in got if r.group is not None]) <= least_cut(sizes, quotas) + 0.1 * len(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check(rows, 8)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 3} == {(1, 0)}
    assert sharding.shard_documents(no_docs).collect() == []
