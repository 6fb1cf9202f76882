import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from quern.llm import bfd_packing, tokens, vector_packing

TOKENIZER = Tokenizer.from_file(tokens.default_path())


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize(
    "text",
    ["it's DON'T  we'LL x's", "áb   c\x1cd <|endoftext|> <|EndOfText|> ²½ Ⅷ ΣΑΣ İ", "naïve\x85x ÀÉ½a", "😀👍 日本語 ͅ ŉ ǅ", "", "\n\n",
     "x" * 300 + " " + "é" * 500, "12345 #$%^&*()_+ __a_b", "á é", None],
)
def test_memo_equals_the_tokenizer(text):
    memo = tokens.chunk_ids(tokens.default_path())
    assert np.frombuffer(tokens.encode(memo, text), "<u4").tolist() == ids_of(text)[:-1]


def test_a_word_is_in_the_memo_once():
    memo = tokens.ChunkIds(tokens.default_path())
    for text in ("Word word word, (word) it's", "\u0130x \u0307 \u023ax \u2c65x", "\u2c65 \u0307x \u0130 \u023a"):
        assert np.frombuffer(tokens.encode(memo, text), "<u4").tolist() == ids_of(text)[:-1]
    assert {w for w in memo if w.isascii()} == set(b"Word word word, , (word) ( ) it's it 's i x".split())
    first = tokens.chunk_ids(tokens.default_path())
    tokens.forget()
    assert tokens.chunk_ids(tokens.default_path()) is not first


def check_pieces(pieces, rows, max_tokens=4096, max_segments=256, max_loss=4096):
    known = {}
    ids_of = lambda t: known[t] if t in known else known.setdefault(t, globals()["ids_of"](t))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[(p.doc_id, p.doc_tokens)].append(p)
        by_sequence[p.sequence_id].append(p)
    want = defaultdict(list)
    for doc_id, text in rows:
        want[(doc_id, len(ids_of(text)))].append(ids_of(text))
    assert by_doc.keys() == want.keys()
    for key, texts in want.items():
        whole = b"".join(np.array(t, "<u4").tobytes() for t in texts)
        got = sorted((p.start, bytes(p.ids)) for p in by_doc[key])
        assert sum(len(x) for _, x in got) == len(whole)
        if len(texts) == 1:
            at = 0
            for start, part in got:
                assert start == at
                at += len(part) // 4
            assert b"".join(x for _, x in got) == whole
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        at = 0
        for p in s:
            assert p.offset == at and p.length > 0 and len(p.ids) == 4 * p.length
            at += p.length
        assert at == max_tokens or at & (at - 1) == 0
        assert at <= max_tokens and len(s) <= max_segments and sum(p.loss_tokens for p in s) <= max_loss


def test_vector_packing_loses_nothing(docs):
    pieces = vector_packing.pack_vectors(docs).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in docs.collect()])


def test_vector_packing_under_three_limits(spark, docs):
    rows = docs.selectExpr("doc_id", "text", "cast(doc_id % 40 as int) as loss_from")
    pieces = vector_packing.pack_vectors(rows, max_tokens=512, max_segments=5, max_loss=300).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in docs.collect()], 512, 5, 300)
    first = {r.doc_id: r.loss_from for r in rows.collect()}
    for p in pieces:
        bearing = [i for i in range(p.start, p.start + p.length) if i >= first[p.doc_id]]
        assert p.loss_tokens == len(bearing)


def test_vector_packing_odd_rows(odd_docs, no_docs):
    pieces = vector_packing.pack_vectors(odd_docs).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert vector_packing.pack_vectors(no_docs).count() == 0


def test_op8_digest(spark, sf):
    from quern.llm.queries import op8_vector_packing

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for p in op8_vector_packing(spark, sf).collect():
        ids = np.array(ids_of(texts[p.doc_id]), "<u4")
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())


def brute_vectors(items, max_tokens, max_segments, max_loss):
    """Sequences of (doc, start, length) by the dot-product rule, with plain lists and exact fractions.

    items: (doc, list of 0/1 for loss-bearing tokens), each shorter than a sequence.
    """
    pool = [[doc, 0, marks] for doc, marks in items]
    out = []
    while pool:
        placed, room, slots, loss_room = [], max_tokens, max_segments, max_loss
        while room and slots and pool:
            def worth(x):
                return (Fraction(len(x[2]) * room, max_tokens**2) + Fraction(slots, max_segments**2)
                        + Fraction(sum(x[2]) * loss_room, max_loss**2))

            fits = [x for x in pool if len(x[2]) <= room and sum(x[2]) <= loss_room]
            x = max(fits or pool, key=worth)
            n = 0
            while n < min(room, len(x[2])) and sum(x[2][: n + 1]) <= loss_room:
                n += 1
            if not n:
                break
            placed.append((x[0], x[1], x[2][:n]))
            room, slots, loss_room = room - n, slots - 1, loss_room - sum(x[2][:n])
            if n < len(x[2]):
                pool[pool.index(x)] = [x[0], x[1] + n, x[2][n:]]
            else:
                pool.remove(x)
        total = sum(len(m) for _, _, m in placed)
        over = 0 if total == max_tokens else total - 2 ** (total.bit_length() - 1)
        while over:
            doc, start, marks = placed.pop()
            k = min(over, len(marks))
            pool.append([doc, start + len(marks) - k, marks[len(marks) - k :]])
            if len(marks) > k:
                placed.append((doc, start, marks[:-k]))
            over -= k
        out.append([(doc, start, len(marks)) for doc, start, marks in placed])
    return out


def test_vector_packing_equals_brute_force():
    rng = np.random.default_rng(8)
    for case in range(60):
        limits = [(64, 4, 64), (64, 9, 20), (32, 3, 8)][case % 3]
        items = []
        for doc in range(int(rng.integers(1, 25))):
            n = int(rng.integers(1, limits[0]))
            items.append((doc, [int(i >= rng.integers(0, n + 1)) for i in range(n)] if case % 2 else [1] * n))
        packer = vector_packing.Packer(*limits)
        for doc, marks in items:
            loss = np.concatenate([[0], np.cumsum(marks)])
            packer.pool.append(vector_packing.Item(doc, np.zeros(len(marks), "<u4"), loss, len(marks)))
            packer.tokens += len(marks)
        got = [[(i.doc_id, s, n) for i, s, n in q] for q in packer.pack()]
        assert got == brute_vectors(items, *limits)


def check_conversations(pieces, turns, max_tokens, max_segments, max_loss):
    """Every token once and in order, whole conversations uncut, every limit kept."""
    by_item, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_item[(p.conv_id, p.turn, p.item_tokens)].append(p)
        by_sequence[p.sequence_id].append(p)
    convs = defaultdict(list)
    for conv_id, turn, role, text in turns:
        convs[conv_id].append((-1 if turn is None else turn, np.array(ids_of(text), "<u4"), role == "assistant"))
    total = defaultdict(int)
    for p in pieces:
        total[p.conv_id] += p.length
    assert total == {c: sum(len(x) for _, x, _ in ts) for c, ts in convs.items()}
    for c, ts in convs.items():
        if c is None:
            continue
        ts.sort(key=lambda t: (t[0], t[1].tobytes()))
        ids = np.concatenate([x for _, x, _ in ts])
        marks = np.concatenate([np.full(len(x), b, dtype=int) for _, x, b in ts])
        own = sorted((p for p in pieces if p.conv_id == c), key=lambda p: (p.turn, p.start))
        if len({t for t, *_ in ts}) == len(ts):
            assert b"".join(bytes(p.ids) for p in own) == ids.tobytes()
            at = 0
            for p in own:
                assert p.loss_tokens == marks[at : at + p.length].sum()
                at += p.length
        if len(ids) <= max_tokens:
            assert len({p.turn for p in own}) == 1  # one item
            if marks.sum() <= max_loss:
                assert len(own) == 1  # and uncut
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        at = 0
        for p in s:
            assert p.offset == at
            at += p.length
        assert at <= max_tokens and len(s) <= max_segments and sum(p.loss_tokens for p in s) <= max_loss
    return by_sequence


def test_conversations_are_packed_whole(spark, sf):
    from quern.llm.queries import conversation_packing

    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    for limits in ((4096, 256, 1024), (300, 5, 120)):
        pieces = vector_packing.pack_conversations(table, max_tokens=limits[0], max_segments=limits[1], max_loss=limits[2]).collect()
        sequences = check_conversations(pieces, turns, *limits)
        assert max(sum(p.loss_tokens for p in s) for s in sequences.values()) > 0.8 * limits[2]
    digest = {(p.conv_id, p.turn, p.start): p for p in conversation_packing(spark, sf).collect()}
    for p in vector_packing.pack_conversations(table, max_loss=1024).collect():
        assert digest[(p.conv_id, p.turn, p.start)].ids_crc32 == zlib.crc32(bytes(p.ids))


def test_odd_and_long_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, ids string, segment int, n int"
    long = [(1, i, "assistant" if i % 2 else "user", f"word{i} " * 30) for i in range(200)]
    rows = long + [(2, 0, "user", "hi"), (2, None, None, None), (2, 1, "assistant", ""), (3, 0, "assistant", "x " * 3000), (None, 0, "user", "a b"), (None, 1, "assistant", "c")]
    rows += [(4, 0, "user", f"same turn {i} " * 9) for i in range(60)] + [(5, 0, "user", "again"), (5, 0, "user", "again")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema).repartition(5)
    pieces = vector_packing.pack_conversations(df, max_tokens=256, max_segments=8, max_loss=100).collect()
    check_conversations(pieces, rows, 256, 8, 100)
    assert vector_packing.pack_conversations(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        vector_packing.pack_conversations(df, max_loss=0)


def test_copies_of_a_turn_are_no_single_item(spark):
    rows = [(None, 0, "assistant", "the same again")] * 40 + [(7, 0, "user", "the same again")] * 400 + [(7, 1, "assistant", "and this")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    pieces = vector_packing.pack_conversations(df, max_tokens=64, max_loss=32).collect()
    check_conversations(pieces, rows, 64, 256, 32)
    n = len(ids_of("the same again"))
    own = [p for p in pieces if p.conv_id is None]
    assert len(own) == 40 and all(p.item_tokens == p.length == p.loss_tokens == n for p in own)
    # what a task holds of one turn's copies does not grow with their number
    assert max(p.item_tokens for p in pieces if p.conv_id == 7) < 2 * 64 + n


def test_id_matrices_are_written_and_read_back(spark, docs, odd_docs, no_docs, tmp_path):
    import json
    import os

    for n, table in enumerate((docs, odd_docs, no_docs)):
        rows = bfd_packing.pack_best_fit(table.repartition(3), length=256)
        path = str(tmp_path / f"m{n}")
        bfd_packing.write_matrices(rows, path)
        key = lambda r: r.sequence_id
        want, got = sorted(rows.collect(), key=key), sorted(bfd_packing.read_matrices(spark, path).collect(), key=key)
        assert [tuple(r) for r in got] == [tuple(r) for r in want]
        parts = json.load(open(f"{path}/manifest.json"))["parts"]
        assert sum(p["n"] for p in parts) == len(want)
        # the matrix is raw: numpy reads it by its shape
        for p in parts:
            matrix = np.fromfile(f"{path}/{p['name']}.ids", "<u4").reshape(p["n"], 256)
            assert {m.tobytes() for m in matrix} <= {bytes(r.input_ids) for r in want}
    # what a lost attempt leaves is in no manifest; what was changed is told
    path = str(tmp_path / "m0")
    open(f"{path}/part-lost.ids", "wb").write(b"1234")
    assert bfd_packing.read_matrices(spark, path).count() == sum(1 for _ in bfd_packing.pack_best_fit(docs.repartition(3), length=256).collect())
    first = json.load(open(f"{path}/manifest.json"))["parts"][0]["name"]
    size = os.path.getsize(f"{path}/{first}.ids")
    with open(f"{path}/{first}.ids", "r+b") as f:
        f.seek(size - 4)
        f.write(b"\x01\x02\x03\x04")
    with pytest.raises(Exception, match="not what was written"):
        bfd_packing.read_matrices(spark, path).collect()


def brute_best_fit(lengths, length):
    rows = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        rooms = [(length - sum(lengths[j] for j in r), k) for k, r in enumerate(rows)]
        fit = [x for x in rooms if x[0] >= lengths[i]]
        if fit:
            rows[min(fit, key=lambda x: x[0])[1]].append(i)
        else:
            rows.append([i])
    return rows


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(3)
    for length in (1, 7, 64, 100):
        lengths = rng.integers(1, length + 1, 200).tolist()
        got, want = bfd_packing.best_fit_decreasing(lengths, length), brute_best_fit(lengths, length)
        assert len(got) == len(want)
        load = lambda rows, lengths=lengths: sorted(sum(lengths[i] for i in r) for r in rows)
        assert load(got) == load(want)
        assert sorted(i for r in got for i in r) == list(range(200))


def test_best_fit_rows(docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        parts = defaultdict(list)
        for r in bfd_packing.pack_best_fit(table, length=256).collect():
            ids = np.frombuffer(bytes(r.input_ids), "<u4").tolist()
            assert len(ids) == 256 and not any(ids[r.n_tokens :]) and r.cu_seqlens[-1] == r.n_tokens
            assert r.position_resets == r.cu_seqlens[:-1]
            for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
                parts[doc].append((start, ids[a:b]))
        want = defaultdict(list)
        for r in table.collect():
            ids = ids_of(r.text)
            want[r.doc_id] += [(s, ids[s : s + 256]) for s in range(0, len(ids), 256)]
        assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    assert bfd_packing.pack_best_fit(no_docs).count() == 0
