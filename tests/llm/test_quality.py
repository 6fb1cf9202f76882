import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quern.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def rows_of(df):
    return [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed), r.kept) for r in df.collect()]


def test_measures_equal_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = rows_of(quality.judged(docs))
    assert len(got) == len(texts)
    for doc_id, measures, kept in got:
        assert measures == brute(texts[doc_id])
        assert not (kept and measures[5])


def test_verdict_follows_quality_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(labels[d], k, m[5]) for d, m, k in rows_of(quality.judged(spark.read.parquet(f"{sf}/documents.parquet"))) if d in labels]
    good = [k for q, k, failed in got if q == 1 and not failed]
    bad = [k for q, k, failed in got if q == 0]
    assert sum(good) / len(good) > 0.98
    assert sum(bad) / len(bad) < 0.05


def test_distance():
    p, q = np.array([1.0, 0, 3]), np.array([0, 2.0, 2])
    assert quality.js_distance(p, p) == 0
    assert abs(quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) - 1) < 1e-12
    assert abs(quality.js_distance(p, q) - quality.js_distance(q, p)) < 1e-12


def test_references_count_everything(docs):
    rows = quality.references(docs, 20).collect()
    for lang in ("en", "fr"):
        words = Counter(w for r in docs.collect() if r.lang == lang for w in r.text.encode().lower().split())
        assert sum(words.values()) == sum(r.n for r in rows if r.lang == lang and r.word is None and r["class"] is None)
        top = sorted(((w, n) for w, n in words.items() if re.search(r"[^\W\d_]", w.decode())), key=lambda x: (-x[1], x[0]))[:20]
        assert sorted((bytes(r.word), r.n) for r in rows if r.lang == lang and r.word is not None) == sorted(top)
        chars = sum(len(r.text) for r in docs.collect() if r.lang == lang)
        assert chars == sum(r.n for r in rows if r.lang == lang and r["class"] is not None)


def test_odd_rows(odd_docs, no_docs):
    got = rows_of(quality.judged(odd_docs))
    want = sorted((str(r.doc_id), brute(r.text)) for r in odd_docs.collect())
    assert sorted((str(d), m) for d, m, _ in got) == want
    clashing = odd_docs.selectExpr("*", "'x' AS n_words", "false AS kept", "1 AS `_kept`", "2 AS `a.b`")
    assert sorted(map(str, quality.accepted(clashing).drop("a").collect())) == sorted(
        str(r) for r in clashing.collect() if (r.doc_id, brute(r.text)) in {(d, m) for d, m, k in got if k}
    )
    assert quality.accepted(clashing).columns == clashing.columns
    assert quality.judged(no_docs).count() == 0 and quality.accepted(no_docs).count() == 0


def test_many_languages_take_passes(docs, monkeypatch):
    """Blocks of one language give what one block of all gives, labelled or not."""
    mixed = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'zz' ELSE lang END AS lang")
    rows = lambda: sorted(map(str, quality.judged(mixed).collect()))
    once = rows()
    monkeypatch.setattr(quality, "PASS_LANGUAGES", 1)
    assert rows() == once


def test_counts_are_handed_on_within_a_batch(monkeypatch):
    monkeypatch.setattr(quality, "HELD_WORDS", 2000)
    texts = [" ".join(f"w{i}x{k}" for k in range(4)) for i in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    counts = [b for b in quality._count(iter([batch])) if b.column(2).null_count == 0]
    assert max(b.num_rows for b in counts) <= 2000 + 4 * 256
    total = Counter()
    for b in counts:
        total.update(dict(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)))
    assert total == Counter(w.encode() for t in texts for w in t.split())
