import zlib

import numpy as np

from quern.llm import langid


def test_held_out_accuracy(spark):
    from quern.llm.queries import op10_string_kernel_language

    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_string_kernel_language(spark, sf).collect()
    assert len(rows) == len(langs)
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == langs[r.doc_id])
    assert sum(right) / len(right) > 0.97


def test_spectrum_and_kernel():
    a, b = np.zeros(langid.BUCKETS), np.zeros(langid.BUCKETS)
    langid.spectrum(b"abab", a)
    langid.spectrum(b"ABAB", b)
    assert a.sum() == 2 + 2 + 2 and (a == b).all()
    assert abs(langid.kernel(a[None], b[None])[0, 0] - 1) < 1e-9
    for text in (b"", b"a", b"ab"):
        langid.spectrum(text, a)


def test_labels_are_no_input(docs):
    model = langid.learn(docs)
    other = docs.withColumn("lang", langid.F.lit("xx")).withColumn("source", langid.F.lit(None).cast("string"))
    read = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict(d, model, langid.F.col("doc_id")).collect())
    assert read(docs) == read(other)


def test_odd_rows(docs, odd_docs, no_docs):
    model = langid.learn(docs)
    rows = langid.predict(odd_docs, model, langid.F.col("doc_id")).collect()
    assert len(rows) == odd_docs.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (3, 4, 5))
    assert langid.predict(no_docs, model).count() == 0
    nothing = langid.learn(no_docs)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.learn(odd_docs).langs


def test_every_language_is_learned(spark):
    """More languages than any table of four: none is left out, however rare."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(90):
        a, b, c = letters[k % 26], letters[(k * 7 + k // 26) % 26], letters[(k * 11 + 3 + k // 26) % 26]
        words = [a + b + c, c + a + b + str(k), b + b + a + str(k)]
        rows += [(k * 100 + i, " ".join(words[(i + j) % 3] for j in range(12)), f"l{k:02d}") for i in range(3 + 40 * (k == 0))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, landmarks=200)
    assert model.langs == [f"l{k:02d}" for k in range(90)]
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model, langid.F.col("doc_id")).collect()}
    assert sum(got[i] == k for i, _, k in rows) / len(rows) > 0.95


def test_regression_equals_direct_solution(docs):
    """The summed normal equations against numpy's least squares on all rows at once."""
    model = langid.learn(docs, per_language=30, landmarks=12)
    pieces = langid.staged(docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(langid._training, "lang string, bits binary, ones int"), "all")
    every = langid.learn(docs, per_language=10**9, sample_rows=10**12, landmarks=12)
    rows = pieces.collect()
    x = langid.unpacked([bytes(r.bits) for r in rows])
    labels = np.array([every.langs.index(r.lang) for r in rows])
    z = every.features(x).astype(float)
    weight = np.sqrt(1 / np.bincount(labels)[labels])[:, None]
    y = np.where(labels[:, None] == np.arange(len(every.langs)), 1.0, -1.0)
    ridge = np.sqrt(langid.RIDGE) * np.eye(z.shape[1])
    want = np.linalg.lstsq(np.vstack([z * weight, ridge]), np.vstack([y * weight, np.zeros((z.shape[1], y.shape[1]))]), rcond=None)[0]
    assert np.abs(want - every.weights).max() < 1e-3
    assert model.langs == every.langs
