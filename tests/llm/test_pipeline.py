"""Each stage against a brute-force version on what the stage before it kept."""

import corpus_pipeline
import pyarrow as pa
import pytest
from quern.llm.common import BATCH_BYTES
from test_balls import brute_components, brute_sets, least_ids
from test_decontaminate import brute as brute_hits
from test_pii import brute as brute_spans


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.staged(stage(spark, docs, sf), "stage")
        after = docs.collect()
        assert docs.columns == columns and 0 < len(after) <= len(before)
        if name == "quality rules":
            assert len(after) < len(before)
        if name == "near-duplicates":
            roots = brute_components(brute_sets([r.text for r in before]))
            assert {r.doc_id for r in after} == set(least_ids([r.doc_id for r in before], roots))
            assert len(after) == len(set(roots)) < len(before)
        if name == "benchmark decontamination":
            bad = {x[0] for x in brute_hits([(r.doc_id, r.text) for r in before], items) if x[4]}
            assert {str(r.doc_id) for r in after} == {str(r.doc_id) for r in before} - bad
        if name == "personal data":
            assert len(after) == len(before)
            assert not any(brute_spans(r.text) for r in after)
            assert all(r.n_chars == len(r.text) for r in after)
    pieces = corpus_pipeline.packed(spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}


def test_near_duplicates_keep_one_of_repeated_rows(spark, odd_docs):
    got = corpus_pipeline.near_duplicates(spark, odd_docs, "").select("doc_id").collect()
    ids = [r.doc_id for r in got]
    assert sorted(x for x in ids if x is not None) == [-3, 1, 3, 6, 7, 8, 9]


def test_near_duplicates_of_rows_without_or_with_repeated_ids(spark):
    a, b, c, d, e, f = (" ".join(f"{x}{i * i}" for i in range(40)) for x in "abcdef")
    assert len(set(brute_components(brute_sets([a, b, c, d, e, f])))) == 6
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (5, c), (6, c), (1, e), (1, f), (0, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=lambda r: r[1]) == [(None, a), (None, b), (5, c), (5, d), (0, e), (1, f)]


def test_all_stages_on_odd_rows(spark, odd_docs, sf):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.staged(stage(spark, docs, sf), "odd")
    assert docs.count() > 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.mark.parametrize("stage", [corpus_pipeline.quality_rules, corpus_pipeline.near_duplicates, corpus_pipeline.packed])
def test_stages_hand_python_small_batches(spark, sf, stage):
    """A batch has few bytes under each stage that runs Python, and a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 500) AS text", "'en' AS lang")

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    try:
        spark.conf.unset(name)
        stage(spark, docs.limit(3), sf)
        rows = docs.mapInArrow(seen, "n long, size long").collect()
        assert sum(r.n for r in rows) == 3000 and max(r.size for r in rows) < 1.2 * BATCH_BYTES
        spark.conf.set(name, "1m")
        stage(spark, docs.limit(3), sf)
        assert spark.conf.get(name).startswith("1m")
    finally:
        spark.conf.unset(name)
