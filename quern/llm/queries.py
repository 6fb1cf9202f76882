"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bfd_packing, centroids, decontaminate, langid, licenses, minhash, pii, quality, runs, sharding, simhash, vector_packing, warc
from .common import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC files of both versions, converted to WARC files and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    odd = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(2)) == 1
    warc.write_arc(pages.where(~odd), f"{arc}/1", "1")
    warc.write_arc(pages.where(odd), f"{arc}/2", "2")
    records = warc.read_arc(spark, f"{arc}/1").unionByName(warc.read_arc(spark, f"{arc}/2"))
    warc.write_warc(warc.to_warc(records), out)
    return warc.read_warc(spark, out).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids as rows of 2048, with the checksum of each row."""
    rows = bfd_packing.pack_best_fit(table(spark, sf_dir, "documents"))
    return rows.withColumn("ids_crc32", F.crc32("input_ids"))


def op3_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans")
    )


def op4_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_distribution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op6_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near"
    )


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = vector_packing.pack_vectors(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over all conversations, each an item: only the assistant's turns bear loss, 1024 tokens a sequence at most."""
    pieces = vector_packing.pack_conversations(table(spark, sf_dir, "conversations"), max_loss=1024)
    return pieces.select("conv_id", "turn", "start", "length", F.crc32("ids").alias("ids_crc32"), "loss_tokens", "item_tokens", "sequence_id", "offset")


def matrix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2's rows written as raw id matrices with their sidecars, and read back."""
    path = scratch(spark, "matrices")
    bfd_packing.write_matrices(bfd_packing.pack_best_fit(table(spark, sf_dir, "documents")), path)
    rows = bfd_packing.read_matrices(spark, path)
    return rows.select("sequence_id", "n_tokens", F.crc32("input_ids").alias("ids_crc32"), "cu_seqlens", "position_resets", "doc_ids", "doc_starts")


def op9_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.learn(docs.where(~held_out))
    return langid.predict(docs, model, F.col("doc_id"), held_out.alias("held_out"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))[0]


def op12_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def cycled_words(text: str | None, doc_id: int | None) -> list[bytes]:
    """The text's words, in every tenth document repeated from one of them on with a period of an id's own."""
    words = runs.words_of(text)
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in documents of which every tenth is made periodic by its id; without an id none is."""
    return runs.periodic_runs(table(spark, sf_dir, "documents"), words=cycled_words)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_arc_to_warc, op2_bfd_packing, op3_weak_supervision_pii, op4_license_patience, op5_distribution_quality,
        op6_balanced_label_propagation, op7_positional_index, op8_vector_packing, op9_simhash_ball,
        op10_string_kernel_language, op11_centroid_clusters, op12_circulant_minhash, op13_periodic_runs, conversation_packing,
        matrix_files, pipeline,
    )
}



def _clusters_sql() -> str:
    """The three rounds and the last assignment, written out."""
    steps = []
    for i in range(4):
        steps.append(f"""near{i} AS MATERIALIZED (
            SELECT r, arg_min(c, [d, c]) AS c, min(d) AS d FROM (
                SELECT r, c, list_sum(list_transform(range(1, 65), lambda j: (x[j] - y[j]) * (x[j] - y[j]))) AS d FROM kept, cents{i}
            ) GROUP BY r
        )""")
        if i < 3:
            steps.append(f"""cents{i + 1} AS MATERIALIZED (
                SELECT c, coalesce(z, y) AS y FROM cents{i} LEFT JOIN (
                    SELECT c, list(m ORDER BY j) AS z FROM (
                        SELECT c, j, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m
                        FROM (SELECT c, unnest(x) AS v, unnest(range(64)) AS j FROM near{i} JOIN kept USING (r)) GROUP BY c, j
                    ) GROUP BY c
                ) USING (c)
            )""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = 64
        ), cents0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x) - 1 AS c, x AS y FROM kept
            ORDER BY c LIMIT 16
        ), {", ".join(steps)}, sums AS (
            SELECT c, sum(d) AS s FROM near3 GROUP BY c
        )
        SELECT vec_id, CAST(near3.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(s AS BIGINT) AS cluster_inertia,
               CAST((SELECT sum(s) FROM sums) AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
        FROM near3 JOIN kept USING (r) JOIN cents3 ON cents3.c = near3.c JOIN sums ON sums.c = near3.c
    """


ORACLE_SQL: dict[str, str] = {
    "op1_arc_to_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op7_positional_index": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), i AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), parts AS (
            SELECT DISTINCT item, list_slice(w, p, p + least(len(w), 13) - 1) AS v
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM i WHERE len(w) > 0)
        ), windows AS (
            SELECT item, len(v) AS k, array_to_string(v, ' ') AS phrase FROM parts
        ), grams AS (
            SELECT doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS phrase
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p
                  FROM d, (SELECT DISTINCT k FROM windows))
        ), found AS (
            SELECT doc_id, item, p, g.k FROM grams g JOIN windows USING (phrase) WHERE g.k = windows.k
        ), hits AS (
            SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
            FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
        ), tokens AS (
            SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d
        ), counts AS (
            SELECT term, count(*) AS n FROM tokens GROUP BY term
        ), placed AS (
            SELECT item, v, unnest(v) AS term, unnest(range(len(v))) AS q FROM parts
        ), ranked AS (
            SELECT item, v, placed.term, q, row_number() OVER (PARTITION BY item, v ORDER BY coalesce(n, 0), placed.term, q) AS r
            FROM placed LEFT JOIN counts USING (term)
        ), ones AS (
            SELECT item, v, term, q FROM ranked WHERE r = 1
        ), twos AS (
            SELECT o.item, o.v, o.term AS first, o.q AS q1, arg_min(x.term, x.r) AS second, arg_min(x.q, x.r) AS q2
            FROM ones o JOIN ranked x ON x.item = o.item AND x.v = o.v AND x.term <> o.term GROUP BY ALL
        ), lists1 AS MATERIALIZED (
            SELECT DISTINCT t.item, t.second, t.q2, doc_id, pos - q1 AS s, unnest([(pos - q1 + 900) // 9 - 1, (pos - q1 + 900) // 9, (pos - q1 + 900) // 9 + 1]) AS cell
            FROM twos t JOIN tokens ON term = t.first
        ), lists2 AS MATERIALIZED (
            SELECT DISTINCT t.second, t.q2, doc_id, pos - q2 AS s, (pos - q2 + 900) // 9 AS cell
            FROM (SELECT DISTINCT second, q2 FROM twos) t JOIN tokens ON term = t.second
        ), near AS (
            SELECT doc_id, count(DISTINCT item) AS n_near
            FROM lists1 a JOIN lists2 b USING (doc_id, second, q2, cell) WHERE abs(a.s - b.s) <= 8 GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
    """,
    "op11_centroid_clusters": _clusters_sql(),
    "op12_circulant_minhash": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS g
            FROM d
        ), sets AS MATERIALIZED (
            SELECT min(r) AS k, g FROM s WHERE len(g) > 0 GROUP BY g
        ), members AS MATERIALIZED (
            SELECT r, s.doc_id, len(s.g) AS n, k FROM s LEFT JOIN sets ON sets.g = s.g
        ), tokens AS MATERIALIZED (
            SELECT k, len(g) AS n, unnest(g) AS t FROM sets
        ), pairs AS MATERIALIZED (
            SELECT a.k AS u, b.k AS v FROM tokens a JOIN tokens b ON a.t = b.t AND a.k <> b.k
            GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT k AS u, k AS v FROM sets
            UNION
            SELECT reach.u, pairs.v FROM reach JOIN pairs ON reach.v = pairs.u
        ), least AS (
            SELECT u, min(doc_id) AS c FROM reach JOIN members ON members.k = reach.v GROUP BY u
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN k IS NULL THEN doc_id ELSE c END AS component_id,
               doc_id IS NOT DISTINCT FROM CASE WHEN k IS NULL THEN doc_id ELSE c END AS kept
        FROM members LEFT JOIN least ON least.u = members.k
    """,
}
