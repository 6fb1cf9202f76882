"""A training corpus from raw documents: filter, deduplicate, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
back as the next stage's ``docs``. All but the last return the columns of ``docs``.

Stages that run Python make the session's Arrow batches small (``small_batches``), as the workers of all stages share an executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm import balls, decontaminate, pii, quality, vector_packing
from quern.llm.common import discard, mark, small_batches, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's distributions (operator 5)."""
    small_batches(spark)
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (operator 9's method): that with the smallest id, NULL last.

    Documents are linked at a similarity of 0.8 or more of their five-word shingles, which balls over several
    fingerprints bring together and whole sets confirm.
    Rows are told apart by id and text, so groups may share an id or have none.
    """
    small_batches(spark)
    # most documents stay, so the keys grow with the table: a merge join at every size, never a broadcast
    kept = staged(balls.one_of_each(docs), "kept").withColumnRenamed("key", "__kept").hint("merge")
    keyed = docs.withColumn("__key", balls.row_key())
    return keyed.join(kept, F.col("__key") == F.col("__kept"), "left_semi").dropDuplicates(["__key"]).drop("__key")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in a benchmark item (operator 7)."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind (operator 3)."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences, with their ids (operator 8)."""
    small_batches(spark)
    return vector_packing.pack_vectors(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("personal data", redacted),
    ("packing", packed),
]

#: SQL can't express fingerprints' components, fitted span classifiers or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    began = mark()
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, began)  # what the stage was made from
    return docs
