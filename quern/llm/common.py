"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..storage import discard, mark, scratch, shared_dir, staged  # noqa: F401

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a batch under ``small_batches``, and the rows of ``pieces``.
BATCH_BYTES, AT_ONCE = 2 << 20, 256


def small_batches(spark: SparkSession) -> None:
    """From now on Spark hands Python ``BATCH_BYTES`` at once (a longer row alone) in this session, or less if it is set so.

    By default it is 10,000 rows or 64 MB, which a task holds several times over, in the executor and in its worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, ``AT_ONCE`` at a time: so much of a batch becomes Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def fits(df: DataFrame, most: int = 64 << 20) -> bool:
    """Whether the rows, a staged table's, are measured to take at most ``most`` bytes."""
    size = F.lit(0)
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            size = size + 16 + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array<string>":
            size = size + 16 + F.coalesce(F.octet_length(F.array_join(c, " ")) + 16 * F.size(c), F.lit(0))
        else:
            size = size + 16
    return (df.agg(F.sum(size)).first()[0] or 0) <= most


def sized(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A broadcast hint if the rows ``fits``."""
    return F.broadcast(df) if fits(df, most) else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def null_safe_key(*cols: Column) -> Column:
    """A 16-byte key of the columns in which NULL differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\x00", *parts)))


def gapless_rank(
    df: DataFrame, keys: list[str], order: list[str], out: str, bucket_by: Column, buckets: int = 1024
) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within each value of ``keys``, without a window over a whole key.

    Rows are ranked inside hash buckets, and a bucket's first rank is the size of the buckets before
    it. The table of bucket sizes has at most ``buckets`` rows a key, so it is broadcast. ``df`` is
    read twice: pass a staged one. Ties in ``order`` are ranked in any order.
    """
    b = "__bucket"
    df = df.withColumn(b, F.pmod(bucket_by, F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        df.groupBy(*keys, b)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    within = Window.partitionBy(*keys, b).orderBy(*order)
    return (
        df.withColumn("__rank", F.row_number().over(within))
        .join(F.broadcast(sizes), [*keys, b])
        .withColumn(out, F.col("__first") + F.col("__rank") - 1)
        .drop(b, "__rank", "__first")
    )
