"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths made in this context (a thread has its own), in order: two runs in one driver don't see each other's.
_paths: ContextVar[list[str]] = ContextVar("quern_paths")


def _made() -> list[str]:
    try:
        return _paths.get()
    except LookupError:
        _paths.set([])
        return _paths.get()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    On a cluster the setting must be there. In local mode, as in tests, a temporary folder takes its place and is
    kept in the session's setting.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}/{name}"
    _made().append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so that a lost executor
    costs a re-read and not a recomputation, and lets later joins see real sizes."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the order of this context's paths, for ``discard``."""
    return len(_made())


def discard(spark: SparkSession, since: int) -> None:
    """Delete what this context made since ``since``, except the path made last: for when that was derived from the rest."""
    made = _made()
    for path in made[since:-1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del made[since:-1]
