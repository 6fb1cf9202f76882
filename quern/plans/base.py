"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """queries: name -> function; sql: name -> DuckDB SQL of the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Callable], Callable]:
        """Register ``f(t)``, where t(name) reads a table of the given folder."""

        def register(f: Callable) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = sql
            return f

        return register


def quoted(options: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in options)


def planted(t: Callable[[str], DataFrame], options: list[str]) -> DataFrame:
    """(doc_id, t): whole documents with one of the statements before or after the text."""
    said = F.element_at(F.array(*[F.lit(x) for x in options]), (1 + F.col("doc_id") % len(options)).cast("int"))
    text, after = F.coalesce("text", F.lit("")), F.col("doc_id") % 2 == 0
    return t("documents").select("doc_id", F.when(after, F.concat(text, F.lit("\n"), said)).otherwise(F.concat(said, F.lit("\n"), text)).alias("t"))


def planted_sql(options: list[str]) -> str:
    """The same as a table x (doc_id, t)."""
    said, text = f"[{quoted(options)}][1 + doc_id % {len(options)}]", "coalesce(text, '')"
    return f"x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {text} || chr(10) || {said} ELSE {said} || chr(10) || {text} END AS t FROM documents)"
