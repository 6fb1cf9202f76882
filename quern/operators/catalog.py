"""Catalogs of several tables whose versions change together, and the load that makes the next one.

A catalog is a folder: ``data`` holds table versions, each in a path of its own that is written once, and
``commits`` numbered manifests, JSON files that name the version of every table. A reader takes the newest whole
manifest; so it sees all tables of one commit or all of the one before. A commit writes its manifest under another name
and renames it to the next number, which fails if that number is there: of two writers one wins, the other gets a
``Conflict``. What a crash leaves behind is data that no manifest names.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..storage import staged


class Conflict(Exception):
    """Another writer committed since the base version was read."""


class Rejected(ValueError):
    """What was written doesn't hold, so it was not committed."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._commits = self._path(f"{self.root}/commits")
        self._fs = self._commits.getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        """The numbers of all manifests, newest first."""
        if not self._fs.exists(self._commits):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._commits)]
        return sorted((int(m[1]) for n in names if (m := re.fullmatch(r"(\d{12})\.json", n))), reverse=True)

    def _tables(self, number: int) -> dict[str, str] | None:
        """The paths that a manifest names; None if it isn't whole."""
        rows = self.spark.read.text(f"{self.root}/commits/{number:012d}.json", wholetext=True).take(1)
        try:
            told = json.loads(rows[0].value)
            return told["tables"] if told["whole"] else None
        except (ValueError, KeyError, TypeError, IndexError):
            return None

    def version(self) -> int:
        """The newest whole commit; 0 before the first."""
        return next((n for n in self._numbers() if self._tables(n) is not None), 0)

    def tables(self, version: int | None = None) -> dict[str, str]:
        """table -> path of a version (the newest by default)."""
        version = self.version() if version is None else version
        return (self._tables(version) or {}) if version else {}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.tables(version)[table])

    def commit(
        self, tables: dict[str, DataFrame], checks: dict[str, dict[str, Column]] | None = None,
        references: list[tuple[str, str, str, str]] = (), base: int | None = None, may_be_empty: set[str] = frozenset(),
    ) -> int:
        """Write new versions of ``tables`` and commit them together; the other tables stay as they are.

        What was written is read back and judged before the commit: a table without rows (unless in ``may_be_empty``), a row
        that fails one of its ``checks``, or a non-null ``references`` (table, column, parent table, parent's column) that
        is not there is a ``Rejected``. ``base`` is the version that the rows were made from (by default the newest one now).
        """
        base = self.version() if base is None else base
        now = self.tables(base)
        run = uuid.uuid4().hex
        for name, df in tables.items():
            path = f"{self.root}/data/{name}/{run}"
            df.write.parquet(path)
            now = now | {name: path}
        read = {name: self.spark.read.parquet(path) for name, path in now.items()}
        bad = {}
        for name in tables:
            own = (checks or {}).get(name, {})
            failed = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(own.values())]
            counts = read[name].agg(F.count(F.lit(1)).alias("n"), *failed).first()
            if not counts["n"] and name not in may_be_empty:
                bad[name] = "no rows"
            bad |= {f"{name}: {c}": counts[f"c{i}"] for i, c in enumerate(own) if counts[f"c{i}"]}
        for name, column, parent, key in references:
            wanted = read[name].where(F.col(column).isNotNull()).select(F.col(column).alias("k"))
            lost = wanted.join(read[parent].select(F.col(key).alias("k")), "k", "left_anti").limit(1).count()
            if lost:
                bad[f"{name}.{column}"] = f"not in {parent}"
        if bad:
            raise Rejected(f"not committed: {bad}")
        if self.version() != base:
            raise Conflict(f"version {base} is no longer the newest")
        number = max(self._numbers(), default=0) + 1  # a broken manifest keeps its number
        self._publish(number, now)
        return number

    def _publish(self, number: int, tables: dict[str, str]) -> None:
        fs, path = self._fs, self._path
        fs.mkdirs(self._commits)
        new = path(f"{self.root}/commits/.{number:012d}-{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps({"tables": tables, "whole": True}).encode()))
        out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._commits.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            files.rename(new, path(f"{self.root}/commits/{number:012d}.json"), options)
        except Exception as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {number} was committed by another writer") from e
            raise


@dataclass
class Table:
    """How a table is loaded. ``key`` is its natural key; ``id`` its surrogate id.

    ``parents``: id column -> (the source's column with the parent's natural key, the parent table). ``needs``: those of
    ``parents`` without which a source row is dropped; other unknown parents give NULL. ``group``: the column by which a
    scoped load is limited. ``required``: an empty source is refused.
    """

    name: str
    key: str
    id: str
    parents: dict[str, tuple[str, str]] = field(default_factory=dict)
    needs: set[str] = field(default_factory=set)
    group: str | None = None
    required: bool = False


def load(
    catalog: Catalog, specs: list[Table], sources: dict[str, DataFrame], protected: dict[str, DataFrame] | None = None,
    scopes: dict[str, list] | None = None, checks: dict[str, dict[str, Column]] | None = None,
) -> int:
    """Load whole sources into the catalog as one commit, parents before children (the order of ``specs``).

    Rows are upserted by natural key and keep their id; new ones get fresh ids. Rows gone from a source are deleted, or kept
    with active = false if ``protected`` (table -> ids) or a row of another loaded table still refers to them. With ``scopes``
    (table -> groups) only rows of these groups can go. Foreign keys are resolved to ids after their parents are known. An
    empty required source, a failed check and a lost reference leave the catalog as it is.
    """
    base, protected, scopes = catalog.version(), protected or {}, scopes or {}
    known = catalog.tables(base)
    written: dict[str, DataFrame] = {}
    current_keys: dict[str, DataFrame] = {}
    for spec in specs:
        source = sources[spec.name]
        for column in spec.needs:
            natural, parent = spec.parents[column]
            source = source.join(current_keys[parent].withColumnRenamed("__key", natural), natural, "left_semi")
        source = staged(source, f"source-{spec.name}")
        if spec.required and source.isEmpty():
            raise Rejected(f"the source of {spec.name} is empty")
        current_keys[spec.name] = source.select(F.col(spec.key).alias("__key"))
        by_name = {t.name: t for t in specs}
        for column, (natural, parent) in spec.parents.items():
            up = by_name[parent]
            ids = written[parent].select(F.col(up.key).alias(natural), F.col(up.id).alias(column))
            source = source.join(ids, natural, "left").drop(natural)
        columns = [c for c in source.columns if c != spec.id]
        if spec.name not in known:
            made = source.withColumn("active", F.lit(True)).withColumn(spec.id, F.monotonically_increasing_id() + 1)
            written[spec.name] = staged(made, spec.name)
            continue
        old = catalog.read(spec.name, base)
        top = old.agg(F.max(spec.id)).first()[0] or 0
        fresh = source.join(old.select(spec.key, F.col(spec.id).alias("__id")), spec.key, "left").select(*columns, "__id").withColumn("active", F.lit(True))
        made = fresh.withColumn(spec.id, F.coalesce("__id", F.monotonically_increasing_id() + top + 1)).drop("__id")
        gone = old.join(source.select(spec.key), spec.key, "left_anti")
        written[spec.name] = staged(made.unionByName(gone.withColumn("__gone", F.lit(True)), allowMissingColumns=True), spec.name)
    # children first: a parent stays, inactive, while a row that is left refers to it
    for spec in reversed(specs):
        rows = written[spec.name]
        if "__gone" not in rows.columns:
            continue
        refs = [protected[spec.name].select(F.col(protected[spec.name].columns[0]).alias(spec.id))] if spec.name in protected else []
        for child in specs:
            refs += [written[child.name].select(F.col(c).alias(spec.id)) for c, (_, parent) in child.parents.items() if parent == spec.name]
        gone = F.coalesce("__gone", F.lit(False))
        if spec.group and spec.name in scopes:
            gone = gone & F.coalesce(F.col(spec.group).isin(scopes[spec.name]), F.lit(False))
        marked = rows.withColumn("__gone", gone)
        if refs:
            used = refs[0]
            for r in refs[1:]:
                used = used.unionByName(r)
            marked = marked.join(used.where(F.col(spec.id).isNotNull()).distinct().withColumn("__used", F.lit(True)), spec.id, "left")
        else:
            marked = marked.withColumn("__used", F.lit(None).cast("boolean"))
        left = marked.where(~F.col("__gone") | F.col("__used")).withColumn("active", F.col("active") & ~F.col("__gone"))
        written[spec.name] = staged(left.drop("__gone", "__used"), f"left-{spec.name}")
    references = [(t.name, c, parent, next(p.id for p in specs if p.name == parent)) for t in specs for c, (_, parent) in t.parents.items()]
    return catalog.commit(written, checks, references, base, may_be_empty={t.name for t in specs if not t.required})
