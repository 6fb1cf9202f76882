"""Sources and sinks: fixed-schema JSON lines, tolerant logs, typed CSV, product feeds, pages."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a fixed schema; a line that doesn't fit is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, torn lines): lines that are no JSON of the schema are set aside, not dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema).alias("x"), F.try_parse_json("value").isNotNull().alias("ok"))
    return parsed.where("ok").select("x.*"), parsed.where("NOT ok").select("value")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text: nothing is inferred."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_csv_typed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed columns; an empty cell is NULL."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays joined by semicolons, booleans in lower case (as Spark writes them)."""
    kinds = dict(df.dtypes)
    cells = [F.array_join(c, ";").alias(c) if kinds[c].startswith("array") else F.col(c) for c in df.columns]
    df.select(*cells).write.option("header", True).option("escape", '"').csv(path)


def find_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Paths below a snapshot with a file name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    return files.select("path", "length")


def read_products(spark: SparkSession, path: str, product: str) -> DataFrame:
    """Products of feeds {"products": [...]}, with their file; the first of equal handles in a file stays."""
    schema = f"products array<struct<{product}>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("file"), F.posexplode("products").alias("pos", "p"))
    rest = rows.groupBy("file", F.col("p.handle").alias("handle")).agg(F.min_by("p", "pos").alias("p"))
    return rest.select("file", "p.*")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(key, parent, level, name) of a three-level tree of JSON objects."""
    raw = spark.read.text(path, wholetext=True)
    tree = raw.select(F.from_json("value", "map<string,map<string,array<string>>>").alias("t"))
    one = tree.select(F.explode("t").alias("a", "t2"))
    two = one.select("a", F.explode("t2").alias("b", "leaves"))
    three = two.select("a", "b", F.explode("leaves").alias("c"))
    path2, path3 = F.concat_ws(">", "a", "b"), F.concat_ws(">", "a", "b", "c")
    return (
        one.select(F.col("a").alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("level"), F.col("a").alias("name"))
        .unionByName(two.select(path2.alias("key"), F.col("a").alias("parent"), F.lit(2).alias("level"), F.col("b").alias("name")))
        .unionByName(three.select(path3.alias("key"), path2.alias("parent"), F.lit(3).alias("level"), F.col("c").alias("name")))
        .distinct()
    )


def data_dictionary(df: DataFrame) -> DataFrame:
    """Numbered definitions of a table's columns."""
    spec = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(spec, "position int, column string, type string, nullable boolean")


def log_objects(line: Column) -> Column:
    """The text from a line's first { to its last }, NULL without one."""
    return F.nullif(F.regexp_extract(line, r"(?s)(\{.*\})", 1), F.lit(""))


class _Facts(HTMLParser):
    """What a page states: products in JSON-LD blocks, title and headings, label-value pairs of th/td and dt/dd, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.products, self.label, self.tag, self.text = [], [], None, None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("th", "td", "dt", "dd", "title", "h1"):
            self._close()
            self.tag, self.text = tag, []
        elif tag == "script" and ("type", "application/ld+json") in attrs:
            self._close()
            self.tag, self.text = "ld", []

    def handle_endtag(self, tag):
        if tag in (self.tag, "tr", "dl", "table") or tag == "script" and self.tag == "ld":
            self._close()

    def handle_data(self, data):
        if self.tag:
            self.text.append(data)

    def _close(self):
        text = "".join(self.text)
        value = " ".join(text.split())
        if self.tag == "ld":
            self._product(text)
        elif self.tag in ("title", "h1") and value:
            self.found.append((self.tag, value))
        elif self.tag in ("th", "dt"):
            self.label = "".join(value.split())  # a label's blanks don't count
        elif self.tag in ("td", "dd"):
            if self.label and value:
                self.found.append((self.label, value))
            self.label = None
        self.tag, self.text = None, []

    def _product(self, text: str) -> None:
        """The facts of the first product node, if no block before had one."""
        if not self.products:
            try:
                self.products = product_facts(json.loads(text))
            except ValueError:
                return


def _nodes(block) -> Iterator[dict]:
    """The nodes of a linked-data document: an object, the items of a list or of a graph."""
    for node in block if isinstance(block, list) else [block]:
        if isinstance(node, dict):
            yield node
            yield from _nodes(node.get("@graph") or [])


def _objects(value) -> list[dict]:
    """A property's objects: it may hold one, several or plain text."""
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]


def product_facts(block) -> list[tuple[str, str]]:
    """(fact, value) of a linked-data document's first product: name, description, price.

    A group of variants is named by itself; description and price are those of its first variant. A price is that of the
    first offer that has one, or the lowest of an aggregate.
    """
    for node in _nodes(block):
        kinds = node.get("@type")
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if "Product" not in kinds and "ProductGroup" not in kinds:
            continue
        item = (_objects(node.get("hasVariant")) or [{}])[0] if "ProductGroup" in kinds else node
        prices = [o.get(p) for o in _objects(item.get("offers")) for p in ("price", "lowPrice")]
        told = {
            "product.name": re.sub(r"<[^<>]*>", " ", str(node.get("name") or "")), "product.description": item.get("description"),
            "product.price": next((p for p in prices if p not in (None, "")), None),
        }
        return [(k, " ".join(html.unescape(str(v)).split())) for k, v in told.items() if v not in (None, "")]
    return []


def labelled_runs(text: Column, labels: dict[str, str], ends: tuple[str, ...] = ()) -> Column:
    """A map of field to value from runs "label value" or "label more words: value" in flowing text; a run ends before the
    next label or one of ``ends``. The first run of a field that has a value counts."""
    spelled = lambda words: "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    no_mark = f"(?!{spelled({*labels, *ends})})"
    run = rf"(?s)({spelled(labels)})(?:\s*(?:{no_mark}[A-Za-z\s])*:)?((?:{no_mark}.)*)"
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    found = F.zip_with(
        F.regexp_extract_all(text, F.lit(run), F.lit(1)), F.regexp_extract_all(text, F.lit(run), F.lit(2)),
        lambda k, v: F.struct(names[k].alias("k"), F.btrim(v, F.lit(" :\u00a0\n\t\r")).alias("v")),
    )
    told = F.filter(found, lambda x: x["v"] != "")
    fields = F.array_distinct(F.transform(told, lambda x: x["k"]))
    return F.map_from_entries(F.transform(fields, lambda f: F.filter(told, lambda x: x["k"] == f)[0]))


def page_facts(pages: DataFrame, key: str, html_column: str) -> DataFrame:
    """(key, field, value): each page's facts, the first value of a field wins; a product's come first. A NULL page has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["k"], batch["h"], strict=True):
                parser = _Facts()
                parser.feed(text or "")
                parser.close()
                parser._close()
                first = {}
                for name, value in [*parser.products, *parser.found]:
                    first.setdefault(name.lower(), value)
                rows += [(k, f, v) for f, v in first.items()]
            yield pd.DataFrame(rows, columns=["k", "field", "value"])

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("k"), F.col(html_column).alias("h")).mapInPandas(run, f"k {kind}, field string, value string")
    return out.withColumnRenamed("k", key)


def text_runs(df: DataFrame, key: str, text: str, labels: dict[str, str], ends: tuple[str, ...] = ()) -> DataFrame:
    """(key, field, value): ``labelled_runs`` of a text column."""
    return df.select(key, F.explode(labelled_runs(F.col(text), labels, ends)).alias("field", "value"))


def wide_rows(df: DataFrame, positions: dict[str, tuple[int, str]]) -> DataFrame:
    """Columns of a wide table by position, under a name and as a type: what is no number of the type is NULL. The rest is not read."""
    pick = lambda at, kind: F.nullif(F.trim(F.col(f"`{df.columns[at]}`").cast("string")), F.lit("")).try_cast(kind)
    return df.select(*[pick(at, kind).alias(name) for name, (at, kind) in positions.items()])
