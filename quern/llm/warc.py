"""Legacy ARC archives to WARC.

``write_arc`` makes ARC files (either version's header lines) of a page table, ``read_arc`` parses them
by version and declared lengths, ``to_warc`` makes the equivalent WARC records (identifiers, timestamps,
types, digests, revisits), ``write_warc`` and ``read_warc`` store and parse those.

Archives are written by Spark's text writer with the format's own record separator, through its commit
protocol: a task that is run again leaves no second copy. They are read as binary files, a file a
row; a task holds one file as it is stored (under 2 GB, Spark's bound of a binary cell) and unzips it record
by record. ``write_*`` make one file, of one gzip member, a partition.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import staged

#: Payloads shorter than this are always stored whole.
REVISIT_BYTES = 100
#: The header lines of both ARC versions (fixed by the format).
ARC_FIELDS = {
    "1": ["url", "ip", "date", "mime", "length"],
    "2": ["url", "ip", "date", "mime", "code", "checksum", "location", "offset", "filename", "length"],
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's for URLs

ARC_SCHEMA = (
    "arc_version string, url string, ip string, arc_date string, mime string, http_header binary, payload binary"
)
WARC_SCHEMA = (
    "record_id string, record_type string, target_uri string, warc_date string, page_id long,"
    " payload_digest string, payload_bytes long, refers_to_id string, refers_to long, payload binary"
)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` bytes of binary cells."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema.names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema.names)


def _arc_url(url: str | None, page_id: int | None) -> str:
    """A header line is split at blanks: what a URL may not hold is percent-encoded."""
    text = url or f"urn:page:{page_id if page_id is not None else 'none'}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def write_arc(pages: DataFrame, path: str, version: str = "1") -> None:
    """Write ``pages`` (page_id, url, html) as gzip ARC files of ``version`` "1" or "2".

    A NULL html is an empty page; a NULL url or page_id is spelled as such. The page's id travels in an
    HTTP header field.
    """
    names = pa.schema([("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            lines = f"{version} 0 quern\n" + {
                "1": "URL IP-address Archive-date Content-type Archive-length",
                "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
            }[version] + "\n"
            first = "text/plain" if version == "1" else "text/plain 200 - - 0 pages.arc.gz"
            yield (f"filedesc://pages.arc 0.0.0.0 20240101000000 {first} {len(lines)}\n{lines}".encode(),)
            for batch in batches:
                for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    body = (html or "").encode("utf-8", "surrogatepass")
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
                    head += "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                    block = head.encode() + b"\r\n" + body
                    middle = "" if version == "1" else "200 - - 0 pages.arc.gz "
                    line = f"{_arc_url(url, page_id)} 192.0.2.1 20240101000000 text/html {middle}{len(block)}\n"
                    yield (line.encode() + block,)

        return _batches(rows(), names)

    records = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write(records.mapInArrow(run, "record binary"), path, "\n")


def _write(records: DataFrame, path: str, separator: str) -> None:
    # a cast from binary keeps the bytes as they are, and the text writer writes them so
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", separator).option("compression", "gzip").text(path)


def arc_header(line: bytes, names: list[str]) -> tuple[dict[str, str], int] | None:
    """The fields of a header line and the length it declares; None if it is no header line.

    Fields are counted from the right, so blanks in a URL do no harm.
    """
    words = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    if len(words) < len(names) or not re.fullmatch(r"[0-9]+", words[-1]):
        return None
    rest = len(words) - len(names) + 1
    return dict(zip(names, [" ".join(words[:rest]), *words[rest:]], strict=True)), int(words[-1])


def parse_arc(stream: BinaryIO, on_bad: str = "raise") -> Iterator[tuple[str, dict[str, str] | None, bytes]]:
    """(version, header fields, block) of each record of an ARC file but its first, the description.

    The description's first line tells the version, and so what a header line's fields are. Blocks
    are taken by their declared length, whatever they contain; a file cut short ends with its last
    whole record. Where a header line should be and is not, ``on_bad="raise"`` stops with an error, and "keep" gives
    the line with None for its fields and goes on with the next line that is a header with a date.
    """
    version, lost = "1", False
    while line := stream.readline():
        if not line.strip(b"\r\n"):
            continue
        described = line.startswith(b"filedesc:")
        # a description's header has its own version's fields, which only its block tells
        read = (arc_header(line, ARC_FIELDS["2"]) or arc_header(line, ARC_FIELDS["1"])) if described else arc_header(line, ARC_FIELDS[version])
        if read is not None and lost and not re.fullmatch(r"[0-9]{12,14}", read[0]["date"]):
            read = None
        if read is None:
            if not line.endswith(b"\n"):
                return  # the file ends inside a header line
            if on_bad == "raise":
                raise ValueError(f"not an ARC header line: {line[:80]!r}")
            lost = True
            yield version, None, line
            continue
        lost = False
        head, length = read
        block = stream.read(length)
        if len(block) < length:
            return
        if described:
            version = block[:1].decode("ascii", "replace")
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version!r}")
            continue
        yield version, head, block


def read_arc(spark: SparkSession, path: str, on_bad: str = "raise") -> DataFrame:
    """The records of ARC files, plain or gzip: version, header fields, HTTP header and payload.

    ``on_bad``: "raise" stops at a line that should be a header and is none; "keep" gives each such line
    as a row without fields (NULL url), the line as its payload.
    """
    schema = pa.schema([(n, pa.binary() if n in ("http_header", "payload") else pa.string()) for n in [x.split()[0] for x in ARC_SCHEMA.split(", ")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    for version, head, block in parse_arc(_plain(batch.column(0)[i].as_py()), on_bad):
                        if head is None:
                            yield version, None, None, None, None, b"", block
                            continue
                        header, payload = _http(block)
                        yield version, head["url"], head["ip"], head["date"], head["mime"], header, payload

        return _batches(rows(), schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ARC_SCHEMA)


def _plain(content: bytes) -> BinaryIO:
    """A stream of a file's bytes, unzipped member by member as they are read."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw


def _http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header and payload of a block; a block without one is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, sep, payload = block.partition(b"\r\n\r\n")
    return (head + sep, payload) if sep else (b"", block)


def to_warc(records: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """The WARC records equivalent to parsed ARC ``records``; lines that are no record (NULL url) are left out.

    Identifiers are name-based UUIDs of URL, date, page id and digest (so records alike in all of these
    share one), dates are ISO 8601, digests are SHA-256 of the payload. A record with an HTTP header is a response,
    one without (a DNS answer, a plain file) a resource. Of records with equal payloads of at least
    ``revisit_bytes`` bytes, the one with the smallest page id stays so and the rest are revisits of it. Rows
    that share that smallest id, and rows of a group in which no page has an id, all stay; a row
    without an id in a group with one is a revisit.
    """
    page_id = F.regexp_extract(F.col("http_header").cast("string"), r"(?im)^X-Page-Id: *(-?[0-9]+)", 1)
    named = (
        records.where("url IS NOT NULL")
        .withColumn("page_id", F.nullif(page_id, F.lit("")).cast("long"))
        .withColumn("digest", F.sha2("payload", 256))
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .withColumn("warc_date", F.regexp_replace("arc_date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z"))
    )
    # only payloads that occur more than once: the rest has no row here
    first = staged(
        named.where(F.col("payload_bytes") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "warc_date", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", F.col("first.page_id").alias("first_id"), F.col("first.warc_date").alias("first_date"), F.col("first.url").alias("first_url")),
        "first",
    )
    name = lambda url, date, page: F.concat_ws(" ", url, date, F.coalesce(page.cast("string"), F.lit("-")), "digest")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")) & (F.col("payload_bytes") >= revisit_bytes)
    whole = F.when(F.octet_length("http_header") > 0, "response").otherwise("resource")
    return (
        named.join(first, "digest", "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise(whole))
        .select(
            "record_type", "url", "warc_date", "mime", "http_header", "digest", "payload_bytes",
            name("url", "warc_date", F.col("page_id")).alias("name"),
            F.when(revisit, name("first_url", "first_date", F.col("first_id"))).alias("refers_name"),
            F.when(revisit, F.col("first_url")).alias("refers_url"),
            F.when(revisit, F.col("first_date")).alias("refers_date"),
            F.when(revisit, F.col("first_id")).alias("refers_page"),
            F.when(~revisit, F.col("payload")).alias("payload"),
        )
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write ``to_warc``'s records as gzip WARC 1.0 files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            info = b"software: quern\r\nformat: WARC File Format 1.0\r\n"
            part = TaskContext.get().partitionId()
            head = [
                "WARC/1.0",
                "WARC-Type: warcinfo",
                f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, f'warcinfo {path} {part}')}>",
                f"WARC-Date: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}",
                "Content-Type: application/warc-fields",
                f"Content-Length: {len(info)}",
            ]
            yield ("\r\n".join(head).encode() + b"\r\n\r\n" + info,)
            for batch in batches:
                for r in batch.to_pylist():
                    block = r["http_header"] + (r["payload"] or b"")
                    head = [
                        "WARC/1.0",
                        f"WARC-Type: {r['record_type']}",
                        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, r['name'])}>",
                        f"WARC-Date: {r['warc_date']}",
                        f"WARC-Target-URI: {r['url']}",
                        f"WARC-Payload-Digest: sha256:{r['digest']}",
                        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
                        f"X-Payload-Length: {r['payload_bytes']}",
                        "Content-Type: application/http; msgtype=response" if r["http_header"] else f"Content-Type: {r['mime']}",
                    ]
                    if r["record_type"] == "revisit":
                        head += [
                            f"WARC-Profile: {PROFILE}",
                            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(NAMESPACE, r['refers_name'])}>",
                            f"WARC-Refers-To-Target-URI: {r['refers_url']}",
                            f"WARC-Refers-To-Date: {r['refers_date']}",
                            f"X-Refers-To-Page-Id: {r['refers_page']}",
                        ]
                    head += [f"Content-Length: {len(block)}"]
                    yield ("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block,)

        return _batches(rows(), pa.schema([("record", pa.binary())]))

    _write(records.mapInArrow(run, "record binary"), path, "\r\n\r\n")


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a WARC file, by its declared lengths."""
    while line := stream.readline():
        if not line.strip(b"\r\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while text := stream.readline().decode("utf-8", "replace").rstrip("\r\n"):
            name, _, value = text.partition(": ")
            head[name] = value
        yield head, stream.read(int(head["Content-Length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files but their warcinfo. Digests of blocks and stored payloads are verified."""
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in [x.split()[0] for x in WARC_SCHEMA.split(", ")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    for head, block in parse_warc(_plain(batch.column(0)[i].as_py())):
                        kind = head["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"][7:]:
                            raise ValueError(f"block digest of {head['WARC-Record-ID']}")
                        header, payload = _http(block)
                        digest, size = head["WARC-Payload-Digest"][7:], int(head["X-Payload-Length"])
                        if kind != "revisit":
                            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                            if digest != head["WARC-Payload-Digest"][7:]:
                                raise ValueError(f"payload digest of {head['WARC-Record-ID']}")
                        page = re.search(rb"(?im)^X-Page-Id: *(-?[0-9]+)", header)
                        refers = head.get("X-Refers-To-Page-Id")
                        yield (
                            head["WARC-Record-ID"], kind, head["WARC-Target-URI"], head["WARC-Date"],
                            int(page[1]) if page else None, digest, size, head.get("WARC-Refers-To"),
                            int(refers) if refers else None, payload if kind != "revisit" else None,
                        )

        return _batches(rows(), schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, WARC_SCHEMA)
