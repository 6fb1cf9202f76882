import gzip
import hashlib
import io

import pytest

from quern.llm import warc
from quern.llm.common import scratch


def convert(spark, pages, version):
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(pages, arc, version)
    warc.write_warc(warc.to_warc(warc.read_arc(spark, arc)), out)
    return warc.read_warc(spark, out).collect(), out


def odd_pages(spark):
    big = "<p>" + "é" * 200_000
    rows = [
        (5, "http://a b/x", "same " * 40), (2, "http://c", "same " * 40), (None, "http://d", "same " * 40),
        (2, "http://e", "same " * 40), (7, None, "short"), (8, "http://f", "short"), (9, "http://g", None),
        (10, "", ""), (None, None, None), (11, "http://h", "HTTP/1.1 404 no\r\n\r\nWARC/1.0\r\n\r\n" * 9), (12, "http://i", big),
        (None, "http://j", "both without id " * 20), (None, "http://k", "both without id " * 20),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS n")


@pytest.mark.parametrize("version", ["1", "2"])
def test_round_trip(spark, version):
    pages = odd_pages(spark)
    got, out = convert(spark, pages, version)
    html = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    want = []
    for page, body in html:
        ids = [p for p, b in html if b == body and p is not None]
        revisit = len(body) >= 100 and ids and page != min(ids)
        want.append((str(page), len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", min(ids) if revisit else None))
    rows = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(rows, key=str) == sorted(want, key=str)
    responses = {r.record_id: r for r in got if r.record_type == "response"}
    for r in got:
        if r.record_type == "revisit":
            assert responses[r.refers_to_id].payload_digest == r.payload_digest and r.payload is None
        else:
            assert len(r.payload) == r.payload_bytes


def test_files_are_archives(spark, tmp_path):
    import glob

    _, out = convert(spark, odd_pages(spark), "1")
    for path in glob.glob(out.removeprefix("file:") + "/part-*"):
        content = gzip.open(path).read()
        heads = [h for h, _ in warc.parse_warc(io.BytesIO(content))]
        assert heads[0]["WARC-Type"] == "warcinfo"
        assert content.startswith(b"WARC/1.0\r\n") and content.endswith(b"\r\n\r\n")
        assert len({h["WARC-Record-ID"] for h in heads}) >= len(heads) - 1


def test_parse_declared_lengths_and_versions():
    one = b"filedesc://x 0.0.0.0 20200101000000 text/plain 21\n1 0 org\nURL IP A C L\n\n"
    body = b"HTTP/1.0 200 OK\r\n\r\nline\nhttp://y 1.1.1.1 20200101000000 text/html 3\nabc"
    one += b"http://x y/ 1.2.3.4 20200101000000 text/html %d\n" % len(body) + body + b"\n"
    one += b"http://z 1.2.3.4 20200101000000 text/html 100\ncut"
    got = list(warc.parse_arc(io.BytesIO(one)))
    assert [(v, h["url"], b) for v, h, b in got] == [("1", "http://x y/", body)]
    torn = one[: one.index(b"http://z") + 12]
    assert len(list(warc.parse_arc(io.BytesIO(torn)))) == 1
    two = b"filedesc://x 0.0.0.0 20200101000000 text/plain 200 - - 0 f 8\n2 0 org\n\n"
    two += b"http://x 1.2.3.4 20200101000000 text/html 404 sum loc 77 f.arc 5\nHello\n"
    ((version, head, block),) = warc.parse_arc(io.BytesIO(two))
    assert (version, head["code"], head["offset"], block) == ("2", "404", "77", b"Hello")
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(b"filedesc://x 0.0.0.0 1 t 2\n9 \nhttp://x 1 2 t 1\na")))


def test_empty_table(spark):
    assert convert(spark, odd_pages(spark).limit(0), "1")[0] == []


def arc_of(*records):
    out = b"filedesc://x 0.0.0.0 20200101000000 text/plain 8\n1 0 org\n\n"
    for head, block in records:
        out += head + (b" %d\n" % len(block) if block is not None else b"\n") + (block or b"") + b"\n"
    return out


def test_bad_header_lines_are_told(spark, tmp_path):
    good = [(b"http://%d 1.2.3.4 20200101000000 text/html" % i, b"HTTP/1.0 200 OK\r\n\r\nbody %d" % i) for i in range(5)]
    data = arc_of(good[0], (b"http://bad 1.2.3.4 20200101000000 text/html many", None), *good[1:])
    with pytest.raises(ValueError, match="not an ARC header"):
        list(warc.parse_arc(io.BytesIO(data)))
    got = list(warc.parse_arc(io.BytesIO(data), "keep"))
    assert [h["url"] for _, h, _ in got if h] == [f"http://{i}" for i in range(5)]
    assert [b for _, h, b in got if h is None] == [b"http://bad 1.2.3.4 20200101000000 text/html many\n"]
    (tmp_path / "a.arc").write_bytes(data)
    rows = warc.read_arc(spark, str(tmp_path), "keep")
    assert rows.where("url IS NULL").count() == 1 and warc.to_warc(rows).count() == 5


def test_links_resolve_across_dates_and_types(spark, tmp_path):
    http = lambda page, body: b"HTTP/1.0 200 OK\r\nX-Page-Id: %d\r\n\r\n" % page + body
    body = b"the same page, met in two years " * 9
    data = arc_of(
        (b"http://b 1.2.3.4 20250203040506 text/html", http(2, body)),
        (b"http://a 1.2.3.4 20240102030405 text/html", http(1, body)),
        (b"dns:a.example 1.2.3.4 20240102030405 text/dns", b"20240102030405\na.example. 1 IN A 1.2.3.4"),
    )
    (tmp_path / "a.arc").write_bytes(data)
    out = scratch(spark, "warc")
    warc.write_warc(warc.to_warc(warc.read_arc(spark, str(tmp_path))), out)
    got = {r.target_uri: r for r in warc.read_warc(spark, out).collect()}
    assert {u: (r.record_type, r.warc_date) for u, r in got.items()} == {
        "http://b": ("revisit", "2025-02-03T04:05:06Z"), "http://a": ("response", "2024-01-02T03:04:05Z"),
        "dns:a.example": ("resource", "2024-01-02T03:04:05Z"),
    }
    assert got["http://b"].refers_to_id == got["http://a"].record_id and got["http://b"].refers_to == 1
    assert got["dns:a.example"].payload.endswith(b"1.2.3.4")


def test_each_file_has_its_own_description(spark):
    import glob

    _, out = convert(spark, odd_pages(spark).repartition(3), "1")
    ids = []
    for path in glob.glob(out.removeprefix("file:") + "/part-*"):
        head, _ = next(warc.parse_warc(io.BytesIO(gzip.open(path).read())))
        assert head["WARC-Date"].endswith("Z")
        ids.append(head["WARC-Record-ID"])
    assert len(set(ids)) == len(ids) > 1
