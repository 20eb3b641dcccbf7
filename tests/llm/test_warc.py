import gzip
import zlib

import pytest

from ratingscope.llm import warc

PAGE = "<html><body><p>Grüße, мир</p></body></html>"
SOURCES = "record_id string, type string, target_uri string, date string, refers_to string, fields map<string,string>, block binary"


def chunked(data, line=b"\r\n"):
    return b"".join(b"%x;ext=1%s%s%s" % (len(data[k : k + 7]), line, data[k : k + 7], line) for k in range(0, len(data), 7)) + b"0" + line * 2


def raw(data):
    c = zlib.compressobj(wbits=-15)
    return c.compress(data) + c.flush()


UTF = PAGE.encode()
BODIES = [
    ("", UTF), ("Content-Type: text/html; charset=koi8-r", PAGE.replace("Grüße", "Gruss").encode("koi8-r")),
    *((f"Content-Type: text/html; charset={c}", UTF) for c in ("idna", "undefined", "a\x00b", "unicode_escape", "base64", "rot13", "no-such", "\"utf-8\"", "")),
    ("Content-Encoding: gzip", gzip.compress(UTF)), ("Content-Encoding: deflate", zlib.compress(UTF)), ("Content-Encoding: deflate", raw(UTF)), ("Content-Encoding: identity", UTF),
    ("Transfer-Encoding: chunked", chunked(UTF)), ("Transfer-Encoding: chunked", chunked(UTF, b"\n")), ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked(gzip.compress(UTF))),
    ("Transfer-Encoding: chunked", UTF), ("Content-Encoding: gzip", UTF),  # said, but not so
]


def text_of(header, body, line="\r\n"):
    block = f"HTTP/1.1 200 OK{line}{header}{line if header else ''}{line}".replace("\r\n", line).encode() + body
    _, headers, payload = warc._http(block)
    return warc._text(headers, payload)


@pytest.mark.parametrize("line", ["\r\n", "\n"])
def test_bodies_are_decoded(line):
    for header, body in BODIES:
        want = "Gruss, мир" if "koi8" in header else "Grüße, мир"
        assert text_of(header, body, line).strip() == want, header
    assert text_of("Content-Encoding: br", UTF, line) is None and text_of("Content-Type: image/png", UTF, line) is None
    assert text_of("Content-Encoding: gzip", gzip.compress(UTF * 3000)[:-300], line).count("Grüße") > 10  # cut


def test_derivatives_of_odd_responses(spark):
    rows = [(None, "response", None, None, None, None, b"HTTP/1.1 200 OK\n\n<p>a</p>"), (None, "response", None, None, None, {}, b"HTTP/1.1 200 OK\n\n<p>b</p>"), ("<urn:x>", "response", "u", "d", None, {}, None), ("<urn:y>", "response", "u", "d", None, {}, b"HTTP/1.1"), ("<urn:z>", "request", None, None, None, {}, b"")]
    rows += [("<urn:long>", "response", "u", "d", None, {}, b"HTTP/1.1 200 OK\r\n\r\n<p>" + b"word " * 400_000 + b"</p>")] * 2
    got = warc.derivatives(spark.createDataFrame(rows, SOURCES)).collect()
    assert sorted(r.type for r in got) == ["conversion"] * 6 + ["metadata"] * 6
    assert len({r.record_id for r in got}) == 10  # the repeated response has the same derivatives twice
    texts = sorted(bytes(r.block).decode().strip()[:9] for r in got if r.type == "conversion")
    assert texts == ["", "", "a", "b", "word word", "word word"]


def test_malformed_records_are_rows(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bad = b"WARC/1.1\r\nWARC-Record-ID: <urn:2>\r\nContent-Length: abc\r\n\r\nxyz\r\n\r\n"
    files = {"a.warc": good + bad + good, "b.warc.gz": gzip.compress(good * 2000)[:-20], "c.warc": good[:-6], "d.warc": b"", "e.warc.gz": b"\x1f\x8bnothing"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    kinds = {name: [r[1] for r in warc.parse_records(data)] for name, data in files.items()}
    assert kinds["a.warc"] == ["response", "malformed", "response"] and kinds["c.warc"] == ["malformed"] and kinds["d.warc"] == []
    assert kinds["b.warc.gz"][-1] == "malformed" and kinds["e.warc.gz"] == ["malformed"]
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(rows) == sum(map(len, kinds.values())) and all(r.fields["error"] for r in rows if r.type == "malformed")


def test_query_by_brute_force(spark):
    """Every page has its two records, and their blocks are what the page's text and digests are."""
    from ratingscope.llm import html_extract, queries

    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = queries.op1_warc_derivatives(spark, "/root/testdata/sf0.001").collect()
    of = {(r.page_id, r.type): r for r in rows}
    assert len(rows) == 2 * len(pages) == len(of)
    for k, page in pages.items():
        meta, text = of[k, "metadata"], of[k, "conversion"]
        assert text.block == html_extract.all_text(page.html or "") and text.content_length == len(text.block.encode()) and text.target_uri == page.url
        assert text.concurrent_to == meta.record_id and text.refers_to == meta.refers_to and f"conversion-record-id: {text.record_id}" in meta.block
        assert text.block_digest == warc.sha1_digest(text.block.encode()) and meta.block.startswith("source-status: HTTP/1.1 200 OK\r\n")
