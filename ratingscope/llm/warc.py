"""WARC derivatives (operator 1): metadata and plain-text conversion records from response records.

Records are rows: record_id, type, target_uri, date, refers_to, fields map<string,string> (all named
fields of the record), block binary. A derivative names the response it comes from (WARC-Refers-To),
carries its address and date, and the metadata record holds the response's HTTP status line and headers, its digests and
the id of the conversion record, so each of the three leads to the others.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingscope.llm.common import map_slices
from ratingscope.llm.html_extract import all_text

RECORD = "record_id string, type string, target_uri string, date string, refers_to string, fields map<string,string>, block binary"
CRLF = "\r\n"
_GAP = re.compile(rb"\r?\n\r?\n")
_CHUNK = re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r?\n")
#: The charsets of web pages, as Python names them; pages that claim another are read as UTF-8.
CHARSETS = frozenset(
    "utf-8 ascii utf-16 utf-16-le utf-16-be iso8859-1 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6 iso8859-7 iso8859-8 iso8859-9 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 "
    "cp866 cp874 cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 koi8-r koi8-u mac-roman mac-cyrillic gb2312 gbk gb18030 big5 big5hkscs euc_jp shift_jis cp932 iso2022_jp euc_kr cp949 tis-620".split()
)
#: Content types that have a plain-text form.
HTML, TEXT = ("text/html", "application/xhtml+xml"), ("text/plain",)


def record_id(*parts: Column) -> Column:
    """A record id from a hash of what identifies the record."""
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def sha1_digest(data: bytes) -> str:
    """A labelled digest as archives have it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def responses(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages, one a row; a null page is an empty payload. Repeated rows have the same record id."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2))
    ident = record_id(F.col(id_col), F.col(url_col), F.col(html_col))
    digest = F.concat(F.lit("sha256:"), F.sha2(body, 256))
    fields = F.create_map(F.lit("Content-Type"), F.lit("application/http; msgtype=response"), F.lit("WARC-Payload-Digest"), digest)
    return pages.select(F.col(id_col).alias("source"), ident.alias("record_id"), F.lit("response").alias("type"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), F.lit(None).cast("string").alias("refers_to"), fields.alias("fields"), F.concat(head.cast("binary"), body.cast("binary")).alias("block"))


def _http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers (folded lines joined) and body of an HTTP response, whose lines may end in bare line feeds; a block
    without header is all body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    gap = _GAP.search(block)
    head, body = (block[: gap.start()], block[gap.end() :]) if gap else (block, b"")
    lines, headers = [x.rstrip("\r") for x in head.decode("utf-8", "replace").split("\n")], []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = headers[-1][0], f"{headers[-1][1]} {line.strip()}"
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return lines[0], headers, body


def _unchunked(body: bytes) -> bytes:
    """The data of chunks; what doesn't begin with the size of a chunk is left as it is, a cut chunk counts as far as it goes."""
    out, at = [], 0
    while size := _CHUNK.match(body, at):
        n = int(size[1], 16)
        if not n:
            break
        out.append(body[size.end() : size.end() + n])
        at = size.end() + n
        at += 2 if body[at : at + 2] == b"\r\n" else body[at : at + 1] == b"\n"
    return b"".join(out) if at or _CHUNK.match(body) else body


def _inflated(body: bytes) -> bytes:
    """gzip, zlib or raw deflate as far as it can be read; anything else as it is."""
    for bits in (47, -15):
        stream, out = zlib.decompressobj(bits), []
        try:
            for k in range(0, len(body), 1 << 16):
                out.append(stream.decompress(body[k : k + (1 << 16)]))
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return body


def _payload(headers: list[tuple[str, str]], body: bytes) -> bytes | None:
    """The body as the page's author sent it; None for an encoding that can't be undone."""
    values = lambda name: [x.strip().lower() for n, v in headers if n.lower() == name for x in v.split(",") if x.strip()]
    if "chunked" in values("transfer-encoding"):
        body = _unchunked(body)
    for coding in reversed(values("content-encoding")):
        if coding in ("gzip", "x-gzip", "deflate"):
            body = _inflated(body)
        elif coding != "identity":
            return None
    return body


def _text(headers: list[tuple[str, str]], body: bytes) -> str | None:
    kind = next((v for n, v in headers if n.lower() == "content-type"), "text/html")
    media, _, more = kind.partition(";")
    charset = next((p.partition("=")[2].strip(" \"'") for p in more.split(";") if p.strip().lower().startswith("charset=")), "utf-8")
    if media.strip().lower() not in HTML + TEXT or (body := _payload(headers, body)) is None:
        return None
    try:
        known = codecs.lookup(charset).name
    except (LookupError, ValueError):  # not a name at all
        known = "utf-8"
    page = body.decode(known if known in CHARSETS else "utf-8", "replace")
    return all_text(page) if media.strip().lower() in HTML else page


def _uuid(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}/{kind}')}>"


def derivatives(records: DataFrame, keep: str | None = None) -> DataFrame:
    """Metadata and conversion records of the response records (``records`` may hold others, they are skipped); ``keep``
    names a column to carry along, as ``source``.

    A response of other than HTML or plain text, or without a known type, has a metadata record only. A response without
    a block has an empty conversion. Digests that the response has are kept as they are; a missing block digest is computed.
    Chunks and gzip or deflate are undone for the text, digests stay those of the stored bytes; a body in another encoding has no
    conversion. A charset that no web page has counts as UTF-8. Ids follow from the response's id, so the same input gives the same
    records; a response with a null id is named by its block and address, and its derivatives refer to nothing. A map without shuffle."""
    cols = [F.col(keep).alias("source") if keep else F.lit(None).cast("string").alias("source"), "record_id", "target_uri", "date", "fields", "block"]
    rows = records.where("type = 'response'").select(cols)

    def run(cols: list[list]) -> list[list]:
        out = []
        for source, ident, uri, date, fields, block in zip(*cols):
            fields, block = dict(fields or []), block or b""
            status, headers, body = _http(block)
            text = _text(headers, body)
            name = ident if ident is not None else f"block {sha1_digest(block)} of {uri}"  # a response without an id is named by what it holds
            own = _uuid(name, "conversion") if text is not None else None
            lines = [("source-status", status), *((f"source-header-{n.lower()}", v) for n, v in headers)]
            lines += [("source-block-digest", fields.get("WARC-Block-Digest") or sha1_digest(block)), ("source-payload-digest", fields.get("WARC-Payload-Digest") or sha1_digest(body)), ("source-length", str(len(block)))]
            lines += [("conversion-record-id", own)] if own else []
            made = [("metadata", _uuid(name, "metadata"), "application/warc-fields", "".join(f"{n}: {v}{CRLF}" for n, v in lines).encode(), {"conversion": own} if own else {})]
            if own:
                made.append(("conversion", own, "text/plain; charset=utf-8", text.encode("utf-8", "replace"), {"metadata": made[0][1]}))
            for kind, mine, media, data, linked in made:
                named = {"WARC-Type": kind, "WARC-Record-ID": mine, "WARC-Refers-To": ident or "", "WARC-Target-URI": uri or "", "WARC-Date": date or "", "WARC-Block-Digest": sha1_digest(data), "Content-Type": media, "Content-Length": str(len(data))}
                if kind == "conversion":
                    named["WARC-Concurrent-To"] = linked["metadata"]
                out.append((source, mine, kind, uri, date, ident, list(named.items()), data))
        return [[x[k] for x in out] for k in range(8)]

    kind = rows.schema["source"].dataType.simpleString()
    return map_slices(rows, run, f"source {kind}, {RECORD}", rows=128)


def write_text_records(records: DataFrame, path: str) -> None:
    """Write records whose blocks are UTF-8 text (metadata, conversions) as WARC files: Spark's text writer ends each with
    the two line breaks that end a record."""
    order = ["WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Concurrent-To", "WARC-Target-URI", "WARC-Date", "WARC-Block-Digest", "Content-Type", "Content-Length"]
    lines = F.concat(*(F.when(F.col("fields")[n].isNotNull(), F.concat(F.lit(f"{n}: "), F.col("fields")[n], F.lit(CRLF))).otherwise(F.lit("")) for n in order))
    records.select(F.concat(F.lit(f"WARC/1.1{CRLF}"), lines, F.lit(CRLF), F.decode("block", "UTF-8")).alias("value")).write.option("lineSep", CRLF * 2).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip (one member a record or one for all). A task holds the bytes of one file (archives have a
    gigabyte at most) and reads its records from them one by one. What can't be read is a record of type ``malformed`` with the
    reason as its field ``error``; reading goes on at the next record, or the next file where the file is cut."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows, size = [], 0
                for row in parse_records(bytes(content)):
                    rows.append(row)
                    size += len(row[-1])
                    if size > 8_000_000:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    return files.mapInPandas(run, RECORD)


def _malformed(reason: object) -> tuple:
    return None, "malformed", None, None, None, {"error": str(reason)}, b""


def parse_records(data: bytes) -> Iterator[tuple]:
    stream = gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        yield from _records(stream)
    except (EOFError, OSError, zlib.error) as e:  # a gzip file that is cut or damaged
        yield _malformed(f"{type(e).__name__}: {e}")


def _records(stream: io.BufferedIOBase) -> Iterator[tuple]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        name = None
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and name:
                fields[name] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                fields[name] = value.strip()
        by = {k.lower(): v for k, v in fields.items()}
        size = by.get("content-length", "0")
        if not (size.isascii() and size.isdigit()):
            yield _malformed(f"Content-Length {size!r} of record {by.get('warc-record-id')}")
            continue
        block = stream.read(int(size))
        if len(block) < int(size):
            yield _malformed(f"{len(block)} of {size} bytes of record {by.get('warc-record-id')}")
            continue
        yield by.get("warc-record-id"), by.get("warc-type"), by.get("warc-target-uri"), by.get("warc-date"), by.get("warc-refers-to"), fields, block
