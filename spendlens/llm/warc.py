"""WARC derivative builder: metadata and plain-text conversion records from responses.

``response_records`` wraps pages as WARC/1.1 response records (an HTTP message
as the block), ``parse_records`` reads them from the bytes of a WARC file, and
``derive`` turns each response into two linked records:

* ``metadata`` (``application/warc-fields``): status, media type, charset, title,
  outlinks, the response's digests, its HTTP headers, and the source record's own
  WARC headers that the derived records do not carry (IP address, truncation, warcinfo id ...);
* ``conversion`` (``text/plain``): the visible text, for a 2xx response whose
  media type is HTML or text.

The payload is what is left of the message after its transfer encoding (chunked) and content
encoding (gzip, deflate, zstd) are undone; a charset comes from the HTTP header, a byte order
mark or a ``meta`` element, else it is UTF-8.  A payload that cannot be decoded has no conversion
and a metadata field ``undecoded``.

Both carry ``WARC-Refers-To`` (the response's id), ``WARC-Refers-To-Target-URI``,
``WARC-Refers-To-Date`` and ``WARC-Payload-Digest`` as in the response; the
metadata record names the conversion in ``WARC-Concurrent-To``.  Record ids are
derived from the response's id and the type, so building twice gives the same
records.  ``record_bytes`` serialises a record.

Every step is a row-wise map: nothing is shuffled, however large a site is.  ``read_warc``
lets Spark's text reader cut the files at the records' starts: plain files are read by
splits, a gzipped one (``.gz``, members one after the other) is streamed record by record
in one task, and no file is ever held whole.

Defined cases: a null URL gives a record without ``WARC-Target-URI``; a null
page an empty payload and an empty conversion; a null id stays null; a response without a
record id has no ``WARC-Refers-To``, and its derived ids come from its URI, date and block; a response without a status line or blank line counts as a payload alone
(status 0) and has no conversion; a null or missing block gives no records;
repeated rows give the same records again; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.html_extract import BLOCKS, TOKEN

VERSION = "WARC/1.1"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs (RFC 4122)
DATE = "2020-01-01T00:00:00Z"
FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date",
          "WARC-Concurrent-To", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Type", "Content-Length")
HIDDEN = frozenset("head script style noscript template textarea title iframe noembed noframes".split())
TEXT_TYPES = ("text/", "application/xhtml+xml")
RESPONSE = "source_id string, headers map<string,string>, block binary"
DERIVED = ("source_id string, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, "
           "content_type string, content_length bigint, payload_digest string, block_digest string, block string")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """A whole WARC record; known fields in their fixed order, others after them."""
    order = [k for k in FIELDS if headers.get(k) is not None] + sorted(k for k in headers if k not in FIELDS and headers[k] is not None)
    head = "".join(f"{k}: {' '.join(headers[k].split())}\r\n" for k in order)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file, gzipped by member or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        while data[at:at + 2] == b"\r\n":
            at += 2
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = _headers(data[at:end])
        n = int(headers.get("Content-Length", "0"))
        yield headers, data[end + 4:end + 4 + n]
        at = end + 4 + n


_NEXT = b"\r\n\r\nWARC/1."


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``source_id``, ``headers``, ``block`` of the response records of WARC files, plain or ``.gz``.

    A record whose block holds the text of a record's start comes in several
    pieces, which are put together by its length; one that a split cuts there,
    or the end of the file, fails the job.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
        held, name = b"", None
        for batch in batches:
            for piece, file in zip(batch.column("piece").to_pylist(), batch.column("file").to_pylist(), strict=True):
                if held and file != name:
                    raise ValueError(f"a record of {name} is cut off")
                name = file
                held = held + _NEXT + piece if held else piece
                end = held.find(b"\r\n\r\n")
                headers = _headers(held[:end]) if end >= 0 else {}
                n = int(headers.get("Content-Length", "0"))
                if end >= 0 and len(held) - end - 4 >= n:
                    yield headers, held[end + 4:end + 4 + n]
                    held = b""
                elif not held.strip():
                    held = b""
        if held:
            raise ValueError(f"a record of {name} is cut off")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for headers, block in records(batches):
            if headers.get("WARC-Type") == "response":
                yield pa.RecordBatch.from_arrays([pa.array([headers.get("WARC-Record-ID")], pa.string()), pa.array([list(headers.items())], kind),
                                                  pa.array([block], pa.binary())], ["source_id", "headers", "block"])

    lines = spark.read.option("lineSep", _NEXT.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file")).mapInArrow(read, RESPONSE)


def _headers(head: bytes) -> dict[str, str]:
    return {k.strip(): v.strip() for k, v in (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)}


def response(source_id: str, url: str | None, page: str | None, date: str = DATE) -> tuple[dict[str, str], bytes]:
    payload = (page or "").encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id(f"response:{source_id}:{url or ''}:{digest(payload)}"), "WARC-Date": date,
               "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response",
               "Content-Length": str(len(block))}
    if url is not None:
        headers["WARC-Target-URI"] = url
    return headers, block


def split_http(block: bytes) -> tuple[int, list[tuple[str, str]], bytes]:
    """Status, headers and payload of an HTTP message."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return 0, [], block
    lines = block[:end].decode("iso-8859-1").split("\r\n")
    status = re.match(r"HTTP/\S+\s+(\d{3})", lines[0])
    headers = [(k.strip(), v.strip()) for k, v in (line.split(":", 1) for line in lines[1:] if ":" in line)]
    return int(status[1]) if status else 0, headers, block[end + 4:]


def unchunked(data: bytes) -> bytes:
    """The body of a chunked message; what is no chunk (a crawler may have undone it) stays as it is."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9a-fA-F]{1,16})\s*(?:;.*)?", data[at:end]) if end >= 0 else None
        if not size:
            return b"".join(out) if out else data
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        out.append(data[end + 2:end + 2 + n])
        at = end + 2 + n + 2
        if at > len(data):
            return b"".join(out)


def inflated(data: bytes, wbits: int) -> bytes:
    """All members of a zlib stream of that kind; one cut short gives what it has."""
    out = []
    while data:
        one = zlib.decompressobj(wbits)
        out.append(one.decompress(data) + one.flush())
        data = one.unused_data if one.eof else b""
    return b"".join(out)


def decoded(http: list[tuple[str, str]], payload: bytes) -> tuple[bytes, str | None]:
    """The payload without its encodings, and the encoding that could not be undone."""
    tokens = lambda name: [t.strip().lower() for k, v in http if k.lower() == name for t in v.split(",") if t.strip()]
    if "chunked" in tokens("transfer-encoding"):
        payload = unchunked(payload)
    for kind in reversed(tokens("content-encoding") + [t for t in tokens("transfer-encoding") if t != "chunked"]):
        try:
            if kind in ("gzip", "x-gzip"):
                if payload[:2] == b"\x1f\x8b":  # else it is stored without
                    payload = inflated(payload, 31)
            elif kind == "deflate":
                try:
                    payload = inflated(payload, 15)
                except zlib.error:
                    payload = inflated(payload, -15)
            elif kind == "zstd":
                payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload)
            elif kind != "identity":
                return payload, kind
        except (zlib.error, zstandard.ZstdError):
            return payload, kind
    return payload, None


_META = re.compile(rb"<meta\s[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def charset_of(media: str, payload: bytes) -> str:
    found = re.search(r"charset\s*=\s*\"?([\w.:-]+)", media, re.I)
    if found:
        return found[1]
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if payload.startswith(mark):
            return name
    meta = _META.search(payload[:1024])
    return meta[1].decode("ascii") if meta else "utf-8"


def plain_text(page: str) -> tuple[str, str, list[str]]:
    """The visible text (blocks on lines of their own), the title and the links of an HTML page."""
    out: list[str] = []
    title, links, at = "", [], 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            out.append(page[at:])
            break
        out.append(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag in HIDDEN and tag != "head" and not (m[1] or m[4]):
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if tag == "title" and not title:
                title = " ".join(entities.unescape(page[at:stop]).split())
            at = stop
        elif tag in BLOCKS or tag == "br":
            out.append("\x00")
        elif tag == "a" and (href := re.search(r"href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", m[3] or m[6] or "", re.I)):
            links.append(entities.unescape(href[1] or href[2] or href[3] or "").strip())
    lines = (" ".join(line.split()) for line in entities.unescape("".join(out)).split("\x00"))
    return "\n".join(line for line in lines if line), title, links


def derive_records(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and, where there is text, the conversion record of one response."""
    status, http, payload = split_http(block)
    source, uri = headers.get("WARC-Record-ID"), headers.get("WARC-Target-URI")
    name = source or f"{uri or ''} {headers.get('WARC-Date') or ''} {digest(block)}"
    stored = payload
    payload, undecoded = decoded(http, payload)
    media = next((v for k, v in http if k.lower() == "content-type"), "")
    kind = media.partition(";")[0]
    charset = charset_of(media.partition(";")[2], payload)
    try:
        page = payload.decode(charset, "replace")
    except (LookupError, ValueError):  # unknown, or no encoding of text
        charset, page = "utf-8", payload.decode("utf-8", "replace")
    kind = kind.strip().lower()
    convert = 200 <= status < 300 and kind.startswith(TEXT_TYPES) and not undecoded
    is_html = kind in ("text/html", "application/xhtml+xml")
    text, title, links = plain_text(page) if is_html else (page, "", [])
    linked = {"WARC-Date": headers.get("WARC-Date"), "WARC-Target-URI": uri, "WARC-Refers-To": source, "WARC-Refers-To-Target-URI": uri,
              "WARC-Refers-To-Date": headers.get("WARC-Date"), "WARC-Payload-Digest": headers.get("WARC-Payload-Digest") or digest(stored)}
    conversion_id = record_id(f"conversion:{name}")
    fields = [("status", str(status)), ("media-type", kind), ("charset", charset), ("title", title), ("payload-length", str(len(payload))),
              ("payload-digest", linked["WARC-Payload-Digest"]), ("block-digest", headers.get("WARC-Block-Digest") or digest(block))]
    fields += [("undecoded", undecoded)] if undecoded else []
    fields += [("http-header", f"{k}: {v}") for k, v in http]
    fields += [("warc-header", f"{k}: {headers[k]}") for k in sorted(headers) if k not in FIELDS and headers[k] is not None]
    for link in links:
        try:
            fields.append(("outlink", urljoin(uri or "", link)))
        except ValueError:
            fields.append(("outlink", link))
    about = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode("utf-8", "replace")
    made = [("metadata", record_id(f"metadata:{name}"), "application/warc-fields", about, conversion_id if convert else None)]
    if convert:
        made.append(("conversion", conversion_id, "text/plain; charset=utf-8", text.encode("utf-8", "replace"), None))
    return [({"WARC-Type": kind_, "WARC-Record-ID": id_, **linked, "WARC-Concurrent-To": other, "WARC-Block-Digest": digest(data),
              "Content-Type": type_, "Content-Length": str(len(data))}, data) for kind_, id_, type_, data, other in made]


def response_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    def wrap(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *response(k or "", u, h, date)) for k, u, h in zip(f["k"], f["u"], f["h"], strict=True)]
            yield pd.DataFrame(rows, columns=["source_id", "headers", "block"])

    return pages.select(F.col(key).cast("string").alias("k"), F.col(url).alias("u"), F.col(html).alias("h")).mapInPandas(wrap, RESPONSE)


def derive(responses: DataFrame) -> DataFrame:
    """One row per derived record of ``source_id, headers, block`` rows."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, h, b in zip(f["source_id"], f["headers"], f["block"], strict=True):
                for head, data in derive_records(dict(h or {}), b) if b is not None else ():
                    rows.append((k, head["WARC-Type"], head["WARC-Record-ID"], head["WARC-Refers-To"], head["WARC-Concurrent-To"], head["WARC-Target-URI"],
                                 head["WARC-Date"], head["Content-Type"], len(data), head["WARC-Payload-Digest"], head["WARC-Block-Digest"],
                                 data.decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DERIVED.split(", ")])

    return responses.mapInPandas(build, DERIVED)
