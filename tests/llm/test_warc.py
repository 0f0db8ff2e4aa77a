"""WARC derivatives: round trip, links, digests and text of the derived records."""

import base64
import gzip
import hashlib

import random
import zlib
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
import zstandard

from spendlens.llm import warc

PAGE = '<html><head><title>T &amp; t</title><script>x</script></head><body><p>a&nbsp;b</p><a href="/c?d&amp;e">l</a><br>k</body></html>'


def test_round_trip(spark, tmp_path):
    records = [warc.response("1", "http://x.y/", PAGE), warc.response("2", None, None)]
    data = b"".join(warc.record_bytes(h, b) for h, b in records)
    assert [(h, b) for h, b in warc.parse_records(data)] == records
    (tmp_path / "plain.warc").write_bytes(data)
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(warc.record_bytes(h, b)) for h, b in records))
    read = warc.read_warc(spark, f"file://{tmp_path}/*").collect()
    assert sorted((r.source_id, bytes(r.block)) for r in read) == sorted((h["WARC-Record-ID"], b) for h, b in records * 2)


def test_derived_records():
    headers, block = warc.response("1", "http://x.y/z/", PAGE)
    (meta, fields), (conv, text) = warc.derive_records(headers, block)
    assert text.decode() == "a b\nl\nk"
    sha = "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()
    for h, data, kind in ((meta, fields, "metadata"), (conv, text, "conversion")):
        assert h["WARC-Type"] == kind and h["WARC-Refers-To"] == headers["WARC-Record-ID"]
        assert h["WARC-Refers-To-Target-URI"] == "http://x.y/z/" and h["WARC-Payload-Digest"] == sha
        assert h["WARC-Block-Digest"] == warc.digest(data) and h["Content-Length"] == str(len(data))
        assert next(warc.parse_records(warc.record_bytes(h, data)))[1] == data
    assert meta["WARC-Concurrent-To"] == conv["WARC-Record-ID"] != meta["WARC-Record-ID"]
    lines = fields.decode().split("\r\n")
    assert "title: T & t" in lines and "outlink: http://x.y/c?d&e" in lines and "http-header: Content-Type: text/html; charset=utf-8" in lines
    assert f"block-digest: {warc.digest(block)}" in lines


def test_other_responses():
    def of(block):
        return [h["WARC-Type"] for h, _ in warc.derive_records({"WARC-Record-ID": "r"}, block)]

    assert of(b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\nx") == ["metadata"]
    assert of(b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\nx") == ["metadata"]
    assert of(b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=no-such\r\n\r\nx") == ["metadata", "conversion"]
    assert of(b"no http") == of(b"") == ["metadata"]


def test_frames(spark):
    rows = [(1, "http://x.y/", PAGE, 0), (None, None, None, 0), (2, "http://x.y/", "", 0), (2, "http://x.y/", "", 0), (3, "u", "<p>" + "w " * 100_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block int")
    out = warc.derive(warc.response_records(pages)).collect()
    assert len(out) == 2 * len(rows)
    assert {r.source_id for r in out} == {"1", None, "2", "3"}
    assert len({r.record_id for r in out}) == 2 * (len(rows) - 1)  # the repeated row gives the same records
    by_id = {r.record_id: r for r in out}
    assert all(by_id[r.concurrent_to].refers_to == r.refers_to for r in out if r.record_type == "metadata")
    assert warc.derive(warc.response_records(pages.limit(0))).count() == 0
    nothing = spark.createDataFrame([("s", None, None)], warc.RESPONSE)
    assert warc.derive(nothing).count() == 0


def message(payload, *lines):
    return ("HTTP/1.1 200 OK\r\n" + "".join(f"{x}\r\n" for x in lines) + "\r\n").encode() + payload


def texts(block, headers=None):
    return {h["WARC-Type"]: d.decode() for h, d in warc.derive_records({"WARC-Record-ID": "r", **(headers or {})}, block)}


def chunks(data):
    return b"".join(f"{len(data[i:i + 7]):x};x=1\r\n".encode() + data[i:i + 7] + b"\r\n" for i in range(0, len(data), 7)) + b"0\r\nTrailer: x\r\n\r\n"


def test_encodings_are_undone():
    page, html = b"<title>T</title><p>caf\xc3\xa9 au lait", "Content-Type: text/html"
    raw = zlib.compressobj(wbits=-15)
    bodies = {"gzip": gzip.compress(page[:9]) + gzip.compress(page[9:]), "deflate": zlib.compress(page), "zstd": zstandard.compress(page), "identity": page}
    for kind, body in bodies.items():
        assert texts(message(body, html, f"Content-Encoding: {kind}"))["conversion"] == "caf\u00e9 au lait", kind
        assert texts(message(chunks(body), html, f"Content-Encoding: {kind}", "Transfer-Encoding: chunked"))["conversion"] == "caf\u00e9 au lait"
    assert texts(message(raw.compress(page) + raw.flush(), html, "Content-Encoding: deflate"))["conversion"] == "caf\u00e9 au lait"
    assert texts(message(page, html, "Content-Encoding: gzip", "Transfer-Encoding: chunked"))["conversion"] == "caf\u00e9 au lait"  # undone before
    assert texts(message(gzip.compress(page)[:-12], html, "Content-Encoding: gzip"))["conversion"].startswith("caf")  # cut short
    for kind, body in (("br", page), ("deflate", b"\xff\xff"), ("zstd", b"xx"), ("gzip", b"\x1f\x8bxx")):
        got = texts(message(body, html, f"Content-Encoding: {kind}"))
        assert "conversion" not in got and f"undecoded: {kind}" in got["metadata"]
    head = message(gzip.compress(page), html, "Content-Encoding: gzip")
    assert f"payload-digest: {warc.digest(warc.split_http(head)[2])}" in texts(head)["metadata"]  # of the payload as stored


def test_charsets():
    page = "<meta charset='iso-8859-1'><p>caf\u00e9".encode("latin-1")
    assert texts(message(page, "Content-Type: text/html"))["conversion"] == "caf\u00e9"
    meta = '<META http-equiv="Content-Type" content="text/html; charset=windows-1251"><p>\u0434\u0430'.encode("cp1251")
    assert texts(message(meta, "Content-Type: text/html"))["conversion"] == "\u0434\u0430"
    assert texts(message("\ufeff<p>\u00e9".encode("utf-16"), "Content-Type: text/html"))["conversion"].endswith("\u00e9")
    for charset in ("no-such", "hex", "idna"):
        assert "conversion" in texts(message(b"<p>x" + b"\xff" * 70, f"Content-Type: text/html; charset={charset}"))


def test_source_headers_and_ids():
    block = message(b"<p>x", "Content-Type: text/html")
    extra = {"WARC-IP-Address": "1.2.3.4", "WARC-Truncated": "length", "WARC-Warcinfo-ID": "<urn:uuid:w>"}
    got = texts(block, extra)["metadata"]
    assert all(f"warc-header: {k}: {v}\r\n" in got for k, v in extra.items())
    a = warc.derive_records({"WARC-Target-URI": "http://a/"}, block)
    b = warc.derive_records({"WARC-Target-URI": "http://b/"}, block)
    c = warc.derive_records({"WARC-Target-URI": "http://a/"}, block + b"y")
    ids = [h["WARC-Record-ID"] for r in (a, b, c) for h, _ in r]
    assert len(set(ids)) == 6 and all(h["WARC-Refers-To"] is None for h, _ in a)
    assert b"WARC-Refers-To:" not in warc.record_bytes(*a[0])


def test_files_are_read_record_by_record(spark, tmp_path):
    rnd = random.Random(1)
    records = []
    for i in range(300):
        page = "".join(rnd.choice(["<p>", "x", "\r\n", "\r\n\r\n", "\u00e9", "\r\n\r\nWARC/1.0\r\n", "WARC/1.1"]) for _ in range(rnd.randint(0, 40)))
        records.append(warc.response(str(i), f"http://x.y/{i}", page))
    data = b"".join(warc.record_bytes(h, b) for h, b in records)
    other = warc.record_bytes({"WARC-Type": "warcinfo", "Content-Length": "0"}, b"")
    (tmp_path / "a.warc").write_bytes(other + data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(other) + b"".join(gzip.compress(warc.record_bytes(h, b)) for h, b in records))
    read = warc.read_warc(spark, f"file://{tmp_path}/*")
    want = sorted((h["WARC-Record-ID"], b, h["WARC-Target-URI"]) for h, b in records * 2)
    assert sorted((r.source_id, bytes(r.block), r.headers["WARC-Target-URI"]) for r in read.collect()) == want
    (tmp_path / "a.warc").write_bytes(data[:-40])
    with pytest.raises(Exception, match="cut off"):
        read.collect()


class Plain(HTMLParser):
    """Visible text, title and links by the standard library's parser, for well-formed pages."""

    def __init__(self):
        super().__init__()
        self.lines, self.links, self.title, self.hidden = [""], [], "", []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.hidden.append(tag)
        elif tag == "a":
            self.links += [v.strip() for k, v in attrs if k == "href"]
        elif tag not in ("b", "i", "span", "a"):
            self.lines.append("")

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        elif tag not in ("b", "i", "span", "a"):
            self.lines.append("")

    def handle_data(self, data):
        if self.hidden[-1:] == ["title"]:
            self.title += data
        elif not self.hidden:
            self.lines[-1] += data


def test_against_a_plain_derivation(spark):
    rnd = random.Random(5)
    inline = ["b", "i", "span"]
    text = lambda: "".join(rnd.choice(["a", " ", "\n", "&amp;", "&lt;x", "\u00e9", "&#233;", "w"]) for _ in range(rnd.randint(1, 9)))

    def tree(depth):
        kind = rnd.random()
        if kind < 0.4 or not depth:
            return text()
        if kind < 0.5:
            return f'<a href="/{rnd.randint(0, 9)}?q=1&amp;r={rnd.randint(0, 9)}">{text()}</a>'
        if kind < 0.6:
            return rnd.choice(["<br>", "<script>if (a < b) {}</script>", "<style>p{}</style>"])
        tag = rnd.choice([*inline, "div", "p", "li", "td", "h2"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rnd.randint(0, 4))) + f"</{tag}>"

    pages = [(i, f"http://h{i % 3}/d/p", f"<html><title>{text()}</title><body>" + "".join(tree(4) for _ in range(5)) + "</body></html>") for i in range(60)]
    out = {}
    for r in warc.derive(warc.response_records(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect():
        out[int(r.source_id), r.record_type] = r
    for key, url, html in pages:
        plain = Plain()
        plain.feed(html)
        conversion, metadata = out[key, "conversion"], out[key, "metadata"]
        assert conversion.block == "\n".join(x for x in (" ".join(line.split()) for line in plain.lines) if x)
        assert [x.split(": ", 1)[1] for x in metadata.block.split("\r\n") if x.startswith("outlink: ")] == [urljoin(url, x) for x in plain.links]
        assert f"title: {' '.join(plain.title.split())}\r\n" in metadata.block
        sha = "sha1:" + base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert conversion.payload_digest == metadata.payload_digest == sha and metadata.concurrent_to == conversion.record_id
        assert conversion.refers_to == metadata.refers_to == warc.response(str(key), url, html)[0]["WARC-Record-ID"]
