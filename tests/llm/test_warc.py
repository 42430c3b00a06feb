"""WARC records against an independent reader and the standard library's HTML parser."""

import base64
import gzip
import hashlib
import random
import time
import zlib
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from linepatterns.llm import queries, warc

SF = "/root/testdata/sf0.001"


class Reader(HTMLParser):
    """Text, title and links by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.title, self.hidden, self.in_title = [], [], None, 0, False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in warc.BLOCK:
            self.text.append("\n")
        if tag in warc.CELL:
            self.text.append(" ")
        if tag in warc.HIDDEN:
            self.hidden += 1
        if tag == "a" and "href" in dict(attrs):
            self.links.append(" ".join((dict(attrs)["href"] or "").split()))
        self.in_title |= tag == "title"

    def handle_endtag(self, tag):
        if tag in warc.BLOCK:
            self.text.append("\n")
        if tag in warc.CELL:
            self.text.append(" ")
        if tag in warc.HIDDEN:
            self.hidden -= 1
        self.in_title &= tag != "title"

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.in_title and self.title is None:
                self.title = " ".join(data.split())

    def lines(self):
        return [x for line in "".join(self.text).split("\n") if (x := " ".join(line.split()))]


def records_of(data):
    """(headers, block) of each record, by their lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        assert first == "WARC/1.0"
        fields = dict(x.split(": ", 1) for x in lines)
        at = end + 4 + int(fields["Content-Length"])
        assert data[at : at + 4] == b"\r\n\r\n"
        yield fields, data[end + 4 : at]
        at += 4


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op3_warc_derivatives(spark, SF).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        ((fields, block),) = records_of(bytes(r["record"]))
        page = pages[r["page_id"]]
        raw = page["html"].encode()
        assert fields["WARC-Type"] == r["record_type"] and block.decode() == r["block"] and fields["WARC-Block-Digest"] == sha1(block) == r["block_digest"]
        assert fields["WARC-Target-URI"] == fields["WARC-Refers-To-Target-URI"] == page["url"] and fields["WARC-Refers-To"] == r["refers_to"] and r["source_digest"] == sha1(raw)
        seen = Reader(page["html"])
        if r["record_type"] == "conversion":
            assert r["block"].split("\n") == seen.lines()
        else:
            own = [x.split(": ", 1) for x in r["block"].split("\r\n")[:-1]]
            assert [v for k, v in own if k == "outlink"] == seen.links and dict(own).get("title") == seen.title
            assert dict(own)["source-payload-digest"] == sha1(raw) and dict(own)["source-content-length"] == str(len(raw)) and dict(own)["source-http-status"] == "HTTP/1.1 200 OK" and dict(own)["source-header-content-type"] == "text/html; charset=utf-8"


def test_random_pages():
    """Well-formed soup: text and links as the standard library reads them."""
    rng = random.Random(1)
    for _ in range(300):
        bits = ["<p>", "</p>", "<b class=x>", "</b>", "<br/>", "a &amp; b ", "x<td>y</td>", "<A HREF='/u?a=1&amp;b=2'>link</A>", '<a title="t" href="/v">', "</a>", "<a href=/w >", "<script>if (a<b) { '<p>' }</script>", "<!-- <p>no --->", " 1 < 2 ", "caf\u00e9\n", "<title>T &lt;</title>", "<style>p {}</style>", "<a name=n>"]
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        seen = Reader(page)
        assert warc.plain_text(page).split("\n") == (seen.lines() or [""]), page
        assert [v for k, v in warc.read(page)[1] if k == "outlink"] == seen.links, page


def test_response_records(spark, tmp_path):
    """A WARC file with records of several kinds, charsets and headers."""
    def record(kind, block, **more):
        fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:x:{kind}-{len(block)}>", "WARC-Date": "2024-05-06T07:08:09Z", "WARC-Target-URI": "http://e.x/\u00e9", "Content-Length": len(block)} | more
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    latin = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nX-Long: one\r\n two\r\n\r\n<title>caf\xe9</title>"
    binary = b"HTTP/1.1 404 Not Found\r\nServer: s\r\n\r\n" + bytes(range(256))
    data = record("warcinfo", b"software: x\r\n") + record("response", latin) + record("request", b"GET / HTTP/1.1\r\n\r\n") + record("response", binary) + record("response", b"HTTP/1.1 200 OK\r\n\r\n") + record("response", b"short", **{"Content-Length": 99})
    (tmp_path / "a.warc").write_bytes(data)
    records = warc.read_records(spark, f"{tmp_path}/a.warc")
    assert records.count() == 6
    found = {r["payload_length"]: r for r in warc.responses(records).collect()}
    assert set(found) == {19, 256, 0} and found[19]["html"] == "<title>caf\u00e9</title>" and found[256]["payload_digest"] == sha1(bytes(range(256)))
    rows = warc.derivatives(warc.responses(records), payload_digest="payload_digest", payload_length="payload_length").collect()
    one = next(r for r in rows if r["record_type"] == "metadata" and "caf\u00e9" in r["block"])
    assert "source-header-x-long: one two\r\n" in one["block"] and "source-payload-digest: " + sha1(b"<title>caf\xe9</title>") in one["block"] and one["date"] == "2024-05-06T07:08:09Z" and one["target_uri"] == "http://e.x/\u00e9"
    assert len(rows) == 6 and all(list(records_of(bytes(r["record"])))[0][0]["WARC-Date"] == "2024-05-06T07:08:09Z" for r in rows)
    assert warc.responses(records, all_rows=True).count() == 6


def test_awkward_pages(spark):
    odd = spark.createDataFrame([(None, None, None), ("", "u", "r"), ("<p", "u", "r"), ("<a href='/x'>t</a><script>" + "<" * 50000, None, "s"), ("<a href='/x'>t</a>", None, "s"), ("<a href='/x'>t</a>", None, "s"), ("<", "u", None), ("a <!-- b", "u", "r"), ("<\u00e9>", "u", "r")], "html string, url string, record_id string").withColumn("_page", F.lit(1)).withColumn("block", F.lit(2)).withColumn("_f0", F.lit(3))
    got = warc.derivatives(odd, date=None, headers=None, keep=("_page", "_f0")).collect()
    assert len(got) == 18 and sum("outlink: /x" in r["block"] for r in got) == 3 and all(r["_page"] == 1 and r["_f0"] == 3 for r in got)
    assert warc.derivatives(odd.limit(0), date=None, headers=None).collect() == []
    again = warc.responses(warc.as_records(odd, keep=("block",)), keep=("block",), all_rows=True).collect()
    assert len(again) == 9 and [r["html"] for r in again if r["url"] is None][0] == "" and all(r["block"] == 2 and r["html"] is not None for r in again)
    assert warc.plain_text("<p>a &amp; b<br>c<script>x<b></script><!-- n --> d</p>e<td>f</td>g") == "a & b\nc d\ne f g"


@pytest.mark.parametrize("unit", ["<a ", "<a href='", "<!-- ", "<script>", "<", "<a>", "</", '<meta charset="', "<title>", "&amp", "<p x=\"' y='\">"])
def test_long_pages_take_time_in_proportion(unit):
    began = time.time()
    page = unit * (1_000_000 // len(unit))
    warc.derive(page, None, None, None, None)
    assert time.time() - began < 20


def a_response(body=b"<p>x</p>", http=b"HTTP/1.1 200 OK\r\nContent-Type: text/html", size=None, version=b"1.0", more=b""):
    block = http + b"\r\n\r\n" + body
    size = str(len(block)).encode() if size is None else size
    return b"WARC/" + version + b"\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\n" + more + b"Content-Length: " + size + b"\r\n\r\n" + block + b"\r\n\r\n"


def typed(charset):
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=" + charset


def test_hostile_heads(spark):
    assert warc.response(a_response(size="²".encode())) is None and warc.response(a_response(size=b"9" * 5000)) is None and warc.response(a_response(size=b"-1")) is None
    for charset in ("idna", "undefined", "punycode", "unicode_escape", "base64", "rot13", "utf-7", "no-such-thing", "utf-16", "utf-32", "cp1252"):
        text = warc.response(a_response(b"\\ud800 \xff\x00 <p>" + b"a" * 9, typed(charset.encode())))[4]
        assert isinstance(text, str) and text.encode("utf-8")
    rows = [(a_response(size="²".encode()),), (a_response(b"x", typed(b"idna")),), (a_response(b"\xe4", typed(b"latin-1")),), (None,), (b"",)]
    got = warc.responses(spark.createDataFrame(rows, "record binary"), all_rows=True).collect()
    assert sorted(str(r["html"]) for r in got) == ["None", "None", "None", "x", "ä"]


def test_codings():
    page = "<p>é</p>".encode() * 50
    zipped, raw = gzip.compress(page), zlib.compress(page)[2:-4]
    chunks = lambda b: b"".join(b"%x;a=b\r\n" % len(b[i : i + 7]) + b[i : i + 7] + b"\r\n" for i in range(0, len(b), 7)) + b"0\r\nTrailer: x\r\n\r\n"
    head = lambda *lines: b"\r\n".join((b"HTTP/1.1 200 OK", *lines))
    chunked, coded = b"Transfer-Encoding: chunked", lambda c: b"Content-Encoding: " + c
    for body, http in (
        (chunks(page), head(chunked)), (zipped, head(coded(b"gzip"))), (zipped[:0] + gzip.compress(page[:100]) + gzip.compress(page[100:]), head(coded(b"x-gzip"))), (zlib.compress(page), head(coded(b"deflate"))), (raw, head(coded(b"deflate"))),
        (chunks(zipped), head(chunked, coded(b"GZIP"))), (gzip.compress(zlib.compress(page)), head(coded(b"deflate, gzip"))), (page, head(chunked)), (page, head(coded(b"gzip"))), (page, head(coded(b"identity"))),
    ):
        found = warc.response(a_response(body, http))
        assert found[4:] == (page.decode(), warc.digest(body), len(body), "whole"), http
    assert warc.response(a_response(zipped[:-20], head(coded(b"gzip"))))[7] == "cut"
    assert warc.response(a_response(chunks(page)[:100], head(chunked)))[7] == "cut"
    assert warc.response(a_response(b"\x0b", head(coded(b"br"))))[4::3] == ("", "coded")
    bomb = gzip.compress(b"a" * 10_000_000)
    cut = warc.response(a_response(bomb, head(coded(b"gzip"))), most=1000)
    assert cut[4:] == ("a" * 1000, warc.digest(bomb), len(bomb), "cut")


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_files_of_any_version(spark, tmp_path, name):
    inside = b"text\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nno"
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    records = [info, *(a_response(b"body %d " % i + (inside if i == 2 else b"\r\n\r\n" * (i % 2)), version=b"1.1" if i % 3 else b"1.0") for i in range(5))]
    write = gzip.compress if name.endswith("gz") else bytes
    (tmp_path / name).write_bytes(b"".join(map(write, records)))
    (tmp_path / f"b{name}").write_bytes(b"".join(map(write, records[1:])))
    got = warc.read_records(spark, [f"{tmp_path}/{name}", f"{tmp_path}/b{name}"])
    assert sorted(bytes(r["record"]) for r in got.collect()) == sorted(records + records[1:])
    assert sorted(r["payload_length"] for r in warc.responses(got).collect()) == sorted(2 * [len(r.partition(b"text/html\r\n\r\n")[2]) - 4 for r in records[1:]])


def test_a_comment_after_tags_that_never_end_is_linear():
    took = []
    for n in (20_000, 160_000):
        began = time.perf_counter()
        assert warc.plain_text("x<a " * n + "<!--") == ("x<a " * n).strip()
        took.append(time.perf_counter() - began)
    assert took[1] < 0.5 + 20 * took[0] and took[1] < 3


def test_signs_that_change_when_lowered():
    letters = set("".join(warc.HIDDEN))
    odd = [chr(i) for i in range(128, 0x110000) if set(chr(i).lower()) & letters]
    assert odd == ["\u0130"]
    for sign in ("\u0130", "\u212a", "\u017f", "\u1e9e"):
        assert warc.plain_text(f"a{sign}<SCRIPT>x{sign}</{sign}cript>y</ScRiPt>b{sign}") == f"a{sign}b{sign}"
