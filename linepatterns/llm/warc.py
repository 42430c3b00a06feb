"""WARC derivatives: a metadata and a plain-text conversion record for each response record.

Responses. ``responses`` takes response records as they stand in a WARC file (record head, HTTP head, body) apart, a record a row, and
``read_records`` splits WARC files into them. ``as_records`` makes such records of a table of pages that has none.

Derivatives refer to their response by WARC-Refers-To, WARC-Refers-To-Target-URI and WARC-Refers-To-Date and carry its target URI and
date. The metadata block (application/warc-fields) lists what the source says of itself: its record id, payload digest, length and
HTTP status and headers, then title, language, character set and outlinks found in the page, in order. The conversion block is the
page's text: without comments, scripts, styles and tags, block elements ending a line, character references decoded, white space
folded. Digests are ``sha1:`` and Base32 as is usual in WARC files. Record ids are UUIDs of the digest of kind, source record and
block, so a rerun gives the same ones.

A page is read once from start to end: a tag ends at the first ``>`` after it, nothing is tried past the last one, and a comment,
script or style that never ends hides the rest.

A null payload is an empty page and still gives both records; a null target URI, date or header is left out. Records that are no
response, or that are cut short, are left out by ``responses`` unless asked for. Repeated rows give repeated records. Of the tables
only the named columns and ``keep`` are read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.0\r\n"
#: fixed values: elements that hide their content, that end a line, and that part cells
HIDDEN = frozenset("script style noscript template".split())
BLOCK = frozenset("p div br hr li ul ol dl dt dd table tr h1 h2 h3 h4 h5 h6 nav header footer article section aside main title head body html pre blockquote form figure figcaption option".split())
CELL = frozenset("td th".split())
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SIZE = re.compile("[0-9]{1,18}")
#: bytes of a record that ``read_records`` puts together from pieces; one that says it has more is taken as it stands
MOST = 1 << 30
_CHUNK = re.compile(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n")
#: fixed values: Python's codecs that are no character sets
NO_CHARSETS = frozenset(("idna", "punycode", "undefined", "unicode-escape", "raw-unicode-escape", "utf-7", "base64", "bz2", "hex", "quopri", "rot13", "uu", "zlib"))
_START, _PART = b"WARC/1.", b"\r\n\r\nWARC/1."
_CHARSET = re.compile(r"""charset\s*=\s*["']?([A-Za-z0-9_-]+)""", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def parts(page: str) -> Iterator[tuple[str | None, str]]:
    """(None, text) and (name of the element, with a slash if it ends, what stands in the tag), in order; hidden content is left out."""
    lower, at, last, shown = None, 0, page.rfind(">"), 0
    while m := _OPEN.search(page, at):
        i = m.start()
        if m[1]:
            if i > shown:
                yield None, page[shown:i]
            end = page.find("-->", i + 4)
            at = shown = len(page) if end < 0 else end + 3
            continue
        if i > last:  # no tag ends any more, and a comment would hide the rest
            at = page.find("<!--", i)
            if at < 0:
                break
            continue
        end = page.find(">", i)
        if i > shown:
            yield None, page[shown:i]
        at = shown = end + 1
        if not m[2]:
            continue
        name = m[2].lower()
        yield name, page[m.end() : end] if name in _READ else ""
        if name in HIDDEN:
            lower = lower if lower is not None else _lowered(page)
            close = lower.find("</" + name, at)
            end = page.find(">", close) if close >= 0 else -1
            at = shown = len(page) if end < 0 else end + 1
    if shown < len(page):
        yield None, page[shown:]


_LOWER = {i: i + 32 for i in range(65, 91)}


def _lowered(page: str) -> str:
    """``page`` with A-Z lowered, signs at their places. ``lower`` is ten times faster and no other sign becomes a letter of a hidden element's name by it, but one becomes two signs."""
    lower = page.lower()
    return lower if len(lower) == len(page) else page.translate(_LOWER)


_OPEN = re.compile(r"<(?:(!--)|(/?[a-zA-Z][a-zA-Z0-9:-]*)|[/!?])")
_READ = frozenset(("html", "meta", "a"))


def read(page: str) -> tuple[str, list[tuple[str, str]]]:
    """The page's text, and title, language, charset and outlinks as (name, value), in one reading."""
    out: list[str] = []
    found: dict[str, str] = {}
    links: list[str] = []
    title = -1  # where in ``out`` it begins
    for name, text in parts(page):
        if name is None:
            out.append(text)
            continue
        bare = name.removeprefix("/")
        if name == "title" and "title" not in found and title < 0:
            title = len(out) + 1
        elif name == "/title" and title >= 0:
            found["title"], title = _folded(html.unescape("".join(out[title:]))), -1
        elif name in _READ:
            if name == "meta":
                if m := _CHARSET.search(text):
                    found.setdefault("charset", m[1])
            else:
                own = _attributes(text)
                if name == "a" and "href" in own:
                    links.append(_folded(html.unescape(own["href"])))
                elif name == "html" and own.get("lang"):
                    found.setdefault("language", own["lang"])
        if bare in BLOCK:
            out.append("\n")
        elif bare in CELL:
            out.append(" ")
    shown = "\n".join(line for x in html.unescape("".join(out)).split("\n") if (line := _folded(x)))
    return shown, [*((k, found[k]) for k in ("title", "language", "charset") if k in found), *(("outlink", x) for x in links)]


def plain_text(page: str) -> str:
    return read(page)[0]


def _folded(value: str) -> str:
    return " ".join(value.split())


def _attributes(inside: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(inside):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def metadata_block(fields: list[tuple[str, str | None]]) -> str:
    return "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)


def serialise(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One WARC/1.0 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return VERSION + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def heads(lines: str) -> list[tuple[str, str]]:
    """(name, value) of header lines; a line that begins with white space goes on with the value before it."""
    out: list[tuple[str, str]] = []
    for line in lines.splitlines():
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], _folded(out[-1][1] + " " + line))
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), _folded(value)))
    return out


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """The body of a chunked transfer, and whether it is whole. A body that doesn't begin as one is returned as it is: archives often keep the header of a body they have put together."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size, at = int(m[1], 16), m.end()
        if not size:
            return b"".join(out), True
        out.append(body[at : at + size])
        at += size
        if at > len(body):
            return b"".join(out), False
        at += 2 * (body[at : at + 2] == b"\r\n")
    return (b"".join(out), False) if out else (body, True)


def inflated(body: bytes, coding: str, most: int) -> tuple[bytes, bool]:
    """The body without its content coding, up to ``most`` bytes, and whether that is all of it."""
    if coding in ("gzip", "x-gzip"):
        ways = [31]
    else:
        ways = [15, -15]  # deflate, with its frame or, as some servers send it, without
    for bits in ways:
        out, size, rest = [], 0, body
        try:
            while rest and size < most:
                d = zlib.decompressobj(bits)
                out.append(d.decompress(rest, most - size))
                size += len(out[-1])
                if not d.eof:
                    return b"".join(out), False
                rest = d.unused_data if bits == 31 else b""
            return b"".join(out), not rest
        except zlib.error:
            if out:
                return b"".join(out), False
    return body, coding == "identity"


def decoded(text: bytes, charset: str) -> str:
    """By a codec for text in the Web; any other name stands for UTF-8."""
    try:
        if codecs.lookup(charset).name not in NO_CHARSETS:
            return text.decode(charset, "replace")
    except (LookupError, UnicodeError):
        pass
    return text.decode("utf-8", "replace")


def response(record: bytes | None, most: int = 64 << 20) -> tuple | None:
    """(record id, target URI, date, HTTP head, payload as text, digest of the payload's bytes, their number, state) of a whole response record; else null.

    Digest and number are those of the payload as it stands in the record. For its text a chunked transfer is put together and gzip or deflate undone. State:
    ``whole``; ``cut`` where the coding breaks off or gives more than ``most`` bytes, and the text is what comes before that; ``coded`` where the coding is not known, and there is no text.
    """
    head, found, rest = (record or b"").partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        return None
    own = {k.lower(): v for k, v in heads(head.split(b"\r\n", 1)[-1].decode("utf-8", "replace"))}
    size = own.get("content-length", "")
    if own.get("warc-type", "").lower() != "response" or not _SIZE.fullmatch(size) or len(rest) < int(size):
        return None
    http, found, payload = rest[: int(size)].partition(b"\r\n\r\n")
    if not found:
        http, payload = b"", http
    said = dict((k.lower(), v) for k, v in heads(http.decode("latin-1")))
    body, state = payload, "whole"
    if "chunked" in said.get("transfer-encoding", "").lower():
        body, whole = unchunked(body)
        state = "whole" if whole else "cut"
    for coding in reversed([c.strip().lower() for c in said.get("content-encoding", "").split(",")]):
        if coding in ("gzip", "x-gzip", "deflate"):
            if coding != "deflate" and not body.startswith(b"\x1f\x8b"):  # kept with the coding undone
                continue
            body, whole = inflated(body, coding, most)
            state = state if whole else "cut"
        elif coding not in ("", "identity"):
            body, state = b"", "coded"
            break
    charset = _CHARSET.search(said.get("content-type", "")) or _CHARSET.search(body[:2048].decode("latin-1"))
    text = decoded(body, charset[1] if charset else "utf-8")
    return own.get("warc-record-id"), own.get("warc-target-uri"), own.get("warc-date"), http.decode("latin-1"), text, digest(payload), len(payload), state


_RESPONSE = "record_id string, url string, date string, headers string, html string, payload_digest string, payload_length long, body string"


def responses(records: DataFrame, record: str = "record", keep: tuple[str, ...] = (), all_rows: bool = False) -> DataFrame:
    """The ``keep`` columns and record_id, url, date, headers, html, payload_digest, payload_length and body (the state of ``response``) of each response; other records go, or have nulls with ``all_rows``."""
    fields = [f"_f{i}" for i in range(len(keep))]
    base = records.select(*(F.col(k).alias(f) for k, f in zip(keep, fields, strict=True)), F.col(record).cast("binary").alias("_record"))

    def take(batches):
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                found = [response(r) for r in part.column("_record").to_pylist()]
                at = [i for i, r in enumerate(found) if r or all_rows]
                columns = list(zip(*(found[i] or (None,) * 8 for i in at), strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([*(part.column(f).take(pa.array(at, pa.int64())) for f in fields), *(pa.array(x, pa.string()) for x in columns[:6]), pa.array(columns[6], pa.int64()), pa.array(columns[7], pa.string())], names=[*fields, *(x.split()[0] for x in _RESPONSE.split(", "))])

    out = base.mapInArrow(take, "".join(f"{f} {base.schema[f].dataType.simpleString()}, " for f in fields) + _RESPONSE)
    return out.select(*(F.col(f).alias(k) for k, f in zip(keep, fields, strict=True)), *(x.split()[0] for x in _RESPONSE.split(", ")))


def _joined(batches):
    """Pieces between record heads -> records: a record shorter than it says goes on with the pieces after it in the same block."""
    held: list[bytes] = []
    lacking, last = 0, None

    def out(over: int):
        """The record without what stands after its length."""
        record = b"".join(held)
        return pa.RecordBatch.from_arrays([pa.array([(record[: len(record) - over] if over > 0 else record) + b"\r\n\r\n"], pa.binary())], names=["record"])

    for batch in batches:
        for path, block, piece in zip(batch.column("path"), batch.column("block"), batch.column("value"), strict=True):
            piece, here = piece.as_py(), (path.as_py(), block.as_py())
            if held and here == last and lacking > 0:
                lacking -= len(_PART) + len(piece)
                held += [_PART, piece]
                continue
            if held:
                yield out(-lacking)
            held, last = [piece if piece.startswith(_START) else _START + piece], here
            head, found, rest = held[0].partition(b"\r\n\r\n")
            size = dict((k.lower(), v) for k, v in heads(head.decode("latin-1"))).get("content-length", "")
            lacking = int(size) - len(rest) if found and _SIZE.fullmatch(size) and int(size) <= MOST else 0
    if held:
        yield out(-lacking)


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(record): the records of WARC files of any version, plain ones split among tasks, compressed ones a task a file. A record must fit in memory.

    Files are split where a blank line and ``WARC/1.`` follow each other. A body may hold that too: so a record that is shorter than its
    Content-Length goes on with what follows. Only where the border of two of Spark's splits of a plain file lies in such a body,
    between its start and that line, the record ends there, which ``responses`` sees from its length.
    """
    rows = spark.read.option("lineSep", _PART.decode()).text(paths)
    pieces = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(_joined, "record binary").where(F.octet_length("record") > len(_START) + 4)


def as_records(pages: DataFrame, payload: str = "html", uri: str = "url", date: str = "1970-01-01T00:00:00Z", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns and record: a response record for each page of a table that has the pages alone. Its id is a UUID of URI and page."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"))
    block = F.concat(F.encode(http, "UTF-8"), body)
    head = F.concat(
        F.lit(VERSION.decode() + "WARC-Type: response\r\n"),
        line("WARC-Record-ID", response_id(uri, payload)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col(uri)),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return pages.select(*keep, F.concat(F.encode(head, "UTF-8"), block, F.lit(bytearray(b"\r\n\r\n"))).alias("record"))


def derive(page: str | None, uri: str | None, record_id: str | None, date: str | None, source: str | None, payload_digest: str | None = None, payload_length: int | None = None) -> list[tuple]:
    """(type, record id, content type, length, block digest, payload digest of the source, block, record) of both records."""
    payload = (page or "").encode("utf-8", "replace")
    source_digest = payload_digest or digest(payload)
    own = [("source-record-id", record_id), ("source-payload-digest", source_digest), ("source-content-length", str(len(payload) if payload_length is None else payload_length))]
    if source and source.startswith("HTTP/"):
        own.append(("source-http-status", _folded(source.splitlines()[0])))
        source = source.partition("\n")[2]
    own += [(f"source-header-{k.lower()}", v) for k, v in heads(source or "")]
    out = []
    text, found = read(page or "")
    for kind, content, block in (("metadata", "application/warc-fields", metadata_block([*own, *found])), ("conversion", "text/plain; charset=utf-8", text)):
        raw = block.encode("utf-8", "replace")
        block_digest = digest(raw)
        name = f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{kind} {record_id} {block_digest}'.encode('utf-8', 'replace')).digest()[:16], version=5)}>"
        head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", record_id), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
        head += [("WARC-Block-Digest", block_digest), ("WARC-Payload-Digest", block_digest), ("Content-Type", content), ("Content-Length", str(len(raw)))]
        out.append((kind, name, content, len(raw), block_digest, source_digest, block, serialise(head, raw)))
    return out


def derivatives(
    responses: DataFrame,
    payload: str = "html",
    uri: str = "url",
    record_id: str = "record_id",
    date: str | None = "date",
    headers: str | None = "headers",
    payload_digest: str | None = None,
    payload_length: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Two rows for each response: the ``keep`` columns and those of ``OUTPUTS``; ``record`` is the bytes for a WARC file."""
    fields = [f"_f{i}" for i in range(len(keep))]
    own = lambda c, kind="string": F.col(c).cast(kind) if c else F.lit(None).cast(kind)
    inputs = {"_page": own(payload), "_uri": own(uri), "_record": own(record_id), "_date": own(date), "_headers": own(headers), "_digest": own(payload_digest), "_length": own(payload_length, "long")}
    base = responses.select(*(F.col(k).alias(f) for k, f in zip(keep, fields, strict=True)), *(c.alias(n) for n, c in inputs.items()))

    names = list(inputs)

    def build(batches):
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                rows = list(zip(*(part.column(k).to_pylist() for k in names), strict=True))
                made = [(r[2], r[1], r[3], *d) for r in rows for d in derive(*r)]
                refers, target, when, kind, name, content, size, block_digest, source_digest, block, record = zip(*made, strict=True)
                twice = pa.array([i for i in range(len(part)) for _ in range(2)])
                texts = lambda *xs: [pa.array(x, pa.string()) for x in xs]
                columns = [*texts(kind, name, refers, target, when, content), pa.array(size, pa.int64()), *texts(block_digest, source_digest, block), pa.array(record, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(f).take(twice) for f in fields), *columns], names=[*fields, *OUTPUTS])

    schema = "".join(f"{f} {base.schema[f].dataType.simpleString()}, " for f in fields)
    kinds = {"content_length": "long", "record": "binary"}
    out = base.mapInArrow(build, schema + ", ".join(f"{c} {kinds.get(c, 'string')}" for c in OUTPUTS))
    return out.select(*(F.col(f).alias(k) for k, f in zip(keep, fields, strict=True)), *OUTPUTS)


OUTPUTS = ("record_type", "warc_record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_digest", "block", "record")


def response_id(*columns: str):
    """A record id for tables that have none: a UUID of the given columns."""
    h = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
