"""WARC records: responses, and derivatives (metadata and plain-text conversions) that refer to them."""

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

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .markup import Tags, unescape

VERSION = b"WARC/1.1"
#: All records of a derivative get the date that the caller gives; pages carry none.
DATE = "1970-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "page_id long, record_id string, record_type string, target_uri string, date string, content_type string, refers_to string, block_digest string, payload_digest string, headers array<struct<name:string,value:string>>, block binary"

# Element names as HTML defines them.
HIDDEN = frozenset("script style noscript template head".split())
INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s samp small span strong sub sup tt u var".split())
#: Encodings that Python knows and no page has; some take quadratic time.
NOT_TEXT = frozenset("idna punycode undefined unicode_escape raw_unicode_escape utf_7 mbcs oem".split())

_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(r"charset=[\"']?([\w-]+)")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    """The same name for the same content, so that a task run again writes the same records."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(chr(0).join((kind, *parts)).encode()).digest(), version=5)}>"


def read_page(source: str) -> tuple[str, str, list[str]]:
    """(text, title, links): all visible text, one line per block, white space collapsed; the first title; the distinct link targets. Character references are decoded."""
    tags, parts, links, at = Tags(source), [], {}, 0
    title: str | None = None
    while found := tags.next():
        start, ends, tag, attributes = found
        parts.append(source[at:start])
        at = tags.at
        if tag in ("a", "area") and not ends and (m := _HREF.search(attributes)):
            links[unescape(m[1] or m[2] or m[3] or "")] = None
        if tag in INLINE:
            continue
        parts.append("\n")
        if tag == "title" and not ends and title is None:
            title = _inside(source, at, "title") or ""
        if tag in HIDDEN and not ends:
            tags.skip(tag)
            if tag == "head" and title is None:
                title = _title(source[at : tags.at])
            at = tags.at
    parts.append(source[at:])
    text = unescape("".join(parts))
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x), unescape(title or ""), list(links)


def _inside(source: str, at: int, tag: str) -> str | None:
    m = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
    return source[at : m.start()] if m else None


def _title(head: str) -> str | None:
    tags = Tags(head)
    while found := tags.next():
        if found[2] == "title" and not found[1]:
            return _inside(head, tags.at, "title")
    return None


def plain_text(source: str) -> str:
    """All visible text, one line per block, white space collapsed, character references decoded."""
    return read_page(source)[0]


def fields(lines: dict[str, str | list[str]]) -> bytes:
    """application/warc-fields: a line per value; line breaks in values become spaces."""
    out = []
    for name, values in lines.items():
        for value in values if isinstance(values, list) else [values]:
            out.append(f"{name}: {' '.join(value.split())}\r\n")
    return "".join(out).encode(errors="replace")


def response(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> dict:
    """The response record of a page; a null page is an empty payload, a null url has no target."""
    payload = (page or "").encode()
    block = HTTP_HEAD + payload
    return {"page_id": page_id, "record_id": record_id("response", str(page_id), url or "", digest(payload)), "record_type": "response", "target_uri": url, "date": date, "content_type": "application/http; msgtype=response", "refers_to": None, "block_digest": digest(block), "payload_digest": digest(payload), "headers": [], "block": block}


def split_http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers in order, repeated ones too, names lower-cased and folded lines joined; payload) of an HTTP response; a block without a head is all payload."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return [], block
    out: list[tuple[str, str]] = []
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif colon:
            out.append((name.strip().lower(), value.strip()))
    return out, payload


def _chunks(payload: bytes) -> bytes:
    """A chunked body put together, as far as it goes; what isn't chunked stays."""
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        size = payload[at:end].partition(b";")[0].strip() if 0 <= end <= at + 64 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return b"".join(out) if out else payload
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def body_of(head: list[tuple[str, str]], payload: bytes) -> tuple[bytes, str | None]:
    """(body, None) with transfer and content encodings undone, a cut body as far as it goes; (b"", encoding) where one isn't known or doesn't fit."""
    named = {k: v.lower() for k, v in head}
    if "chunked" in named.get("transfer-encoding", ""):
        payload = _chunks(payload)
    for coding in reversed([c.strip() for c in named.get("content-encoding", "").split(",")]):
        if coding in ("", "identity"):
            continue
        try:
            if coding in ("gzip", "x-gzip"):
                payload = zlib.decompressobj(31).decompress(payload)
            elif coding == "deflate":
                payload = zlib.decompressobj(15 if payload[:1] == b"\x78" else -15).decompress(payload)
            else:
                return b"", coding
        except zlib.error:
            return b"", coding
    return payload, None


def decoded(payload: bytes, content_type: str) -> str:
    """The text of a body in its declared charset, in UTF-8 where that isn't known; what doesn't fit becomes U+FFFD."""
    charset = _CHARSET.search(content_type)
    try:
        found = codecs.lookup(charset[1] if charset else "utf-8")
        name = "utf-8" if found.name.replace("-", "_") in NOT_TEXT else found.name
        return payload.decode(name, errors="replace")
    except (LookupError, UnicodeError, ValueError):
        return payload.decode("utf-8", errors="replace")


def derive(source: dict) -> list[dict]:
    """The metadata and the conversion record of a response.

    Both refer to the response's id, target and date and keep its payload digest; the metadata block has the title,
    outgoing links and source headers, the conversion block the plain text. Chunked, gzip and deflate bodies are undone; of
    other encodings the text is empty and the metadata say so.
    """
    head, payload = split_http(source["block"])
    content_type = next((v for k, v in head if k == "content-type"), "")
    body, unread = body_of(head, payload)
    text, title, links = read_page(decoded(body, content_type))
    kept = [("WARC-Refers-To-Target-URI", source["target_uri"]), ("WARC-Refers-To-Date", source["date"]), *((f"WARC-Source-{k.title()}", v) for k, v in head)]
    kept = [(k, v) for k, v in kept if v is not None]
    lines = {"title": title, "outlink": links, "source-payload-digest": source["payload_digest"] or digest(payload)}
    for k, v in head:
        lines.setdefault(f"source-{k}", []).append(v)
    if unread:
        lines["unread-content-encoding"] = unread
    blocks = (("metadata", "application/warc-fields", fields(lines)), ("conversion", "text/plain; charset=utf-8", text.encode(errors="replace")))
    return [
        {"page_id": source["page_id"], "record_id": record_id(kind, source["record_id"] or ""), "record_type": kind, "target_uri": source["target_uri"], "date": source["date"], "content_type": mime, "refers_to": source["record_id"], "block_digest": digest(block), "payload_digest": source["payload_digest"], "headers": kept, "block": block}
        for kind, mime, block in blocks
    ]


def to_bytes(record: dict, *, compress: bool = False) -> bytes:
    """A record in the file format; ``compress`` makes a gzip member of it."""
    refers = "WARC-Concurrent-To" if record["record_type"] == "request" else "WARC-Refers-To"
    named = [("WARC-Type", record["record_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["date"]), ("WARC-Target-URI", record["target_uri"]), (refers, record["refers_to"]), ("WARC-Block-Digest", record["block_digest"]), ("WARC-Payload-Digest", record["payload_digest"]), ("Content-Type", record["content_type"])]
    named += record["headers"] or []
    head = b"".join(f"{k}: {' '.join(v.split())}\r\n".encode(errors="replace") for k, v in named if v is not None)
    data = VERSION + b"\r\n" + head + f"Content-Length: {len(record['block'])}\r\n\r\n".encode() + record["block"] + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


_NAMED = {"warc-record-id": "record_id", "warc-type": "record_type", "warc-target-uri": "target_uri", "warc-date": "date", "content-type": "content_type", "warc-refers-to": "refers_to", "warc-block-digest": "block_digest", "warc-payload-digest": "payload_digest"}


def parse(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of a file, plain or gzip members, read one by one.

    Headers keep their order and repeats, folded lines are joined. A record that is cut, by the end of the file, a broken
    gzip member or a length that isn't a number, comes as far as it goes with the header WARC-Truncated and ends the file.
    """
    start = stream.peek(2)[:2] if hasattr(stream, "peek") else b""
    if start == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)

    def line() -> bytes:
        try:
            return stream.readline()
        except (EOFError, OSError, zlib.error):
            return b""

    while True:
        head = line()
        while head in (b"\r\n", b"\n"):
            head = line()
        if not head.startswith(b"WARC/"):
            return
        lines: list[tuple[str, str]] = []
        while (text := line()).rstrip(b"\r\n"):
            name, _, value = text.decode("utf-8", errors="replace").partition(":")
            if text[:1] in (b" ", b"\t") and lines:
                lines[-1] = (lines[-1][0], f"{lines[-1][1]} {text.decode('utf-8', errors='replace').strip()}".strip())
            else:
                lines.append((name.strip(), value.strip()))
        record = dict.fromkeys(("page_id", *_NAMED.values())) | {"headers": [], "block": b""}
        size = -1 if not text else 0
        for name, value in lines:
            key = name.lower()
            if key == "content-length":
                size = int(value) if text and re.fullmatch(r"[0-9]{1,18}", value) else -1
            elif key in _NAMED and record[_NAMED[key]] is None:
                record[_NAMED[key]] = value
            else:
                record["headers"].append((name, value))
        got = bytearray()
        while len(got) < size:
            try:
                some = stream.read(min(size - len(got), 1 << 20))
            except (EOFError, OSError, zlib.error):
                some = b""
            if not some:
                break
            got += some
        record["block"] = bytes(got)
        if len(got) != size:
            record["headers"].append(("WARC-Truncated", "unspecified"))
        yield record
        if len(got) != size:
            return


_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_SCHEMA = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("record_id", "record_type", "target_uri", "date", "content_type", "refers_to", "block_digest", "payload_digest")), ("headers", _HEADERS), ("block", pa.binary())])


def _batch(records: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([r | {"headers": _named(r["headers"])} for r in records], schema=_SCHEMA)


def _named(headers: list[tuple[str, str]]) -> list[dict[str, str]]:
    return [{"name": k, "value": v} for k, v in headers]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files (plain or gzip), by Spark's binary file source; a file is read in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                some: list[dict] = []
                for record in parse(io.BufferedReader(io.BytesIO(content.as_buffer()))):
                    some.append(record)
                    if len(some) == 256:
                        yield _batch(some)
                        some = []
                yield _batch(some)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """A response record for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield _batch([response(*row, date) for row in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of all response records (other records have none).

    Null blocks are empty; repeated responses give repeated derivatives of the same ids; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = batch.slice(at, 128).to_pylist()
                yield _batch([d for r in rows for d in derive(r | {"block": bytes(r["block"] or b"")})])

    return records.filter("record_type = 'response'").mapInArrow(run, RECORD)


DERIVED = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, content_length long, block_digest string, payload_digest string, record_crc32 long, headers array<struct<name:string,value:string>>, block string"
_DERIVED = (pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.string(), pa.int64(), _HEADERS, pa.string())


def build_derivatives(pages: DataFrame, *, date: str = DATE) -> DataFrame:
    """Both derivatives of every page, as they stand in a file: page_id, record_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, payload_digest, record_crc32, headers, block (UTF-8 text in both).

    ``record_crc32`` is that of the record's bytes in the file format. Null html is an empty payload, null urls have no target; repeated
    pages give equal records; an empty table gives no rows.
    """
    names = [c.split()[0] for c in DERIVED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                made = [d for row in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True) for d in derive(response(*row, date))]
                made = [d | {"content_length": len(d["block"]), "record_crc32": zlib.crc32(to_bytes(d)), "headers": _named(d["headers"]), "block": d["block"].decode()} for d in made]
                yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in made], t) for c, t in zip(names, _DERIVED, strict=True)], names=names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, DERIVED)
