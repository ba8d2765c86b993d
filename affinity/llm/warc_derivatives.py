"""WARC derivative builder: responses to metadata and conversion records.

Each response record gives two records that refer to it: ``metadata``
(warc-fields with the source's headers, digests and the link to the converted
text) and ``conversion`` (its plain text).  Ids are derived from the source
id, so a rerun after a lost executor gives the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
# A tag's name ends at a blank, "/" or ">"; quoted attribute values may hold ">".
_END, _REST = r"(?=[\s/>]|\Z)", r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
_DROP = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template){_END}.*?(?:</\1{_END}[^>]*+>|\Z)")
_BLOCK = re.compile(r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|"
                    rf"header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul){_END}(?:{_REST}|[^<>]*>)")
_TAG = re.compile(rf"<[!/?a-zA-Z](?:{_REST}|[^<>]*>)")
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


class Record(NamedTuple):
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def render(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers)
        return f"WARC/1.1\r\n{head}\r\n".encode() + self.block + b"\r\n\r\n"


def parse_record(raw: bytes) -> Record:
    """One WARC record from its bytes; folded header lines are joined."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
    record = Record(headers, rest)
    size = record.get("Content-Length")
    return Record(headers, rest[:int(size)] if size and size.isdigit() else rest.removesuffix(b"\r\n\r\n"))


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def page_response(page_id, url: str | None, body: str | None, date: str = DATE) -> Record:
    """The response record of a crawled page."""
    payload = (body or "").encode("utf-8", "surrogatepass")
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
             ).encode() + payload
    return Record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "")),
                   ("WARC-Target-URI", _one_line(url or "")), ("WARC-Date", date),
                   ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)),
                   ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))], block)


def plain_text(markup: str) -> str:
    """Visible text: block elements end lines, blank lines and runs of blanks go."""
    text = _TAG.sub("", _BLOCK.sub("\n", _DROP.sub(" ", markup)))
    if "&" in text:
        text = html.unescape(text)
    return _LINES.sub("\n", _SPACE.sub(" ", text)).strip()


def _unchunked(body: bytes) -> bytes | None:
    """The content of a chunked body; None if it is not one (it was undone before, say)."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = body[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return None
        n, at = int(size, 16), line + 2
        if n == 0:
            return b"".join(out)
        out.append(body[at:at + n])
        if body[at + n:at + n + 2] != b"\r\n":
            return None
        at += n + 2


def _inflated(body: bytes, bits: int) -> bytes:
    """All members of a compressed body (what can be read of a cut one)."""
    out = []
    while body:
        stream = zlib.decompressobj(bits)
        out.append(stream.decompress(body))
        out.append(stream.flush())
        body = stream.unused_data.lstrip(b"\0")
        if bits != 31:
            break
    return b"".join(out)


def decoded_body(body: bytes, http: list[tuple[str, str]]) -> tuple[bytes, list[str], list[str]]:
    """(content, encodings undone, encodings left) of an HTTP body.

    Transfer codings are undone first, then content codings, the last one
    first.  gzip, deflate (zlib or raw), chunked and identity are known; the
    first other one, or one that the body does not have, ends it.
    """
    codings = []
    for name in ("content-encoding", "transfer-encoding"):
        codings += [c.strip().lower() for k, v in http if k.lower() == name for c in v.split(",") if c.strip()]
    undone: list[str] = []
    while codings:
        kind = codings[-1].removeprefix("x-")
        try:
            if kind == "chunked":
                content = _unchunked(body)
            elif kind == "gzip":
                content = _inflated(body, 31)
            elif kind == "deflate":
                try:
                    content = _inflated(body, 15)
                except zlib.error:
                    content = _inflated(body, -15)
            else:
                content = body if kind == "identity" else None
        except zlib.error:
            content = None
        if content is None and kind == "chunked":
            codings.pop()  # stored without it, as archives often do
            continue
        if content is None:
            break
        body = content
        undone.append(codings.pop())
    return body, undone, codings


def derive(source: Record) -> list[Record]:
    """The metadata and the conversion record of a response.

    The metadata block has the HTTP status and headers, every WARC header of
    the source (``warc-header-...``), digests, and the encodings that were
    undone before the conversion or could not be (``content-left-encoded``; the
    conversion then is empty, as the bytes are no text).
    """
    head, _, payload = source.block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    origin = source.get("WARC-Record-ID") or record_id("source", digest(source.block))
    uri, date = source.get("WARC-Target-URI") or "", source.get("WARC-Date") or DATE
    payload_digest = source.get("WARC-Payload-Digest") or digest(payload)
    block_digest = source.get("WARC-Block-Digest") or digest(source.block)
    http = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines if ":" in x)]
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    content, undone, left = decoded_body(payload, http)
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    try:
        markup = content.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        markup = content.decode("utf-8", "replace")
    text = b"" if left else plain_text(markup).encode("utf-8", "replace")
    coding = [(name, ", ".join(c)) for name, c in (("content-decoded", undone), ("content-left-encoded", left)) if c]
    ids = {t: record_id(t, origin) for t in ("metadata", "conversion")}
    fields = [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in http),
              *((f"warc-header-{k.lower()}", v) for k, v in source.headers), *coding,
              ("source-payload-digest", payload_digest), ("source-block-digest", block_digest),
              ("source-length", str(len(payload))), ("conversion-record-id", ids["conversion"]),
              ("conversion-block-digest", digest(text)), ("conversion-length", str(len(text)))]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode()),
              "conversion": ("text/plain; charset=utf-8", text)}
    out = []
    for kind, (content, block) in blocks.items():
        out.append(Record([("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Target-URI", uri),
                           ("WARC-Date", date), ("WARC-Refers-To", origin),
                           ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
                           ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Source-Block-Digest", block_digest),
                           ("WARC-Block-Digest", digest(block)), ("Content-Type", content),
                           ("Content-Length", str(len(block)))], block))
    return out


_COLUMNS = [("source_key", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
            ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()),
            ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()),
            ("source_payload_digest", pa.string()), ("source_block_digest", pa.string()), ("block", pa.string())]
_DDL = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in _COLUMNS)


def _rows(key, records: list[Record]) -> list[tuple]:
    return [(key, r.get("WARC-Type"), r.get("WARC-Record-ID"), r.get("WARC-Refers-To"), r.get("WARC-Target-URI"),
             r.get("WARC-Date"), r.get("Content-Type"), len(r.block), r.get("WARC-Block-Digest"),
             r.get("WARC-Source-Payload-Digest"), r.get("WARC-Source-Block-Digest"), r.block.decode("utf-8"))
            for r in records]


def _derived(df: DataFrame, source) -> DataFrame:
    schema = pa.schema(_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                record = source(key, *rest)
                if record is not None:
                    rows += _rows(key, derive(record))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return df.mapInArrow(run, _DDL)


def derive_pages(pages: DataFrame) -> DataFrame:
    """Derivatives of crawled pages (``page_id, url, html``): two rows per page.

    A null url is an empty target, a null or empty page an empty payload and an
    empty conversion.  Pages of any length are converted whole.  A repeated row
    gives the same records again (ids derive from page id and url); a null
    page_id stays null in ``source_key``.  An empty table gives an empty
    result.  Only the three named columns are read, so extra columns cannot
    clash.
    """
    return _derived(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")),
                    page_response)


def _response(key, raw: bytes | None) -> Record | None:
    record = parse_record(raw or b"")
    return record if (record.get("WARC-Type") or "").lower() == "response" else None


def derive_records(records: DataFrame, key_col: str = "key", raw_col: str = "raw") -> DataFrame:
    """Derivatives of raw WARC records (bytes); records of other types and nulls give none."""
    return _derived(records.select(F.col(key_col).cast("long"), F.col(raw_col).cast("binary")), _response)


def render(derived: DataFrame) -> DataFrame:
    """(source_key, record_type, record_id, raw): each derived row as WARC record bytes."""
    line = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "target_uri"),
            ("WARC-Date", "warc_date"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"),
            ("WARC-Refers-To-Date", "warc_date"), ("WARC-Source-Payload-Digest", "source_payload_digest"),
            ("WARC-Source-Block-Digest", "source_block_digest"), ("WARC-Block-Digest", "block_digest"),
            ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    head = F.concat(F.lit("WARC/1.1\r\n"), *[F.concat(F.lit(f"{n}: "), F.col(c).cast("string"), F.lit("\r\n")) for n, c in line])
    raw = F.concat(head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).cast("binary")
    return derived.select("source_key", "record_type", "record_id", raw.alias("raw"))
