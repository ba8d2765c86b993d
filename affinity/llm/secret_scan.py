"""Secret scan with a recursive decoding worklist.

Every text is scanned as it stands; then encoded stretches of it (URL escapes,
Unicode escapes, base64, and zlib or gzip data inside base64) are unwrapped
one layer at a time.  Each decoded layer is scanned again and goes back on the
worklist until nothing new comes out; a layer whose text was seen on the same
document ends that branch, so cycles stop.  Findings in a layer are mapped back
to the code points of the document that they were decoded from.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII | re.IGNORECASE)
# Equal to the greedy run followed by a length test, as a run has one start.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# A whole run of the alphabet; runs over line breaks (also escaped or quoted ones) are one.
_BREAK = r"[\x20\t]*(?:\r\n?|\n|(?:\\r)?\\n)[\x20\t>]*"
_RUN = "[A-Za-z0-9+/_-]"
_BASE64 = re.compile(f"(?<!{_RUN})(?:{_RUN}++(?:{_BREAK}{_RUN}++)++|{_RUN}{{16,}}+)={{0,2}}")
_LINE = re.compile(f"({_RUN}+)(?:{_BREAK}|=*$)")
_CUT = re.compile("[+/_-]")
# The shortest secret has 12 characters (token=abcdef), all of them ASCII.
_ASCII = re.compile(rb"[\x00-\x7f]{12,}")
_PCT_UNIT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNI_UNIT = re.compile(r"(?:\\u(?:[0-9A-Fa-f]{4}|\{[0-9A-Fa-f]{1,6}\}))+")
_UNI_ONE = re.compile(r"\\u(?:([0-9A-Fa-f]{4})|\{([0-9A-Fa-f]{1,6})\})")

# ASCII as UTF-16 or UTF-32, with or without a byte order mark.
_WIDE = [(re.compile(rb"(?:[\x01-\x7f]\x00){12,}+"), 0, 2), (re.compile(rb"(?:\x00[\x01-\x7f]){12,}+"), 1, 2),
         (re.compile(rb"(?:[\x01-\x7f]\x00{3}){12,}+"), 0, 4), (re.compile(rb"(?:\x00{3}[\x01-\x7f]){12,}+"), 3, 4)]
# Heads of gzip and (with the usual window) zlib streams.
_HEAD = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
# Unpacked data is read in pieces and scanned in windows of about this size.
PIECE, WINDOW = 1 << 20, 1 << 24
# What no secret and no encoded stretch has inside: windows end behind one of these.
_APART = (*(bytes([c]) for c in b",;()<!|*#&$@~^`"), bytes(16))

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """(kind, start, end) of one layer: leftmost, non-overlapping per kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


class _Layer:
    """A decoded text; ``marks`` maps its offsets to spans of the document.

    marks: (offset, length, start, end): from ``offset`` on, ``length`` code
    points stand for [start, end) of the document.  Equal lengths map one to
    one, others as a whole.
    """

    def __init__(self, text: str, marks: list[tuple[int, int, int, int]]):
        self.text, self.marks = text, marks
        self.offsets = [m[0] for m in marks]

    def source(self, start: int, end: int) -> tuple[int, int]:
        first = self.marks[max(0, bisect.bisect_right(self.offsets, start) - 1)]
        last = self.marks[max(0, bisect.bisect_right(self.offsets, end - 1) - 1)]
        lo = first[2] + (start - first[0] if first[1] == first[3] - first[2] else 0)
        hi = last[2] + end - last[0] if last[1] == last[3] - last[2] else last[3]
        return lo, hi

    def unwrap(self, start: int, end: int, parts: list[tuple[str, int, int]]) -> _Layer:
        """The layer of ``parts`` (text, start, end) that replace [start, end) of this one."""
        marks, at = [], 0
        for text, s, e in parts:
            if not text:
                continue
            if text != self.text[s:e]:  # decoded: the stretch as a whole, never one to one
                marks.append((at, -1, *self.source(s, e)))
                at += len(text)
                continue
            k = max(0, bisect.bisect_right(self.offsets, s) - 1)
            while s < e:  # as it was: with the marks that it has
                stop = min(e, self.offsets[k + 1]) if k + 1 < len(self.offsets) else e
                offset, length, lo, hi = self.marks[k]
                marks.append((at, stop - s, lo + s - offset, lo + stop - offset) if length == hi - lo else (at, -1, lo, hi))
                at, s, k = at + stop - s, stop, k + 1
        return _Layer("".join(p[0] for p in parts), marks)


def _texts(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, start, end): the bytes as one text, or each stretch of them that may hold a secret."""
    try:
        yield data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8"), 0, len(data)
    except UnicodeDecodeError:
        for m in _ASCII.finditer(data):
            yield m[0].decode("ascii"), *m.span()
    if b"\0" in data:
        for form, first, step in _WIDE:
            for m in form.finditer(data):
                yield m[0][first::step].decode("ascii"), *m.span()


def _is_head(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0


class _Inflated:
    """What a zlib or gzip stream holds, in pieces: all members, one cut short as far as it goes."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.taken = chunks, 0  # taken: bytes of all that was read

    def __iter__(self) -> Iterator[bytes]:
        engine, fresh = zlib.decompressobj(47), True
        for rest in self.chunks:
            more = True
            while rest or more:
                if fresh and self.taken:  # members may be padded with zeros
                    self.taken, rest = self.taken + len(rest) - len(rest.lstrip(b"\0")), rest.lstrip(b"\0")
                    if not rest:
                        break
                try:
                    out = engine.decompress(rest, PIECE)
                except zlib.error:
                    return
                left = engine.unused_data if engine.eof else engine.unconsumed_tail
                self.taken, rest, more, fresh = self.taken + len(rest) - len(left), left, len(out) == PIECE, False
                if out:
                    yield out
                if engine.eof:
                    engine, more, fresh = zlib.decompressobj(47), False, True


def _from(chunks: Iterator[bytes], start: int) -> Iterator[bytes]:
    for chunk in chunks:
        if start < len(chunk):
            yield chunk[start:]
        start = max(0, start - len(chunk))


def _windows(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The chunks in windows that cut nothing apart; one grows as long as there is no place to cut."""
    held, size = [], 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size >= WINDOW and (at := max(chunk.rfind(c) + len(c) if c in chunk else 0 for c in _APART)):
            yield b"".join([*held[:-1], chunk[:at]])
            held, size = [chunk[at:]], len(chunk) - at
    yield b"".join(held)


Source = Callable[[], Iterator[bytes]]


def _packed(chunks: Source, heads: Iterable[int], seen: set[bytes]) -> Iterator[tuple[int, int, Iterator[str]]]:
    """(start, end, texts) of the compressed streams that start at ``heads``; no content twice."""
    done = 0
    for head in heads:
        if head < done:
            continue
        stream, digest, size = _Inflated(_from(chunks(), head)), hashlib.blake2b(), 0
        for piece in stream:
            digest.update(piece)
            size += len(piece)
        if size:
            done = head + stream.taken
            if digest.digest() not in seen:  # else a cycle, or nothing new
                seen.add(digest.digest())
                yield head, done, _unpacked(lambda head=head: iter(_Inflated(_from(chunks(), head))), seen)


def _unpacked(chunks: Source, seen: set[bytes]) -> Iterator[str]:
    """All texts of a stream of bytes and of the streams packed in it."""
    at, heads = 0, []
    for window in _windows(chunks()):
        for plain, _, _ in _texts(window):
            yield plain
        heads += [at + m.start() for m in _HEAD.finditer(window)]
        if not at and _is_head(window) and 0 not in heads:
            heads.insert(0, 0)
        at += len(window)
    for _, _, texts in _packed(chunks, heads, seen):
        yield from texts


def _units(text: str, unit: re.Pattern, decode) -> list[tuple[str, int, int]] | None:
    parts, at = [], 0
    for m in unit.finditer(text):
        parts += [(text[at:m.start()], at, m.start()), (decode(m[0]), *m.span())]
        at = m.end()
    return parts + [(text[at:], at, len(text))] if at else None


def _percent(run: str) -> str:
    return binascii.unhexlify(run.replace("%", "")).decode("utf-8", "replace")


def _escapes(run: str) -> str:
    units = [min(int(a or b, 16), 0x110000) for a, b in _UNI_ONE.findall(run)]
    return b"".join(u.to_bytes(2, "little") if u < 0x10000 else chr(u).encode("utf-16-le") if u < 0x110000 else b"\xfd\xff"
                    for u in units).decode("utf-16-le", "replace")


def _decoded(layer: _Layer) -> Iterator[_Layer]:
    text = layer.text
    # all escapes at once, in place: keys and values may stand on both sides of blanks
    for sign, unit, decode in (("%", _PCT_UNIT, _percent), ("\\u", _UNI_UNIT, _escapes)):
        if sign in text and (parts := _units(text, unit, decode)):
            yield layer.unwrap(0, len(text), parts)
    for m in _BASE64.finditer(text):
        for plain, start, end in _base64(text, *m.span()):
            yield layer.unwrap(start, end, [(plain, start, end)])


_URLSAFE = str.maketrans("-_", "+/")


def _base64(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of what a run of base64 characters decodes to.

    Words, paths or other lines may stand before the data and cannot be told
    from it, but they only shift it: one of four alignments decodes all of it.
    """
    lines = [m.span(1) for m in _LINE.finditer(text, start, end)]
    first = list(itertools.accumulate((e - s for s, e in lines), initial=0))  # of each line, in the body
    body = "".join(text[s:e] for s, e in lines)
    if len(body) < 16:
        return
    cuts = [*first[:-1], *(m.end() for m in _CUT.finditer(body))]
    body = body.translate(_URLSAFE)

    def place(at: int) -> int:
        k = bisect.bisect_right(first, at) - 1
        return lines[k][0] + at - first[k]

    for shift in range(4):
        rest = (len(body) - shift) % 4
        data = base64.b64decode(body[shift:len(body) - (rest == 1)] + "=" * (4 - rest if rest > 1 else 0))

        def span(lo: int, hi: int) -> tuple[int, int]:
            lo, hi = shift + lo // 3 * 4, shift + -(-hi // 3) * 4
            return place(lo), end if hi >= len(body) - (rest == 1) else place(hi - 1) + 1

        for plain, lo, hi in _texts(data):
            yield plain, *span(lo, hi)
        # compressed data starts the run, a line or what follows a separator; a usual head counts anywhere
        heads = {m.start() for m in _HEAD.finditer(data)}
        heads |= {at for c in cuts if c >= shift and (c - shift) % 4 == 0 and _is_head(data[(at := (c - shift) // 4 * 3):at + 3])}
        for lo, hi, texts in _packed(lambda data=data: iter([data]), sorted(heads), set()):
            for plain in texts:
                yield plain, *span(lo, hi)


def scan_recursive(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base, all): spans of the text itself, and with those of decoded layers."""
    text = text or ""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(scan(text), key=order)
    found, seen = set(base), set()
    work = [_decoded(_Layer(text, [(0, len(text), 0, len(text))]))]
    while work:
        layer = next(work[-1], None)  # one layer at a time is in memory per depth
        if layer is None:
            work.pop()
            continue
        key = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.source(0, len(layer.text)))
        if not layer.text or layer.text == text or key in seen:
            continue
        seen.add(key)
        found.update((kind, *layer.source(s, e)) for kind, s, e in scan(layer.text))
        work.append(_decoded(layer))
    return base, sorted(found, key=order)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every (merged) span replaced by a placeholder of its first kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= at:
            out += [text[at:start], f"<{kind}-secret>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, spans`` and ``base_spans``, both
    ARRAY<STRUCT<kind, start, end>> in code points (end exclusive), ordered by
    start, then kind.

    A null text counts as empty and has no spans.  Texts of any length are
    scanned whole.  Null, tied or repeated ids keep their rows; an empty table
    gives an empty result.  Only the two named columns are read, so extra
    columns cannot clash.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base_spans", span), ("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("kind", "start", "end")
        for batch in batches:
            both = [scan_recursive(t.as_py()) for t in batch.column(1)]
            cols = [pa.array([[dict(zip(keys, s)) for s in b[k]] for b in both], span) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], schema=schema)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = "array<struct<kind:string,start:long,end:long>>"
    return source.mapInArrow(run, f"doc_id long, base_spans {kind}, spans {kind}")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with all secrets replaced by placeholders.

    Texts without secrets (null ones too) stay as they are; ``n_chars`` follows
    the text where the column exists.  All rows and columns are kept.
    """
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            clean = [None if t is None else mask(t, spans) if (spans := scan_recursive(t)[1]) else t for t in texts]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))
    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*columns)


def digest(spans: DataFrame) -> DataFrame:
    """Counts, the base spans' SHA-256 and all spans as text, per document."""
    def text(c: str):
        return F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))))
    def number(k: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [number(k) for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(text("base_spans"), 256).alias("base_sha256"),
                        text("spans").alias("spans"))
