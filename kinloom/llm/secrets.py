"""Secret scans over nested encodings: a worklist of layers, decoded to a fixpoint.

The text itself is the first layer. Each layer is scanned, then every decoder that applies adds new layers: percent
escapes, Unicode escapes, base64 runs (whole, over line breaks, and the readable stretches in one at any alignment, as
a run may be glued to what stands before it), and what base64 wraps in gzip, zlib, bzip2, xz or zstandard, all members
of it, read as a stream in overlapping parts, so no layer is held whole and none is too large. A layer whose text is
that of a layer it comes from is not taken again, nor is the same text over the same place, which ends cycles; copies
of an encoded text in other places are layers of their own. Every layer maps its characters to spans of the original
text, so that a find in any depth has a place there.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import gzip
import hashlib
import io
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm.bpe import batches

#: Bytes of an unpacked stream that are one layer, and how many the next one repeats; a secret's end that tells it apart lies within these.
PART, OVERLAP = 4 << 20, 64 << 10

#: Kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

PERCENT = re.compile("(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{19,}={0,2}")

#: A line break in base64 and the line after it, up to where it ends or a mark closes it.
WRAP = re.compile(r"""[\x20\t]*\r?\n[\x20\t]*([A-Za-z0-9+/_-]+={0,2})(?=[\x20\t]*(?:\r?\n|\Z)|["'<,;)\]}\\])""")

#: Base64 of what gzip, bzip2, xz and zstandard begin with.
PACKED = re.compile("H4sI|QlpoO|/Td6WFoA|KLUv/")

#: What stands readable in bytes; the shortest find has 14.
READABLE = re.compile(rb"[\x20-\x7e\t\r\n]{14,}")

Span = tuple[str, int, int]


def scan_plain(text: str) -> list[Span]:
    """The base kinds in one text, by start and then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _longest(text) >= 32:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _longest(text: str) -> int:
    return max(map(len, text.split()), default=0)


class Layer:
    """A text and, for each of its characters, the span of the original that it stands for (None: itself), or one ``span`` for all."""

    __slots__ = ("depth", "ends", "name", "parent", "span", "starts", "text")

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, span: tuple[int, int] | None = None, parent: Layer | None = None) -> None:
        self.text, self.starts, self.ends, self.span, self.parent = text, starts, ends, span, parent
        self.depth = parent.depth + 1 if parent else 0
        self.name = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def place(self) -> tuple[bytes, bytes]:
        """Digests of the text and of where its characters stand."""
        where = repr(self.span).encode() if self.starts is None else self.starts.tobytes() + self.ends.tobytes()
        return self.name, hashlib.blake2b(where, digest_size=16).digest()

    def cyclic(self) -> bool:
        above = self.parent
        while above is not None and above.name != self.name:
            above = above.parent
        return above is not None

    def original(self, start: int, end: int) -> tuple[int, int]:
        return self.span or ((start, end) if self.starts is None else (int(self.starts[start]), int(self.ends[end - 1])))

    def child(self, text: str, starts: np.ndarray, ends: np.ndarray) -> Layer:
        """A layer whose characters stand for spans ``[starts, ends)`` of this one."""
        if self.span:
            return Layer(text, span=self.span, parent=self)
        if self.starts is not None:
            starts, ends = self.starts[starts], self.ends[ends - 1]
        return Layer(text, starts, ends, parent=self)

    def whole(self, text: str, start: int, end: int) -> Layer:
        """A layer whose characters all stand for ``[start, end)`` of this one."""
        return Layer(text, span=self.original(start, end), parent=self)


def _replaced(layer: Layer, parts: list[tuple[int, int, str]]) -> Layer:
    """The layer with stretches replaced; each new character stands for its whole stretch."""
    texts, starts, ends, at = [], [], [], 0
    for begin, end, text in [*parts, (len(layer.text), len(layer.text), "")]:
        plain = np.arange(at, begin)
        texts += [layer.text[at:begin], text]
        starts += [plain, np.full(len(text), begin)]
        ends += [plain + 1, np.full(len(text), end)]
        at = end
    return layer.child("".join(texts), np.concatenate(starts), np.concatenate(ends))


def _percent(layer: Layer) -> Iterator[Layer]:
    """The layer with percent escapes decoded; bytes that are no UTF-8 stay as they are."""
    if "%" not in layer.text:
        return
    parts = []
    for m in PERCENT.finditer(layer.text):
        at = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            raw = "\udc80" <= c <= "\udcff"
            width = 3 if raw else 3 * len(c.encode())
            if not raw:
                parts.append((at, at + width, c))
            at += width
    if parts:
        yield _replaced(layer, parts)


def _escapes(layer: Layer) -> Iterator[Layer]:
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    parts = []
    for m in ESCAPE.finditer(layer.text):
        if m[1]:
            code = 0x10000 + (int(m[1], 16) - 0xD800 << 10) + int(m[2], 16) - 0xDC00
        else:
            code = int(m[8]) if m[8] else int(next(x for x in m.groups()[2:7] if x), 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            parts.append((m.start(), m.end(), chr(code)))
    if parts:
        yield _replaced(layer, parts)


class _Once(io.RawIOBase):
    """A file that gives what one read gives, so an error does not take what came before it."""

    def __init__(self, file) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        out = self.file.read1(len(buffer))
        buffer[: len(out)] = out
        return len(out)


class _Zlib(io.RawIOBase):
    """A zlib stream as a file."""

    def __init__(self, file: io.BufferedReader) -> None:
        self.file, self.tool, self.left = file, zlib.decompressobj(), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.tool.eof:
            data = self.left or self.file.read(1 << 14)
            if not data:
                return 0
            out = self.tool.decompress(data, len(buffer))
            self.left = self.tool.unconsumed_tail
            if out:
                buffer[: len(out)] = out
                return len(out)
        return 0


def _reader(file: io.BufferedReader, head: bytes) -> io.RawIOBase | None:
    """What decompresses a file that begins with ``head``, all of its members; None if nothing does."""
    if head[:2] == b"\x1f\x8b":
        return _Once(gzip.GzipFile(fileobj=file))
    if head[:3] == b"BZh":
        return _Once(bz2.BZ2File(file))
    if head[:6] == b"\xfd7zXZ\x00":
        return _Once(lzma.LZMAFile(file))
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return _Once(zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True))
    if len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return _Zlib(file)
    return None


def _read(file: io.BufferedReader, most: int, peek: bool = False) -> bytes:
    """Up to ``most`` bytes; what comes before an error in the stream counts."""
    out = b""
    try:
        while len(out) < most and (data := file.peek(1) if peek else file.read1(most - len(out))):
            out += data
            if peek:
                break
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        pass
    except Exception as error:
        if type(error).__name__ != "ZstdError":
            raise
    return out


def _opened(raw: bytes, depth: int) -> io.BufferedReader:
    """``raw`` behind as many decompressions."""
    file = io.BufferedReader(io.BytesIO(raw), 1 << 16)
    for _ in range(depth):
        inner = _reader(file, _read(file, 8, peek=True))
        file = io.BufferedReader(inner, 1 << 16)
    return file


def _unpacked(raw: bytes) -> Iterator[str]:
    """Texts of what ``raw`` wraps in compression, in overlapping parts if it is large; none if it wraps nothing."""
    depth, seen = 0, set()
    while (head := _read(_opened(raw, depth), 1 << 16, peek=True)) and head not in seen:
        seen.add(head)  # what unpacks to itself does so for ever
        if _reader(io.BufferedReader(io.BytesIO(head)), head) is None or not _read(_opened(raw, depth + 1), 1, peek=True):
            break
        depth += 1
    if not depth:
        return
    file, decoder, tail = _opened(raw, depth), None, ""
    while part := _read(file, PART):
        if decoder is None and len(part) < PART:
            if (text := _text(part)) is not None:
                yield text
            return
        decoder = decoder or codecs.getincrementaldecoder("utf-8")("replace")
        text = tail + decoder.decode(part)
        if _readable(text):
            yield text
        tail = text[-OVERLAP:]


def _readable(text: str) -> bool:
    return bool(text) and sum(c.isprintable() or c in "\n\r\t" for c in text) >= 0.9 * len(text)


def _text(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if _readable(text) else None


def _bytes(run: str) -> bytes | None:
    body = run.rstrip("=")
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4)) if len(body) % 4 != 1 else None
    except (binascii.Error, ValueError):
        return None


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Spans of base64: every unbroken run, and runs that go on over line breaks, with and without their last line."""
    done = 0
    for m in BASE64.finditer(text):
        yield [m.span()]
        if m.start() < done:
            continue
        lines = [m.span()]
        while lines[-1][1] - lines[-1][0] >= 19 and text[lines[-1][1] - 1] != "=" and (more := WRAP.match(text, lines[-1][1])):
            lines.append(more.span(1))
        done = lines[-1][1]
        if len(lines) > 1:
            yield lines
        if len(lines) > 2:
            yield lines[:-1]


def _base64(layer: Layer) -> Iterator[Layer]:
    if _longest(layer.text) < 19:
        return
    for lines in _runs(layer.text):
        run = "".join(layer.text[a:b] for a, b in lines)
        places = np.concatenate([np.arange(a, b) for a, b in lines])
        start, end, whole = lines[0][0], lines[-1][1], False
        for m in [None, *PACKED.finditer(run, 1)]:  # from its start, and from where something packed may be glued to it
            raw = _bytes(run[m.start() :] if m else run)
            for text in _unpacked(raw) if raw else ():
                whole = True
                yield layer.whole(text, int(places[m.start()]) if m else start, end)
        if whole:
            continue
        if (raw := _bytes(run)) and (text := _text(raw)) is not None:
            # three bytes stand for four characters
            after = np.cumsum(np.fromiter((len(c.encode()) for c in text), np.int64, len(text)))
            before = np.append(0, after[:-1])
            yield layer.child(text, places[before // 3 * 4], places[np.minimum(-(-after // 3) * 4, len(run)) - 1] + 1)
            continue
        for skip in range(4):
            own = run[skip:].rstrip("=")
            for m in READABLE.finditer(_bytes(own[: len(own) - (len(own) % 4 == 1)]) or b""):
                at = np.arange(m.start(), m.end())
                yield layer.child(m[0].decode(), places[skip + at // 3 * 4], places[np.minimum(skip + -(-(at + 1) // 3) * 4, len(run)) - 1] + 1)


def _inner(layer: Layer) -> Iterator[Layer]:
    for decode in (_percent, _escapes, _base64):
        yield from decode(layer)


def scan(text: str) -> tuple[list[tuple[str, int, int, int]], int]:
    """Finds as ``(kind, start, end, depth)``, depth 0 being the text itself, and the number of layers decoded."""
    work: list[Iterator[Layer]] = [iter([Layer(text)])]
    seen: set[tuple[bytes, bytes]] = set()
    found: dict[Span, int] = {}
    layers = -1
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif not layer.cyclic() and (place := layer.place()) not in seen:
            seen.add(place)
            layers += 1
            for kind, start, end in scan_plain(layer.text):
                span = (kind, *layer.original(start, end))
                found[span] = min(found.get(span, layer.depth), layer.depth)
            work.append(_inner(layer))
    order = sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [(*s, found[s]) for s in order], layers


FINDING = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("depth", T.IntegerType())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, findings`` (array of ``kind, start, end, depth`` in code points of the text), and ``layers``.

    One row per row of ``docs``, whatever its id; a null text counts as empty. Finds of inner layers that fall on
    the span of an outer find of the same kind are the same find. Other columns are not carried.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())])
        for batch, texts in batches(stream):
            found = [scan(t) for t in texts]
            rows = [[dict(zip(("kind", "start", "end", "depth"), f, strict=True)) for f in x[0]] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind)), pa.array([x[1] for x in found], pa.int32())], schema.names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("findings", FINDING), T.StructField("layers", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def redacted(text: str) -> str:
    """The text with every find, of whatever depth, replaced by ``[kind]``; overlapping finds become one."""
    spans, out, at = scan(text)[0], [], 0
    merged: list[list] = []
    for kind, start, end, _ in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in the text; all rows and columns stay, a null text stays null."""
    at = docs.columns.index(text_col)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(stream, at):
            valid = batch.column(at).is_valid().to_pylist()
            new = pa.array([redacted(t) if v else None for t, v in zip(texts, valid, strict=True)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
