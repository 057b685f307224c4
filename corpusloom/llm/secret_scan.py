r"""Secret scans with a recursive decoding worklist.

Every text is scanned as it is. Then URL escapes, Unicode escapes, base64 runs and compressed data found in it
are unwrapped into new layers, which are scanned and unwrapped in turn until nothing new appears. A layer
that was seen before is not entered again, so a cycle ends. Each layer knows which span of the original text
each of its characters comes from, and findings are reported as spans of the original.

The base kinds, leftmost and non-overlapping per kind, are ``assign`` (a password, passwd, secret, token or
api key that is given a value of six characters or more), ``access`` (AKIA and what follows, 20 characters or
more) and ``hex`` (24 hex digits or more). What only a decoded layer shows is reported as ``decoded_`` + kind.

Packed data that has a mark but does not open to its end is not passed over: what opens is scanned, and the data's span is reported as ``closed``.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import io
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate([*BASE, *("decoded_" + k for k in BASE)])}

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
LINE_END = re.compile(r"\r?\n[ \t]*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
SHORTEST = 12  # characters of the shortest finding
PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{%d,}" % SHORTEST)
WIDE = re.compile(rb"(\x00?)((?:[\t\n\r\x20-\x7e]\x00){%d,}[\t\n\r\x20-\x7e])(\x00?)" % (SHORTEST - 1))  # two bytes a character, in either order
ZLIB = [bytes([c, f]) for c in range(0x08, 0x80, 0x10) for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 0x20]
ZSTD, BZIP, XZ = b"\x28\xb5\x2f\xfd", b"BZh", b"\xfd7zXZ\x00"
PACKED = re.compile(b"|".join([*map(re.escape, [b"\x1f\x8b\x08", ZSTD, XZ, *ZLIB]), rb"BZh[1-9]1AY&SY"]))
SURE = re.compile(rb"(?s)\x1f\x8b\x08[\x00-\x1f].{4}[\x00\x02\x04][\x00-\x0d\xff]|" + b"|".join(map(re.escape, [ZSTD, XZ, BZIP])))  # hardly by chance
UNPRINTABLE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd]")
IN_RUN = "".join(map(chr, range(33, 127))) + "\r\n"
BLOCK, OVERLAP, STEP = 8 << 20, 4096, 1024
LONGEST = 8 * BLOCK  # characters of one run that are carried over block borders


class Span(NamedTuple):
    start: int
    end: int
    kind: str


class Run(NamedTuple):
    """Characters of a layer from ``at`` on: as in the original from ``start`` on, or all made of start..end."""

    at: int
    start: int
    end: int
    plain: bool


class Layer:
    """A text and the runs that say where its characters come from."""

    def __init__(self, text: str, runs: list[Run]):
        self.text, self.runs, self.ats = text, runs, [r.at for r in runs]

    def original(self, start: int, end: int) -> tuple[int, int]:
        a, b = self.runs[bisect_right(self.ats, start) - 1], self.runs[bisect_right(self.ats, end - 1) - 1]
        return a.start + start - a.at if a.plain else a.start, b.start + end - b.at if b.plain else b.end


def findings(text: str) -> Iterator[Span]:
    """The base kinds in one layer."""
    for m in ASSIGN.finditer(text) if "=" in text or ":" in text else ():
        if m.end(2) - m.start(2) >= 6:
            yield Span(*m.span(), "assign")
    for m in ACCESS.finditer(text):
        yield Span(*m.span(), "access")
    for m in HEX.finditer(text):
        yield Span(*m.span(), "hex")


def _url(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _unicode(run: str) -> str:
    points = [int(m[5]) if m[5] else int(next(g for g in m.groups() if g), 16) for m in ONE_UNICODE.finditer(run)]
    units = "".join(chr(p) if p <= 0x10FFFF else "\ufffd" for p in points).encode("utf-16", "surrogatepass")
    return units.decode("utf-16", "replace")


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match of pattern decoded in place. Text and runs are gone through once."""
    parts, runs, at, size, k = [], [], 0, 0, 0
    stops = [*layer.ats[1:], len(layer.text)]

    def copy(until: int) -> None:
        nonlocal size, k
        while k < len(stops):
            r = layer.runs[k]
            if (a := max(at, r.at)) < (b := min(until, stops[k])):
                runs.append(Run(size + a - at, r.start + a - r.at if r.plain else r.start, r.end, r.plain))
            if stops[k] > until:
                break
            k += 1
        parts.append(layer.text[at:until])
        size += until - at

    for m in pattern.finditer(layer.text):
        if not (made := decode(m[0])):
            continue
        copy(m.start())
        runs.append(Run(size, *layer.original(*m.span()), False))
        parts.append(made)
        size, at = size + len(made), m.end()
    if not at:
        return None
    copy(len(layer.text))
    return Layer("".join(parts), runs)


class Closed(Exception):
    """Packed data that does not open to its end: it is damaged, cut off, or asks for more memory than it gets."""


class _Pieces(io.BytesIO):
    """Bytes that are read STEP at a time, and from ``careful`` on one by one."""

    careful = 1 << 62

    def read(self, size: int = -1) -> bytes:
        return super().read(STEP if self.tell() < self.careful else 1)


def _zstandard(raw: memoryview) -> Iterator[bytes]:
    """What zstandard frames hold, by the codec of Arrow, which Spark's Python workers have."""
    source, got = _Pieces(raw), 0
    try:
        stream = pa.CompressedInputStream(pa.PythonFile(source, "r"), "zstd")
        while made := stream.read(STEP):
            got += len(made)
            yield made
        return
    except OSError:
        again = _Pieces(raw)
        again.careful = source.tell() - STEP
    stream = pa.CompressedInputStream(pa.PythonFile(again, "r"), "zstd")  # once more, byte by byte to where it fails
    for k in range(0, got, STEP):
        stream.read(min(STEP, got - k))
    try:
        while made := stream.read(1):
            got += 1
            yield made
    except OSError as error:
        if not got or "frame descriptor" not in str(error):  # else a frame is over and what follows is none
            raise Closed from error


def _inflated(raw: memoryview) -> Iterator[bytes]:
    """What the zlib, gzip (all members), zstandard, bzip2, xz or bare deflated data at the start of raw holds, in blocks of bounded size.

    Raises Closed behind what opens of data that has a mark but does not open to its end, as when xz data asks for over 256 MB or
    zstandard data for over 128 MB. Bare deflated data has no mark, so where it does not open it was none.
    """
    if raw[:4] == ZSTD:
        yield from _zstandard(raw)
        return
    marked = bool(PACKED.match(raw))
    if raw[:3] == BZIP:
        new = bz2.BZ2Decompressor
    elif raw[:6] == XZ:
        new = lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=1 << 28)
    else:
        new = lambda: zlib.decompressobj(47 if marked else -15)
    failures = zlib.error, lzma.LZMAError, OSError, EOFError
    at = 0
    while True:
        begin, machine = at, new()
        while at < len(raw) and not machine.eof:
            try:
                yield machine.decompress(raw[at : at + STEP])
            except failures as error:
                if not marked:
                    return
                machine = new()
                for k in range(begin, at, STEP):
                    machine.decompress(raw[k : k + STEP])
                try:
                    for k in range(at, at + STEP):  # byte by byte to where it fails
                        yield machine.decompress(raw[k : k + 1])
                except failures:
                    raise Closed from error
            at = min(at + STEP, len(raw))
        if not machine.eof:
            if marked:
                raise Closed
            return
        at -= len(machine.unused_data)
        if raw[at : at + 2] != b"\x1f\x8b":
            return
        marked, new = True, lambda: zlib.decompressobj(47)


def _unpacked(raw: memoryview) -> Iterator[str]:
    """The texts of packed data. Each holds the end of the one before it: 4096 characters, and all of a run
    that is not finished there, up to 64 MB. Raises Closed behind what opens of data that does not open to its end."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    parts, size, carry, failure = [], 0, "", None
    blocks = _inflated(raw)
    while True:
        try:
            block = next(blocks, None)
        except Closed as error:
            block, failure = None, error
        if block is None:
            break
        parts.append(decode(block))
        size += len(parts[-1])
        if size < BLOCK:
            continue
        text = carry + "".join(parts)
        parts, size = [], 0
        start = len(text.rstrip(IN_RUN))
        if start or len(text) > LONGEST:
            yield text
            carry = text[max(min(start, len(text) - OVERLAP), len(text) - LONGEST, 0) :] if len(text) - start <= LONGEST else text[-OVERLAP:]
        else:
            carry = text
    if (text := carry + "".join(parts) + decode(b"", True)) and len(text) >= SHORTEST:
        yield text
    if failure:
        raise failure


def _base64(layer: Layer, m: re.Match, line: bool = False) -> Iterator[Layer | Span]:
    """The texts in a base64 run, which may be wrapped into lines and begin or end with characters of other things.

    The run is decoded from each of its first four characters. Printable stretches and what packed data
    holds are kept wherever they begin in the bytes; a run that is one text is a layer as a whole. Packed data that does not open
    to its end is a span ``closed``; where its mark may stand there by chance, as that of zlib data, only if what opens of it is text. A line of a longer run (``line``) may well be
    cut off and reports none.
    """
    run, lines, size = m[0].rstrip("="), [], 0
    at = 0
    for k in [*LINE_END.finditer(run), None]:
        end = k.start() if k else len(run)
        lines.append((size, m.start() + at, end - at))  # place in the joined run and in the layer, length
        size, at = size + end - at, k.end() if k else end
    joined = "".join(layer.text[p : p + n] for _, p, n in lines).replace("-", "+").replace("_", "/")

    def made_of(text: str, shift: int, i: int, j: int, each: bool) -> Layer:
        """A layer whose text comes from bytes i to j; with each, byte by byte, so that lines keep their places."""
        first, last, runs = shift + i * 8 // 6, shift + (j * 8 - 1) // 6 + 1, []
        for o, p, n in lines:
            u, v = max(first, o), min(last, o + n)
            if u < v:
                end = m.end() if v == len(joined) else p + v - o
                a, b = layer.original(p + u - o, end)
                to = max((u - shift) * 6 // 8 - i, 0)
                if runs and (not each or to == runs[-1].at):
                    runs[-1] = runs[-1]._replace(end=b)
                else:
                    runs.append(Run(to, a, b, False))
        return Layer(text, runs)

    for k, (_, p, n) in enumerate(lines if len(lines) > 1 else ()):  # a line may also be a run by itself
        if alone := BASE64.fullmatch(layer.text, p, m.end() if k + 1 == len(lines) else p + n):
            yield from _base64(layer, alone, True)
    for shift in range(4):
        part = joined[shift:]
        if len(part) < 16 and shift:
            break
        part = part[:-1] if len(part) % 4 == 1 else part
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        whole = None
        if not shift and len(lines) == 1:
            try:
                whole = raw.decode()
            except UnicodeDecodeError:
                pass
        if whole and not UNPRINTABLE.search(whole):
            yield made_of(whole, 0, 0, len(raw), False)
        else:
            for k in PRINTABLE.finditer(raw):
                yield made_of(k[0].decode("ascii"), shift, *k.span(), True)
            for k in WIDE.finditer(raw):
                larger_first = k[1] and not (k[3] and k.start() % 2)  # the character's zero stands before it
                i, j = (k.start(1), k.end(2)) if larger_first else (k.start(2), k.end(3))
                yield made_of(k[2][::2].decode("ascii"), shift, i, j, False)
            if not shift and not PACKED.match(raw):  # bare deflated data has no mark to be known by, so only whole runs are tried
                for text in _unpacked(memoryview(raw)):
                    yield made_of(text, 0, 0, len(raw), False)
        for k in PACKED.finditer(raw):
            text = ""
            try:
                for text in _unpacked(memoryview(raw)[k.start() :]):
                    yield made_of(text, shift, k.start(), len(raw), False)
            except Closed:
                if not line and (SURE.match(raw, k.start()) or len(set(text)) >= SHORTEST and not UNPRINTABLE.search(text)):
                    runs = made_of("", shift, k.start(), len(raw), False).runs
                    yield Span(runs[0].start, runs[-1].end, "closed")


def layers_under(layer: Layer) -> Iterator[Layer | Span]:
    """The layers one step below, and spans of the original that do not open to their end."""
    text = layer.text
    if "%" in text and (made := _rewritten(layer, URL, _url)) is not None:
        yield made
    if ("\\" in text or "&#" in text) and (made := _rewritten(layer, UNICODE, _unicode)) is not None:
        yield made
    for m in BASE64.finditer(text):
        yield from _base64(layer, m)


def scan_whole(text: str) -> tuple[list[Span], list[Span], list[Span]]:
    """The base spans of a text, those that only its decoded layers show, and those of packed data that does not open to its end, in order."""
    base = sorted(findings(text), key=lambda s: (s.start, ORDER[s.kind]))
    top = Layer(text, [Run(0, 0, len(text), True)])
    todo, seen, more, closed = deque([top]), set(), set(), set()
    while todo:
        for layer in layers_under(todo.popleft()):
            if isinstance(layer, Span):
                closed.add(layer)
                continue
            mark = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest() + repr(layer.runs[:1]).encode()
            if mark not in seen:
                seen.add(mark)
                more.update(Span(*layer.original(s.start, s.end), s.kind) for s in findings(layer.text))
                todo.append(layer)
    decoded = [s._replace(kind="decoded_" + s.kind) for s in more - set(base)]
    return base, sorted(decoded, key=lambda s: (s.start, ORDER[s.kind], s.end)), sorted(closed)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and those that only its decoded layers show, in order."""
    return scan_whole(text)[:2]


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by a mark that names its kind."""
    out, at = [], 0
    for s in sorted(spans):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.removeprefix('decoded_')}-secret>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<start:int,end:int,kind:string>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, decoded and closed (arrays of start, end, kind) for each row; code points, end exclusive.

    ``closed`` are the spans of packed data that does not open to its end, so secrets in it may be missing.

    Null text counts as empty; repeated rows are scanned one by one; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_whole(t or "") for t in batch.column("text").to_pylist()]
            spans = [pa.array([[s._asdict() for s in lists[k]] for lists in found], kind) for k in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *spans], names=["doc_id", "base", "decoded", "closed"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, base {SPANS}, decoded {SPANS}, closed {SPANS}")


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every secret in text_col replaced by a mark; null stays null and other columns stay as they are."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, [s for part in scan(t) for s in part]))

    return docs.withColumn(text_col, clean(F.col(text_col)))
