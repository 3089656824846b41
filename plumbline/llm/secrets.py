"""Secret scans with a recursive decoding worklist.

Every whole text is scanned by three patterns. Then encoded layers are unwrapped until nothing new appears: URL
escapes, Unicode escapes (``\\\\uXXXX``, ``\\\\xXX``, numeric character references, full-width forms), base64 runs in
both alphabets, and compressed base64 payloads (gzip, zlib, bzip2, xz, zstandard). Each unwrapped layer is scanned by
the same patterns and put on the worklist itself; a layer whose text was seen before at the same place of the document
is not visited again, so cycles end; the worklist holds the layers above the present one and what is left of each. Every character of a layer carries the interval of the document it came from, so
spans found in any layer are reported in code points of the document.

Escapes are unwrapped in place, since a secret's name and value may be encoded apart. Base64 runs are decoded as they
stand and, where lines follow each other, continued over the line ends (also written as \\n), at all four alignments:
every stretch of text in the bytes becomes a layer of its own, whatever the run holds before and after it. So does UTF-16
text in the bytes. Compressed payloads are looked for in the bytes of base64 runs, at any place, and in bytes written as URL or
``\\\\xXX`` escapes: gzip, zlib, bzip2, xz and zstandard with all their members, and a run that is one raw deflate stream. All
characters of a payload map to the whole payload, so a layer below it keeps one interval and no places. Lines that each hold
base64 of their own are also read as one run, which may give a second, longer span where a value reaches the line's end.

A payload may hold tens of thousands of times its size. It is inflated twice, in pieces: once to see that it ends well, once
to read it in windows of ``WINDOW`` characters that overlap by ``OVERLAP``, each scanned and unwrapped like any layer;
windows equal to earlier ones are skipped. Memory holds one window a level, and nothing is left out: only an encoded run longer than the overlap
may be read in two parts where windows meet. A chain of escapes of the escape character itself is one step.

Null and empty texts have no spans. Rows are independent; repeated rows give repeated results. Equal spans found
in several layers are reported once. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, types as T

from plumbline.llm.texts import map_texts

KINDS = ("assign", "access", "hex")

#: Fixed patterns of the contract.
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """Base spans (kind, start, end): leftmost, non-overlapping within a kind, too short ones dropped."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


WINDOW, OVERLAP = 1 << 20, 1 << 16


class Layer:
    """Text and, for each of its characters, the interval of the document it stands for; ``flat`` if that is one for all."""

    __slots__ = ("text", "starts", "ends", "flat")

    def __init__(
        self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, flat: tuple[int, int] | None = None
    ) -> None:
        self.text, self.flat = text, flat
        if flat is None:
            self.starts = np.arange(len(text)) if starts is None else starts
            self.ends = np.arange(1, len(text) + 1) if ends is None else ends

    def interval(self, start: int, end: int) -> tuple[int, int]:
        return self.flat or (int(self.starts[start:end].min()), int(self.ends[start:end].max()))

    def mark(self) -> bytes:
        """Hash of the text and its place: the same payload may stand at several places of a document."""
        places = [repr(self.flat).encode()] if self.flat else [self.starts.tobytes(), self.ends.tobytes()]
        parts = (self.text.encode("utf-8", "surrogatepass"), *places)
        return b"".join(hashlib.blake2b(part, digest_size=16).digest() for part in parts)

    def part(self, text: str, first: np.ndarray, last: np.ndarray) -> Layer:
        """Text whose characters stand for the characters ``first`` to ``last`` of this layer."""
        if self.flat:
            return Layer(text, flat=self.flat)
        return Layer(text, self.starts[first], self.ends[last])

    def substituted(self, pattern: re.Pattern, decode: Callable[[re.Match], str | None]) -> Layer | None:
        """Layer with every decodable match replaced; a replacement maps to its whole match."""
        parts: list[str] = []
        starts: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        at = 0
        for match in pattern.finditer(self.text):
            new = decode(match)
            if new is None:
                continue
            parts += [self.text[at : match.start()], new]
            if not self.flat:
                low, high = self.interval(match.start(), match.end())
                starts += [self.starts[at : match.start()], np.full(len(new), low)]
                ends += [self.ends[at : match.start()], np.full(len(new), high)]
            at = match.end()
        if not at:
            return None
        parts.append(self.text[at:])
        if self.flat:
            return Layer("".join(parts), flat=self.flat)
        return Layer("".join(parts), np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]]))


#: One escaped character at a time where it can be, so that spans stay tight; multi-byte UTF-8 as one unit.
#: An escaped escape character, however often, becomes the character in one step.
URL = re.compile(
    r"%(?:25)+(?=[0-9A-Fa-f]{2})|%[0-7][0-9A-Fa-f]|%[Cc2-9DdEeFf][0-9A-Fa-f](?:%[89ABab][0-9A-Fa-f]){1,3}", re.ASCII
)
UNICODE = re.compile(
    r"\\(?:u005[Cc]|x5[Cc])+(?=[uUx])|&(?:amp;|#38;|#[xX]26;)+(?=#|(?:quot|amp|lt|gt|apos);)|"
    r"\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
    r"|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|amp|lt|gt|apos);|[！-～]"
)
ESCAPED = re.compile(r"\\(?:u005[Cc]|x5[Cc])+|&(?:amp;|#38;|#[xX]26;)+")
NAMED = {"quot": '"', "amp": "&", "lt": "<", "gt": ">", "apos": "'"}
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINE_END = r"[ \t]*+(?:\r?\n|\r|\\r\\n|\\n)[ \t>|#*]*+"
#: Runs continued on the next lines, each of which they fill.
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_LINE_END}[A-Za-z0-9+/_-]++)++={{0,2}}")
DIGITS = re.compile(r"[A-Za-z0-9+/_-]+")
LEAST_DIGITS = 16
#: What a text needs to have any encoded layer at all.
HINT = re.compile(
    r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&(?:#|quot|amp|lt|gt|apos)|[！-～]|[A-Za-z0-9+/_-]{16}"
    rf"|[A-Za-z0-9+/_-]{{4}}{_LINE_END}[A-Za-z0-9+/_-]{{4}}"
)
#: UTF-8 text without control characters; shorter stretches hold no secret.
TEXT = re.compile(
    rb"(?:[\t-\r\x20-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
    rb"|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}+"
)
#: The same for two-byte text, as far as it is ASCII.
WIDE_LITTLE = re.compile(rb"(?:[\t-\r\x20-\x7e]\x00){12,}+")
WIDE_BIG = re.compile(rb"(?:\x00[\t-\r\x20-\x7e]){12,}+")
#: Runs of bytes of which some are written as escapes, the bytes in them, and those of them that text does not need.
URL_BYTES = (re.compile(r"(?:%[0-9A-Fa-f]{2}|[!#-$&-;=?-\[\]_a-z~])++"), re.compile(r"%([0-9A-Fa-f]{2})|."), re.compile(r"%[0189A-Fa-f][0-9A-Fa-f]"))
CODE_BYTES = (
    re.compile(r"[ -~]{12,}+"),
    re.compile(r"\\x([0-9A-Fa-f]{2})|\\[nrt\\'\"]|."),
    re.compile(r"\\x[0189A-Fa-f][0-9A-Fa-f]"),
)
SHORT_ESCAPES = {"n": 10, "r": 13, "t": 9}
#: First bytes of gzip, zlib, bzip2, xz and zstandard.
MAGIC = re.compile(rb"(?=\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd)")


def _url(match: re.Match) -> str | None:
    if match[0].startswith("%25"):
        return "%"
    try:
        return bytes.fromhex(match[0].replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _character(code: int) -> str | None:
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else None


def _unicode(match: re.Match) -> str | None:
    found = match[0]
    if ESCAPED.fullmatch(found):
        return found[0]
    if found[0] == "&":
        if found[1] != "#":
            return NAMED[found[1:-1]]
        return _character(int(found[3:-1], 16) if found[2] in "xX" else int(found[2:-1]))
    if found[0] != "\\":
        return chr(ord(found) - 0xFEE0)
    if len(found) == 12:
        return bytes.fromhex(found[2:6] + found[8:12]).decode("utf-16-be")
    return _character(int(found[2:].strip("{}"), 16))


PIECE = 1 << 18
ZSTANDARD = b"\x28\xb5\x2f\xfd"


def _stream(data: memoryview, raw: bool = False):
    """Decompressor for what the bytes begin with, None if nothing known."""
    if raw:
        return zlib.decompressobj(-15)
    if data[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if len(data) > 2 and data[0] & 0x0F == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=1 << 28)
    if data[:4] == ZSTANDARD:
        return zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
    return None


def _pieces(data: memoryview, raw: bool = False) -> Iterator[bytes | int]:
    """Content of one stream in pieces, then its length in bytes; nothing after the pieces if it is broken or cut off."""
    stream = _stream(data, raw)
    if stream is None:
        return
    try:
        if not hasattr(stream, "needs_input") and data[:4] == ZSTANDARD and not raw:
            # A few bytes of this format give 128 KiB at most, so the content of small steps is bounded.
            at = 0
            while at < len(data) and not stream.eof:
                yield stream.decompress(data[at : at + 64])
                at += 64
            left = max(0, len(data) - at) + len(stream.unused_data)
        elif hasattr(stream, "needs_input"):
            yield stream.decompress(data, PIECE)
            while not stream.eof and not stream.needs_input:
                yield stream.decompress(b"", PIECE)
            left = len(stream.unused_data)
        else:
            yield stream.decompress(data, PIECE)
            while not stream.eof and (more := stream.decompress(stream.unconsumed_tail, PIECE)):
                yield more
            left = len(stream.unused_data)
        if stream.eof:
            yield len(data) - left
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        return


def _extent(data: memoryview, raw: bool = False) -> int:
    """Bytes of all complete streams that follow each other from the first byte on, 0 if there is none."""
    at = stop = 0
    while at < len(data):
        size = 0
        for piece in _pieces(data[at:], raw):
            size = piece if isinstance(piece, int) else 0
        if not size:
            break
        stop = at = at + size
        while at < len(data) and not data[at]:  # padding between streams
            at += 1
    return stop


def _windows(data: memoryview, raw: bool = False) -> Iterator[str]:
    """Text of complete streams in overlapping windows."""
    decoder, text, at, fresh = codecs.getincrementaldecoder("utf-8")("replace"), "", 0, 0
    while at < len(data):
        size = 0
        for piece in _pieces(data[at:], raw):
            if isinstance(piece, int):
                size = piece
                continue
            new = decoder.decode(piece)
            text += new
            fresh += len(new)
            if len(text) >= WINDOW:
                yield text
                text, fresh = text[-OVERLAP:], 0
        if not size:
            break
        at += size
        while at < len(data) and not data[at]:
            at += 1
    if fresh:
        yield text


def _runs(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Base64 runs without padding, and the place of each of their characters in the text."""
    for match in BASE64.finditer(text):
        run = match[0].rstrip("=")
        yield run, np.arange(match.start(), match.start() + len(run))
    for match in WRAPPED.finditer(text):
        # A line end written as backslash and n is no part of the run.
        lines = list(DIGITS.finditer(re.sub(r"\\[rn]", "\n\n", match[0])))
        run = "".join(line[0] for line in lines)
        if len(run) >= LEAST_DIGITS:
            yield run, match.start() + np.concatenate([np.arange(*line.span()) for line in lines])


def _decoded(layer: Layer) -> Iterator[Layer]:
    """Layers of the text and of the compressed payloads that base64 runs hold."""
    for run, places in _runs(layer.text):
        run = run.replace("-", "+").replace("_", "/")
        for skip in range(4):
            body = run[skip:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            if len(body) < 12:
                break
            data = base64.b64decode(body + "=" * (-len(body) % 4))
            own = places[skip : skip + len(body)]
            end = int(own[-1]) + 1
            while end < len(layer.text) and layer.text[end] == "=":
                end += 1
            # Byte k lies in characters 4k/3 to (4k + 6)/3 of the run.
            first = lambda k: own[np.asarray(k) * 4 // 3]
            last = lambda k: own[np.minimum((np.asarray(k) * 4 + 2) // 3, len(own)) - 1]
            yield from _payloads(layer, data, lambda k: int(first(k)), lambda k: end if k >= len(data) else int(last(k)) + 1, 3)
            for pattern, encoding in ((TEXT, "utf-8"), (WIDE_LITTLE, "utf-16-le"), (WIDE_BIG, "utf-16-be")):
                for match in pattern.finditer(data):
                    text = match[0].decode(encoding)
                    widths = np.array([len(c.encode(encoding)) for c in text])
                    stop = match.start() + np.cumsum(widths)
                    yield layer.part(text, first(stop - widths), last(stop))
    for runs, unit, telling in (URL_BYTES, CODE_BYTES):
        for match in runs.finditer(layer.text) if telling.search(layer.text) else ():
            if not telling.search(match[0]):
                continue
            units = list(unit.finditer(match[0]))
            data = bytes(int(u[1], 16) if u[1] else SHORT_ESCAPES.get(u[0][-1], ord(u[0][-1])) if len(u[0]) > 1 else ord(u[0]) for u in units)
            base = match.start()
            yield from _payloads(layer, data, lambda k: base + units[k].start(), lambda k: base + units[k - 1].end(), 1)


def _payloads(layer: Layer, data: bytes, first: Callable[[int], int], end: Callable[[int], int], step: int) -> Iterator[Layer]:
    """Contents of the compressed payloads in bytes; ``first`` and ``end`` give a byte's characters, payloads start every ``step``."""
    view, done = memoryview(data), 0
    for match in MAGIC.finditer(data):
        at = match.start()
        # A payload begins with a group of four characters.
        if at < done or at % step or not (size := _extent(view[at:])):
            continue
        done = at + size
        flat = layer.interval(first(at), end(done))
        for text in _windows(view[at:done]):
            yield Layer(text, flat=flat)
    if not done and len(data) >= 12 and _extent(view, raw=True) == len(data):
        flat = layer.interval(first(0), end(len(data)))
        for text in _windows(view, raw=True):
            yield Layer(text, flat=flat)


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """Every layer one step below."""
    if "%" in layer.text and (below := layer.substituted(URL, _url)):
        yield below
    if below := layer.substituted(UNICODE, _unicode):
        yield below
    yield from _decoded(layer)


def all_spans(text: str, base: list[Span]) -> set[Span]:
    """Base spans and those of all layers, in code points of the text."""
    found = set(base)
    if not HINT.search(text):
        return found
    top = Layer(text)
    seen = {top.mark()}
    work = [unwrapped(top)]
    while work:
        below = next(work[-1], None)
        if below is None:
            work.pop()
            continue
        mark = below.mark()
        if mark in seen:
            continue
        seen.add(mark)
        for kind, start, end in scan(below.text):
            found.add((kind, *below.interval(start, end)))
        work.append(unwrapped(below))
    return found


def written_out(spans: set[Span] | list[Span]) -> str:
    """kind:start:end by start, then kind as listed, then end, joined by commas."""
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


FIELDS = [
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("base_spans", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def _row(text: str) -> tuple:
    base = scan(text)
    counts = [sum(kind == span[0] for span in base) for kind in KINDS]
    return (*counts, written_out(base), written_out(all_spans(text, base)))


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, base counts and spans, and all spans of every document's whole text."""
    return map_texts(docs, [key], text, FIELDS, _row)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span of any layer replaced; overlapping spans become one mark."""
    out, at = [], 0
    for _, start, end in sorted(all_spans(text, scan(text)), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
