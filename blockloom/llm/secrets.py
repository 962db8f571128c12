"""Secret scans by a recursive decoding worklist.

Every text is the first layer of a worklist. A layer is scanned for secrets and searched for
encoded parts: URL escapes, Unicode escapes and character references, each decoded over the whole
layer; base64 and compressed bytes. Bytes are text of one character each. What is decoded is a new
layer, unless a layer with the same content from the same places was seen in this text before; the
list runs dry at the fixpoint. Each layer keeps, for its characters, where they come from in the
text, so a find in any layer is a span of the text.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import html
import itertools
import lzma
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from hashlib import blake2b

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .rows import add_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

URL_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPE = re.compile(
    r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[A-Za-z]{2,8};"
)
# Bytes as programs print them: other control characters and the backslash have short escapes.
BYTES_ESCAPE = re.compile(r"""\\x[0-9A-Fa-f]{2}|\\[nrtabfv0\\'"]""")
SHORT = {"n": "\n", "r": "\r", "t": "\t", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
BASE64_PART = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Base64 over several lines; a line that is not full ends it by itself, what follows is only out of step.
BASE64_LINES = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++(?=[\s=]|\Z))++={0,2}"
)
BASE64_OTHER = re.compile(r"[^A-Za-z0-9+/_-]+")
# How the streams of gzip, bzip2, xz and zlib begin.
STREAM = re.compile("\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|x[\x01^\x9c\xda]")
STREAM_BYTES = re.compile(STREAM.pattern.encode("latin-1"))
# Bytes that encoded runs are made of.
RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\&#;{}"
# Without one of these, decoded bytes hold neither a secret nor another layer.
WORTH = re.compile(
    STREAM.pattern
    + r"|(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}|[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\[uUx]|&[#A-Za-z]"
)

# A compressed stream is unwrapped in pieces that overlap, so memory is bounded by the piece and
# not by what a stream unfolds to.
PIECE_BYTES, OVERLAP_BYTES = 4 << 20, 64 << 10
# What is read of a possible stream at first, and how far into a gzip or zlib stream its content begins at the
# latest: its head holds at most 64 kB of extra data and a name.
FIRST_BYTES, HEAD_BYTES = 512, 72 << 10
# Streams directly inside each other that are unwrapped on the fly; deeper ones are layers of their own.
MOST_WRAPS = 16
WIDE = re.compile("[^\x00-\xff]")


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, leftmost and not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A decoded text and where its characters come from.

    ``marks`` and ``origins``: from position ``marks[i]`` on, characters come from the span
    ``origins[i]``; a span that is as long as the stretch is mapped one to one.
    """

    __slots__ = ("text", "marks", "origins", "key")

    def __init__(self, text: str, marks: list[int], origins: list[tuple[int, int]]):
        self.text, self.marks, self.origins = text, marks, origins
        places = array("q", marks)
        for origin in origins:
            places.extend(origin)
        digest = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16)
        digest.update(places.tobytes())
        self.key = digest.digest()

    def _place(self, at: int) -> tuple[int, int]:
        i = bisect.bisect_right(self.marks, at) - 1
        begin, end = self.origins[i]
        size = (self.marks[i + 1] if i + 1 < len(self.marks) else len(self.text)) - self.marks[i]
        if size == end - begin:
            begin += at - self.marks[i]
            return begin, begin + 1
        return begin, end

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text behind ``text[start:end]``."""
        return self._place(start)[0], self._place(end - 1)[1]

    def inner(self, pieces: list[tuple[str | None, int, int]]) -> Layer:
        """A layer made of pieces ``(text, start, end)`` of this one: decoded, or taken over where
        the text is None. What is taken over keeps the origin of every character."""
        marks, origins, texts, at = [], [], [], 0
        last = None

        def add(size: int, begin: int, end: int) -> None:
            nonlocal at, last
            plain = size == end - begin
            # Stretches mapped one to one are joined, so equal layers look the same however they came about.
            if plain and last == begin:
                origins[-1] = (origins[-1][0], end)
            else:
                marks.append(at)
                origins.append((begin, end))
            last = end if plain else None
            at += size

        for text, start, end in pieces:
            if text:
                texts.append(text)
                add(len(text), *self.span(start, end))
            elif text is None and start < end:
                texts.append(self.text[start:end])
                i = bisect.bisect_right(self.marks, start) - 1
                while start < end:
                    mark, origin = self.marks[i], self.origins[i]
                    stop = self.marks[i + 1] if i + 1 < len(self.marks) else len(self.text)
                    upto = min(end, stop)
                    if stop - mark == origin[1] - origin[0]:
                        add(upto - start, origin[0] + start - mark, origin[0] + upto - mark)
                    elif start == mark and upto == stop:
                        add(upto - start, *origin)
                    else:
                        # Part of a stretch comes from all of its origin, character by character if as long.
                        whole = upto - start != origin[1] - origin[0]
                        for size in [upto - start] if whole else [1] * (upto - start):
                            add(size, *origin)
                    start, i = upto, i + 1
        return Layer("".join(texts), marks, origins)


def _escapes(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of ``pattern`` decoded and the rest as it is; None if nothing changes."""
    pieces, at, changed = [], 0, False
    for m in pattern.finditer(layer.text):
        new = decode(m.group())
        if new is None:
            continue
        pieces.append((None, at, m.start()))
        pieces.append((new, m.start(), m.end()))
        at, changed = m.end(), True
    if not changed:
        return None
    pieces.append((None, at, len(layer.text)))
    return layer.inner(pieces)


def _url(escaped: str) -> str:
    # One character per byte: secrets and encoded parts are ASCII, and compressed bytes stay whole.
    return bytes.fromhex(escaped.replace("%", "")).decode("latin-1")


def _unicode(escaped: str) -> str | None:
    if escaped[0] == "&":
        if escaped[1] == "#":
            code = int(escaped[3:-1], 16) if escaped[2] in "xX" else int(escaped[2:-1])
            # HTML reads some of these as Windows-1252 or drops them; here they are bytes.
            if code < 256:
                return chr(code)
        plain = html.unescape(escaped)
        return plain if plain != escaped else None
    digits = escaped[2:].strip("{}")
    code = int(digits, 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _byte(escaped: str) -> str:
    return chr(int(escaped[2:], 16)) if escaped[1] == "x" else SHORT.get(escaped[1], escaped[1])


def _opened(data: bytes):
    """A decompressor for the stream at the start of ``data``, or None."""
    m = STREAM.match(data[:8].decode("latin-1"))
    if not m:
        return None
    if m.group()[0] == "B":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if m.group()[0] == "\xfd" else zlib.decompressobj(47)


class Stream:
    """The content of a compressed stream and of those that follow it at once, in bounded chunks.

    ``rest`` is how much of the input is left after the last of them.
    """

    def __init__(self, source: Iterator[bytes]):
        self.source, self.rest, self.ended = source, 0, False

    def __iter__(self) -> Iterator[bytes]:
        unzip, data, silent = None, b"", 0
        for chunk in self.source:
            data += chunk
            while data:
                if unzip is None:
                    if len(data) < 8 and (more := next(self.source, b"")):
                        data += more
                        continue
                    unzip = _opened(data)
                    if unzip is None:
                        self.rest = len(data)
                        return
                    self.ended = False
                try:
                    got = unzip.decompress(data, PIECE_BYTES)
                    silent = 0 if got else silent + len(data)
                    if silent > HEAD_BYTES and hasattr(unzip, "unconsumed_tail"):
                        return
                    while got or not getattr(unzip, "needs_input", True):
                        if got:
                            yield got
                        if unzip.eof:
                            break
                        data = unzip.unconsumed_tail if hasattr(unzip, "unconsumed_tail") else b""
                        got = unzip.decompress(data, PIECE_BYTES)
                except (zlib.error, OSError, EOFError, lzma.LZMAError):
                    return
                data = unzip.unused_data if unzip.eof else b""
                self.rest = len(data)
                if unzip.eof:
                    unzip, self.ended, silent = None, True, 0


def _pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Chunks put together to pieces that overlap.

    An encoded run or a stream that is open at the end of a piece is carried whole into the next one, so
    nothing is cut in two; memory is bounded by the piece and by the longest such run.
    """
    held, new, wait = b"", 0, PIECE_BYTES
    for chunk in chunks:
        held, new = held + chunk, new + len(chunk)
        if new >= wait:
            keep = min(max(len(held) - OVERLAP_BYTES, 0), _open_from(held))
            if keep <= len(held) // 2 and keep < len(held) - PIECE_BYTES:
                # Nearly all of it is open: look again when it has doubled.
                wait = new + len(held)
                continue
            yield held
            held, new, wait = held[keep:], 0, PIECE_BYTES
    if new:
        yield held


def _open_from(data: bytes) -> int:
    """Where the encoded run or the stream that goes on after the end of the data begins; its length, if none does."""
    at = len(data)
    while True:
        run = len(data[:at].rstrip(RUN))
        if at - run < 16 and at < len(data):
            break
        at = run
        # A full line before it may be part of the same run.
        before = len(data[:at].rstrip(b"\r\n\t "))
        if not before or before == at:
            break
        last = len(data[:before].rstrip(RUN))
        if before - last < 16:
            break
        at = before
    begin = 0
    while begin < at and (m := STREAM_BYTES.search(data, begin)):
        end = _stream_end(data, m.start())
        if end is None:
            return min(at, m.start())
        begin = max(end, m.start() + 1)
    return at


def _stream_end(data: bytes, start: int) -> int | None:
    """End of the stream at ``start``; 0 if there is none, and ``None`` if it goes on after the data."""
    unzip, at, size = _opened(data[start : start + 8]), start, FIRST_BYTES
    if unzip is None:
        return 0
    try:
        while at < len(data):
            part, at, size = data[at : at + size], min(at + size, len(data)), 2 * size
            unzip.decompress(part, PIECE_BYTES)
            while not unzip.eof and (getattr(unzip, "unconsumed_tail", b"") or not getattr(unzip, "needs_input", True)):
                unzip.decompress(getattr(unzip, "unconsumed_tail", b""), PIECE_BYTES)
            if unzip.eof:
                return at - len(unzip.unused_data)
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        return 0
    return None


def _unfolded(source: Iterator[bytes]) -> Iterator[bytes]:
    """Content of a stream to the bottom: what begins as a stream itself is unwrapped without being held."""
    for _ in range(MOST_WRAPS):
        first = next(source, b"")
        while first and len(first) < 8 and (more := next(source, b"")):
            first += more
        source = itertools.chain([first] if first else [], source)
        if _opened(first) is None:
            break
        source = iter(Stream(source))
    return source


def _streams(layer: Layer) -> Iterator[Layer]:
    """Layers out of the compressed bytes of a layer, wherever they begin."""
    text, at, stop = layer.text, 0, 0
    while m := STREAM.search(text, at):
        start = m.start()
        if start >= stop:
            wide = WIDE.search(text, start)
            stop = wide.start() if wide else len(text)
        read = start

        def source(size: int = FIRST_BYTES) -> Iterator[bytes]:
            # Little at first: most that looks like the head of a stream is none.
            nonlocal read
            while read < stop:
                part = text[read : min(read + size, stop)].encode("latin-1")
                read, size = read + len(part), min(2 * size, PIECE_BYTES)
                yield part

        stream = Stream(source())
        found = False
        for piece in _pieces(_unfolded(iter(stream))):
            found, inside = True, piece.decode("latin-1")
            if WORTH.search(inside):
                yield layer.inner([(inside, start, read - stream.rest)])
        end = read - stream.rest
        at = end if found and stream.ended and end < stop else start + 1


def _base64(layer: Layer, start: int, end: int) -> Iterator[Layer]:
    """What a part decodes to from each of four starts: a blob behind a path or a name begins at one of them."""
    raw = layer.text[start:end].rstrip("=")
    gaps, kept = [], []
    at = size = 0
    for gap in BASE64_OTHER.finditer(raw):
        kept.append(raw[at : gap.start()])
        size += gap.start() - at
        at = gap.end()
        # From this character of the body on, so much lies between it and the start.
        gaps.append((size, at - size))
    body = ("".join(kept) + raw[at:]).replace("-", "+").replace("_", "/")
    froms = [g[0] for g in gaps]

    def place(i: int) -> int:
        return start + i + (gaps[bisect.bisect_right(froms, i) - 1][1] if froms and i >= froms[0] else 0)

    for skip in range(4):
        size = len(body) - skip
        size -= size % 4 == 1
        if size < 2:
            continue
        data = base64.b64decode(body[skip : skip + size] + "=" * (-size % 4))
        text = data.decode("latin-1")
        if not WORTH.search(text):
            continue
        # Four characters of base64 are three bytes; a character comes from the group of its byte.
        pieces = [
            (text[i : i + 3], place(skip + i // 3 * 4), min(end, place(min(skip + i // 3 * 4 + 3, len(body) - 1)) + 1))
            for i in range(0, len(text), 3)
        ]
        if skip + size == len(body):
            pieces[-1] = (*pieces[-1][:2], min(end, pieces[-1][1] + 4) if not gaps else pieces[-1][2])
        yield layer.inner(pieces)


def decoded_layers(layer: Layer) -> Iterator[Layer]:
    """All layers one step below."""
    text = layer.text
    if "%" in text and (new := _escapes(layer, URL_ESCAPE, _url)):
        yield new
    if ("\\" in text or "&" in text) and (new := _escapes(layer, UNICODE_ESCAPE, _unicode)):
        yield new
    if "\\x" in text and (new := _escapes(layer, BYTES_ESCAPE, _byte)) and STREAM.search(new.text):
        yield new
    yield from _streams(layer)
    for m in BASE64_PART.finditer(text):
        yield from _base64(layer, m.start(), m.end())
    for m in BASE64_LINES.finditer(text):
        yield from _base64(layer, m.start(), m.end())


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each sorted by start, kind and end."""
    base = sorted(find_secrets(text))
    if not text:
        return base, base
    spans, seen = set(base), set()
    work = [Layer(text, [0], [(0, len(text))])]
    while work:
        layer = work.pop()
        if layer.key in seen:
            continue
        if seen:
            for start, kind, end in find_secrets(layer.text):
                begin, stop = layer.span(start, end)
                spans.add((begin, kind, stop))
        seen.add(layer.key)
        work.extend(decoded_layers(layer))
    return base, sorted(spans)


def _kernel():
    def listed(spans):
        return ",".join([f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans])

    def run(texts: list[str]) -> list[list]:
        found = [scan_text(t) for t in texts]
        counts = [[sum(1 for s in base if s[1] == k) for base, _ in found] for k in range(len(KINDS))]
        return [*counts, [listed(base) for base, _ in found], [listed(spans) for _, spans in found]]

    return run


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_assign, n_access, n_hex, base, spans`` to every row.

    ``base`` lists the finds in the text itself as ``kind:start:end`` (code points, end exclusive) by
    start, then kind; ``spans`` those of all layers. Null and empty texts have none. Repeated rows are
    scanned each; other columns pass through, those with these names are replaced; an empty
    table gives an empty one. A find in a decoded layer has the span of the encoded characters it
    comes from; equal spans are listed once.
    """
    fields = "n_assign long, n_access long, n_hex long, base string, spans string"
    return add_columns(docs, text, fields, _kernel)
