"""Secret scan with a recursive decoding worklist.

Each text is scanned with the base rules. Then every layer of encoding is unwrapped: URL escapes, Unicode
escapes and character references, base64 words, and compressed data inside base64. Each decoded layer is
scanned with the same rules and goes on the worklist itself, until nothing new comes out. A layer is
identified by its text and its place in the document; one seen before is not opened again, so layers that
decode into each other end. Every layer carries the stretches of the document its characters came from, as
few pieces as there were escapes, so findings are reported as spans of the document.

One step decodes the URL and Unicode escapes of a layer together. After ``STEPS`` such steps the next one
decodes word by word until nothing is left to decode, so the work does not grow with the square of a text
that is escaped very many times over. Base64 words are decoded from each of their first four characters and
from where compressed data begins inside them, as something may be glued before the encoded part.

Decompressed data is read as a stream, all members of it, and scanned in windows of about ``WINDOW`` bytes
that end where no match can be open, so a layer may have any size. What decompresses once is scanned
whatever bytes it holds; so is what base64 words decode to. Base64 in lines is joined before it is decoded,
beside each line by itself. Counted as unopened is only what a caller's ``most`` refuses, compression nested
more than ``MAX_NESTED`` deep, and a single open stretch of more than ``MAX_OPEN`` bytes, scanned in pieces.
The scan of a document needs nothing but that document: one narrow pass without a shuffle.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.common import arrow_map, read_table, utf8

KINDS = ("assign", "access", "hex")
MAX_NESTED = 16
WINDOW = 1 << 20
MAX_OPEN = 1 << 26
MIN_BASE64 = 16
STEPS = 8
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ESCAPE = re.compile(
    r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
#: One escape at the end of a text.
_LAST_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)\Z")
_LONGEST_ESCAPE = 10
_MAY_END_ESCAPE = frozenset("0123456789abcdefABCDEF};")
_NO_SPACE = re.compile(r"\S+")
#: Where base64 of compressed data (gzip, bzip2, xz, zstandard) begins.
_PACKED = re.compile(r"H4sI|QlpoO|/Td6WF|KLUv/")
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_BASE64},}}={{0,2}}")
_TO_WORDS = bytes(c if chr(c).isalnum() and c < 128 or c in b"+/_-" else 32 for c in range(256))
_STANDARD = str.maketrans("-_", "+/")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ESCAPES = re.compile(rb"%[0-9A-Fa-f]{2}|\\[uUx]|&#")
#: A next line of base64, after a line end that may be escaped.
_NEXT_LINE = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t>]*([A-Za-z0-9+/_-]+={0,2})")
#: ASCII in UTF-16, either byte order.
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){8,}|(?:\0[\t\n\r\x20-\x7e]){8,}")
#: Bytes that a match of any rule or encoding may hold become 1.
_TO_OPEN = bytes(c < 128 and (chr(c).isalnum() or c in b"+/_-=.%\\&#;{}\"': \t\r\n>\0") for c in range(256))


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base rules; kind is an index into ``KINDS``."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return found


class Refused:
    """A word that was not opened, or not all of it, and its span of the document."""

    __slots__ = ("span",)

    def __init__(self, span: tuple[int, int]):
        self.span = span


class Layer:
    """A decoded text and the stretches of the document its characters came from.

    Character i of the piece that begins at ``at`` came from ``low`` + (i - at) * ``step`` to ``high`` +
    (i - at) * ``step``: step 1 for characters kept as they are, 3 for URL escapes, 0 for one shared stretch.
    """

    __slots__ = ("text", "at", "low", "high", "step", "depth")

    def __init__(self, text: str, depth: int, low: int = 0, high: int = 1, step: int = 1):
        self.text, self.depth = text, depth
        self.at, self.low, self.high, self.step = (array("q", [x]) for x in (0, low, high, step))

    @classmethod
    def pieced(cls, text: str, depth: int, *pieces: array) -> Layer:
        made = cls(text, depth)
        made.at, made.low, made.high, made.step = pieces
        return made

    def key(self) -> tuple:
        digest = hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest()
        return digest, *self.span(0, len(self.text))

    def one_stretch(self) -> bool:
        return len(self.at) == 1 and not self.step[0]

    def piece(self, i: int) -> int:
        return bisect_right(self.at, i) - 1

    def span(self, start: int, end: int) -> tuple[int, int]:
        first, last = self.piece(start), self.piece(end - 1)
        return self.low[first] + (start - self.at[first]) * self.step[first], self.high[last] + (end - 1 - self.at[last]) * self.step[last]

    def spans(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``span`` of many stretches, given by their first and last characters."""
        at, low, high, step = (np.frombuffer(x, np.int64) for x in (self.at, self.low, self.high, self.step))
        a, b = np.searchsorted(at, first, "right") - 1, np.searchsorted(at, last, "right") - 1
        return low[a] + (first - at[a]) * step[a], high[b] + (last - at[b]) * step[b]


def _code_point(n: int) -> str:
    return chr(n) if n < 0x110000 else "\ufffd"


def _decoded(found: str) -> tuple[str, int, list[int] | None]:
    """The text of escapes and how many characters each of its own came from: all the same number, or a list.

    Zero and no list: they belong together, as the escapes are broken.
    """
    if found.startswith("%"):
        data = bytes.fromhex(found.replace("%", ""))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace"), 0, None
        return (text, 3, None) if len(text) == len(data) else (text, 0, [3 * len(c.encode()) for c in text])
    if found.startswith("\\u{"):
        return _code_point(int(found[3:-1], 16)), len(found), None
    if found.startswith("\\u"):
        units = b"".join(int(x, 16).to_bytes(2, "little") for x in found.split("\\u")[1:])
        try:
            text = units.decode("utf-16-le")
        except UnicodeDecodeError:
            return units.decode("utf-16-le", "replace"), 0, None
        return (text, 6, None) if 2 * len(text) == len(units) else (text, 0, [6 * (1 + (c > "\uffff")) for c in text])
    if found.startswith("\\"):
        return _code_point(int(found[2:], 16)), len(found), None
    return _code_point(int(found[3:-1], 16) if found[2] in "xX" else int(found[2:-1])), len(found), None


def _fully_decoded(word: str) -> tuple[str, int, list[int]]:
    """As ``_decoded``, for a word whose escapes are decoded as soon as they are whole, until none is left."""
    out: list[str] = []
    sizes: list[int] = []
    for c in word:
        out.append(c)
        sizes.append(1)
        while out[-1] in _MAY_END_ESCAPE and (m := _LAST_ESCAPE.search("".join(out[-_LONGEST_ESCAPE:]))):
            n = len(m[0])
            text = chr(int(m[0][1:], 16)) if m[0][0] == "%" else _decoded(m[0])[0]
            whole = sum(sizes[-n:])
            del out[-n:], sizes[-n:]
            out.append(text)
            sizes.append(whole)
    return "".join(out), 0, sizes


def _unescaped(layer: Layer) -> Layer | None:
    """The layer with all its escapes decoded once, or, after STEPS layers, until none is left."""
    fully = layer.depth >= STEPS
    out: list[str] = []
    at, low, high, step = pieces = tuple(array("q") for _ in range(4))
    size = done = 0

    def add(to: int, first: int, last: int, each: int) -> None:
        at.append(to)
        low.append(first)
        high.append(last)
        step.append(each)

    def keep(start: int, end: int) -> None:
        nonlocal size
        k = layer.piece(start)
        while start < end:
            stop = min(end, layer.at[k + 1]) if k + 1 < len(layer.at) else end
            off = (start - layer.at[k]) * layer.step[k]
            add(size, layer.low[k] + off, layer.high[k] + off, layer.step[k])
            size += stop - start
            start, k = stop, k + 1

    for m in (_NO_SPACE if fully else _ESCAPE).finditer(layer.text):
        if fully and not _ESCAPE.search(m[0]):
            continue
        text, each, sizes = _fully_decoded(m[0]) if fully else _decoded(m[0])
        if m.start() > done:
            out.append(layer.text[done : m.start()])
            keep(done, m.start())
        out.append(text)
        first = layer.piece(m.start())
        if sizes is not None:
            start = m.start()
            for n in sizes:
                add(size, *layer.span(start, start + n), 0)
                size, start = size + 1, start + n
        elif each and first == layer.piece(m.end() - 1):
            add(size, layer.span(*m.span())[0], layer.span(m.start(), m.start() + each)[1], each * layer.step[first])
            size += len(text)
        elif each:
            for start in range(m.start(), m.end(), each):
                add(size, *layer.span(start, start + each), 0)
                size += 1
        elif text:
            add(size, *layer.span(*m.span()), 0)
            size += len(text)
        done = m.end()
    if not done:
        return None
    if done < len(layer.text):
        out.append(layer.text[done:])
        keep(done, len(layer.text))
    text = "".join(out)
    return Layer.pieced(text, layer.depth + 1, *pieces) if text else None


class _Zstd:
    """zstandard with the interface of zlib; small slices keep each output small."""

    def __init__(self):
        import zstandard

        self.inner, self.eof, self.unused_data, self.unconsumed_tail = zstandard.ZstdDecompressor().decompressobj(), False, b"", b""

    def decompress(self, data: bytes, most: int) -> bytes:
        out = self.inner.decompress(data[:64]) if data else b""
        self.unconsumed_tail, self.eof = data[64:], self.inner.eof
        if self.eof:
            self.unused_data, self.unconsumed_tail = self.inner.unused_data + data[64:], b""
        return out


def _decoder(head: bytes):
    """A decompressor for data that begins like this, or None."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:5] == b"\xfd7zXZ":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        try:
            return _Zstd()
        except ImportError:
            return None
    return zlib.decompressobj() if head[:1] == b"\x78" else None


def _members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What one member after the other decompresses to, then bytes that are none; data that breaks ends there.

    Raises ValueError before the first output if the data is not compressed.
    """
    data, first = b"", True
    while True:
        while len(data) < 6 and (more := next(pieces, None)) is not None:
            data += more
        if not first:
            data = data.lstrip(b"\0")  # padding between members
        if not data:
            return
        inner, held = _decoder(data), data
        if inner is None:
            if first:
                raise ValueError
            yield b"\0" + data
            yield from pieces
            return
        some = False
        while not inner.eof:
            try:
                out = inner.decompress(data, WINDOW)
            except Exception as e:  # zstandard has an error type of its own
                if not isinstance(e, (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)) and type(e).__name__ != "ZstdError":
                    raise
                if first and not some:
                    raise ValueError from None
                if not some:
                    yield b"\0" + held
                return
            if out:
                some = True
                yield out
            data = getattr(inner, "unconsumed_tail", b"")
            if not data and not out and not inner.eof:
                data = next(pieces, None)
                if data is None:
                    return
        data, first = inner.unused_data, False


def _unpacked(pieces: Iterator[bytes]) -> tuple[bool, Iterator[bytes]]:
    """Whether a stream of bytes is compressed, and what it decompresses to, else itself."""
    read: list[bytes] = []

    def noted() -> Iterator[bytes]:
        for piece in pieces:
            if not begun:
                read.append(piece)
            yield piece

    begun = False
    out = _members(noted())
    try:
        first = next(out, b"")
    except ValueError:
        return False, chain(read, pieces)
    if not first and not b"".join(read):
        return False, iter(())
    begun = True
    read.clear()
    return True, chain([first], out)


def _opened(data: bytes) -> tuple[Iterator[bytes] | None, bool]:
    """The stream of fully decompressed data, None if it isn't compressed; whether it is nested too deep."""
    pieces: Iterator[bytes] = iter([data])
    for nested in range(MAX_NESTED + 1):
        inside, pieces = _unpacked(pieces)
        if not inside:
            return (pieces if nested else None), False
    return pieces, True


def _windows(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Windows of a stream, cut where no match can be open; and whether one had to be cut elsewhere."""
    held: list[bytes] = []
    size = 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size < WINDOW:
            continue
        at = piece.translate(_TO_OPEN).rfind(b"\0") + 1
        if at or size >= MAX_OPEN:
            yield b"".join([*held[:-1], piece[: at or None]]), not at
            held = [piece[at:]] if at else []
            size = len(piece) - at if at else 0
    if size:
        yield b"".join(held), False


def _idle(raw: bytes) -> bool:
    """Whether neither a rule nor an encoding can match in this."""
    low = raw.lower()
    return not (
        any(k in low for k in _KEYWORDS) or b"AKIA" in raw or _ESCAPES.search(raw)
        or any(len(w) >= MIN_BASE64 for w in raw.translate(_TO_WORDS).split())
    )


def _texts(data: bytes) -> Iterator[tuple[str, range | None]]:
    """The texts in bytes that may hold something, and the place of each character (None: by their UTF-8)."""
    if not _idle(data):
        try:
            yield data.decode("utf-8"), None
        except UnicodeDecodeError:
            yield data.decode("latin-1"), range(len(data) + 1)
    if b"\0" in data:
        for m in _WIDE.finditer(data):
            text = m[0].replace(b"\0", b"")
            if not _idle(text):
                yield text.decode("latin-1"), range(m.start(), m.end() + 2, 2)


def _words(text: str) -> Iterator[list[tuple[int, int]]]:
    """Base64 words, each the stretches it is made of: every word by itself, and lines of one length joined.

    The first line may be shorter, as something may stand before it, and the last. A word by itself is also
    given without its first one to three characters, and from where compressed data begins inside it.
    """
    covered = 0
    for m in _BASE64.finditer(text):
        yield [m.span()]
        for start in range(m.start() + 1, min(m.start() + 4, m.end() - MIN_BASE64)):
            yield [(start, m.end())]
        for packed in _PACKED.finditer(text, m.start() + 4, m.end()):
            yield [(packed.start(), m.end())]
        if m.start() < covered or m[0].endswith("="):
            continue
        lines, full, last = [m.span()], m.end() - m.start(), m.end()
        while found := _NEXT_LINE.match(text, lines[-1][1]):
            n = found.end(1) - found.start(1)
            if n > full:
                if len(lines) > 1:
                    break
                full = n
            lines.append(found.span(1))
            if n < full or found[1].endswith("="):
                break
            if m.end() - m.start() == full:
                last = found.end(1)
        if len(lines) > 1:
            yield lines
        covered = last


def _bytes_of(layer: Layer, lines: list[tuple[int, int]]) -> bytes:
    body = "".join(layer.text[a:b] for a, b in lines).rstrip("=").translate(_STANDARD)
    body = body[:-1] if len(body) % 4 == 1 else body
    return binascii.a2b_base64(body + "=" * (-len(body) % 4))


def _decoded_words(layer: Layer, most: int | None):
    """Layers for the base64 words of a layer, one for each window; ``Refused`` for what is not opened."""
    opened = 0  # where the last word of compressed data ends; nothing inside it is tried again
    for lines in _words(layer.text):
        start, end = lines[0]
        if len(lines) == 1 and start < opened:
            continue
        if len(lines) == 1 and end - start > 256 and layer.text.startswith(("H4sI", "Qlpo", "/Td6", "KLUv"), start):
            # A few bytes show what only looks like compressed data before the whole word is decoded.
            if _decoder(_bytes_of(layer, [(start, start + 64)])) is None:
                continue
        data = _bytes_of(layer, lines)
        whole = layer.span(lines[0][0], lines[-1][1]) if layer.one_stretch() else None
        pieces, deep = _opened(data)
        if pieces is not None:
            whole = layer.span(lines[0][0], lines[-1][1])
            opened = end if len(lines) == 1 else opened
            if deep:
                yield Refused(whole)
            if most is not None:
                kept, size = [], 0
                for piece in pieces:
                    kept.append(piece)
                    size += len(piece)
                    if size > most:
                        break
                if size > most:
                    yield Refused(whole)
                    continue
                pieces = iter(kept)
        for window, cut in [(data, False)] if pieces is None else _windows(pieces):
            if cut:
                yield Refused(whole)
            for text, places in _texts(window):
                if whole is not None:
                    yield Layer(text, layer.depth + 1, *whole, 0)
                    continue
                chars = np.concatenate([np.arange(a, b) for a, b in lines])
                # Bytes a to b of the data are one character of the text, and come from these characters of the word.
                if places is not None:
                    a = np.arange(places.start, places.stop, places.step)[: len(text)]
                    b = a + places.step
                else:
                    sizes = np.ones(len(text), np.int64) if len(text) == len(window) else np.fromiter((len(c.encode()) for c in text), np.int64, len(text))
                    b = np.cumsum(sizes)
                    a = b - sizes
                low, high = layer.spans(chars[4 * a // 3], chars[np.minimum(-(-4 * b // 3), len(chars)) - 1])
                made = [array("q", x.astype(np.int64).tobytes()) for x in (np.arange(len(text)), low, high, np.zeros(len(text)))]
                yield Layer.pieced(text, layer.depth + 1, *made)


def search(raw: bytes, most: int | None = None) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Sorted (start, end, kind, depth) of a text in UTF-8, and the sorted spans of words left unopened.

    Depth 0 marks what the base rules find in the text itself. A span and kind is reported once, at the
    least depth where it is found.
    """
    if _idle(raw):
        return [], []
    text = raw.decode("utf-8", "replace")
    depths = {x: 0 for x in scan(text)}
    refused: list[tuple[int, int]] = []
    seen, work = set(), deque([Layer(text, 0)])
    seen.add(work[0].key())

    def walk(work: deque) -> None:
        while work:
            layer = work.popleft()
            for made in chain(
                [_unescaped(layer) if "%" in layer.text or "\\" in layer.text or "&#" in layer.text else None],
                _decoded_words(layer, most),
            ):
                if made is None:
                    continue
                if isinstance(made, Refused):
                    refused.append(made.span)
                    continue
                key = made.key()
                if key in seen:
                    continue
                seen.add(key)
                for start, end, kind in scan(made.text):
                    place = (*made.span(start, end), kind)
                    depths[place] = min(depths.get(place, made.depth), made.depth)
                if len(made.text) < WINDOW:
                    work.append(made)
                else:  # windows of a large layer do not wait in memory
                    walk(deque([made]))

    walk(work)
    return sorted(((a, b, k, d) for (a, b, k), d in depths.items()), key=lambda x: (x[0], x[2], x[1])), sorted(refused)


def find(raw: bytes, most: int | None = None) -> tuple[list[tuple[int, int, int, int]], int]:
    """The findings of ``search``, and the number of words left unopened."""
    found, refused = search(raw, most)
    return found, len(refused)


SPANS = "array<struct<start:bigint,end:bigint,kind:string,depth:int>>"


def find_secrets(
    df: DataFrame, text_col: str = "text", max_layer: int | None = None, unopened_col: str | None = None
) -> DataFrame:
    """``df`` with ``secrets``, the spans of ``find`` in code points, sorted by start and then kind.

    Null and empty texts have none. ``secrets`` replaces a column of that name; other columns and
    repeated rows stay. ``unopened_col`` names a column for the number of words left unopened.
    """
    more = ["secrets"] + [unopened_col] * (unopened_col is not None)
    keep = [c for c in df.columns if c not in more]
    kind = pa.list_(
        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("depth", pa.int32())])
    )

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find(v.as_py(), max_layer) for v in batch.column(len(keep))]
        rows = [[{"start": a, "end": b, "kind": KINDS[k], "depth": d} for a, b, k, d in spans] for spans, _ in found]
        made = [pa.array(rows, kind), pa.array([n for _, n in found], pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made[: len(more)]], [*keep, *more])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep]
    given = df.select(*keep, utf8(F.col(text_col)).alias("_raw"))
    return arrow_map(given, ", ".join([*schema, f"secrets {SPANS}", *(f"`{c}` long" for c in more[1:])]), per_batch)


def cover(raw: bytes, spans: list[tuple[int, int]], mark: str) -> bytes:
    """A text in UTF-8 with every stretch covered by sorted spans replaced; overlapping spans share a mark."""
    if not spans:
        return raw
    text, out, at = raw.decode("utf-8", "replace"), [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]).encode()


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", max_layer: int | None = None) -> DataFrame:
    """``df`` whose texts have every stretch covered by secret spans, or by words left unopened, replaced by ``mark``.

    A null text stays null; texts without secrets, other columns and repeated rows stay as they are. The
    work grows with the text and its spans together, however many there are.
    """
    keep = [c for c in df.columns if c != text_col]

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for value, null in zip(batch.column(len(keep)), batch.column(len(keep) + 1)):
            raw = value.as_py()
            found, refused = search(raw, max_layer)
            spans = sorted([*((a, b) for a, b, _, _ in found), *refused])
            texts.append(None if null.as_py() else cover(raw, spans, mark))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.binary())], [*keep, text_col])

    given = df.select(*keep, utf8(F.col(text_col)).alias("_raw"), F.col(text_col).isNull().alias("_null"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep]
    clean = arrow_map(given, ", ".join([*schema, f"`{text_col}` binary"]), per_batch)
    return clean.withColumn(text_col, F.col(text_col).cast("string")).select(*df.columns)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"), unopened_col="n_unopened")
    base = F.filter("secrets", lambda x: x["depth"] == 0)

    def of_kind(kind: str):
        return lambda x: x["kind"] == kind

    def label(x):
        return F.concat_ws(":", x["kind"], x["start"], x["end"])

    return found.select(
        "doc_id",
        *(F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.transform(base, label), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", label), ",").alias("spans"),
        "n_unopened",
    )
