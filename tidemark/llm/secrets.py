"""Secret scans through nested encodings.

A document is the first layer of a worklist. Each layer is scanned; what it holds in
URL, Unicode, base64 or compressed form (gzip, zlib, bare deflate, bzip2, xz) is unwrapped to further layers until no new
layer appears. Layers seen before are not entered again, so cycles end. Each layer
carries, for each of its characters, the range of the original text that it came from:
spans are always reported in the original. Base64 goes on over line breaks. What is
packed is unpacked member after member; where that gives very much, it is scanned in
parts as it comes.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, utf8

# The kinds of secrets, as they are listed, and the forms of encoding.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\})+")
UNICODE_ONE = re.compile(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?")
UNICODE_SAME = re.compile(r"(?P<u>(?:\\u[0-9A-Fa-f]{4})+)|(?P<U>(?:\\U[0-9A-Fa-f]{8})+)|(?P<x>(?:\\x[0-9A-Fa-f]{2})+)|(?P<b>(?:\\u\{[0-9A-Fa-f]{1,6}\})+)")
WIDTHS = {"u": 6, "U": 10, "x": 4, "b": 0}
ASCII_RUN = re.compile(rb"[\x00-\x7f]+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
# The least secret is "token=" and six characters: less than 16 characters of base64 hold none.
PART_OF_PATH = re.compile(r"(?<![A-Za-z0-9+])[A-Za-z0-9+]{16,}(?![A-Za-z0-9+])")
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
ESCAPE_START = re.compile(r"[%\\]")
ESCAPE_END = re.compile(r"(?:%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\})\Z")
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
#: Where a large layer may be cut: within no encoded run.
APART = re.compile(r"(?<=\S)[ \t]+(?=\S)|[^\s\w+/=%\\{}:\"'-]")

#: A layer that unpacks to more than this is reported as a bomb and scanned in parts.
MAX_LAYER = 1 << 26
#: Characters of such a part, and how far back the next one starts.
PART, BACK = 1 << 22, 1 << 16
#: An escape character that is escaped over and over: each step takes one of the repeated
#: parts away. A text may be one such chain, so these steps are not made one by one, but for
#: the last ones. No kind of secret starts within the parts, but for hex in the first.
CHAIN = re.compile(r"%(?:25){33,}|\\(?:(?:u005[cC]){33,}|(?:x5[cC]){33,})")
LAST = 32

Span = tuple[int, int, str]


def matches(text: str) -> list[Span]:
    """Spans (start, end, kind) of one layer, leftmost and non-overlapping per kind.
    A maximal run that is too short can't hold a longer one, so the lengths of access
    and hex runs are in their patterns; a short value of an assignment still uses up
    its characters, so that length is checked afterwards."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


class Layer:
    """A text, and where it comes from: segments (start, end, step), each from some character
    on. With a step, each character stands for so many of the source, one after the
    other from ``start`` on; without, all stand for the range from ``start`` to ``end``
    together. The source is the original, or what ``out`` maps to it: so the characters
    of a base64 text need no entry each."""

    def __init__(self, text: str, at: list[int] | None = None, segments: list[tuple[int, int, int]] | None = None, out=None):
        self.text, self.out = text, out
        self.at, self.segments = ([0], [(0, len(text), 1)]) if segments is None else (at, segments)

    @classmethod
    def within(cls, text: str, whole: tuple[int, int]) -> Layer:
        """One that stands for a range of the original as a whole."""
        return cls(text, [0], [(*whole, 0)])

    @property
    def fine(self) -> bool:
        """Whether its parts are known to come from parts of the original."""
        return len(self.segments) > 1 or self.segments[0][2] > 0

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The range of the source that characters stand for."""
        k = bisect_right(self.at, start) - 1
        a, _, step = self.segments[k]
        j = bisect_right(self.at, end - 1) - 1
        c, d, other = self.segments[j]
        return a + (start - self.at[k]) * step, c + (end - self.at[j]) * other if other else d

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The same of the original."""
        found = self.source(start, end)
        return self.out(*found) if self.out else found

    def rewritten(self, pattern: re.Pattern, decode) -> Layer | None:
        """This layer with the runs of ``pattern`` decoded; none if nothing decodes.
        ``decode`` gives (characters, start, end, step), offsets within the run: with a step,
        one character for each so many, else all for the range."""
        parts: list[str] = []
        at: list[int] = []
        segments: list[tuple[int, int, int]] = []
        last = size = changed = 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            if a == b:
                return
            parts.append(self.text[a:b])
            k = bisect_right(self.at, a) - 1
            while k < len(self.at) and self.at[k] < b:
                first = max(a, self.at[k])
                start, end, step = self.segments[k]
                at.append(size + first - a)
                segments.append((start + (first - self.at[k]) * step, end, step))
                k += 1
            size += b - a

        for m in pattern.finditer(self.text):
            if not (found := decode(m[0])):
                continue
            keep(last, m.start())
            for c, a, b, step in found:
                a, b = m.start() + a, m.start() + b
                parts.append(c)
                k = bisect_right(self.at, a) - 1
                inner = self.segments[k][2]
                if not step:
                    at.append(size)
                    segments.append((*self.source(a, b), 0))
                elif inner and (k + 1 == len(self.at) or b <= self.at[k + 1]):  # all from one segment
                    at.append(size)
                    segments.append((*self.source(a, b), step * inner))
                else:
                    at.extend(range(size, size + len(c)))
                    segments.extend((*self.source(x, x + step), 0) for x in range(a, b, step))
                size += len(c)
            last, changed = m.end(), 1
        if not changed:
            return None
        keep(last, len(self.text))
        text = "".join(parts)
        return Layer(text, at or [0], segments or [(0, 0, 0)], self.out) if self.fine else Layer.within(text, self.span(0, len(self.text)))

    def settled(self) -> Layer:
        """This layer with all its URL and Unicode escapes decoded to the end, those that
        only come about by decoding as well, in one pass: an escape is decoded as soon as
        its last character is there, and its character may be the last of another one."""
        out: list[str] = []
        ends: list[tuple[int, int]] = []

        def put(c: str, at: tuple[int, int]) -> None:
            out.append(c)
            ends.append(at)
            while (found := _escape_at_end(out)) is not None:
                n, c = found
                whole = (ends[-n][0], ends[-1][1])
                del out[-n:], ends[-n:]
                out.append(c)
                ends.append(whole)

        k = 0
        for m in ESCAPE_START.finditer(self.text):
            at = m.start()
            if at < k:
                continue
            out.extend(self.text[k:at])
            ends.extend((x, x + 1) for x in range(k, at))
            k = at
            # From an escape's start on, one character after another, until all is plain again.
            plain = 0
            while k < len(self.text) and plain < 12:
                n = len(out)
                put(self.text[k], (k, k + 1))
                plain = 0 if len(out) <= n or out[-1] in "%\\" else plain + 1
                k += 1
        out.extend(self.text[k:])
        ends.extend((x, x + 1) for x in range(k, len(self.text)))
        text = "".join(out)
        text = "".join("\ufffd" if 0xD800 <= ord(c) < 0xE000 else c for c in text)
        if not self.fine:
            return Layer.within(text, self.span(0, len(self.text)))
        at, segments, last = [], [], -1
        for n, (a, b) in enumerate(ends):
            x, y = self.span(a, b)
            if not (y - x == 1 and n and last == x and segments[-1][2]):
                at.append(n)
                segments.append((x, y, int(y - x == 1)))
            last = y if y - x == 1 else -1
        return Layer(text, at or [0], segments or [(0, 0, 0)])


def _escape_at_end(out: list[str]) -> tuple[int, str] | None:
    """(number of characters, what they stand for) of an escape that ends here."""
    c = out[-1]
    if "\udc80" <= c <= "\udcff":  # a byte that isn't a character by itself
        for n in (2, 3, 4):
            if len(out) >= n and all("\udc80" <= x <= "\udcff" for x in out[-n:]):
                try:
                    return n, bytes(ord(x) - 0xDC00 for x in out[-n:]).decode()
                except UnicodeDecodeError:
                    pass
        return None
    if "\udc00" <= c < "\ue000" or c not in HEX_DIGITS and c != "}":
        return None
    tail = "".join(out[-10:])
    if m := ESCAPE_END.search(tail):
        code = int(next(x for x in m.groups() if x), 16)
        if m[1]:
            return 3, chr(code) if code < 0x80 else chr(0xDC00 + code)
        if 0xDC00 <= code < 0xE000 and (n := m.end() - m.start()) < len(out) and "\ud800" <= out[-n - 1] < "\udc00":
            return n + 1, chr(0x10000 + ((ord(out[-n - 1]) - 0xD800) << 10) + code - 0xDC00)
        if code <= 0x10FFFF:
            return m.end() - m.start(), "\ufffd" if 0xDC00 <= code < 0xE000 else chr(code)
    return None


def _url(run: str) -> list[tuple[str, int, int, int]]:
    """Decoded characters of a run of %XX; bytes that aren't UTF-8 stay as written."""
    raw = bytes.fromhex(run.replace("%", ""))
    out: list[tuple[str, int, int, int]] = []
    i = 0
    while i < len(raw):
        if m := ASCII_RUN.match(raw, i):
            out.append((m[0].decode(), 3 * i, 3 * m.end(), 3))
            i = m.end()
            continue
        n = 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4
        try:
            out.append((raw[i : i + n].decode(), 3 * i, 3 * (i + n), 0))
            i += n
        except UnicodeDecodeError:
            out.append((run[3 * i : 3 * i + 3], 3 * i, 3 * i + 3, 1))
            i += 1
    return out


def _unicode(run: str) -> list[tuple[str, int, int, int]]:
    """Decoded characters of a run of \\uXXXX and the like; surrogate pairs join."""
    out: list[tuple[str, int, int, int]] = []
    for same in UNICODE_SAME.finditer(run):  # escapes of one width
        width, codes = WIDTHS[same.lastgroup], [int(x[1], 16) for x in UNICODE_ONE.finditer(run, same.start(), same.end())]
        if not any(0xD800 <= c < 0xE000 or c > 0x10FFFF for c in codes) and width:
            out.append(("".join(map(chr, codes)), same.start(), same.end(), width))
            continue
        for m in UNICODE_ONE.finditer(run, same.start(), same.end()):
            code = int(m[1], 16)
            if 0xDC00 <= code < 0xE000 and out and len(out[-1][0]) == 1 and 0xD800 <= ord(out[-1][0]) < 0xDC00:
                high, start, _, _ = out.pop()
                out.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00), start, m.end(), 0))
            elif code <= 0x10FFFF:
                out.append((chr(code), m.start(), m.end(), 0))
            else:
                out.append((m[0], m.start(), m.end(), 1))
    return [("\ufffd" if len(c) == 1 and 0xD800 <= ord(c) < 0xE000 else c, a, b, step) for c, a, b, step in out]


class Packed:
    """Compressed data, and the range of the original that they stand for."""

    def __init__(self, raw: bytes, whole: tuple[int, int]):
        self.raw, self.whole = raw, whole


def _packed(raw: bytes) -> bool:
    """Whether data start like gzip, zlib, bzip2 or xz data; some text does, too."""
    return raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0) or raw[:3] == b"BZh" or raw[:6] == b"\xfd7zXZ\0"


class _Inflate:
    """Unpacks one member; ``left`` is what a call didn't take."""

    def __init__(self, raw: bytes, bare: bool = False):
        self.left, self.deflate = b"", not (raw[:3] == b"BZh" or raw[:6] == b"\xfd7zXZ\0")
        self.d = zlib.decompressobj(-15 if bare else 47) if self.deflate else bz2.BZ2Decompressor() if raw[:3] == b"BZh" else lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=1 << 28)

    def decompress(self, data: bytes, most: int) -> bytes:
        out = self.d.decompress(data, most)
        self.left = self.d.unused_data if self.d.eof else self.d.unconsumed_tail if self.deflate else b""
        return out

    @property
    def hungry(self) -> bool:
        return self.deflate or self.d.needs_input


BROKEN = (zlib.error, OSError, lzma.LZMAError, EOFError)


def _inflated(parts: Iterable[bytes], most: int = 1 << 20) -> Iterator[bytes]:
    """What packed data unpack to, member after member, in pieces of about ``most`` bytes.
    From where they are broken, or go on as something else, bytes stay as they are."""
    d, data, plain = None, b"", False
    for piece in (p[at : at + 4096] for p in parts for at in range(0, len(p), 4096)):
        data += piece
        while data:
            if plain:
                yield data
                data = b""
                continue
            if d is None:
                data = data.lstrip(b"\0")  # fills up between members
                if len(data) < 6:
                    break
                if not _packed(data):
                    plain, data = True, b"\n" + data
                    continue
                d = _Inflate(data)
            before = d.d.copy() if d.deflate else None
            try:
                out = d.decompress(data, most)
            except BROKEN:
                if before is not None:
                    yield from _until_broken(before, data)
                plain, data = True, b"\n" + data
                continue
            if out:
                yield out
            while not d.d.eof and not d.hungry:
                try:
                    if not (out := d.decompress(b"", most)):
                        break
                except BROKEN:
                    break
                yield out
            data, d = (d.left, None) if d.d.eof else (d.left, d)
    if data:
        if d is None and not plain and _packed(data):
            d = _Inflate(data)
            try:
                data, out = b"", d.decompress(data, most)
                yield out
            except BROKEN:
                d = None
        if data:
            yield b"\n" + data
    if d is not None and d.deflate and not plain and (out := d.d.flush()):
        yield out


def _until_broken(d, data: bytes) -> Iterator[bytes]:
    for k in range(len(data)):
        try:
            out = d.decompress(data[k : k + 1])
        except zlib.error:
            return
        if out:
            yield out


def _bare(raw: bytes) -> bool:
    """Whether data are deflated without any mark: they unpack to their very end, to
    text. Little is tried, and what isn't deflated breaks at once."""
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(raw, 1 << 16)
        while d.unconsumed_tail and not d.eof:
            d.decompress(d.unconsumed_tail, 1 << 16)
    except zlib.error:
        return False
    if not d.eof or d.unused_data or len(out) < 4:
        return False
    try:
        out[: len(out) - 4 if len(out) == 1 << 16 else None].decode()
    except UnicodeDecodeError:
        return False
    return True


def _head(parts: Iterator[bytes], size: int) -> tuple[bytes, bool]:
    """The first parts, up to more than ``size`` bytes, and whether that is all."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p)
        if n > size:
            return b"".join(held), False
    return b"".join(held), True


def unpacked(layer: Packed, limit: int) -> Iterator[Layer | Packed | None]:
    """The layers directly inside packed data; None stands for a bomb. What is larger
    than ``limit`` isn't held: it is unpacked as far as it is packed, and given in parts.
    A run without a place to cut it within ``limit`` characters is cut nevertheless.
    Text may look like packed data, so the data themselves are a layer as well."""
    yield Layer.within(layer.raw.decode(errors="replace"), layer.whole)
    parts = _inflated([layer.raw])
    head, ended = _head(parts, limit)
    if ended:
        yield Packed(head, layer.whole) if _packed(head) else Layer.within(head.decode(errors="replace"), layer.whole)
        return
    yield None
    while _packed(head):
        parts = _inflated(chain([head], parts))
        head, _ = _head(parts, 2)
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    held, n, want = [], 0, min(PART, limit)
    for piece in chain((head[at : at + (1 << 20)] for at in range(0, len(head), 1 << 20)), parts):
        held.append(decode(piece))
        n += len(held[-1])
        if n < want:
            continue
        text = "".join(held)
        cut = _apart(text)
        if cut <= min(BACK, limit // 4):
            if n < limit:
                held, want = [text], min(2 * n, limit)
                continue
            cut = n
        yield Layer.within(text[:cut], layer.whole)
        held = [text[max(0, cut - min(BACK, limit // 4)) :]]
        n, want = len(held[0]), len(held[0]) + min(PART, limit)
    held.append(decode(b"", True))
    yield Layer.within("".join(held), layer.whole)


def _apart(text: str) -> int:
    """The last place where a text can be cut, or 0."""
    for size in (1 << 10, 1 << 16, len(text)):
        last = max(0, len(text) - size)
        at = 0
        for m in APART.finditer(text, last):
            at = m.end()
        if at:
            return at
    return 0


def _runs(text: str, m: re.Match) -> list[list[tuple[int, int]]]:
    """Lines that may be one base64 text together: all lines of a match, those that are
    of one length but for a shorter last one, and each line by itself."""
    lines = [x.span() for x in LINE.finditer(text, m.start(), m.end())]
    if len(lines) == 1:
        a, b = lines[0]
        # A part of a path or of a name may be base64 by itself.
        parts = [x.span() for x in PART_OF_PATH.finditer(text, a, b)] if "/" in m[0] or "-" in m[0] or "_" in m[0] else []
        return [lines, *([x] for x in dict.fromkeys(parts) if x != (a, b))]
    groups: list[list[tuple[int, int]]] = []
    width, full = 0, True
    for a, b in lines:
        if full or b - a > width or text.startswith("H4sI", a):  # gzip data start so
            groups.append([])
            width, full = b - a, False
        groups[-1].append((a, b))
        full = b - a < width
    return [lines, *(g for g in groups if 1 < len(g) < len(lines)), *([x] for x in lines if x[1] - x[0] >= 16)]


class Steps:
    """The layers between one whose only escape is a chain of ``parts`` equal parts, and that of
    its last ones, one for each part less. They have the secrets of that layer at the same
    places in the original; what else there is starts behind the escape character."""

    def __init__(self, layer: Layer, m: re.Match):
        self.layer, self.start, self.unit = layer, m.start() + 1, m[0][1:6] if m[0][1] == "u" else m[0][1:4] if m[0][1] == "x" else m[0][1:3]
        same = re.compile(f"(?:{self.unit})+").match(layer.text, self.start)
        self.parts = (same.end() - self.start) // len(self.unit)
        self.run, self.last = BASE64.match(layer.text, self.start), LAST

    @classmethod
    def of(cls, layer: Layer) -> Steps | None:
        """Those of a layer, if there is one chain and no other escape, and if no more than
        the first line of base64 depends on its length."""
        m = CHAIN.search(layer.text) if "%2525" in layer.text or "\\" in layer.text else None
        if m is None or sum(1 for p in (URL, UNICODE) for _ in p.finditer(layer.text)) != 1:
            return None
        steps = cls(layer, m)
        plain = steps.parts > LAST and steps.run and not re.search(r"[/_\s-]", steps.run[0])
        first = (URL if m[0][0] == "%" else UNICODE).match(layer.text, m.start())
        return steps if plain and first and first.end() == steps.start + len(steps.unit) else None

    @property
    def number(self) -> int:
        return self.parts - self.last

    @property
    def key(self) -> tuple:
        """What layers with more and less parts have in common."""
        text, end = self.layer.text, self.start + self.parts * len(self.unit)
        return hashlib.sha256(utf8(text[: self.start])).digest(), self.unit, hashlib.sha256(utf8(text[end:])).digest(), self.layer.span(0, len(text))

    def spans(self) -> Iterator[Span]:
        if self.unit == "25":
            end = HEX.match(self.layer.text, self.start).end()
            for k in range(1, self.number + 1):
                yield *self.layer.span(self.start + 2 * k, end), "hex"

    def inside(self) -> Iterator[Layer | Packed]:
        """Layers of base64 that start with the chain, and the layer with the last parts. Of runs that
        start a multiple of four characters later, data are the end of the former's: where those
        hold nothing that is a secret or encoded, these don't either, unless they are packed."""
        layer, text, n = self.layer, self.layer.text, len(self.unit)
        a, b = LINE.match(text, self.start).span()
        known: dict[int, tuple[int, bytes, int]] = {}
        for k in range(1, self.number + 1):
            at = self.start + k * n
            first, data, upto = known.get(at % 4, (at, b"", -1))
            skip = (at - first) // 4 * 3
            if skip > upto:
                yield from _decoded(layer, [(at, b)], layer.span(at, self.run.end()))
                if at % 4 not in known:
                    data, inner = _base64(text[at:b])[0], ""
                    inner = data.decode(errors="replace")
                    barren = not any(p.search(inner) for p in (ASSIGN, ACCESS, HEX, URL, UNICODE, BASE64))
                    # Up to where a character that can't be decoded is in what is left.
                    known[at % 4] = at, data, len(data) - len(utf8(inner[inner.rfind("\ufffd") + 1 :])) - 4 if barren and "\ufffd" in inner else -1
                continue
            raw = data[skip:]
            if _packed(raw):
                yield Packed(raw, layer.span(at, self.run.end()))
            elif _bare(raw):
                yield Packed(b"\x1f\x8b\x08" + bytes(7) + raw, layer.span(at, self.run.end()))
        # One step before the last parts begin, as a layer like others.
        cut, at = self.number * n, self.start - 1
        if not layer.fine:
            yield Layer.within(text[: self.start] + text[self.start + cut :], layer.span(0, len(text)))
            return

        def run(found: str) -> list[tuple[str, int, int, int]]:
            return [(found[0], 0, 1 + cut, 0)]

        yield layer.rewritten(re.compile(re.escape(text[at]) + f"(?:{self.unit}){{{self.number}}}"), run)


def _base64(token: str) -> tuple[bytes, int]:
    """The data, and how many characters stand for them: six bits alone are no byte."""
    token = token.replace("-", "+").replace("_", "/")
    size = len(token) - (len(token) % 4 == 1)
    return base64.b64decode(token[:size] + "=" * (-size % 4)), size


def _decoded(layer: Layer, lines: list[tuple[int, int]], whole: tuple[int, int]) -> Iterator[Layer | Packed]:
    """The layers directly inside lines of base64."""
    raw, size = _base64("".join([layer.text[a:b] for a, b in lines]))
    if _packed(raw):
        yield Packed(raw, whole)
        return
    inner = raw.decode(errors="replace")
    if "\ufffd" in inner and _bare(raw):
        yield Packed(b"\x1f\x8b\x08" + bytes(7) + raw, whole)  # as gzip data without their end
    if layer.fine and inner.isascii() and inner:
        yield Layer(inner, out=_within_base64(layer, lines, size))
    else:
        yield Layer.within(inner, whole)


def unwrapped(layer: Layer, steps: Steps | None) -> Iterator[Layer | Packed | Steps]:
    """The layers directly inside one, of which ``steps`` are known."""
    text = layer.text
    if steps:
        yield steps
    else:
        url = layer.rewritten(URL, _url) if "%" in text else None
        code = layer.rewritten(UNICODE, _unicode) if "\\" in text else None
        yield from filter(None, (url, code))
    for m in BASE64.finditer(text):
        for lines in _runs(text, m):
            yield from _decoded(layer, lines, layer.span(lines[0][0], m.end() if text[lines[-1][1] : m.end()].strip("=") == "" else lines[-1][1]))


def _within_base64(layer: Layer, lines: list[tuple[int, int]], size: int):
    """What maps characters of a decoded base64 text to the original: each three bytes
    stand for four characters, of which there are ``size`` in these lines of a layer."""
    upto = [0]
    for a, b in lines:
        upto.append(upto[-1] + b - a)

    def place(k: int) -> int:
        n = bisect_right(upto, k) - 1
        return lines[n][0] + k - upto[n]

    return lambda a, b: layer.span(place(a * 8 // 6), place(min(size, (b * 8 + 5) // 6) - 1) + 1)


def _key(item: Layer | Packed) -> tuple:
    """What tells a layer from others, without holding long ones."""
    if isinstance(item, Packed):
        return (True, hashlib.sha256(item.raw).digest(), item.whole)
    long = len(item.text) > 4096
    return (False, hashlib.sha256(utf8(item.text)).digest() if long else item.text, item.span(0, len(item.text)) if item.text else None)


def _counted(text: str) -> bool:
    return text != "" and "\ufffd" not in text and CONTROL.search(text) is None


def scan(text: str | None, limit: int = MAX_LAYER) -> tuple[list[Span], list[Span], int, int]:
    """(base spans, all spans, number of layers, number of bombs) of one text. Base
    spans are those of the text itself. Both lists are sorted by start, then kind as
    listed, then end; spans that several layers give are there once. All layers are
    scanned; only those without control and undecodable characters are counted."""
    order = {k: n for n, k in enumerate(KINDS)}
    seen, spans, base, layers, bombs = set(), set(), [], 0, 0
    chains: dict[tuple, int] = {}  # parts from which on all steps are made
    work: list[Iterator[Layer | Packed | Steps | None]] = [iter([Layer(text or "")])]
    while work:
        for item in work[-1]:
            break
        else:
            work.pop()
            continue
        if item is None:
            bombs += 1
            continue
        if isinstance(item, Steps):
            spans.update(item.spans())
            layers += item.number - 1 if _counted(item.layer.text) else 0  # the last one comes as a layer
            work.append(item.inside())
            continue
        key = _key(item)
        if key in seen:
            continue
        first = not seen
        seen.add(key)
        if isinstance(item, Packed):
            work.append(unpacked(item, limit))
            continue
        if steps := Steps.of(item):
            made = chains.get(steps.key, 0)
            if steps.parts < made:
                continue
            chains[steps.key], steps.last = steps.parts, max(LAST, made)
        layers += first or _counted(item.text)
        found = matches(item.text)
        base = found if first else base
        spans.update((*item.span(a, b), k) for a, b, k in found)
        work.append(unwrapped(item, steps))
    by = lambda s: (s[0], order[s[2]], s[1])
    return sorted(base, key=by), sorted(spans, key=by), layers, bombs


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """``text`` with each maximal run of overlapping spans replaced by ``mark``."""
    out, last, end = [], 0, -1
    for a, b, _ in sorted(spans):
        if a >= end:
            if end >= 0:
                out.append(mark)
                last = end
            out.append(text[last:a])
            end = b
        end = max(end, b)
    return "".join([*out, mark, text[end:]]) if end >= 0 else text


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_bombs long, redacted string"


def secret_scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = True, limit: int = MAX_LAYER) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, then n_assign, n_access, n_hex
    (secrets of the text itself), base_sha256 (of their kind:start:end list), spans (all,
    those of decoded layers too, as offsets in the text), n_layers, n_bombs and, if
    ``with_text``, redacted (the text with all spans replaced).

    A null text is an empty one, and its redacted text null. Rows are independent: an
    empty table, repeated rows and further columns change nothing. ``keep`` may name
    any columns but the added ones.
    """
    kept = docs.select(*keep, F.col(text).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    out = ", ".join([*fields, SCHEMA if with_text else SCHEMA.rpartition(",")[0]])

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("_text")
            for part in slices(b, at, 512, 1 << 22):
                rows = []
                for t in part.column(at).to_pylist():
                    base, spans, layers, bombs = scan(t, limit)
                    n = [sum(k == s[2] for s in base) for k in KINDS]
                    rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), layers, bombs, t if t is None else redacted(t, spans) if with_text else None))
                cols = list(zip(*rows, strict=True))[: 8 if with_text else 7]
                types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
                arrays = [part.column(i) for i in range(at)] + [pa.array(c, t) for c, t in zip(cols, types, strict=False)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:at], *"n_assign n_access n_hex base_sha256 spans n_layers n_bombs redacted".split()[: len(cols)]])

    return kept.mapInArrow(run, out)


__all__ = ["joined", "matches", "redacted", "scan", "secret_scan"]
