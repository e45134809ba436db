"""JBIG2 (ITU-T T.88) with arithmetic coding: generic regions both ways, symbols and text one way.

``encode_generic`` writes an embedded stream of one lossless region, with
template 0 and typical prediction.  ``decode`` reads page information, generic
regions of all templates, symbol dictionaries and text regions; Huffman
coding, refinement, halftones and MMR are refused by name.  What a stream
would cost is counted from its headers before anything is decoded.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

MAX_PIXELS = 1 << 26
MAX_SYMBOLS = 1 << 16
MAX_INSTANCES = 1 << 20


class Refused(ValueError):
    """A stream that isn't decoded; the message says why."""


# --- arithmetic coding (annex E) --------------------------------------------

_QE = [
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
]


class Contexts:
    """Adaptive states: index into the table of estimates, and the likelier bit."""

    def __init__(self, n: int) -> None:
        self.index, self.bit = [0] * n, [0] * n


class Encoder:
    def __init__(self) -> None:
        self.a, self.c, self.ct, self.out = 0x8000, 0, 12, bytearray([0])

    def put(self, cx: Contexts, k: int, d: int) -> None:
        qe, nmps, nlps, switch = _QE[cx.index[k]]
        self.a -= qe
        if d == cx.bit[k]:
            if self.a & 0x8000:
                self.c += qe
                return
            if self.a < qe:
                self.a = qe
            else:
                self.c += qe
            cx.index[k] = nmps
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            cx.bit[k] ^= switch
            cx.index[k] = nlps
        while True:
            self.a <<= 1
            self.c <<= 1
            self.ct -= 1
            if not self.ct:
                self._byte()
            if self.a & 0x8000:
                return

    def _byte(self) -> None:
        if self.out[-1] != 0xFF and self.c >= 0x8000000:
            self.out[-1] += 1
            if self.out[-1] == 0xFF:
                self.c &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20 & 0xFF)
            self.c &= 0xFFFFF
            self.ct = 7
        else:
            self.out.append(self.c >> 19 & 0xFF)
            self.c &= 0x7FFFF
            self.ct = 8

    def finish(self) -> bytes:
        last = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= last:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self._byte()
        if self.out[-1] == 0xFF:
            self.out.pop()
        return bytes(self.out[1:]) + b"\xff\xac"


class Decoder:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0
        self.c = (self._get(0)) << 16
        self.ct = 0
        self._byte()
        self.c <<= 7
        self.ct -= 7
        self.a = 0x8000

    def _get(self, i: int) -> int:
        return self.data[i] if i < len(self.data) else 0xFF

    def _byte(self) -> None:
        if self._get(self.at) == 0xFF:
            if self._get(self.at + 1) > 0x8F:
                self.c += 0xFF00
                self.ct = 8
            else:
                self.at += 1
                self.c += self._get(self.at) << 9
                self.ct = 7
        else:
            self.at += 1
            self.c += self._get(self.at) << 8
            self.ct = 8

    def get(self, cx: Contexts, k: int) -> int:
        qe, nmps, nlps, switch = _QE[cx.index[k]]
        self.a -= qe
        if (self.c >> 16) < qe:
            less = self.a < qe
            self.a = qe
            d = cx.bit[k] if less else 1 - cx.bit[k]
            likely = less
        else:
            self.c -= qe << 16
            if self.a & 0x8000:
                return cx.bit[k]
            likely = self.a >= qe
            d = cx.bit[k] if likely else 1 - cx.bit[k]
        if likely:
            cx.index[k] = nmps
        else:
            cx.bit[k] ^= switch
            cx.index[k] = nlps
        while True:
            if not self.ct:
                self._byte()
            self.a <<= 1
            self.c = (self.c << 1) & 0xFFFFFFFF
            self.ct -= 1
            if self.a & 0x8000:
                return d


_RANGES = ((2, 0), (4, 4), (6, 20), (8, 84), (12, 340), (32, 4436))


class Integers:
    """Arithmetic integers (annex A); None stands for out of band."""

    def __init__(self) -> None:
        self.cx = Contexts(512)

    def get(self, d: Decoder) -> int | None:
        prev = 1

        def bit() -> int:
            nonlocal prev
            b = d.get(self.cx, prev)
            prev = prev << 1 | b if prev < 256 else ((prev << 1 | b) & 511) | 256
            return b

        sign, k = bit(), 0
        while k < 5 and bit():
            k += 1
        bits, base = _RANGES[k]
        v = 0
        for _ in range(bits):
            v = v << 1 | bit()
        v += base
        return (None if v == 0 else -v) if sign else v


class Ids:
    def __init__(self, bits: int) -> None:
        self.bits, self.cx = bits, Contexts(1 << (bits + 1))

    def get(self, d: Decoder) -> int:
        prev = 1
        for _ in range(self.bits):
            prev = prev << 1 | d.get(self.cx, prev)
        return prev - (1 << self.bits)


# --- generic regions (6.2) ---------------------------------------------------

USUAL = (((3, -1), (-3, -1), (2, -2), (-2, -2)), ((3, -1),), ((2, -1),), ((2, -1),))
_TYPICAL = (0x9B25, 0x0795, 0x00E5, 0x0195)


def _places(template: int, at: tuple) -> list[tuple[int, int]]:
    """Neighbours from the highest context bit down, as figures 3 to 6 number them."""
    if template == 0:
        return [at[3], (-1, -2), (0, -2), (1, -2), at[2], at[1], (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), at[0], (-4, 0), (-3, 0), (-2, 0), (-1, 0)]
    if template == 1:
        return [(-1, -2), (0, -2), (1, -2), (2, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), at[0], (-3, 0), (-2, 0), (-1, 0)]
    if template == 2:
        return [(-1, -2), (0, -2), (1, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), at[0], (-2, 0), (-1, 0)]
    return [(-3, -1), (-2, -1), (-1, -1), (0, -1), (1, -1), at[0], (-4, 0), (-3, 0), (-2, 0), (-1, 0)]


_PAD = 130


def _above(ink: np.ndarray, y: int, places: list[tuple[int, int]], w: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Context bits of row ``y`` that come from earlier rows, for all x at once; and the (shift, dx) of those within the row."""
    total, inside = np.zeros(w, np.int64), []
    n = len(places)
    for i, (dx, dy) in enumerate(places):
        if dy == 0:
            inside.append((n - 1 - i, dx))
        elif y + dy >= 0:
            total |= ink[y + dy, _PAD + dx : _PAD + dx + w].astype(np.int64) << (n - 1 - i)
    return total.tolist(), inside


def encode_generic(ink: np.ndarray, template: int = 0, typical: bool = True) -> bytes:
    """Coded data of one region."""
    h, w = ink.shape
    wide = np.pad(ink.astype(np.uint8), ((0, 0), (_PAD, _PAD)))
    e, cx, places = Encoder(), Contexts(1 << 16), _places(template, USUAL[template])
    was, blank = 0, np.zeros(w, np.uint8)
    for y in range(h):
        if typical:
            same = int(np.array_equal(ink[y], ink[y - 1] if y else blank))
            e.put(cx, _TYPICAL[template], same ^ was)
            was = same
            if same:
                continue
        above, inside = _above(wide, y, places, w)
        row = [0] * _PAD + ink[y].astype(int).tolist()
        for x in range(w):
            k = above[x]
            for shift, dx in inside:
                k |= row[_PAD + x + dx] << shift
            e.put(cx, k, row[_PAD + x])
    return e.finish()


def decode_generic(d: Decoder, w: int, h: int, template: int, typical: bool, at: tuple, cx: Contexts) -> np.ndarray:
    wide = np.zeros((h, w + 2 * _PAD), np.uint8)
    places, same = _places(template, at), 0
    for y in range(h):
        if typical:
            same ^= d.get(cx, _TYPICAL[template])
            if same:
                if y:
                    wide[y] = wide[y - 1]
                continue
        above, inside = _above(wide, y, places, w)
        row = [0] * (_PAD + w)
        for x in range(w):
            k = above[x]
            for shift, dx in inside:
                k |= row[_PAD + x + dx] << shift
            row[_PAD + x] = d.get(cx, k)
        wide[y, _PAD : _PAD + w] = row[_PAD:]
    return wide[:, _PAD : _PAD + w].astype(bool)


# --- segments (7) --------------------------------------------------------------


class Segment(NamedTuple):
    number: int
    kind: int
    refers: tuple[int, ...]
    page: int
    data: bytes


_NAMES = {0: "symbol-dictionary", 4: "text-region", 6: "text-region", 7: "text-region", 16: "pattern-dictionary", 20: "halftone-region", 22: "halftone-region", 23: "halftone-region"}
_NAMES |= {36: "generic-region", 38: "generic-region", 39: "generic-region", 40: "refinement-region", 42: "refinement-region", 43: "refinement-region", 48: "page-information"}
_NAMES |= {49: "end-of-page", 50: "end-of-stripe", 51: "end-of-file", 52: "profiles", 53: "tables", 62: "extension"}


def segments(data: bytes) -> list[Segment]:
    """Segments of an embedded stream, in order."""
    out, i = [], 0
    try:
        while i < len(data):
            number, flags, count = struct.unpack_from(">IBB", data, i)
            i += 5
            n = count >> 5
            if n == 7:
                n = struct.unpack_from(">I", data, i)[0] & 0x1FFFFFFF
                i += 4 + (n + 8) // 8
            else:
                i += 1
            size = 1 if number <= 256 else 2 if number <= 65536 else 4
            if n * size > len(data):
                raise Refused("a segment refers to more segments than there is room for")
            refers = tuple(int.from_bytes(data[i + k * size : i + (k + 1) * size], "big") for k in range(n))
            i += n * size
            width = 4 if flags & 0x40 else 1
            page = int.from_bytes(data[i : i + width], "big")
            i += width
            (length,) = struct.unpack_from(">I", data, i)
            i += 4
            if length == 0xFFFFFFFF:
                raise Refused("a segment of unknown length")
            if i + length > len(data):
                raise Refused("a segment goes on beyond the end")
            out.append(Segment(number, flags & 63, refers, page, data[i : i + length]))
            i += length
    except struct.error:
        raise Refused("a segment header is cut off") from None
    return out


def _segment(number: int, kind: int, body: bytes, refers: tuple[int, ...] = ()) -> bytes:
    return struct.pack(">IBB", number, kind, len(refers) << 5) + bytes(refers) + b"\x01" + struct.pack(">I", len(body)) + body


def embedded(ink: np.ndarray) -> bytes:
    """A stream of page information and one generic region."""
    h, w = ink.shape
    if not 0 < w * h <= MAX_PIXELS:
        raise Refused(f"an image of {w} x {h}")
    at = b"".join(struct.pack(">bb", *p) for p in USUAL[0])
    region = struct.pack(">IIIIB", w, h, 0, 0, 0) + bytes([8]) + at + encode_generic(ink)
    return _segment(0, 48, struct.pack(">IIIIBH", w, h, 0, 0, 0, 0)) + _segment(1, 38, region)


def profile(data: bytes, shared: bytes = b"") -> list[dict]:
    """(number, kind, name, coding, template, bytes) of each segment, from the headers alone."""
    out = []
    for s in segments(shared) + segments(data):
        coding, template = None, None
        if s.kind in (36, 38, 39) and len(s.data) > 17:
            f = s.data[17]
            coding, template = ("mmr", None) if f & 1 else ("arithmetic", f >> 1 & 3)
        elif s.kind == 0 and len(s.data) > 1:
            f = int.from_bytes(s.data[:2], "big")
            coding, template = ("huffman" if f & 1 else "arithmetic") + ("-refined" if f & 2 else ""), f >> 10 & 3
        elif s.kind in (4, 6, 7) and len(s.data) > 18:
            f = int.from_bytes(s.data[17:19], "big")
            coding = ("huffman" if f & 1 else "arithmetic") + ("-refined" if f & 2 else "")
        out.append({"number": s.number, "kind": s.kind, "name": _NAMES.get(s.kind, "unknown"), "coding": coding, "template": template, "bytes": len(s.data)})
    return out


def _page_size(all_: list[Segment]) -> tuple[int, int, int]:
    first = next((s for s in all_ if s.kind == 48), None)
    if first is None or len(first.data) < 17:
        raise Refused("no page information")
    w, h = struct.unpack_from(">II", first.data)
    if h == 0xFFFFFFFF:
        ends = [s for s in all_ if s.kind == 50]
        if not ends:
            raise Refused("a page of unknown height")
        h = int.from_bytes(ends[-1].data[:4], "big") + 1
    if not 0 < w * h <= MAX_PIXELS:
        raise Refused(f"a page of {w} x {h}")
    return w, h, first.data[16]


def plan(data: bytes, shared: bytes = b"") -> dict:
    """(width, height, pixels): what decoding would cost; raises Refused beyond the limits."""
    every = segments(shared) + segments(data)
    w, h, _ = _page_size(every)
    pixels = 0
    for s in every:
        if s.kind in (16, 20, 22, 23, 40, 42, 43, 53):
            raise Refused(f"segment type {s.kind}")
        if s.kind in (4, 6, 7, 36, 38, 39):
            rw, rh = struct.unpack_from(">II", s.data)
            pixels += rw * rh
            if pixels > 4 * MAX_PIXELS:
                raise Refused("regions of too many pixels")
    return {"width": w, "height": h, "pixels": pixels}


def _combine(page: np.ndarray, part: np.ndarray, x: int, y: int, how: int) -> None:
    """Or, and, exclusive or, its complement, or replacement of the part of ``page`` that ``part`` covers."""
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + part.shape[1], page.shape[1]), min(y + part.shape[0], page.shape[0])
    if x1 <= x0 or y1 <= y0:
        return
    new, old = part[y0 - y : y1 - y, x0 - x : x1 - x], page[y0:y1, x0:x1]
    page[y0:y1, x0:x1] = (old | new, old & new, old ^ new, ~(old ^ new), new)[how]


def _adaptive(data: bytes, i: int, template: int) -> tuple[tuple, int]:
    n = len(USUAL[template])
    at = tuple(struct.unpack_from(">bb", data, i + 2 * k) for k in range(n))
    if any(dy > 0 or (dy == 0 and dx >= 0) for dx, dy in at):
        raise Refused("an adaptive pixel that isn't decoded yet")
    return at, i + 2 * n


def _symbols(s: Segment, before: list[np.ndarray]) -> list[np.ndarray]:
    flags = int.from_bytes(s.data[:2], "big")
    if flags & 1:
        raise Refused("Huffman symbols")
    if flags & 2:
        raise Refused("refined symbols")
    template = flags >> 10 & 3
    at, i = _adaptive(s.data, 2, template)
    exported, new = struct.unpack_from(">II", s.data, i)
    if new > MAX_SYMBOLS or exported > len(before) + new:
        raise Refused("too many symbols")
    d, cx = Decoder(s.data[i + 8 :]), Contexts(1 << 16)
    dh, dw, ex = Integers(), Integers(), Integers()
    out, height, spent, classes = list(before), 0, 0, 0
    while len(out) < len(before) + new:
        step, classes = dh.get(d), classes + 1
        if step is None or classes > MAX_SYMBOLS:
            raise Refused("height classes without heights or symbols")
        height += step
        width = 0
        while (grow := dw.get(d)) is not None:
            width += grow
            spent += max(width, 0) * max(height, 0)
            if width < 0 or height < 0 or spent > MAX_PIXELS or len(out) >= len(before) + new:
                raise Refused("a symbol of an impossible size")
            out.append(decode_generic(d, width, height, template, False, at, cx))
    kept, i, on, last = [], 0, False, None
    while i < len(out):
        run = ex.get(d)
        if run is None or run < 0 or i + run > len(out) or run == last == 0:
            raise Refused("a broken export run")
        if on:
            kept += out[i : i + run]
        i, on, last = i + run, not on, run
    if len(kept) != exported:
        raise Refused("the exported symbols don't add up")
    return kept


def _text(s: Segment, symbols: list[np.ndarray], w: int, h: int) -> np.ndarray:
    flags = int.from_bytes(s.data[17:19], "big")
    if flags & 1:
        raise Refused("Huffman text")
    if flags & 2:
        raise Refused("refined text")
    log_strips, corner, turned, how, paper = flags >> 2 & 3, flags >> 4 & 3, flags >> 6 & 1, flags >> 7 & 3, flags >> 9 & 1
    offset = (flags >> 10 & 31) - (32 if flags >> 10 & 16 else 0)
    (count,) = struct.unpack_from(">I", s.data, 19)
    if count > MAX_INSTANCES or not symbols:
        raise Refused("too many instances, or no symbols")
    d, strips = Decoder(s.data[23:]), 1 << log_strips
    idt, ifs, ids, iit = (Integers() for _ in range(4))
    names = Ids(max(0, (len(symbols) - 1).bit_length()))
    out = np.full((h, w), bool(paper))

    def need(v: int | None) -> int:
        if v is None:
            raise Refused("an instance without a place")
        return v

    strip, first, done = -need(idt.get(d)) * strips, 0, 0
    while done < count:
        strip += need(idt.get(d)) * strips
        first += need(ifs.get(d))
        at = first
        while True:
            t = strip + (need(iit.get(d)) if strips > 1 else 0)
            n = names.get(d)
            if n >= len(symbols) or done >= count:
                raise Refused("an instance of no symbol")
            g = symbols[n]
            gh, gw = g.shape
            if turned:
                at += gh - 1 if corner in (0, 2) else 0
                x, y = (t, at - (gh - 1 if corner in (0, 2) else 0))
                x -= gw - 1 if corner in (2, 3) else 0
            else:
                at += gw - 1 if corner > 1 else 0
                x, y = at - (gw - 1 if corner > 1 else 0), t - (gh - 1 if corner in (0, 2) else 0)
            _combine(out, g, x, y, how)
            if turned:
                at += gh - 1 if corner in (1, 3) else 0
            else:
                at += gw - 1 if corner < 2 else 0
            done += 1
            gap = ids.get(d)
            if gap is None:
                break
            at += gap + offset
    return out


def decode(data: bytes, shared: bytes = b"") -> np.ndarray:
    """The page of a stream, true where inked."""
    plan(data, shared)
    every = segments(shared) + segments(data)
    w, h, flags = _page_size(every)
    page = np.full((h, w), bool(flags >> 2 & 1))
    known: dict[int, list[np.ndarray]] = {}
    try:
        for s in every:
            before = [g for n in s.refers for g in known.get(n, [])]
            if s.kind == 0:
                known[s.number] = _symbols(s, before)
            elif s.kind in (4, 6, 7, 36, 38, 39):
                rw, rh, x, y, how = struct.unpack_from(">IIIIB", s.data)
                if how & 7 > 4:
                    raise Refused("an unknown combination")
                if s.kind < 8:
                    part = _text(s, before, rw, rh)
                else:
                    f = s.data[17]
                    if f & 1:
                        raise Refused("MMR coding")
                    at, i = _adaptive(s.data, 18, f >> 1 & 3)
                    part = decode_generic(Decoder(s.data[i:]), rw, rh, f >> 1 & 3, bool(f & 8), at, Contexts(1 << 16))
                if s.kind not in (4, 36):
                    _combine(page, part, x, y, how & 7)
    except (struct.error, IndexError):
        raise Refused("a segment is cut off") from None
    return page
