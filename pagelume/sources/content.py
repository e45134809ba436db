"""Content streams: tokens, and what a page places and paints.

``scan`` runs the graphics state over a stream and returns placements, paths
and counts; it never raises: a stream that breaks off keeps what it had.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

MAX_OPERANDS, MAX_DEPTH = 8192, 8

_LEX = re.compile(
    rb"(?P<skip>[\x00\t\n\x0c\r ]+|%[^\r\n]*)"
    rb"|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|/(?P<name>[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|(?P<open>\()|(?P<dict><<|>>)|<(?P<hex>[^>]*)>?|(?P<mark>[\[\]{}])"
    rb"|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<stray>[)>])"
)
_PREFIX = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Token(NamedTuple):
    """kind: number, name, string, mark, word or inline (a whole inline image)."""

    kind: str
    value: object


class Broken(ValueError):
    """The stream can't be read on."""


def literal(src: bytes, at: int) -> tuple[bytes, int]:
    """Bytes of the string whose parenthesis opens at ``at``, and where it ends."""
    out, depth, i = bytearray(), 1, at + 1
    while i < len(src):
        c = src[i : i + 1]
        if c == b"\\":
            n = src[i + 1 : i + 2]
            digits = re.match(rb"[0-7]{1,3}", src[i + 1 : i + 4])
            if digits:
                out.append(int(digits.group(), 8) & 255)
                i += 1 + len(digits.group())
                continue
            if n in b"\r\n" and n:
                i += 3 if src[i + 1 : i + 3] == b"\r\n" else 2
                continue
            out += _ESCAPES.get(n, n)
            i += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), i + 1
        out += c
        i += 1
    raise Broken("a string doesn't end")


def hex_string(digits: bytes) -> bytes:
    kept = re.sub(rb"[^0-9A-Fa-f]", b"", digits)
    return bytes.fromhex((kept + b"0" * (len(kept) % 2)).decode())


def name(raw: bytes) -> str:
    return re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m.group(1), 16)]), raw).decode("latin-1")


def tokens(src: bytes) -> Iterator[Token]:
    """Tokens of a content stream; raises Broken where it can't go on."""
    i = 0
    while i < len(src):
        m = _LEX.match(src, i)
        if not m:
            raise Broken(f"no token at {i}")
        i, kind = m.end(), m.lastgroup
        if kind == "open":
            value, i = literal(src, m.start())
            yield Token("string", value)
        elif kind == "number":
            yield Token("number", float(_PREFIX.match(m.group()).group()))
        elif kind == "name":
            yield Token("name", name(m.group("name")))
        elif kind == "hex":
            yield Token("string", hex_string(m.group("hex")))
        elif kind in ("mark", "dict"):
            yield Token("mark", m.group().decode())
        elif kind == "word":
            word = m.group().decode("latin-1")
            if word == "BI":
                facts, i = _inline(src, i)
                yield Token("inline", facts)
            else:
                yield Token("word", word)


_SHORT = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "F": "Filter", "IM": "ImageMask", "D": "Decode", "DP": "DecodeParms", "I": "Interpolate"}
_COMPONENTS = {"G": 1, "DeviceGray": 1, "RGB": 3, "DeviceRGB": 3, "CMYK": 4, "DeviceCMYK": 4}


def _inline(src: bytes, i: int) -> tuple[dict, int]:
    """(dictionary, end) of an inline image after BI: unfiltered data is skipped by its size, other data up to EI."""
    facts: dict[str, object] = {}
    key, depth = None, 0
    while True:
        m = _LEX.match(src, i)
        if not m:
            raise Broken("an inline image doesn't begin")
        i, kind = m.end(), m.lastgroup
        if kind == "word" and m.group() == b"ID":
            break
        if kind == "open":
            _, i = literal(src, m.start())
        elif kind == "mark":
            depth += m.group() == b"["
            depth -= m.group() == b"]"
            if not depth:
                key = None
        elif kind in ("name", "number", "word"):
            value = name(m.group("name")) if kind == "name" else float(_PREFIX.match(m.group()).group()) if kind == "number" else m.group().decode("latin-1")
            if key is None and kind == "name" and not depth:
                key = _SHORT.get(value, value)
            elif key is not None:
                facts.setdefault(key, value)
                if not depth:
                    key = None
    i += 1  # the white space after ID
    if "Filter" not in facts:
        bits = 1 if facts.get("ImageMask") == "true" else int(facts.get("BitsPerComponent", 8)) * _COMPONENTS.get(str(facts.get("ColorSpace", "G")), 1)
        size = -(-int(facts.get("Width", 0)) * bits // 8) * int(facts.get("Height", 0))
        end = re.compile(rb"[\x00\t\n\x0c\r ]*EI(?=[\x00\t\n\x0c\r ]|$)").match(src, i + size)
        if end:
            return facts, end.end()
    end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(src, i - 1)
    if not end:
        raise Broken("an inline image doesn't end")
    return facts, end.end()


# --- geometry -------------------------------------------------------------

Matrix = tuple[float, float, float, float, float, float]
Box = tuple[float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def product(a: Matrix, b: Matrix) -> Matrix:
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def point(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def bounds(points: list[tuple[float, float]]) -> Box:
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


def mapped(box: Box, m: Matrix) -> Box:
    return bounds([point(m, x, y) for x in (box[0], box[2]) for y in (box[1], box[3])])


def common(a: Box, b: Box) -> Box:
    x, y = max(a[0], b[0]), max(a[1], b[1])
    return x, y, max(x, min(a[2], b[2])), max(y, min(a[3], b[3]))


# --- interpreter ----------------------------------------------------------


@dataclass(frozen=True)
class XObject:
    """An image (id), or a form with its stream, matrix, scope and box."""

    image: bool
    id: int = -1
    content: bytes = b""
    matrix: Matrix = IDENTITY
    scope: object = None
    bbox: Box | None = None


@dataclass
class Scan:
    images: list[dict] = field(default_factory=list)
    paints: list[dict] = field(default_factory=list)
    text_chars: int = 0
    text_ops: int = 0
    inked_text_ops: int = 0
    shading_ops: int = 0
    inline_imgs: int = 0
    unresolved: list[str] = field(default_factory=list)
    error: str | None = None

    @property
    def order(self) -> int:
        return len(self.images) + len(self.paints) + 1


@dataclass
class _State:
    ctm: Matrix = IDENTITY
    opaque: bool = True
    mode: int = 0
    width: float = 1.0
    fill: tuple = (None, ())
    stroke: tuple = (None, ())
    clip: Box | None = None

    def copy(self) -> _State:
        return _State(**self.__dict__)


_STROKES = {"S", "s", "B", "B*", "b", "b*"}
_PAINTS = _STROKES | {"f", "F", "f*"}
_COLOURS = {"g": "DeviceGray", "rg": "DeviceRGB", "k": "DeviceCMYK"}

Lookup = Callable[[object, str], XObject | None]
Opaque = Callable[[object, str], bool]


def scan(src: bytes, scope: object = None, xobject: Lookup = lambda s, n: None, opaque: Opaque = lambda s, n: True) -> Scan:
    """Everything a content stream shows."""
    out = Scan()
    try:
        _run(src, scope, xobject, opaque, _State(), 0, out)
    except Broken as e:
        out.error = str(e)
    return out


def _run(src: bytes, scope: object, xobject: Lookup, opaque: Opaque, gs: _State, depth: int, out: Scan) -> None:
    if depth > MAX_DEPTH:
        raise Broken(f"forms are nested deeper than {MAX_DEPTH}")
    stack: list[_State] = []
    path: list[tuple[float, float]] = []
    args: list[Token] = []
    clipping = False
    for token in tokens(src):
        if token.kind == "inline":
            out.inline_imgs += 1
            args.clear()
            continue
        if token.kind != "word":
            if len(args) < MAX_OPERANDS:
                args.append(token)
            continue
        op = token.value
        numbers = [a.value for a in args if a.kind == "number"]
        last = args[-1] if args else None
        if op == "q":
            stack.append(gs.copy())
        elif op == "Q":
            if stack:
                gs = stack.pop()
        elif op == "cm":
            if len(args) >= 6 and all(a.kind == "number" for a in args[-6:]):
                gs.ctm = product(tuple(a.value for a in args[-6:]), gs.ctm)
        elif op == "gs":
            if last and last.kind == "name":
                gs.opaque = gs.opaque and opaque(scope, last.value)
        elif op == "Tr":
            if last and last.kind == "number":
                gs.mode = int(last.value)
        elif op == "w":
            if numbers:
                gs.width = numbers[-1]
        elif op in _COLOURS:
            gs.fill = (_COLOURS[op], tuple(numbers))
        elif op.lower() in _COLOURS and op.isupper():
            gs.stroke = (_COLOURS[op.lower()], tuple(numbers))
        elif op in ("cs", "CS"):
            space = next((a.value for a in reversed(args) if a.kind == "name"), "")
            if op == "cs":
                gs.fill = (space, ())
            else:
                gs.stroke = (space, ())
        elif op in ("sc", "scn"):
            gs.fill = (gs.fill[0], tuple(numbers))
        elif op in ("SC", "SCN"):
            gs.stroke = (gs.stroke[0], tuple(numbers))
        elif op in ("m", "l", "c", "v", "y"):
            path += [point(gs.ctm, x, y) for x, y in zip(numbers[::2], numbers[1::2])]
        elif op == "re":
            if len(numbers) >= 4:
                x, y, w, h = numbers[-4:]
                path += [point(gs.ctm, a, b) for a in (x, x + w) for b in (y, y + h)]
        elif op in ("W", "W*"):
            clipping = True
        elif op == "n" or op in _PAINTS:
            before = gs.clip
            if clipping and path:
                box = bounds(path)
                gs.clip = box if gs.clip is None else common(gs.clip, box)
            clipping = False
            if path and op != "n":
                box = bounds(path)
                if op in _STROKES:
                    r = gs.width * math.sqrt(abs(gs.ctm[0] * gs.ctm[3] - gs.ctm[1] * gs.ctm[2])) / 2
                    box = (box[0] - r, box[1] - r, box[2] + r, box[3] + r)
                out.paints.append({"op": op, "box": box, "clip": before, "ctm": gs.ctm, "ord": out.order, "fill": gs.fill, "stroke": gs.stroke})
            path = []
        elif op == "Do":
            if last and last.kind == "name":
                _place(last.value, scope, xobject, opaque, gs, depth, out)
        elif op in ("Tj", "'", '"', "TJ"):
            out.text_ops += 1
            out.inked_text_ops += gs.mode not in (3, 7)
            strings = [len(a.value) for a in args if a.kind == "string"]
            out.text_chars += sum(strings) if op == "TJ" else sum(strings[-1:])
        elif op == "sh":
            out.shading_ops += 1
        args.clear()


def _place(key: str, scope: object, xobject: Lookup, opaque: Opaque, gs: _State, depth: int, out: Scan) -> None:
    x = xobject(scope, key)
    if x is None:
        out.unresolved.append(key)
        return
    if x.image:
        box = mapped((0.0, 0.0, 1.0, 1.0), gs.ctm)
        if gs.clip is not None:
            box = common(gs.clip, box)
        out.images.append({"name": key, "id": x.id, "ctm": gs.ctm, "box": box, "clip": gs.clip, "opaque": gs.opaque, "ord": out.order})
        return
    inner = gs.copy()
    inner.ctm = product(x.matrix, gs.ctm)
    if x.bbox is not None:
        box = mapped(x.bbox, inner.ctm)
        inner.clip = box if gs.clip is None else common(gs.clip, box)
    _run(x.content, x.scope, xobject, opaque, inner, depth + 1, out)


def balance(src: bytes) -> dict:
    """q/Q balance of a stream: final depth, Q without q, and the error that ended it."""
    depth = surplus = 0
    error = None
    try:
        for t in tokens(src):
            if t.kind == "word" and t.value == "q":
                depth += 1
            elif t.kind == "word" and t.value == "Q":
                if depth:
                    depth -= 1
                else:
                    surplus += 1
    except Broken as e:
        error = str(e)
    return {"has_content": bool(src.strip()), "depth": depth, "surplus": surplus, "error": error}


def net_matrix(src: bytes) -> Matrix:
    """The matrix that a stream leaves behind for what follows it."""
    ctm, stack, args = IDENTITY, [], []
    try:
        for t in tokens(src):
            if t.kind != "word":
                args.append(t)
                continue
            if t.value == "q":
                stack.append(ctm)
            elif t.value == "Q" and stack:
                ctm = stack.pop()
            elif t.value == "cm" and len(args) >= 6 and all(a.kind == "number" for a in args[-6:]):
                ctm = product(tuple(a.value for a in args[-6:]), ctm)
            args.clear()
    except Broken:
        pass
    return ctm
