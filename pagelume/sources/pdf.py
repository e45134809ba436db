"""PDF files as tables: documents, pages, placements, paths, annotations, fonts.

Own reader for classic and compressed cross references, object streams and
Flate, LZW, ASCII and run-length filters; a broken cross reference is rebuilt
by scanning.  Encrypted files are reported, not decrypted.  ``documents``
reads a folder with Spark: a file that can't be read gives a row that says so.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelume.sources import content as C


class Name(str):
    pass


class Ref(NamedTuple):
    number: int
    generation: int


class Stream(NamedTuple):
    facts: dict
    raw: bytes


class Unreadable(ValueError):
    pass


_WS = b"\x00\t\n\x0c\r "
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![A-Za-z])")
_OBJ = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj")
MAX_NESTING = 100


def parse(src: bytes, i: int = 0, depth: int = 0) -> tuple[object, int]:
    """One object from ``i`` on, and where it ends; a word that is no object gives its bytes as str."""
    if depth > MAX_NESTING:
        raise Unreadable("objects are nested too deep")
    while True:
        m = C._LEX.match(src, i)
        if not m:
            raise Unreadable("the file ends within an object")
        if m.lastgroup != "skip":
            break
        i = m.end()
    kind = m.lastgroup
    if kind == "number":
        ref = _REF.match(src, i)
        if ref:
            return Ref(int(ref.group(1)), int(ref.group(2))), ref.end()
        number = float(C._PREFIX.match(m.group()).group())
        return int(number) if number.is_integer() and b"." not in m.group() else number, m.end()
    if kind == "name":
        return Name(C.name(m.group("name"))), m.end()
    if kind == "open":
        return C.literal(src, i)
    if kind == "hex":
        return C.hex_string(m.group("hex")), m.end()
    if kind == "mark" and m.group() == b"[":
        out, i = [], m.end()
        while True:
            value, i = parse(src, i, depth + 1)
            if value == "]" and not isinstance(value, (Name, bytes)):
                return out, i
            out.append(value)
    if kind == "dict" and m.group() == b"<<":
        facts, i = {}, m.end()
        while True:
            key, i = parse(src, i, depth + 1)
            if key == ">>" and not isinstance(key, Name):
                return facts, i
            facts[str(key)], i = parse(src, i, depth + 1)
    word = m.group().decode("latin-1")
    return {"true": True, "false": False, "null": None}.get(word, word), m.end()


def _lzw(data: bytes) -> bytes:
    out, table, width, bits, n, before = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        bits, n = (bits << 8) | byte, n + 8
        while n >= width:
            code = (bits >> (n - width)) & ((1 << width) - 1)
            n -= width
            bits &= (1 << n) - 1
            if code == 256:
                table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return bytes(out)
            if not table:
                raise Unreadable("LZW data begins without a clear code")
            word = table[code] if code < len(table) else before + before[:1]
            if before:
                table.append(before + word[:1])
            out += word
            before = word
            width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def _run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~")[0]:
        if c == 122 and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += sum(x * 85 ** (4 - i) for i, x in enumerate(group)).to_bytes(5, "big")[1:]
                group = []
    if group:
        n = len(group)
        out += sum(x * 85 ** (4 - i) for i, x in enumerate(group + [84] * (5 - n))).to_bytes(5, "big")[1:n]
    return bytes(out)


def _unpredicted(data: bytes, parms: dict) -> bytes:
    predictor = parms.get("Predictor", 1)
    if predictor < 10:
        return data
    from pagelume.operators.raster import unfilter

    bits, colours, columns = parms.get("BitsPerComponent", 8), parms.get("Colors", 1), parms.get("Columns", 1)
    row = -(-bits * colours * columns // 8)
    whole = data[: len(data) // (row + 1) * (row + 1)]
    return unfilter(whole, row, max(1, bits * colours // 8)).tobytes()


_IMAGE_CODECS = {"DCTDecode": "jpg", "DCT": "jpg", "JPXDecode": "jpx", "JBIG2Decode": "jbig2", "CCITTFaxDecode": "tif", "CCF": "tif"}


class Document:
    """An open file.  Raises Unreadable if it has no pages to read."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        if b"%PDF-" not in data[:1024]:
            raise Unreadable("no PDF header")
        self.where: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.cache: dict[int, object] = {}
        try:
            self._chain()
            self.page_refs = self._pages()
        except (Unreadable, C.Broken, zlib.error, ValueError, KeyError, TypeError, IndexError):
            self._rebuild()
            self.page_refs = self._pages()

    # cross references

    def _chain(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise Unreadable("no startxref")
        nxt: object = parse(self.data, at + 9)[0]
        seen = set()
        while isinstance(nxt, int) and nxt not in seen:
            seen.add(nxt)
            i = nxt
            while self.data[i : i + 1] in _WS and i < len(self.data):
                i += 1
            facts = self._table(i) if self.data[i : i + 4] == b"xref" else self._compressed(i)
            self.trailer = facts | self.trailer
            if isinstance(facts.get("XRefStm"), int):
                self._compressed(facts["XRefStm"])
            nxt = facts.get("Prev")

    def _table(self, i: int) -> dict:
        i += 4
        head = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[ ]+(\d+)[\x00\t\n\x0c\r ]*")
        entry = re.compile(rb"(\d{10})[ ](\d{5})[ ]([nf])[\x00\t\n\x0c\r ]*")
        while m := head.match(self.data, i):
            first, n, i = int(m.group(1)), int(m.group(2)), m.end()
            for k in range(n):
                e = entry.match(self.data, i)
                if not e:
                    raise Unreadable("a cross-reference entry is broken")
                if e.group(3) == b"n":
                    self.where.setdefault(first + k, (1, int(e.group(1))))
                else:
                    self.where.setdefault(first + k, (0,))
                i = e.end()
        word, i = parse(self.data, i)
        if word != "trailer":
            raise Unreadable("no trailer")
        return parse(self.data, i)[0]

    def _compressed(self, i: int) -> dict:
        s = self._object_at(i)
        if not isinstance(s, Stream):
            raise Unreadable("no cross-reference stream")
        data, w = self.decoded(s), s.facts["W"]
        index = s.facts.get("Index", [0, s.facts["Size"]])
        at = 0
        for first, n in zip(index[::2], index[1::2]):
            for k in range(n):
                cells = []
                for size in w:
                    cells.append(int.from_bytes(data[at : at + size], "big"))
                    at += size
                kind = cells[0] if w[0] else 1
                self.where.setdefault(first + k, (kind, *cells[1:]))
        return s.facts

    def _rebuild(self) -> None:
        self.where, self.cache = {}, {}
        for m in _OBJ.finditer(self.data):
            self.where[int(m.group(1))] = (1, m.start())
        for m in re.finditer(rb"trailer", self.data):
            try:
                facts = parse(self.data, m.end())[0]
                if isinstance(facts, dict):
                    self.trailer = self.trailer | facts
            except (Unreadable, C.Broken):
                continue
        for n in list(self.where):
            o = self.get(Ref(n, 0))
            if isinstance(o, Stream) and o.facts.get("Type") == "ObjStm":
                for k, (inner, _) in enumerate(self._members(o)):
                    self.where.setdefault(inner, (2, n, k))
            if isinstance(o, dict) and o.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(n, 0))

    # objects

    def _object_at(self, i: int) -> object:
        m = _OBJ.match(self.data, i)
        if not m:
            raise Unreadable(f"no object at {i}")
        value, i = parse(self.data, m.end())
        word = re.compile(rb"[\x00\t\n\x0c\r ]*stream\r?\n?").match(self.data, i)
        if isinstance(value, dict) and word:
            size = self.get(value.get("Length"))
            raw = self.data[word.end() : word.end() + size] if isinstance(size, int) and size >= 0 else None
            if raw is None or not re.compile(rb"[\x00\t\n\x0c\r ]*endstream").match(self.data, word.end() + len(raw)):
                end = self.data.find(b"endstream", word.end())
                raw = self.data[word.end() : end if end >= 0 else len(self.data)].rstrip(b"\r\n")
            return Stream(value, raw)
        return value

    def _members(self, s: Stream) -> list[tuple[int, object]]:
        data, n, first = self.decoded(s), self.get(s.facts["N"]), self.get(s.facts["First"])
        head, i = [], 0
        for _ in range(2 * n):
            x, i = parse(data, i)
            head.append(x)
        return [(num, parse(data, first + at)[0]) for num, at in zip(head[::2], head[1::2])]

    def get(self, x: object) -> object:
        """What a reference stands for, through chains; None for a missing object."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            if x.number not in self.cache:
                entry = self.where.get(x.number, (0,))
                value = None
                self.cache[x.number] = None
                try:
                    if entry[0] == 1:
                        value = self._object_at(entry[1])
                    elif entry[0] == 2:
                        for number, member in self._members(self.get(Ref(entry[1], 0))):
                            if number == x.number:
                                value = member
                except (Unreadable, C.Broken, zlib.error, ValueError, KeyError, TypeError, IndexError):
                    value = None
                self.cache[x.number] = value
            x = self.cache[x.number]
        return None

    def of(self, facts: dict | None, key: str, kind: type | tuple = object) -> object:
        value = self.get((facts or {}).get(key))
        return value if isinstance(value, kind) else None

    def decoded(self, s: Stream, stop_at_image: bool = False) -> bytes:
        """Data of a stream; raises Unreadable for a filter that isn't read here."""
        filters = self.get(s.facts.get("Filter", s.facts.get("F"))) or []
        parms = self.get(s.facts.get("DecodeParms", s.facts.get("DP"))) or []
        filters = [filters] if isinstance(filters, Name) else [self.get(f) for f in filters]
        parms = [parms] if isinstance(parms, dict) else [self.get(p) for p in parms]
        data = s.raw
        for i, f in enumerate(filters):
            p = (parms[i] if i < len(parms) else None) or {}
            if f in ("FlateDecode", "Fl"):
                d = zlib.decompressobj()
                data = _unpredicted(d.decompress(data), p)
            elif f in ("LZWDecode", "LZW"):
                data = _unpredicted(_lzw(data), p)
            elif f in ("ASCIIHexDecode", "AHx"):
                data = C.hex_string(data.split(b">")[0])
            elif f in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
            elif f in ("RunLengthDecode", "RL"):
                data = _run_length(data)
            elif stop_at_image and f in _IMAGE_CODECS:
                return data
            else:
                raise Unreadable(f"filter {f}")
        return data

    # pages

    def _pages(self) -> list[tuple[Ref | None, dict]]:
        root = self.of(self.trailer, "Root", dict)
        if root is None:
            raise Unreadable("no catalog")
        out: list = []
        seen: set = set()

        def walk(x: object, inherited: dict, depth: int) -> None:
            node = self.get(x)
            if depth > 64 or not isinstance(node, dict) or (isinstance(x, Ref) and x in seen):
                return
            if isinstance(x, Ref):
                seen.add(x)
            here = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            kids = self.of(node, "Kids", list)
            if kids is not None and node.get("Type") != "Page":
                for kid in kids:
                    walk(kid, here, depth + 1)
            else:
                out.append((x if isinstance(x, Ref) else None, here | node))

        walk(root.get("Pages"), {}, 0)
        if not out:
            raise Unreadable("no pages")
        return out

    def box(self, value: object) -> list[float] | None:
        value = self.get(value)
        if not isinstance(value, list) or len(value) != 4:
            return None
        n = [self.get(v) for v in value]
        if not all(isinstance(v, (int, float)) for v in n):
            return None
        return [float(min(n[0], n[2])), float(min(n[1], n[3])), float(max(n[0], n[2])), float(max(n[1], n[3]))]

    def page(self, n: int) -> dict:
        """Boxes, rotation, content and resources of page ``n`` from 1; ``error`` says that the content can't be read."""
        _, facts = self.page_refs[n - 1]
        media = self.box(facts.get("MediaBox")) or [0.0, 0.0, 612.0, 792.0]
        crop = self.box(facts.get("CropBox")) or media
        rotate = self.get(facts.get("Rotate"))
        parts = self.get(facts.get("Contents"))
        parts = parts if isinstance(parts, list) else [parts]
        data, error = [], None
        for p in parts:
            s = self.get(p)
            if isinstance(s, Stream):
                try:
                    data.append(self.decoded(s))
                except (Unreadable, C.Broken, zlib.error, ValueError) as e:
                    error = f"content: {e}"
            elif p is not None:
                error = "content: a part is missing"
        return {"media": media, "crop": crop, "rotate": int(rotate) % 360 if isinstance(rotate, (int, float)) else 0, "content": b"\n".join(data), "scope": (facts,), "error": error}

    def _resource(self, scope: tuple, kind: str, key: str) -> object:
        for owner in scope:
            found = self.of(self.of(self.of(owner, "Resources", dict), kind, dict), key)
            if found is not None:
                return found, (self.of(self.of(owner, "Resources", dict), kind, dict) or {}).get(key)
        return None, None

    def xobject(self, scope: tuple, key: str) -> C.XObject | None:
        s, ref = self._resource(scope, "XObject", key)
        if not isinstance(s, Stream):
            return None
        kind = self.of(s.facts, "Subtype")
        if kind == "Image":
            number = ref.number if isinstance(ref, Ref) else -1
            self.images[number] = s
            return C.XObject(True, number)
        if kind != "Form":
            return None
        try:
            data = self.decoded(s)
        except (Unreadable, C.Broken, zlib.error, ValueError):
            return None
        m = self.of(s.facts, "Matrix", list) or []
        matrix = tuple(float(self.get(v)) for v in m) if len(m) == 6 else C.IDENTITY
        bbox = self.box(s.facts.get("BBox"))
        return C.XObject(False, content=data, matrix=matrix, scope=(s.facts, *scope), bbox=tuple(bbox) if bbox else None)

    def opaque(self, scope: tuple, key: str) -> bool:
        """A graphics state leaves paint opaque; one that isn't found doesn't."""
        gs, _ = self._resource(scope, "ExtGState", key)
        if not isinstance(gs, dict):
            return False
        alphas = [self.get(gs.get(k)) for k in ("ca", "CA")]
        mask = self.get(gs.get("SMask"))
        return all(a is None or (isinstance(a, (int, float)) and a >= 1) for a in alphas) and mask in (None, "None")

    def image_facts(self, s: Stream) -> dict:
        f = self.get(s.facts.get("Filter"))
        last = (self.get(f[-1]) if isinstance(f, list) and f else f) or ""
        n = {k: self.get(s.facts.get(k)) for k in ("Width", "Height", "BitsPerComponent")}
        space = self.get(s.facts.get("ColorSpace"))
        return {
            "width": n["Width"] if isinstance(n["Width"], int) else 0,
            "height": n["Height"] if isinstance(n["Height"], int) else 0,
            "bpc": n["BitsPerComponent"] if isinstance(n["BitsPerComponent"], int) else (1 if self.get(s.facts.get("ImageMask")) is True else 0),
            "image_mask": self.get(s.facts.get("ImageMask")) is True,
            "smask": self.get(s.facts.get("SMask")) is not None,
            "mask": self.get(s.facts.get("Mask")) is not None,
            "decode": s.facts.get("Decode") is not None,
            "filter": str(last),
            "color_space": str(space[0]) if isinstance(space, list) and space else str(space or ""),
        }

    def raw_image(self, s: Stream) -> tuple[bytes, str, bytes | None]:
        """(bytes, type, JBIG2 globals) of an image; type 'raw' for samples that decode here."""
        f = self.get(s.facts.get("Filter"))
        last = self.get(f[-1]) if isinstance(f, list) and f else f
        kind = _IMAGE_CODECS.get(last, "raw")
        parms = self.get(s.facts.get("DecodeParms"))
        parms = self.get(parms[-1]) if isinstance(parms, list) and parms else parms
        shared = self.get(parms.get("JBIG2Globals")) if isinstance(parms, dict) else None
        return self.decoded(s, stop_at_image=True), kind, self.decoded(shared) if isinstance(shared, Stream) else None

    def scan(self, n: int) -> tuple[dict, C.Scan]:
        page = self.page(n)
        self.images: dict[int, Stream] = {}
        found = C.scan(page["content"], page["scope"], self.xobject, self.opaque)
        for image in found.images:
            image |= self.image_facts(self.images[image["id"]])
        return page, found

    def annotations(self, n: int) -> list[dict]:
        out = []
        for x in self.of(self.page_refs[n - 1][1], "Annots", list) or []:
            a = self.get(x)
            if isinstance(a, dict):
                ap = self.of(a, "AP", dict)
                flags = self.get(a.get("F"))
                out.append(
                    {"subtype": str(self.of(a, "Subtype", Name) or ""), "rect": self.box(a.get("Rect")), "flags": flags if isinstance(flags, int) else 0, "has_ap": ap is not None, "has_apn": ap is not None and self.get(ap.get("N")) is not None, "has_oc": a.get("OC") is not None}
                )
        return out

    def fonts(self) -> list[dict]:
        """Every font dictionary of the file."""
        out = []
        for number in sorted(self.where):
            d = self.get(Ref(number, 0))
            if isinstance(d, dict) and d.get("Type") == "Font":
                enc = self.get(d.get("Encoding"))
                flags = self.get((self.of(d, "FontDescriptor", dict) or {}).get("Flags"))
                kind = "named" if isinstance(enc, Name) else "differences" if isinstance(enc, dict) and "Differences" in enc else "named" if isinstance(enc, dict) and "BaseEncoding" in enc else "absent"
                out.append({"subtype": str(self.of(d, "Subtype", Name) or ""), "to_unicode": d.get("ToUnicode") is not None, "encoding": kind, "symbolic": bool(isinstance(flags, int) and flags & 4)})
        return out

    def encryption(self) -> dict:
        e = self.of(self.trailer, "Encrypt", dict)
        return {"encrypted": e is not None, **{k.lower(): self.get(e.get(k)) if e else None for k in ("P", "V", "R")}}

    def properties(self) -> dict[str, str]:
        def text(v: bytes) -> str:
            return v[2:].decode("utf-16-be", "replace") if v[:2] == b"\xfe\xff" else v.decode("latin-1")

        info = self.of(self.trailer, "Info", dict) or {}
        return {k: text(v) for k, x in info.items() if isinstance(v := self.get(x), bytes)}


# --- tables ---------------------------------------------------------------

_BOX = pa.list_(pa.float64())
IMAGE = pa.struct(
    [("name", pa.string()), ("id", pa.int32()), ("ctm", _BOX), ("box", _BOX), ("clip", _BOX), ("opaque", pa.bool_()), ("ord", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("bpc", pa.int32())]
    + [(k, pa.bool_()) for k in ("image_mask", "smask", "mask", "decode")]
    + [("filter", pa.string()), ("color_space", pa.string())]
)
PAINT = pa.struct([("op", pa.string()), ("box", _BOX), ("clip", _BOX), ("ctm", _BOX), ("ord", pa.int32())])
ANNOT = pa.struct([("subtype", pa.string()), ("rect", _BOX), ("flags", pa.int32()), ("has_ap", pa.bool_()), ("has_apn", pa.bool_()), ("has_oc", pa.bool_())])
PAGE = pa.struct(
    [("page_index", pa.int32()), ("media", _BOX), ("crop", _BOX), ("rotate", pa.int32()), ("images", pa.list_(IMAGE)), ("paints", pa.list_(PAINT)), ("annots", pa.list_(ANNOT))]
    + [(k, pa.int32()) for k in ("text_chars", "text_ops", "inked_text_ops", "shading_ops", "inline_imgs")]
    + [("unresolved", pa.list_(pa.string())), ("error", pa.string()), ("q_depth", pa.int32()), ("q_surplus", pa.int32())]
)
FONT = pa.struct([("subtype", pa.string()), ("to_unicode", pa.bool_()), ("encoding", pa.string()), ("symbolic", pa.bool_())])
DOCUMENT = pa.schema(
    [("path", pa.string()), ("error", pa.string()), ("encrypted", pa.bool_()), ("p", pa.int64()), ("v", pa.int32()), ("r", pa.int32()), ("linearized", pa.bool_()), ("sha256", pa.string())]
    + [("properties", pa.map_(pa.string(), pa.string())), ("fonts", pa.list_(FONT)), ("pages", pa.list_(PAGE))]
)


def read(path: str, data: bytes) -> dict:
    """The row of one file; never raises."""
    import hashlib

    row = {k: None for k in DOCUMENT.names} | {"path": path, "linearized": b"/Linearized" in data[:1024], "sha256": hashlib.sha256(data).hexdigest()}
    try:
        d = Document(data)
        row |= {**d.encryption(), "properties": list(d.properties().items())}
        if row["encrypted"]:
            return row | {"error": "encrypted", "fonts": [], "pages": []}
        pages = []
        for n in range(1, len(d.page_refs) + 1):
            page, s = d.scan(n)
            b = C.balance(page["content"])
            pages.append(
                {"page_index": n, "media": page["media"], "crop": page["crop"], "rotate": page["rotate"], "images": s.images, "paints": [{k: p[k] for k in ("op", "box", "clip", "ctm", "ord")} for p in s.paints]}
                | {"annots": d.annotations(n), "text_chars": s.text_chars, "text_ops": s.text_ops, "inked_text_ops": s.inked_text_ops, "shading_ops": s.shading_ops, "inline_imgs": s.inline_imgs}
                | {"unresolved": s.unresolved, "error": page["error"] or s.error, "q_depth": b["depth"], "q_surplus": b["surplus"]}
            )
        return row | {"pages": pages, "fonts": d.fonts()}
    except (Unreadable, C.Broken, zlib.error, ValueError, KeyError, TypeError, IndexError, RecursionError, OverflowError) as e:
        return row | {"error": f"{type(e).__name__}: {e}", "fonts": [], "pages": []}


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [read(p, c or b"") for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())]
        yield pa.RecordBatch.from_pylist(rows, schema=DOCUMENT)


def documents(spark: SparkSession, root: str) -> DataFrame:
    """One row per PDF file below ``root``, in any letter case of the extension."""
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    return parsed(files.select("path", "content"), from_arrow_schema(DOCUMENT))


def parsed(files: DataFrame, schema=None) -> DataFrame:
    """Documents of (path, content)."""
    from pyspark.sql.pandas.types import from_arrow_schema

    return files.mapInArrow(_read_batches, schema or from_arrow_schema(DOCUMENT))


def pages(docs: DataFrame) -> DataFrame:
    """(path, page columns) of readable documents."""
    return docs.select("path", F.explode("pages").alias("p")).select("path", "p.*")


def placements(docs: DataFrame) -> DataFrame:
    """Census rows: one per placement, one of index -1 for a page without any."""
    rows = pages(docs).select("path", "page_index", F.size("images").alias("n"), F.posexplode_outer("images").alias("i", "x"))
    m = [F.col("x.ctm")[k].alias(f"m{k}") for k in range(6)]
    index = F.coalesce("i", F.lit(-1))
    return rows.select(
        F.col("path").alias("doc"), "page_index", index.alias("placement_index"), (F.col("n") - 1 == F.col("i")).alias("is_top"), F.col("n").alias("n_placements"), *m,
        F.col("x.width").alias("width"), F.col("x.height").alias("height"), ((F.col("x.bpc") == 1) | F.col("x.image_mask")).alias("bitonal"), F.col("x.filter").alias("filter"),
    )


def population(docs: DataFrame) -> DataFrame:
    """(path, unopenable, pages) as the population count takes them."""
    return docs.select("path", F.col("error").isNotNull().alias("unopenable"), F.size("pages").alias("pages"))
