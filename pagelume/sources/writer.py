"""Writing PDF files: pages from images, stamped text, replaced images, reordered pages.

Every function takes and gives bytes, so that a table of files is rewritten by
``over_files`` in parallel.  Objects are numbered in the order in which the
catalog reaches them and the cross reference is the classic one, so equal
input gives equal output.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from pagelume.sources import content as C
from pagelume.sources.pdf import Document, Name, Ref, Stream, Unreadable

_PLAIN = frozenset(range(33, 127)) - frozenset(b"#/()<>[]{}%")


def _number(x: float) -> str:
    if isinstance(x, int) or float(x).is_integer():
        return str(int(x))
    return f"{x:.6f}".rstrip("0").rstrip(".")


def serialized(x: object) -> bytes:
    """One object in file syntax."""
    if x is None:
        return b"null"
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, Ref):
        return b"%d %d R" % x
    if isinstance(x, (int, float)):
        return _number(x).encode()
    if isinstance(x, Name):
        return b"/" + b"".join(bytes([c]) if c in _PLAIN else b"#%02X" % c for c in x.encode("latin-1", "replace"))
    if isinstance(x, bytes):
        return b"<" + x.hex().encode() + b">"
    if isinstance(x, list):
        return b"[" + b" ".join(map(serialized, x)) + b"]"
    if isinstance(x, dict):
        return b"<<" + b" ".join(serialized(Name(k)) + b" " + serialized(v) for k, v in x.items()) + b">>"
    if isinstance(x, Stream):
        return serialized(x.facts | {"Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream"
    raise TypeError(f"{type(x).__name__} can't be written")


def written_file(objects: dict[int, object], trailer: dict) -> bytes:
    """A whole file of numbered objects; raises if one refers to an object that isn't there."""
    out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for number, x in sorted(objects.items()):
        for ref in references(x):
            if ref.number not in objects:
                raise Unreadable(f"object {number} refers to {ref.number}, which isn't there")
        at[number] = len(out)
        out += b"%d 0 obj\n" % number + serialized(x) + b"\nendobj\n"
    size, table = max(objects, default=0) + 1, len(out)
    out += b"xref\n0 %d\n" % size
    for n in range(size):
        out += b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n"
    return bytes(out + b"trailer\n" + serialized(trailer | {"Size": size}) + b"\nstartxref\n%d\n%%%%EOF\n" % table)


def references(x: object) -> Iterator[Ref]:
    """References directly within an object."""
    if isinstance(x, Ref):
        yield x
    elif isinstance(x, Stream):
        yield from references(x.facts)
    elif isinstance(x, dict):
        for v in x.values():
            yield from references(v)
    elif isinstance(x, list):
        for v in x:
            yield from references(v)


class _Copy:
    """Objects carried from documents into a new numbering."""

    def __init__(self) -> None:
        self.objects: dict[int, object] = {}
        self.known: dict[tuple[int, int], Ref] = {}

    def add(self, x: object) -> Ref:
        n = len(self.objects) + 1
        self.objects[n] = x
        return Ref(n, 0)

    def moved(self, d: Document, x: object, swap: dict[int, object] | None = None) -> object:
        """``x`` of document ``d`` with all that it refers to; ``swap`` has objects that stand in for numbered ones."""
        todo: list[tuple[int, int]] = []

        def carry(v: object) -> object:
            if isinstance(v, Ref):
                key = (id(d), v.number)
                if key not in self.known:
                    self.known[key] = self.add(None)
                    todo.append((v.number, self.known[key].number))
                return self.known[key]
            if isinstance(v, Stream):
                return Stream({k: carry(y) for k, y in v.facts.items() if k != "Length"}, v.raw)
            if isinstance(v, dict):
                return {k: carry(y) for k, y in v.items()}
            if isinstance(v, list):
                return [carry(y) for y in v]
            return v

        out = carry(x)
        while todo:
            number, place = todo.pop()
            self.objects[place] = carry((swap or {}).get(number, d.get(Ref(number, 0))))
        return out

    def finish(self, pages: list[dict], info: object = None) -> bytes:
        root = self.add({})
        kids = []
        tree = self.add({})
        for p in pages:
            kids.append(self.add({k: v for k, v in p.items() if k != "Parent"} | {"Type": Name("Page"), "Parent": tree}))
        self.objects[tree.number] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
        self.objects[root.number] = {"Type": Name("Catalog"), "Pages": tree}
        return written_file(self.objects, {"Root": root} | ({"Info": info} if info else {}))


def _page_facts(d: Document, n: int) -> dict:
    return {k: v for k, v in d.page_refs[n - 1][1].items() if k != "Parent"}


class Raster(NamedTuple):
    """Samples of an image: ``filter`` is None for raw ones, which are deflated here."""

    width: int
    height: int
    data: bytes
    bits: int = 8
    colour_space: str = "DeviceGray"
    filter: str | None = None

    def stream(self) -> Stream:
        facts = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": self.width, "Height": self.height, "BitsPerComponent": self.bits, "ColorSpace": Name(self.colour_space)}
        if self.filter is None:
            return Stream(facts | {"Filter": Name("FlateDecode")}, zlib.compress(self.data, 9))
        return Stream(facts | {"Filter": Name(self.filter)}, self.data)


def check_raster(r: Raster) -> str | None:
    """What is wrong with an image, or None: sizes, depth, and for raw samples their number."""
    if r.width <= 0 or r.height <= 0:
        return "an image needs a positive width and height"
    if r.bits not in (1, 2, 4, 8):
        return f"{r.bits} bits per component"
    channels = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}.get(r.colour_space)
    if channels is None:
        return f"colour space {r.colour_space}"
    if r.filter not in (None, "FlateDecode", "DCTDecode", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode"):
        return f"filter {r.filter}"
    if r.filter in (None, "FlateDecode"):
        try:
            data = r.data if r.filter is None else zlib.decompress(r.data)
        except zlib.error:
            return "the samples don't inflate"
        need = -(-r.width * channels * r.bits // 8) * r.height
        if len(data) != need:
            return f"{len(data)} bytes of samples, {need} needed"
    return None


def build(rasters: list[Raster], dpi: float = 300.0, page: tuple[float, float] | None = None) -> bytes:
    """A file with an image on each page: at its size in points, or fitted into the middle of ``page``."""
    if not rasters:
        raise ValueError("a file needs a page")
    copy, pages = _Copy(), []
    for r in rasters:
        if wrong := check_raster(r):
            raise ValueError(wrong)
        w, h = r.width * 72 / dpi, r.height * 72 / dpi
        pw, ph = page or (w, h)
        k = min(pw / w, ph / h) if page else 1.0
        cm = " ".join(map(_number, (w * k, 0, 0, h * k, (pw - w * k) / 2, (ph - h * k) / 2)))
        image, body = copy.add(r.stream()), copy.add(Stream({}, f"q {cm} cm /Im0 Do Q".encode()))
        pages.append({"MediaBox": [0, 0, pw, ph], "Resources": {"XObject": {"Im0": image}}, "Contents": body})
    return copy.finish(pages)


class Pick(NamedTuple):
    """A page of a source file (both from 0 and 1), turned by quarter turns or straightened by degrees."""

    source: int
    page: int
    rotate: int = 0
    straighten: float = 0.0


def check_pick(p: Pick, pages: list[int]) -> str | None:
    """What is wrong with a pick from files of so many ``pages``, or None."""
    if not 0 <= p.source < len(pages):
        return f"no source {p.source}"
    if not 1 <= p.page <= pages[p.source]:
        return f"no page {p.page}"
    if p.rotate not in (0, 90, 180, 270):
        return f"a turn of {p.rotate} degrees"
    return None if math.isfinite(p.straighten) else "an angle that is no number"


def _around(d: Document, contents: object, before: bytes, after: bytes) -> list:
    parts = d.get(contents)
    parts = parts if isinstance(parts, list) else [contents] if contents is not None else []
    return [Stream({}, before), *parts, Stream({}, after)]


def wrapped(d: Document, n: int, matrix: tuple[float, ...]) -> list:
    """Contents of page ``n`` under ``matrix``, with its own open states closed."""
    b = C.balance(d.page(n)["content"])
    before = b"q " * b["surplus"] + b"q " + " ".join(map(_number, matrix)).encode() + b" cm\n"
    return _around(d, d.page_refs[n - 1][1].get("Contents"), before, b"\n" + b"Q " * (b["depth"] + 1))


def assemble(sources: list[bytes], picks: list[Pick]) -> bytes:
    """Pages of several files, in the order of ``picks``."""
    docs = [Document(s) for s in sources]
    sizes = [len(d.page_refs) for d in docs]
    if wrong := next((w for p in picks if (w := check_pick(p, sizes))), None):
        raise ValueError(wrong)
    copy, pages = _Copy(), []
    for p in picks:
        d = docs[p.source]
        facts = _page_facts(d, p.page)
        if p.straighten:
            box = d.page(p.page)["crop"]
            cx, cy, t = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, math.radians(p.straighten)
            c, s = math.cos(t), math.sin(t)
            facts["Contents"] = wrapped(d, p.page, (c, s, -s, c, cx - c * cx + s * cy, cy - s * cx - c * cy))
        new = copy.moved(d, facts)
        if isinstance(new.get("Contents"), list):
            new["Contents"] = [copy.add(x) if isinstance(x, Stream) else x for x in new["Contents"]]
        if p.rotate:
            new["Rotate"] = (d.page(p.page)["rotate"] + p.rotate) % 360
        pages.append(new)
    return copy.finish(pages)


def replace_images(data: bytes, new: dict[int, Raster]) -> bytes:
    """The file with the images of these object numbers replaced: all of them, or none if one can't be."""
    d = Document(data)
    for number, r in new.items():
        old = d.get(Ref(number, 0))
        if not isinstance(old, Stream) or d.of(old.facts, "Subtype") != "Image":
            raise ValueError(f"object {number} is no image")
        facts = d.image_facts(old)
        if facts["smask"] or facts["mask"] or facts["image_mask"]:
            raise ValueError(f"image {number} is masked")
        if wrong := check_raster(r):
            raise ValueError(wrong)
    copy = _Copy()
    swap = {n: r.stream() for n, r in new.items()}
    return copy.finish([copy.moved(d, _page_facts(d, n), swap) for n in range(1, len(d.page_refs) + 1)])


class Word(NamedTuple):
    text: str
    box: tuple[float, float, float, float]


def stamp(data: bytes, page: int, words: list[Word]) -> bytes:
    """The file with ``words`` as invisible text on a page, each as wide and high as its box."""
    d = Document(data)
    body = [b"BT 3 Tr"]
    for w in words:
        width, height = w.box[2] - w.box[0], w.box[3] - w.box[1]
        if width <= 0 or height <= 0 or not w.text:
            raise ValueError(f"no room for {w.text!r}")
        # Courier is 600 thousandths of the size wide at every sign
        scale = 100 * width / (0.6 * height * len(w.text))
        text = w.text.encode("cp1252")
        body.append(f"/PLT {_number(height)} Tf {_number(round(scale, 4))} Tz 1 0 0 1 {_number(w.box[0])} {_number(w.box[1])} Tm".encode() + b" <" + text.hex().encode() + b"> Tj")
    copy, pages = _Copy(), []
    for n in range(1, len(d.page_refs) + 1):
        facts = _page_facts(d, n)
        if n == page:
            b = C.balance(d.page(n)["content"])
            facts["Contents"] = _around(d, facts.get("Contents"), b"q " * (b["surplus"] + 1), b"\n" + b"Q " * (b["depth"] + 1) + b"\n" + b"\n".join([*body, b"ET"]))
            resources = d.of(facts, "Resources", dict) or {}
            fonts = (d.of(resources, "Font", dict) or {}) | {"PLT": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": Name("WinAnsiEncoding")}}
            facts["Resources"] = resources | {"Font": fonts}
        new = copy.moved(d, facts)
        if isinstance(new.get("Contents"), list):
            new["Contents"] = [copy.add(x) if isinstance(x, Stream) else x for x in new["Contents"]]
        pages.append(new)
    return copy.finish(pages)


def with_properties(data: bytes, properties: dict[str, str]) -> bytes:
    """The file with entries of its information dictionary set."""
    d, copy = Document(data), _Copy()
    pages = [copy.moved(d, _page_facts(d, n)) for n in range(1, len(d.page_refs) + 1)]
    old = d.of(d.trailer, "Info", dict) or {}
    info = copy.moved(d, dict(old)) | {k: b"\xfe\xff" + v.encode("utf-16-be") for k, v in properties.items()}
    return copy.finish(pages, copy.add(info))


def optimize(data: bytes) -> tuple[bytes, str]:
    """(the smaller of the file and the file rewritten, how it was left): unreached objects go, plain streams are deflated.

    The state is '' for a file that stays, 'rewritten-delinearized' if the
    rewrite lost the input's linearization, 'rewritten' otherwise.
    """
    d, copy = Document(data), _Copy()
    if d.encryption()["encrypted"]:
        return data, ""
    small = {}
    for n in d.where:
        s = d.get(Ref(n, 0))
        if isinstance(s, Stream) and "Filter" not in s.facts:
            small[n] = Stream(s.facts | {"Filter": Name("FlateDecode")}, zlib.compress(s.raw, 9))
    pages = [copy.moved(d, _page_facts(d, n), small) for n in range(1, len(d.page_refs) + 1)]
    info = d.of(d.trailer, "Info", dict)
    out = copy.finish(pages, copy.add(copy.moved(d, dict(info))) if info else None)
    how = "rewritten-delinearized" if b"/Linearized" in data[:1024] else "rewritten"
    return (out, how) if len(out) < len(data) else (data, "")


def over_files(files: DataFrame, change: Callable[[bytes], bytes]) -> DataFrame:
    """(path, content, error) of ``change`` on each file (path, content); a file that can't be changed keeps its bytes and says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for data in batch.column("content").to_pylist():
                try:
                    out.append(change(data or b""))
                    errors.append(None)
                except (Unreadable, C.Broken, zlib.error, ValueError, KeyError, TypeError, IndexError, RecursionError) as e:
                    out.append(data)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("path").cast(pa.string()), pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=["path", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, error string")
