"""Reading and writing of files, held against what was written."""

import json
import math
import zlib

import pytest
from pyspark.sql import functions as F

from pagelume.functions import classify as K
from pagelume.functions import geometry as G
from pagelume.operators import census
from pagelume.sources import content, pdf, sinks, writer
from pagelume.streaming import arrivals


def raster(w=30, h=40, level=7):
    return writer.Raster(w, h, bytes((x * level) % 256 for x in range(w * h)))


def plain(body: bytes, resources: dict | None = None, extra: dict | None = None, objects: dict | None = None) -> bytes:
    """A file of one page with this content."""
    page = {"Type": pdf.Name("Page"), "Parent": pdf.Ref(2, 0), "MediaBox": [0, 0, 612, 792], "Contents": pdf.Ref(4, 0), "Resources": resources or {}} | (extra or {})
    return writer.written_file(
        {1: {"Type": pdf.Name("Catalog"), "Pages": pdf.Ref(2, 0)}, 2: {"Type": pdf.Name("Pages"), "Kids": [pdf.Ref(3, 0)], "Count": 1}, 3: page, 4: pdf.Stream({}, body)} | (objects or {}), {"Root": pdf.Ref(1, 0)}
    )


IMAGE = pdf.Stream({"Type": pdf.Name("XObject"), "Subtype": pdf.Name("Image"), "Width": 8, "Height": 8, "BitsPerComponent": 8, "ColorSpace": pdf.Name("DeviceGray")}, bytes(64))


def test_built_file_reads_back():
    data = writer.build([raster(), raster(60, 20)], dpi=72)
    d = pdf.Document(data)
    assert len(d.page_refs) == 2
    page, scan = d.scan(2)
    assert page["crop"] == [0, 0, 60, 20] and page["error"] is None
    (image,) = scan.images
    assert (image["width"], image["height"], image["bpc"], image["filter"]) == (60, 20, 8, "FlateDecode")
    assert image["box"] == (0, 0, 60, 20)
    assert d.raw_image(d.images[image["id"]])[:2] == (raster(60, 20).data, "raw")
    assert data == writer.build([raster(), raster(60, 20)], dpi=72)


def test_image_is_fitted_into_the_middle():
    _, scan = pdf.Document(writer.build([raster(100, 50)], 72, (200, 200))).scan(1)
    assert scan.images[0]["box"] == (0, 50, 200, 150)


@pytest.mark.parametrize("bad", [writer.Raster(0, 4, b""), writer.Raster(4, 4, b"x"), writer.Raster(1, 1, b"x", 3), writer.Raster(1, 1, b"x", 8, "Lab"), writer.Raster(1, 1, b"x", filter="Odd"), writer.Raster(2, 2, b"xx", filter="FlateDecode")])
def test_bad_rasters_are_refused(bad):
    assert writer.check_raster(bad)
    with pytest.raises(ValueError):
        writer.build([bad])


def test_pages_are_reordered_turned_and_straightened():
    a, b = writer.build([raster(10, 20), raster(30, 40)], 72), writer.build([raster(50, 60)], 72)
    out = pdf.Document(writer.assemble([a, b], [writer.Pick(1, 1, 90), writer.Pick(0, 2), writer.Pick(0, 1, 0, 5.0), writer.Pick(0, 2)]))
    boxes = [out.page(n)["crop"][2:] for n in range(1, 5)]
    assert boxes == [[50, 60], [30, 40], [10, 20], [30, 40]]
    assert [out.page(n)["rotate"] for n in range(1, 5)] == [90, 0, 0, 0]
    _, scan = out.scan(3)
    m = scan.images[0]["ctm"]
    assert math.degrees(math.atan2(m[1], m[0])) == pytest.approx(5, abs=1e-3)
    x, y = content.point(m, 0.5, 0.5)
    assert (x, y) == (pytest.approx(5, abs=1e-3), pytest.approx(10, abs=1e-3))
    for bad in (writer.Pick(2, 1), writer.Pick(0, 3), writer.Pick(0, 1, 45), writer.Pick(0, 1, 0, math.inf)):
        with pytest.raises(ValueError):
            writer.assemble([a, b], [bad])


def test_images_are_replaced_all_or_none():
    data = writer.build([raster(), raster()], 72)
    d = pdf.Document(data)
    ids = [d.scan(n)[1].images[0]["id"] for n in (1, 2)]
    out = pdf.Document(writer.replace_images(data, {ids[0]: raster(5, 5)}))
    assert [out.scan(n)[1].images[0]["width"] for n in (1, 2)] == [5, 30]
    with pytest.raises(ValueError):
        writer.replace_images(data, {ids[0]: raster(5, 5), 999: raster()})
    with pytest.raises(ValueError):
        writer.replace_images(data, {ids[0]: writer.Raster(5, 5, b"")})


def test_stamped_text_is_invisible_and_counted():
    data = writer.build([raster()], 72)
    out = pdf.Document(writer.stamp(data, 1, [writer.Word("two", (1, 1, 10, 5)), writer.Word("(words)", (11, 1, 20, 5))]))
    _, s = out.scan(1)
    assert (s.text_ops, s.inked_text_ops, s.text_chars) == (2, 0, 10) and len(s.images) == 1
    assert out.fonts() == [] or out.fonts()[0]["encoding"] == "named"
    with pytest.raises(ValueError):
        writer.stamp(data, 1, [writer.Word("x", (1, 1, 1, 5))])


def test_properties_and_optimize():
    data = writer.with_properties(writer.build([raster()], 72), {"Title": "é 1"})
    assert pdf.Document(data).properties() == {"Title": "é 1"}
    small, how = writer.optimize(plain(b"q Q " * 500))
    assert how == "rewritten" and pdf.Document(small).page(1)["content"] == b"q Q " * 500
    again, how = writer.optimize(small)
    assert how in ("", "rewritten") and len(again) <= len(small)


def test_dangling_reference_is_refused():
    with pytest.raises(pdf.Unreadable):
        plain(b"", objects={9: [pdf.Ref(77, 0)]})


def test_broken_cross_reference_is_rebuilt():
    data = plain(b"0 0 1 1 re f").replace(b"startxref", b"startxxxx")
    assert len(pdf.Document(data).scan(1)[1].paints) == 1
    for bad in (b"", b"no file", b"%PDF-1.4\nnothing"):
        assert pdf.read("x", bad)["error"]


def test_object_streams_and_compressed_cross_references():
    inner = [serial for serial in (b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 9 9]/Rotate -90>>")]
    body, head, at = b"", b"", 0
    for n, x in enumerate(inner, 1):
        head += b"%d %d " % (n, at)
        body += x + b" "
        at = len(body)
    packed = zlib.compress(head + body)
    out = bytearray(b"%PDF-1.5\n")
    o5 = len(out)
    out += b"5 0 obj <</Type/ObjStm/N 3/First %d/Filter/FlateDecode/Length %d>>stream\n" % (len(head), len(packed)) + packed + b"\nendstream endobj\n"
    o6 = len(out)
    rows = bytes([0, 0, 0, 0]) + b"".join(bytes([2, 0, 5, k]) for k in range(3)) + bytes([0, 0, 0, 0]) + bytes([1]) + o5.to_bytes(2, "big") + b"\0" + bytes([1]) + o6.to_bytes(2, "big") + b"\0"
    out += b"6 0 obj <</Type/XRef/Size 7/W[1 2 1]/Root 1 0 R/Length %d>>stream\n" % len(rows) + rows + b"\nendstream endobj\nstartxref\n%d\n%%%%EOF" % o6
    d = pdf.Document(bytes(out))
    assert d.page(1)["crop"] == [0, 0, 9, 9] and d.page(1)["rotate"] == 270


@pytest.mark.parametrize(
    ("raw", "filters", "plain_text"),
    [
        (b"68656C6C6F>", "ASCIIHexDecode", b"hello"),
        (b"87cURDZ~>", "ASCII85Decode", b"Hello"),
        (bytes([2]) + b"abc" + bytes([254]) + b"z" + bytes([128]), "RunLengthDecode", b"abczzz"),
        (bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), "LZWDecode", bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])),
        (zlib.compress(b"flat"), "FlateDecode", b"flat"),
    ],
)
def test_filters(raw, filters, plain_text):
    d = pdf.Document(plain(b""))
    assert d.decoded(pdf.Stream({"Filter": pdf.Name(filters)}, raw)) == plain_text


def test_content_walk_counts_text_paths_forms_and_states():
    form = pdf.Stream({"Subtype": pdf.Name("Form"), "Matrix": [2, 0, 0, 2, 0, 0], "BBox": [0, 0, 10, 10], "Resources": {"XObject": {"I": pdf.Ref(11, 0)}}}, b"q 30 0 0 30 0 0 cm /I Do Q")
    body = b"""BT /F1 12 Tf (ab\\)c) Tj 3 Tr [(xy) -20 <4142>] TJ ET
    q /G gs 100 0 0 50 10 10 cm /I Do Q /X Do /Missing Do
    4 w 100 100 m 200 100 l S 0 0 5 5 re W n 10 10 50 50 re f
    BI /W 2 /H 2 /BPC 8 /CS /G ID abcd EI /Sh sh Q q"""
    res = {"XObject": {"I": pdf.Ref(11, 0), "X": pdf.Ref(10, 0)}, "ExtGState": {"G": {"ca": 0.5}}}
    d = pdf.Document(plain(body, res, objects={10: form, 11: IMAGE}))
    _, s = d.scan(1)
    assert (s.text_ops, s.inked_text_ops, s.text_chars, s.inline_imgs, s.shading_ops, s.unresolved) == (2, 1, 8, 1, 1, ["Missing"])
    assert [i["opaque"] for i in s.images] == [False, True]
    assert s.images[0]["box"] == (10, 10, 110, 60) and s.images[1]["box"] == (0, 0, 20, 20)
    assert s.paints[0]["box"] == (98, 98, 202, 102) and s.paints[1]["clip"] == (0, 0, 5, 5)
    assert content.balance(body)["surplus"] == 1 and content.balance(body)["depth"] == 1
    assert content.net_matrix(b"2 0 0 2 1 1 cm q 5 0 0 5 0 0 cm Q") == (2, 0, 0, 2, 1, 1)


def test_folder_becomes_tables(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    annots = {"Annots": [{"Subtype": pdf.Name("Ink"), "Rect": [1, 2, 30, 40], "AP": {"N": None}}, {"Subtype": pdf.Name("Popup")}]}
    fonts = {9: {"Type": pdf.Name("Font"), "Subtype": pdf.Name("Type1")}}
    (tmp_path / "a" / "scan.pdf").write_bytes(writer.build([raster()] * 3, 72))
    (tmp_path / "a" / "b" / "TEXT.PDF").write_bytes(plain(b"BT (seen) Tj ET", {"Font": {"F": pdf.Ref(9, 0)}}, annots, fonts))
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    (tmp_path / "other.txt").write_bytes(b"%PDF-")
    docs = pdf.documents(spark, str(tmp_path)).cache()
    assert census.population(pdf.population(docs)).collect()[0].asDict() == {"files": 3, "documents": 2, "unopenable": 1, "pages": 4}
    p = pdf.placements(docs)
    assert sorted((r.placement_index, r.n_placements) for r in p.collect()) == [(-1, 0), (0, 1), (0, 1), (0, 1)]
    pages = pdf.pages(docs).withColumns({"images": K.with_image_facts(F.col("images")), "paints": K.with_paint_facts(F.col("paints"))})
    reason = K.page_reason(F.col("crop"), F.col("images"), F.col("paints"), F.col("inked_text_ops"), F.col("inline_imgs"), F.col("shading_ops"), F.col("unresolved"))
    assert sorted(r.reason for r in pages.select(reason.alias("reason")).collect()) == ["", "", "", "no-image"]
    a = docs.select(F.explode("pages").alias("p")).select(F.explode("p.annots").alias("a")).select("a.*")
    assert sorted(r.subtype for r in a.collect()) == ["Ink", "Popup"]
    f = docs.select(F.explode("fonts").alias("f")).select("f.*").collect()
    assert [(x.subtype, x.encoding) for x in f] == [("Type1", "absent")]
    rewritten = writer.over_files(docs.select("path").join(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)), "path"), lambda b: writer.stamp(b, 1, [writer.Word("w", (0, 0, 5, 5))]))
    assert sorted(r.error is None for r in rewritten.collect()) == [False, True, True]
    docs.unpersist()


def test_files_that_arrive_are_read_once(spark, tmp_path):
    inbox, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    inbox.mkdir()
    for k in range(2):
        (inbox / f"{k}.pdf").write_bytes(writer.build([raster()] * (k + 1), 72))
        arrivals.to_table(arrivals.arriving(spark, str(inbox)), str(out), str(ck)).start().awaitTermination(120)
        assert spark.read.parquet(str(out)).count() == k + 1
    q = arrivals.running_population(arrivals.arriving(spark, str(inbox))).writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").collect()[0].asDict() == {"files": 2, "unopenable": 0, "pages": 3}


def test_lines_and_tables_are_ordered(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, i, "a\tb" if i else None, float("nan") if i == 3 else i / 8) for i in range(50)], "k int, i int, s string, d double")
    sinks.write_lines(df, str(tmp_path / "l"), "k", "i")
    lines = [json.loads(x) for f in sorted((tmp_path / "l").glob("part-*")) for x in f.read_text().splitlines()]
    assert [(x["k"], x["i"]) for x in lines] == sorted((i % 7, i) for i in range(50))
    assert "s" not in next(x for x in lines if x["i"] == 0)
    assert sinks.read_lines(spark, str(tmp_path / "l"), "i int").agg(F.sum("i")).first()[0] == 1225
    sinks.write_table(df, str(tmp_path / "t"), "i")
    text = [x.split("\t") for f in sorted((tmp_path / "t").glob("part-*")) for x in f.read_text().splitlines() if not x.startswith("k\t")]
    assert text[0] == ["0", "0", "-", "0"] and text[3] == ["3", "3", "a b", "-"] and text[5][3] == "0.625"
    (tmp_path / "bad.json").write_text('{"i": 1}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        sinks.read_lines(spark, str(tmp_path / "bad.json"), "i int").collect()
    counters, reasons = spark.createDataFrame([(3, 1)], "attempted int, diverted int"), spark.createDataFrame([("no-image", 1)], "reason string, pages int")
    assert json.loads(sinks.summary_line(counters, reasons).first()[0])["reasons"] == {"no-image": 1}


def test_pinned_geometry(spark):
    t = math.tan(math.radians(5))
    c, s = math.cos(math.radians(5)), math.sin(math.radians(5))
    cases = [([c, s, -s, c, 0, 0], 0, 5), ([1, t, t, 1, 0, 0], 10, 5), ([612, 0, 80, 792, 0, 0], 5.767889, 5.767889), ([1.2642, 0, 0, 1, 0, 0], 0, 0)]
    df = spark.createDataFrame([([float(x) for x in m], float(a), float(b)) for m, a, b in cases], "m array<double>, shear double, skew double")
    for r in df.select(G.shear_degrees(F.col("m")).alias("a"), "shear", G.skew_degrees(F.col("m")).alias("b"), "skew").collect():
        assert r.a == pytest.approx(r.shear, abs=1e-6) and r.b == pytest.approx(r.skew, abs=1e-6)
    turned = spark.createDataFrame([([612.0, 0.0, 0.0, -792.0, 0.0, 792.0],), ([0.0, 792.0, -612.0, 0.0, 612.0, 0.0],)], "m array<double>")
    assert [r[0] for r in turned.select(K.placement_reason(F.col("m"))).collect()] == ["flipped-placement", "rotated-placement"]
    small = spark.createDataFrame([([0.4, 0.0, 0.0, 0.4, 10.0, 10.0],)], "m array<double>")
    assert list(small.select(G.pixel_rect(G.unit_box(F.col("m")))).first()[0]) == [10, 10, 11, 11]
