"""Registered queries over the stand-in tables, each with the same in SQL.

Inputs are derived (see ``standin``); the letters and numbers in docstrings
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelume.functions import checks as K
from pagelume.functions import classify as C
from pagelume.functions import geometry as G
from pagelume.functions import text as T
from pagelume.operators import census, graphs, provenance, raster, sampling, skew
from pagelume.operators import pixels as P
from pagelume.plans import standin as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = S.plain(sql)
        return f

    return add


# --- counts ---------------------------------------------------------------


@query(f"""with d as ({S.DOCUMENTS}) select count(*) as files, count(*) filter (where not unopenable) as documents,
count(*) filter (where unopenable) as unopenable, cast(coalesce(sum(pages) filter (where not unopenable), 0) as bigint) as pages from d""")
def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, SC2: files, documents and pages of a corpus."""
    return census.population(S.derive(spark, sf_dir, S.DOCUMENTS))


@query(f"""with o as ({S.OUTCOMES}), c as (select count(*) as attempted, count(*) filter (where outcome = 'extracted') as extracted, count(*) filter (where outcome = 'diverted') as diverted,
count(*) filter (where outcome = 'failed') as failed, count(*) filter (where outcome = 'extracted' and partial) as partial from o)
select *, round(diverted / attempted, 6) as divert_rate, round((diverted + failed) / attempted, 6) as unhandled_rate from c""")
def extract_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A4: outcomes and rates."""
    return census.outcome_counters(S.derive(spark, sf_dir, S.OUTCOMES))


@query(f"""with o as ({S.OUTCOMES}) select reason, case when reason in ('unsupported-codec-jbig2', 'unsupported-codec-jpx') then reason when reason = 'unsupported-codec-tif' then 'unsupported-codec-tiff'
when reason like 'unsupported-codec%' then 'unsupported-codec' else 'not-single-raster' end as class, count(*) as pages from o where outcome = 'diverted' group by reason order by pages desc, reason""")
def divert_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, O2, F2: reasons of diverted pages, most frequent first, with their class."""
    return census.reason_histogram(S.derive(spark, sf_dir, S.OUTCOMES))


@query(f"""with o as ({S.OUTCOMES}) select doc, count(*) as attempted, count(*) filter (where outcome = 'extracted') as extracted, count(*) filter (where outcome = 'diverted') as diverted,
round(coalesce(count(*) filter (where outcome = 'diverted') / count(*), 0), 6) as divert_rate from o group by doc""")
def divert_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of each document."""
    o = S.derive(spark, sf_dir, S.OUTCOMES)
    n, d = F.count("*"), F.count_if(F.col("outcome") == "diverted")
    return o.groupBy("doc").agg(n.alias("attempted"), F.count_if(F.col("outcome") == "extracted").alias("extracted"), d.alias("diverted"), F.round(census.ratio(d, n), 6).alias("divert_rate"))


_FACTS = f"""p as ({S.PLACEMENTS}), f as (select *, coalesce((m0 = 0 and m1 = 0) or (m2 = 0 and m3 = 0), false) as degenerate,
round(degrees(greatest(atan2(abs(m1), abs(m0)), atan2(abs(m2), abs(m3)))), 9) as skew_deg, round(degrees(atan2(m1, m0)), 9) as placement_deg,
case when not ((m0 = 0 and m1 = 0) or (m2 = 0 and m3 = 0)) then round(abs(90 - degrees(atan2(abs(m0 * m3 - m1 * m2), m0 * m2 + m1 * m3))), 9) end as shear_deg from p)"""

_BIN = "case " + " ".join(f"when {{0}} <= {e:g}e0 then {i}" for i, e in enumerate(census.EDGES[:-1])) + " when {0} is not null then 9 end"
_HIT = "placement_index >= 0 and not degenerate and shear_deg > {0}e0 and shear_deg <= 2 and skew_deg <= 2"


def _census_sql() -> str:
    per = ", ".join(
        [f"max(case when {_HIT.format(t)} and is_top then 1 else 0 end) as top{i}, max(case when {_HIT.format(t)} then 1 else 0 end) as any{i}" for i, t in enumerate(census.THRESHOLDS)]
        + [f"count(*) filter (where placement_index >= 0 and not degenerate and {_BIN.format('shear_deg')} = {i}) as b{i}" for i in range(10)]
    )
    parts = [
        "select 'total' as section, 'documents' as name, cast(count(distinct doc) as double) as value from g",
        "select 'total', 'pages', count(*) from g",
        "select 'total', 'image_bearing_pages', count(*) filter (where n > 0) from g",
        "select 'total', 'placements', sum(placements) from g",
        "select 'total', 'degenerate_placements', sum(deg) from g",
        "select 'total', 'degenerate_top_pages', count(*) filter (where top_deg = 1) from g",
    ]
    for i, label in enumerate(census.LABELS):
        parts.append(f"select 'placement', '{label}', sum(b{i}) from g")
        parts.append(f"select 'page_top', '{label}', count(*) filter (where {_BIN.format('top_shear')} = {i}) from g")
    for i, t in enumerate(census.THRESHOLDS):
        parts.append(f"select 'gated_top', '{t:g}', count(*) filter (where reason = '' and top{i} = 1) from g")
        parts.append(f"select 'gated_any', '{t:g}', count(*) filter (where reason = '' and any{i} = 1) from g")
    for section, where in (("placement_percentile", ""), ("page_top_percentile", "and is_top")):
        ranked = f"(select shear_deg as v, row_number() over (order by shear_deg) - 1 as r, count(*) over () as n from f where placement_index >= 0 and not degenerate {where})"
        for name, p in census.SHARES.items():
            parts.append(f"select '{section}', '{name}', round(v, 6) from {ranked} where r = cast(floor({p}e0 * (n - 1)) as bigint)")
    return f"""with {_FACTS}, g as (select doc, page_index, max(n_placements) as n, max(page_reason) as reason, count(*) filter (where placement_index >= 0) as placements,
count(*) filter (where placement_index >= 0 and degenerate) as deg, max(case when is_top and placement_index >= 0 and degenerate then 1 else 0 end) as top_deg,
max(case when is_top and placement_index >= 0 and not degenerate then shear_deg end) as top_shear, {per} from f group by doc, page_index) """ + " union all ".join(parts)


@query(_census_sql())
def ctm_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skew and shear of placements by page."""
    return census.placement_census(census.placement_facts(S.derive(spark, sf_dir, S.PLACEMENTS)))


@query(f"""with {_FACTS} select doc, page_index, placement_index, is_top, degenerate, round(skew_deg, 6) as skew_deg, round(shear_deg, 6) as shear_deg, round(placement_deg, 6) as placement_deg,
filter, width, height from f where placement_index >= 0""")
def ctm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK1, P7-P10, W1, W3: one row per placement."""
    f = census.placement_facts(S.derive(spark, sf_dir, S.PLACEMENTS)).filter("placement_index >= 0")
    return f.select("doc", "page_index", "placement_index", "is_top", "degenerate", *[F.round(c, 6).alias(c) for c in ("skew_deg", "shear_deg", "placement_deg")], "filter", "width", "height")


@query(f"""with {_FACTS} select doc, page_index, round(max(skew_deg), 6) as max_skew, round(max(shear_deg), 6) as max_shear, count(*) as placements from f where placement_index >= 0 group by doc, page_index""")
def page_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest skew over a page's placements."""
    f = census.placement_facts(S.derive(spark, sf_dir, S.PLACEMENTS)).filter("placement_index >= 0")
    return f.groupBy("doc", "page_index").agg(F.round(F.max("skew_deg"), 6).alias("max_skew"), F.round(F.max("shear_deg"), 6).alias("max_shear"), F.count("*").alias("placements"))


_RASTER, _PAGE = (0.0, 0.0, 600.0, 400.0), (0.0, 0.0, 612.0, 792.0)
_ANNOT_FACTS = f"""a as ({S.ANNOTATIONS}), af as (select *, case when coalesce(subtype, '') = '' then 'no-subtype' when subtype = 'Popup' then 'popup' when (flags & 2) <> 0 then 'hidden'
when (flags & 32) <> 0 then 'noview-print-only' when x0 is null then 'no-rect' when x1 <= x0 or y1 <= y0 then 'zero-area-rect' when has_apn then 'PAINTS' when has_ap then 'ap-without-n'
when subtype in ('Caret', 'Circle', 'FreeText', 'Highlight', 'Ink', 'Line', 'PolyLine', 'Polygon', 'Square', 'Squiggly', 'StrikeOut', 'Text', 'Underline') then 'no-ap-viewer-synthesised' else 'no-ap' end as bucket from a)"""
_OUT = "(x0 < {0} - 1e-3 or y0 < {1} - 1e-3 or x1 > {2} + 1e-3 or y1 > {3} + 1e-3)"


@query(f"""with o as ({S.OUTCOMES}), {_ANNOT_FACTS}, pg as (select page, count(*) filter (where bucket = 'PAINTS') as painting, count(*) filter (where bucket = 'PAINTS' and {_OUT.format(*_PAGE)}) as off_page,
count(*) filter (where bucket = 'PAINTS' and not {_OUT.format(*_PAGE)} and {_OUT.format(*_RASTER)}) as outside, count(*) filter (where bucket = 'no-ap-viewer-synthesised') as maybe from af group by page),
j as (select o.*, coalesce(painting, 0) as painting, coalesce(off_page, 0) as off_page, coalesce(outside, 0) as outside, coalesce(maybe, 0) as maybe from o left join pg on o.page = pg.page)
select 'extracted_with_annot' as name, count(*) filter (where outcome = 'extracted' and painting > 0) as value from j
union all select 'extracted_not_covering', count(*) filter (where outcome = 'extracted' and painting > 0 and not covers_page) from j
union all select 'extracted_outside', count(*) filter (where outcome = 'extracted' and outside > 0) from j
union all select 'extracted_maybe', count(*) filter (where outcome = 'extracted' and painting = 0 and maybe > 0) from j
union all select 'diverted_with_annot', count(*) filter (where outcome = 'diverted' and painting > 0) from j
union all select 'off_page', cast(coalesce(sum(off_page), 0) as bigint) from j
union all select 'bucket:' || bucket, count(*) from af group by bucket union all select 'subtype:' || subtype, count(*) from af where bucket = 'PAINTS' group by subtype""")
def annotation_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations lost by extraction."""
    return census.annotation_tally(S.derive(spark, sf_dir, S.OUTCOMES), S.derive(spark, sf_dir, S.ANNOTATIONS), _RASTER, _PAGE)


@query(f"with o as ({S.OUTCOMES}), {_ANNOT_FACTS} select o.page, count(af.page) as dropped from o left join af on o.page = af.page and af.bucket = 'PAINTS' group by o.page")
def dropped_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations lost on each page."""
    return census.dropped_annotations(S.derive(spark, sf_dir, S.OUTCOMES), S.derive(spark, sf_dir, S.ANNOTATIONS))


_FONT_FACTS = f"""fo as ({S.FONTS}), ff as (select *, case when subtype = 'Type3' then 'G' when subtype = 'Type0' then case when to_unicode then 'A' else 'F' end when to_unicode then 'B'
when encoding = 'differences' then 'C' when symbolic then 'E' else 'D' end as class from fo where subtype not in ('CIDFontType0', 'CIDFontType2'))"""


@query(f"""with {_FONT_FACTS}, c as (select class, count(*) as fonts, count(distinct file) as files, count(*) filter (where class = 'D' and encoding = 'named') as named,
count(*) filter (where class = 'D' and encoding = 'absent') as absent from ff group by class) select *, round(fonts / sum(fonts) over (), 6) as share from c""")
def font_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts by how their text can be read."""
    return census.font_totals(S.derive(spark, sf_dir, S.FONTS))


@query(f"""with {_FONT_FACTS}, m as (select file, count(*) as fonts from ff group by file), k as (select file, count(*) as other from fo group by file)
select m.file, fonts, other, round(100 * abs(fonts - other) / other, 6) as gap_percent from m join k on m.file = k.file""")
def font_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown fonts per file against all that are counted."""
    fonts = S.derive(spark, sf_dir, S.FONTS)
    return census.font_gap(fonts, fonts.groupBy("file").agg(F.count("*").alias("other")))


_ENC = f"""d as ({S.DOCUMENTS}), e as (select *, case when not unopenable and not wrong_password then case when encrypted then 2 else 1 end when wrong_password then 3 else 4 end as bucket from d)"""
_TALLY = """t as (select bucket, count(*) as files, cast(coalesce(sum(pages) filter (where bucket <= 2), 0) as bigint) as pages, count(*) filter (where bucket = 2 and inspect_ok) as inspected,
count(*) filter (where bucket = 2 and not inspect_ok) as not_inspected, cast(coalesce(sum(rasters) filter (where bucket = 2 and inspect_ok), 0) as bigint) as rasters from e group by bucket)"""


@query(f"with {_ENC}, {_TALLY} select * from t")
def encryption_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by encryption."""
    return census.encryption_tally(census.encryption_facts(S.derive(spark, sf_dir, S.DOCUMENTS)))


@query(f"with {_ENC}, {_TALLY} select cast(sum(files) as bigint) as files, cast(sum(case when bucket >= 3 then files else 0 end) as bigint) as unopenable, cast(sum(pages) as bigint) as pages from t")
def encryption_reaggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals from the tally alone."""
    return census.unopenable_of(census.encryption_tally(census.encryption_facts(S.derive(spark, sf_dir, S.DOCUMENTS))))


# --- geometry -------------------------------------------------------------

_MAT = "m0 * {0} + m2 * {1} + m4"
_GEOMETRY_SQL = f"""with p as ({S.PLACEMENTS}), c as (select *, m4 as ax, m5 as ay, m0 + m4 as bx, m1 + m5 as by_, m0 + m2 + m4 as cx, m1 + m3 + m5 as cy, m2 + m4 as dx, m3 + m5 as dy from p where placement_index >= 0),
b as (select *, least(ax, bx, cx, dx) as x0, least(ay, by_, cy, dy) as y0, greatest(ax, bx, cx, dx) as x1, greatest(ay, by_, cy, dy) as y1 from c)
select doc, page_index, placement_index, round(x0, 6) + 0e0 as x0, round(y0, 6) + 0e0 as y0, round(x1, 6) + 0e0 as x1, round(y1, 6) + 0e0 as y1, round((x1 - x0) * (y1 - y0), 4) as area,
x0 <= 1 and y0 <= 1 and x1 >= 611 and y1 >= 791 as covers, m1 = 0 and m2 = 0 as aligned, round(sqrt(abs(m0 * m3 - m1 * m2)), 6) as line_scale,
round(ax * by_ - bx * ay + bx * cy - cx * by_ + cx * dy - dx * cy + dx * ay - ax * dy, 4) + 0e0 as area2,
cast(case when round(x0) = round(x1) and x1 > x0 then floor(x0) else round(x0) end as int) as rx0, cast(case when round(x0) = round(x1) and x1 > x0 then ceil(x1) else round(x1) end as int) as rx1,
case when degrees(greatest(atan2(abs(m1), abs(m0)), atan2(abs(m2), abs(m3)))) > 2 then 'rotated-placement' when m0 <= 0 or m3 <= 0 then 'flipped-placement' else '' end as reason,
round(case when m0 * m3 - m1 * m2 <> 0 then m3 / (m0 * m3 - m1 * m2) end, 9) as inverse0 from b"""


@query(_GEOMETRY_SQL)
def placement_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2-P6, P11-P13, P23, C2, CW7: boxes, coverage and inverses of placements."""
    p = S.derive(spark, sf_dir, S.PLACEMENTS).filter("placement_index >= 0")
    m = F.array(*[F.col(f"m{i}") for i in range(6)])
    p = p.withColumns({"m": m, "box": G.unit_box(m), "quad": G.unit_quad(m)})
    box, page = F.col("box"), F.array(*[F.lit(x) for x in _PAGE])
    rect = G.pixel_rect(box)
    return p.select(
        "doc", "page_index", "placement_index",
        *[(F.round(box[i], 6) + 0.0).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))],
        F.round(G.area(box), 4).alias("area"),
        G.box_contains(box, page).alias("covers"),
        G.axis_aligned(m).alias("aligned"),
        F.round(G.line_scale(m), 6).alias("line_scale"),
        (F.round(G.signed_area2(F.col("quad")), 4) + 0.0).alias("area2"),
        rect[0].alias("rx0"), rect[2].alias("rx1"),
        C.placement_reason(m).alias("reason"),
        F.round(G.invert(m)[0], 9).alias("inverse0"),
    )


# --- page classifier ------------------------------------------------------

#: One struct per placement and one per path of each page; every third line is a path instead.
_SCAN = """
select o.o_custkey as doc, o.o_orderkey as page, l.l_orderkey is not null as has_line, l.l_partkey % 3 = 0 as is_paint, l.l_partkey % 8 as k,
  row_number() over (partition by o.o_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) as ord,
  case when l.l_partkey % 5 = 0 then 300e0 else 612e0 end as w, case when l.l_partkey % 7 = 0 then 500e0 else 792e0 end as h,
  case when l.l_partkey % 31 = 0 then 40e0 else 0e0 end as shear, case when l.l_partkey % 37 = 0 then -1 else 1 end as flip,
  l.l_suppkey % 9 <> 0 as opaque, case l.l_suppkey % 4 when 0 then 1 else 8 end as bpc, l.l_suppkey % 17 = 0 as image_mask, l.l_suppkey % 19 = 0 as smask,
  l.l_suppkey % 23 = 0 as clipped, l.l_quantity as q,
  case when o.o_orderkey % 10 = 0 then 1 else 0 end as inked, case when o.o_orderkey % 23 = 0 then 1 else 0 end as inline_, case when o.o_orderkey % 29 = 0 then 1 else 0 end as shading
from {orders} o left join {lineitem} l on o.o_orderkey = l.l_orderkey
"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with arrays of placements and paths in paint order."""
    lines = S.derive(spark, sf_dir, _SCAN)
    ctm = F.array("w", F.lit(0.0), F.col("shear"), F.col("h") * F.col("flip"), F.lit(0.0), F.when(F.col("flip") < 0, F.col("h")).otherwise(0.0))
    clip = F.when(F.col("clipped"), F.array(F.lit(700.0), F.lit(0.0), F.lit(710.0), F.lit(10.0)))
    own = G.unit_box(F.col("ctm"))
    one = lines.withColumns({"ctm": ctm, "clip": clip}).withColumn("box", F.when(F.col("clip").isNull(), own).otherwise(G.intersect(F.col("clip"), own)))
    image = F.struct(F.col("ord").alias("id"), "ctm", "box", "clip", "opaque", "ord", "bpc", "image_mask", "smask", F.lit(False).alias("mask"))
    path_box = F.array(F.lit(10.0), F.lit(10.0), 10 + F.col("q") * 14, 10 + F.col("q") * 8)
    paint = F.struct(F.when(F.col("k") < 3, "S").otherwise("f").alias("op"), path_box.alias("box"), F.lit(None).cast("array<double>").alias("clip"), F.array(*[F.lit(x) for x in G.IDENTITY]).alias("ctm"), "ord")

    def listed(c, where):
        return F.array_sort(F.collect_list(F.when(F.col("has_line") & where, F.struct("ord", c.alias("x")))))

    per = one.groupBy("doc", "page").agg(
        listed(image, ~F.col("is_paint")).alias("i"), listed(paint, F.col("is_paint")).alias("p"), *[F.max(c).alias(c) for c in ("inked", "inline_", "shading")]
    )
    plain = per.select("doc", "page", F.transform("i", lambda x: x["x"]).alias("i"), F.transform("p", lambda x: x["x"]).alias("p"), "inked", "inline_", "shading")
    facts = plain.withColumns({"images": C.with_image_facts(F.col("i")), "paints": C.with_paint_facts(F.col("p"))})
    return facts.select("doc", "page", "images", "paints", "inked", "inline_", "shading", F.array(*[F.lit(x) for x in _PAGE]).alias("crop"))


def _reason(quads: bool, paints=None):
    return C.page_reason(F.col("crop"), F.col("images"), F.col("paints") if paints is None else paints, F.col("inked"), F.col("inline_"), F.col("shading"), F.array().cast("array<string>"), quads)


_SCAN_SQL = f"""l as ({_SCAN}), b as (select *, least(0e0, shear, w, w + shear) as x0, case when clipped then 1 else 0 end as cl, w + shear as x1, h as y1 from l where has_line),
i as (select page, ord, w, h, shear, flip, opaque, bpc, image_mask, smask, clipped, case when clipped then least(greatest(700e0, 0e0), 710e0) else 0e0 end as ix0, 0e0 as iy0,
  case when clipped then greatest(700e0, least(710e0, w + shear)) else w + shear end as ix1, case when clipped then least(10e0, h) else h end as iy1,
  degrees(atan2(shear, h)) as skew, opaque and not image_mask and not smask as cover, bpc = 1 or image_mask as bit from b where not is_paint),
pt as (select page, ord, k < 3 as stroke, 10 + q * 14 as px1, 10 + q * 8 as py1 from b where is_paint),
n as (select page, count(*) as n, max(ord) as top from i group by page),
vis as (select distinct pt.page from pt where (stroke or (px1 > 10 and py1 > 10)) and not exists (select 1 from i where i.page = pt.page and i.ord >= pt.ord and i.cover
  and 10 >= i.ix0 - case when stroke then 1e-3 else 1e0 end and 10 >= i.iy0 - case when stroke then 1e-3 else 1e0 end
  and px1 <= i.ix1 + case when stroke then 1e-3 else 1e0 end and py1 <= i.iy1 + case when stroke then 1e-3 else 1e0 end)),
mrc as (select i.page from i join n on i.page = n.page group by i.page having bool_or(bit and ord < n.top and (ix1 - ix0) * (iy1 - iy0) >= 0.9e0 * 612 * 792) and bool_or(not bit and (ix1 - ix0) * (iy1 - iy0) > 0.02e0 * 612 * 792)),
und as (select distinct i.page from i join n on i.page = n.page join i t on t.page = n.page and t.ord = n.top where i.ord < n.top and not (t.ix0 <= i.ix0 + 1 and t.iy0 <= i.iy0 + 1 and t.ix1 >= i.ix1 - 1 and t.iy1 >= i.iy1 - 1)),
pg as (select doc, page, max(inked) as inked, max(inline_) as inline_, max(shading) as shading from l group by doc, page),
c as (select pg.doc, pg.page, case when n.n is null then 'no-image' when inked > 0 then 'has-text' when inline_ > 0 then 'inline-image' when vis.page is not null then 'vector-paint' when shading > 0 then 'shading'
  when mrc.page is not null then 'mrc-layers' when t.clipped and not (t.ix1 > t.ix0 and t.iy1 > t.iy0) then case when n.n > 1 then 'multiple-images' else 'clipped-away' end
  when t.skew > 2 or t.flip < 0 then case when n.n > 1 then 'multiple-images' when t.skew > 2 then 'rotated-placement' else 'flipped-placement' end
  when n.n > 1 and not (t.ix0 <= 1 and t.iy0 <= 1 and t.ix1 >= 611 and t.iy1 >= 791) then 'multiple-images' when n.n > 1 and not t.cover then 'transparent-overlay'
  when n.n > 1 and und.page is not null then 'multiple-images' else '' end as reason
  from pg left join n on pg.page = n.page left join i t on t.page = n.page and t.ord = n.top left join vis on vis.page = pg.page left join mrc on mrc.page = pg.page left join und on und.page = pg.page)"""


@query(f"with {_SCAN_SQL} select * from c")
def page_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census form of the page classifier."""
    return scans(spark, sf_dir).select("doc", "page", _reason(False).alias("reason"))


@query(f"with {_SCAN_SQL} select reason, count(*) as pages from c group by reason")
def page_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by classifier result."""
    return scans(spark, sf_dir).select(_reason(False).alias("reason")).groupBy("reason").agg(F.count("*").alias("pages"))


@query()
def page_reasons_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier with outline tests, and what it says without paths."""
    s = scans(spark, sf_dir).withColumn("none", F.slice("paints", 1, 0))
    return s.select("doc", "page", _reason(True).alias("reason"), _reason(True, F.col("none")).alias("reason_without_paths"))


@query()
def clause_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps each vector page from extracting, and the slack that would let it."""
    # The number of the partition keeps the filter above the facts: pushed below, it would work them out anew in every test.
    s = scans(spark, sf_dir).withColumn("reason", _reason(True)).withColumn("part", F.spark_partition_id()).filter("reason = 'vector-paint' and part >= 0")
    s = s.withColumn("visible", C.with_clauses(F.col("paints"), F.col("images")))
    v = F.col("visible")
    return s.select(
        "doc",
        "page",
        C.deciding_clause(v).alias("clause"),
        F.round(C.required_tolerance(v), 6).alias("tolerance"),
        F.round(C.required_tolerance(v, True), 6).alias("tolerance_fills"),
        F.size(F.filter("paints", lambda p: p["marks"])).alias("marking"),
        F.size(v).alias("visible"),
    )


@query(f"""with p as ({S.PLACEMENTS}) select filter, case when filter in ('DCTDecode', 'FlateDecode', 'CCITTFaxDecode') then '' when filter = 'JBIG2Decode' then 'unsupported-codec-jbig2'
when filter = 'JPXDecode' then 'unsupported-codec-jpx' else 'unsupported-codec' end as reason, count(*) as placements from p where placement_index >= 0 group by filter""")
def codec_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusal by codec."""
    p = S.derive(spark, sf_dir, S.PLACEMENTS).filter("placement_index >= 0")
    return p.groupBy("filter").agg(F.count("*").alias("placements")).select("filter", T.codec_reason(F.col("filter")).alias("reason"), "placements")


# --- records --------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, text): a JSON record per document from its pages; some are absent, some broken."""
    p = S.derive(spark, sf_dir, S.PROVENANCE)
    steps = F.array(F.when(F.col("diverted") == "", F.col("step")))
    page = F.struct(
        F.filter(steps, lambda x: x.isNotNull()).alias("applied"), "diverted", "dropped_annots", F.when(F.col("page") % 5 == 0, F.struct((F.col("page") % 90 / 10.0).alias("deg"))).alias("straightened")
    )
    per = p.groupBy("doc", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", page.alias("p")))), lambda x: x["p"]).alias("pages"))
    record = F.struct(
        F.lit("1.2").alias("version"),
        F.array(F.lit("inspect"), F.when(F.col("doc") % 2 == 0, "linearize").otherwise("extract-raster")).alias("capabilities"),
        "pages",
        F.when(F.col("doc") % 3 == 0, "rewritten-linearized").when(F.col("doc") % 3 == 1, "rewritten").alias("optimized"),
        F.lit(7).alias("not_in_the_schema"),
    )
    text = F.to_json(record)
    return per.select("doc", F.when(F.col("kind") == 3, None).when(F.col("doc") % 25 == 0, F.concat(F.lit("{"), text)).otherwise(text).alias("text"))


_CURRENT = (*T.CAPABILITIES, *provenance.PLANNED, "new-thing")
_PV = f"""p as ({S.PROVENANCE}), d as (select doc, max(kind) as kind, doc % 25 = 0 as broken,
bool_or(diverted = '' and regexp_replace(step, '-[0-9]+$', '') = 'ccitt-g4') as has_ccitt, bool_or(diverted = '' and regexp_replace(step, '-[0-9]+$', '') = 'jbig2-generic') as has_generic,
bool_or(dropped_annots > 0 or diverted = 'not-single-raster') as render, bool_or(diverted = 'unsupported-codec') as coarse, bool_or(diverted = 'unsupported-codec-jpx') as jpx,
bool_or(diverted = '' and (step like 'jbig2-%' or step like 'ccitt-%' or step like 'quantize-%' or step like 'downsample-%' or step like 'jpeg-%')) as cleanup from p group by doc)"""


def _candidates_sql() -> str:
    arms = {
        "jbig2-generic": "has_ccitt", "jbig2-symbol": "has_generic", "render": "render", "decode-jbig2": "coarse", "decode-jpx": "coarse or jpx", "decode-tiff": "coarse",
        "linearize": "doc % 2 <> 0 and doc % 3 <> 0", "page-cleanup": "cleanup", "pdfa": "true", "new-thing": "true",
    }
    listed = " union all ".join(f"select doc, '{c}' as candidate from d where kind <> 3 and not broken and ({w})" for c, w in arms.items())
    every = " union all ".join(f"select doc, '{c}' from d where kind = 3 or broken" for c in sorted(set(_CURRENT)))
    return f"with {_PV} {listed} union all {every}"


@query(_candidates_sql())
def upgrade_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1-U11, F1, J10, SC14: (doc, candidate) that a newer build could do better; a broken record counts as none."""
    r = records(spark, sf_dir).select("doc", provenance.read_record(F.col("text"))["record"].alias("r"))
    current = F.array(*[F.lit(c) for c in _CURRENT])
    return r.select("doc", F.explode(provenance.upgrade_candidates(F.col("r"), current)).alias("candidate"))


@query(f"""with {_PV} select case when kind = 3 then 'absent' when broken then 'corrupt' else 'ok' end as status, count(*) as documents from d group by 1""")
def record_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC14, F9: records that are absent, corrupt or sound."""
    return records(spark, sf_dir).select(provenance.read_record(F.col("text"))["status"].alias("status")).groupBy("status").agg(F.count("*").alias("documents"))


@query(f"""with {_PV}, g as (select doc, page, diverted, step, dropped_annots, row_number() over (partition by doc order by page) - 1 as pos from p), k as (select g.*, d.kind, d.broken from g join d on g.doc = d.doc)
select doc, pos, diverted, case when diverted <> '' then '' when kind = 3 or broken then step || '-7' when step < step || '-7' then step || ',' || step || '-7' else step || '-7,' || step end as applied,
case when kind = 3 or broken then case when page % 5 = 0 then page % 90 / 10e0 end else case when page % 5 = 0 then page % 90 / 10e0 end end as deg from k""")
def record_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh extraction's record merged with the stored one, page by page."""
    old = records(spark, sf_dir).select("doc", provenance.read_record(F.col("text"))["record"].alias("old"))
    p = S.derive(spark, sf_dir, S.PROVENANCE)
    page = F.struct(
        F.when(F.col("diverted") == "", F.array(F.concat("step", F.lit("-7")))).otherwise(F.array().cast("array<string>")).alias("applied"), "diverted", F.lit(None).cast("array<double>").alias("placement"), "dropped_annots",
        F.lit(None).cast("struct<raster_box:array<double>,page_box:array<double>,clip_box:array<double>,raster_quad:array<double>>").alias("geometry"),
        F.when(F.col("page") % 5 == 0, F.struct((F.col("page") % 90 / 10.0).alias("deg"))).alias("straightened"),
    )
    new = p.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", page.alias("p")))), lambda x: x["p"]).alias("pages")).select(
        F.col("doc").alias("d"),
        F.struct(F.lit("1.3").alias("version"), F.array(F.lit("extract-raster")).alias("capabilities"), F.lit(None).cast("timestamp").alias("processed_at"), "pages", F.lit(None).cast("string").alias("optimized")).alias("new"),
    )
    merged = new.join(old, F.col("d") == F.col("doc"), "left").select(F.col("d").alias("doc"), provenance.merge_extraction(F.col("old"), F.col("new")).alias("m"))
    return merged.select("doc", F.posexplode("m.pages").alias("pos", "p")).select(
        "doc", F.col("pos").cast("bigint").alias("pos"), F.col("p.diverted").alias("diverted"), F.array_join("p.applied", ",").alias("applied"), F.col("p.straightened.deg").alias("deg")
    )


@query(f"""with {_PV}, g as (select doc, page, diverted, step, row_number() over (partition by doc order by page) as n from p),
plan as (select doc as out, n as position, doc as source, n + 1 as source_page, case when n % 4 = 0 then 2.5e0 end as straighten from g)
select plan.out, plan.position, case when d.kind = 3 or d.broken or g.doc is null then 'source-unrecorded' else g.diverted end as diverted,
case when d.kind = 3 or d.broken or g.doc is null then case when straighten is not null then 'straighten' else '' end
  when g.diverted <> '' then case when straighten is not null then 'straighten' else '' end
  when straighten is null or g.step = 'straighten' then g.step when g.step < 'straighten' then g.step || ',straighten' else 'straighten,' || g.step end as applied,
round(case when straighten is null then 0e0 else straighten - case when d.kind = 3 or d.broken or g.doc is null or g.page % 5 <> 0 then 0e0 else g.page % 90 / 10e0 end end, 6) as turn
from plan join d on plan.source = d.doc left join g on g.doc = plan.source and g.n = plan.source_page""")
def built_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of edited documents, each page taken from the next of the source."""
    p = S.derive(spark, sf_dir, S.PROVENANCE)
    n = F.row_number().over(Window.partitionBy("doc").orderBy("page"))
    plan = p.select(F.col("doc").alias("out"), n.alias("position"), F.col("doc").alias("source"), (n + 1).alias("source_page")).withColumn("straighten", F.when(F.col("position") % 4 == 0, 2.5))
    known = records(spark, sf_dir).select(F.col("doc").alias("source"), provenance.read_record(F.col("text"))["record"].alias("record"))
    out = provenance.build_records(plan, known)
    return out.select("out", F.col("position").cast("bigint").alias("position"), F.col("page.diverted").alias("diverted"), F.array_join("page.applied", ",").alias("applied"), F.round("turn", 6).alias("turn"))


@query(f"""with {_PV}, s as (select doc, kind = 3 or broken as missing, doc % 10 as out, doc % 2 = 0 as even from d)
select out, case when bool_or(missing) then '' when bool_and(even) then 'inspect,linearize' when bool_and(not even) then 'extract-raster,inspect' else 'inspect' end as capabilities from s group by out""")
def common_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what all sources of a document were built with."""
    r = records(spark, sf_dir).select((F.col("doc") % 10).alias("out"), provenance.read_record(F.col("text"))["record"]["capabilities"].alias("capabilities"))
    return provenance.common_capabilities(r, "out").select("out", F.array_join("capabilities", ",").alias("capabilities"))


# --- object graphs --------------------------------------------------------

_REFS = """
select 1 as doc, n_nationkey + 100 as src, n_regionkey as dst from {nation} union all select 1, c_custkey + 1000, c_nationkey + 100 from {customer}
union all select 1, n_nationkey + 100, n_nationkey + 500 from {nation} where n_nationkey % 5 = 0
"""
_DEFINED = "select 1 as doc, r_regionkey as obj from {region} union all select 1, n_nationkey + 100 from {nation} union all select 1, c_custkey + 1000 from {customer}"


@query(f"with r as ({_REFS}), d as ({_DEFINED}) select distinct r.src as object, r.dst as target from r left join d on r.dst = d.obj where d.obj is null")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to objects that aren't defined."""
    return graphs.dangling(S.derive(spark, sf_dir, _REFS), S.derive(spark, sf_dir, _DEFINED)).select(F.col("src").alias("object"), F.col("dst").alias("target"))


@query("""with c as (select c_custkey + 1000 as page, c_nationkey + 100 as a, n_regionkey as b, n_nationkey % 5 = 0 as d from customer join nation on c_nationkey = n_nationkey),
e as (select page, page as obj from c union all select page, a from c union all select page, b from c union all select page, a + 400 from c where d)
select obj, count(distinct page) as pages from e group by obj""")
def object_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages reach each object."""
    roots = S.table(spark, sf_dir, "customer").select(F.lit(1).alias("doc"), (F.col("c_custkey") + 1000).alias("root"))
    return graphs.page_counts(S.derive(spark, sf_dir, _REFS), roots).select("obj", "pages")


# --- samples and manifests ------------------------------------------------


@query("select c_custkey as id from customer order by md5('7:' || c_custkey), c_custkey limit 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC18: a sample without replacement that a seed fixes."""
    return sampling.seeded_sample(S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id", 50, 7)


@query("select count(*) as n, count(distinct l_orderkey) as ids, count(distinct l_orderkey) >= 0.2 * count(*) as sound from lineitem")
def frame_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC19: distinct ids against rows of a sampling frame."""
    return sampling.frame_guard(S.table(spark, sf_dir, "lineitem"), "l_orderkey", 0.2, fail=False)


@query("""with m as (select page_id as id, 'http' as source, octet_length(encode(html)) as bytes, sha256(html) as sha256 from pages), f as (select *, row_number() over (partition by sha256 order by id) as copy from m),
r as (select id, source, bytes, sha256, sum(bytes) over (order by id rows unbounded preceding) as total from f where copy = 1) select id, source, bytes, sha256 from r where total <= 200000""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC20, O6, F12: distinct contents with their digests, as far as a byte budget goes."""
    rows = S.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("http").alias("source"), F.col("html").cast("binary").alias("content"))
    return sampling.manifest(rows, "id", 200_000)


@query("select row_number() over (order by c_name) - 1 as position, c_name as path from customer")
def document_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each path in lexical order."""
    from pagelume.operators.ranks import ranked

    return ranked(S.table(spark, sf_dir, "customer").select(F.col("c_name").alias("path")), "path").select(F.col("rank").alias("position"), "path")


# --- rasters --------------------------------------------------------------

_PIXELS_SQL = "px as (select image, (i - 1) % 8 as x, (i - 1) // 8 as y, least(255, greatest(0, cast(floor(128 + 240 * cast(embedding[i] as double)) as int))) as v from (select vec_id as image, embedding, unnest(range(1, 65)) as i from embeddings))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, x, y, v): embeddings as grey rasters of 8 x 8."""
    e = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "e"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 240 * F.col("e").cast("double")).cast("int")))
    return e.select("image", (F.col("i") % 8).cast("bigint").alias("x"), F.floor(F.col("i") / 8).alias("y"), v.alias("v"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, w, h, pixels): the same as bytes, from one pass over the table."""
    e = S.table(spark, sf_dir, "embeddings")
    grey = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 240 * v.cast("double")).cast("int"))))
    return e.select(F.col("vec_id").alias("image"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.unhex(F.array_join(F.transform(grey, lambda v: F.lpad(F.hex(v), 2, "0")), "")).alias("pixels"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for kernels that take far longer than a row takes to move."""
    return df.repartition(max(2, df.sparkSession.sparkContext.defaultParallelism), "image")


@query(f"""with {_PIXELS_SQL}, s as (select a.image, a.x, a.y, a.v, sum(b.v) / count(*) as m, sum(b.v * b.v) / count(*) as q from px a join px b on a.image = b.image and abs(a.x - b.x) <= 15 and abs(a.y - b.y) <= 15 group by all)
select image, x, y, v < m * (1 + 0.5e0 * (sqrt(greatest(q - m * m, 0)) / 128 - 1)) as ink from s""")
def sauvola(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive threshold as windows of 31 x 31, cut at the borders."""
    return raster.sauvola_windows(pixels(spark, sf_dir), 15)


@query(f"""with {_PIXELS_SQL}, h as (select image, v, count(*) as n from px group by image, v), c as (select image, v, sum(n) over w as w, sum(n * v) over w as s, sum(n) over (partition by image) as nn, sum(n * v) over (partition by image) as ss from h window w as (partition by image order by v)),
k as (select image, v, round(w * (nn - w) * (s / w - (ss - s) / (nn - w)) * (s / w - (ss - s) / (nn - w)), 6) as score from c where nn > w)
select image, v as threshold from (select *, row_number() over (partition by image order by score desc, v) as r from k) where r = 1""")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: threshold of the largest variance between classes."""
    return raster.otsu_table(pixels(spark, sf_dir))


@query(f"with {_PIXELS_SQL} select image, round(avg(case when v < 128 then 1e0 else 0e0 end), 6) as ink, round(avg(v), 6) as mean from px group by image")
def ink_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of ink."""
    return raster.ink_share(pixels(spark, sf_dir))


@query(f"with {_PIXELS_SQL} select a.image, a.x, a.y, bool_or(b.v < 128) as ink from px a join px b on a.image = b.image and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by all")
def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dilation by a square."""
    return raster.dilate_rows(pixels(spark, sf_dir).withColumn("ink", F.col("v") < 128), 1)


@query(f"with {_PIXELS_SQL} select a.image, a.x, a.y, bool_and(b.v < 128) and count(*) = 9 as ink from px a join px b on a.image = b.image and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by all")
def erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Erosion by a square."""
    return raster.dilate_rows(pixels(spark, sf_dir).withColumn("ink", F.col("v") < 128), 1, erode=True)


@query(f"with {_PIXELS_SQL}, pal as (select unnest(range(0, 8)) as i), d as (select image, x, y, i, (v - (16 + 32 * i)) * (v - (16 + 32 * i)) as d from px, pal) select image, x, y, i from (select *, row_number() over (partition by image, x, y order by d, i) as r from d) where r = 1")
def nearest_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: nearest entry of a palette of eight greys."""
    palette = spark.range(8).select(F.col("id").alias("i"), (16 + 32 * F.col("id")).alias("c"))
    return raster.nearest_colour(pixels(spark, sf_dir), palette)


@query(f"with {_PIXELS_SQL}, q as (select image, x, y, v, v // 16 * 16 + 8 as u from px), e as (select image, avg(abs(v - u)) as m, avg((v - u) * (v - u)) as e from q group by image) select image, round(m, 6) as mean_difference, case when e > 0 then round(10 * log10(65025e0 / e), 6) end as psnr from e")
def raster_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference and PSNR against a coarser copy."""
    a = pixels(spark, sf_dir)
    return raster.compare(a, a.withColumn("v", F.floor(F.col("v") / 16).cast("int") * 16 + 8))


@query(f"with {_PIXELS_SQL} select image, v, count(*) as n from px group by image, v")
def colour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by level."""
    return pixels(spark, sf_dir).groupBy("image", "v").agg(F.count("*").alias("n"))


@query()
def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes of up to four colours by median cut and refinement."""
    import numpy as np

    def kernel(grey):
        rgb = np.repeat(grey[:, :, None], 3, axis=2)
        palette, index = raster.quantize(rgb, 4)
        return {"colours": len(palette), "palette": palette[:, 0].tolist(), "psnr": round(min(raster.psnr(palette[index], rgb), 99.0), 6)}

    return raster.over_rasters(spread(rasters(spark, sf_dir)), kernel, "colours bigint, palette array<bigint>, psnr double")


@query()
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters at half the resolution."""

    def kernel(grey):
        small = raster.downsample(grey, 300, 150)
        return {"w": small.shape[1], "h": small.shape[0], "mean": round(float(small.mean()), 6)}

    return raster.over_rasters(spread(rasters(spark, sf_dir)), kernel, "w bigint, h bigint, mean double")


@query()
def skew_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skew of pages of ruled lines, each turned by an angle (``drawn``, -10 to 10 degrees) and as ragged as its 8 x 8 raster says."""

    def kernel(grey):
        drawn = (int(grey.sum()) % 81 - 40) / 4
        return {"drawn": drawn} | skew.measure(skew.ruled(drawn, grey.ravel()))

    return raster.over_rasters(spread(rasters(spark, sf_dir)), kernel, "drawn double, " + skew.KINDS)


@query()
def skew_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, those with a raster and those measured."""
    return skew.census(skew_estimates(spark, sf_dir))


# --- text functions -------------------------------------------------------


@query(f"""with p as ({S.PROVENANCE}) select step, regexp_replace(step, '-[0-9]+$', '') as capability, count(*) as pages from p group by step""")
def applied_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """steps without their parameters."""
    p = S.derive(spark, sf_dir, S.PROVENANCE)
    return p.groupBy("step").agg(F.count("*").alias("pages")).select("step", T.capability_of(F.col("step")).alias("capability"), "pages")


@query("select p_partkey as id, replace(replace(replace(p_name || ' (' || p_type || ')', '\\', '\\\\'), '(', '\\('), ')', '\\)') as escaped from part")
def escaped_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts as parenthesised strings."""
    return S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.escape_literal(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("escaped"))


_NUMBERS = "select l_orderkey as k, l_linenumber as n, cast(l_partkey as int) as part, cast(l_suppkey as int) as supp, cast(l_quantity as double) as q, cast(l_partkey % 50 as double) as p, cast(l_suppkey % 30 as double) as s from {lineitem}"


@query(f"""with t as ({S.plain(_NUMBERS)}) select k, n, q * 2 + p * s as product_0, q * s - p * 2 as product_2, s * 3 + p as product_4, 1 + q as product_5,
least(p, s) as up_x0, least(q, 10) as up_y0, greatest(p, s) as up_x1, greatest(q, 10) as up_y1,
least(s, q * q + s, q * q - p * p + s, s - p * p) as box_x0, 1e0 as box_y0, greatest(s, q * q + s, q * q - p * p + s, s - p * p) as box_x1, 2 * q * p + 1 as box_y1,
case when part % 5 = 0 then case when part % 3 = 0 then null else 20e0 end when part % 3 = 0 then s + p else greatest(s, least(20e0, s + p)) end as clip_x1,
round(cos(radians(p - 25)), 9) as turn_0, round(s - s * cos(radians(p - 25)) + q * sin(radians(p - 25)), 6) + 0e0 as turn_4, round(q - s * sin(radians(p - 25)) - q * cos(radians(p - 25)), 6) + 0e0 as turn_5,
((part % 9 - 4) * 90 % 360 + 360) % 360 as quarter, round(part * 72e0 / 150, 6) as points, case when supp % 300 + 72 <= 150 then part else greatest(1, cast(round(part * 150e0 / (supp % 300 + 72)) as int)) end as scaled,
cast(round(least(1e0, greatest(0e0, (p - 10) / 20)) * 255) as int) as grey, case when part % 300 <= 2 then 1 when part % 300 <= 4 then 2 when part % 300 <= 16 then 4 when part % 300 <= 256 then 8 end as depth,
case when q > 0 and p > 0 and supp > 0 then round(100 * q * 1000 / (supp * 100e0 * p), 6) end as scale from t""")
def geometry_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products, boxes under matrices, clips, turns and sizes."""
    t = S.derive(spark, sf_dir, _NUMBERS)
    part, supp, q, p, s = (F.col(c) for c in ("part", "supp", "q", "p", "s"))
    one, zero = F.lit(1.0), F.lit(0.0)
    a, b = F.array(q, p, -p, q, s, one), F.array(F.lit(2.0), zero, s, one, p, q)
    product, up, box = G.multiply(a, b), G.upright(F.array(p, q, s, F.lit(10.0))), G.map_box(F.array(zero, zero, q, p), a)
    clip = F.when(part % 3 != 0, F.array(zero, zero, F.lit(20.0), F.lit(20.0)))
    path = F.when(part % 5 != 0, F.array(s, q, s + p, q + 5))
    turn = G.rotate_about(p - 25, s, q)
    return t.select(
        "k", "n", *[product[i].alias(f"product_{i}") for i in (0, 2, 4, 5)],
        *[up[i].alias(f"up_{c}") for i, c in enumerate(("x0", "y0", "x1", "y1"))], *[box[i].alias(f"box_{c}") for i, c in enumerate(("x0", "y0", "x1", "y1"))],
        G.narrow_clip(clip, path)[2].alias("clip_x1"), F.round(turn[0], 9).alias("turn_0"), *[(F.round(turn[i], 6) + 0.0).alias(f"turn_{i}") for i in (4, 5)],
        G.quarter_turns((part % 9 - 4) * 90).alias("quarter"), F.round(G.page_points(part, F.lit(150)), 6).alias("points"), G.scaled_pixels(part, supp % 300 + 72, F.lit(150)).alias("scaled"),
        G.grey_level((p - 10) / 20).alias("grey"), G.palette_depth(part % 300).alias("depth"), F.round(G.word_scale(q, p, supp * 100.0), 6).alias("scale"),
    )


@query(f"""with t as ({S.plain(_NUMBERS)}) select k, n, part % 3 <= 1 and supp % 3 <= 1 and 50 + part % 50 >= 60 and 60 + supp % 30 >= 70 and (part % 2 = 0 or (part % 3 + 2 <= 2 and supp % 3 + 2 <= 2 and 48 + part % 50 >= 59 and 58 + supp % 30 >= 69)) as covers_rect,
part % 3 <= 2 and supp % 3 <= 2 and 50 + part % 50 >= 59 and 60 + supp % 30 >= 69 and (part % 2 = 0 or (part % 3 + 2 <= 2 and supp % 3 + 2 <= 2 and 48 + part % 50 >= 59 and 58 + supp % 30 >= 69)) as covers_record from t""")
def page_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a placement covers its page, in whole points and on a stored record."""
    t = S.derive(spark, sf_dir, _NUMBERS)
    part, supp = F.col("part"), F.col("supp")
    rect = F.array(part % 3, supp % 3, 50 + part % 50, 60 + supp % 30)
    page = F.array(*[F.lit(x) for x in (1, 1, 60, 70)])
    # A list of one holds the boxes once, where the tests would otherwise spell them out at every use.
    held = F.transform(F.array(rect), lambda r: F.struct(r.alias("rect"), F.when(part % 2 != 0, F.array(*[r[i] + d for i, d in ((0, 2.0), (1, 2.0), (2, -2.0), (1, 2.0), (2, -2.0), (3, -2.0), (0, 2.0), (3, -2.0))])).alias("quad")))
    cover = F.transform(held, lambda x: F.struct(G.covers_page_rect(x["rect"], page, x["quad"]).alias("rect"), G.covers_page_record(x["rect"].cast("array<double>"), page.cast("array<double>"), x["quad"]).alias("record")))
    return t.select("k", "n", F.explode(cover).alias("c")).select("k", "n", F.col("c.rect").alias("covers_rect"), F.col("c.record").alias("covers_record"))


_MESSAGES = """select o_orderkey as k, concat(case o_orderkey % 4 when 0 then '' when 1 then '-' when 2 then '+' else 'x' end, cast(o_custkey as varchar(20)), case o_custkey % 3 when 0 then '' when 1 then '.5' else '.7.8' end) as token,
  case o_orderkey % 7 when 0 then '' when 1 then 'bad decode array' when 2 then 'over the pixel limit' when 3 then 'size disagrees with the page' when 4 then 'no dictionary' when 5 then concat('segment type ', cast(o_custkey % 63 as varchar(20)), ' refused') else 'arithmetic' end as message,
  concat(case when o_custkey % 2 = 0 then '/data/in/' else '/other/' end, cast(o_orderkey as varchar(20))) as path, concat(repeat('x', cast(o_orderkey % 1100 as int)), '/Linearized 1') as content from {orders}"""


@query(f"""with t as ({S.plain(_MESSAGES)}) select k, coalesce(try_cast(regexp_extract(token, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)', 0) as double), 0e0) as number, try_cast(regexp_extract(message, 'segment type ([0-9]+)', 1) as int) as segment,
case when message = '' then 'none' when message like '%decode array%' then 'decode-array' when message like '%pixel limit%' then 'pixel-limit' when message like '%size disagrees%' then 'size-disagreement' when message like '%no dictionary%' then 'no-dictionary' else 'coding-mode' end as gate,
case when path like '/data/in/%' then substr(path, 10) else path end as relative, sha256(content) as hash, strpos(substr(content, 1, 1024), '/Linearized') > 0 as linearized from t""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CW3, F7, F10, F12-F14: lenient numbers, segment types, refusing gates, paths, hashes and the linearization mark."""
    t, content = S.derive(spark, sf_dir, _MESSAGES), F.col("content").cast("binary")
    return t.select(
        "k", T.number_prefix(F.col("token")).alias("number"), T.segment_type(F.col("message")).alias("segment"), T.gate_of(F.col("message")).alias("gate"),
        T.relative_path(F.col("path"), "/data/in").alias("relative"), T.pixel_hash(content).alias("hash"), T.is_linearized(content).alias("linearized"),
    )


@query("""select o_orderkey as k, case when o_orderkey % 5 = 0 then '' when o_orderkey % 3 = 0 then 'rewritten-linearized' when o_custkey % 2 = 0 then 'rewritten-delinearized' else 'rewritten' end as state,
case when o_orderkey % 7 = 0 then 'error' when o_custkey % 4 = 0 then 'warning' else '' end as severity,
case when o_orderkey % 11 = 0 then 'dictionary' when o_custkey % 13 = 0 then 'levels' when (o_custkey % 9) * (o_orderkey % 17) <= 0 or (o_custkey % 9) * (o_orderkey % 17) > 100 then 'pixels' when o_custkey % 9 <> o_custkey % 8 then 'size' when o_orderkey % 2 = 0 then 'decode' else '' end as gate,
case when length('#' || (o_custkey * 1000)) < length(o_orderpriority) then '#' || (o_custkey * 1000) else o_orderpriority end as smaller, o_custkey % 6 > 0 and o_orderkey % 4 <> 1 and o_orderkey % 5 <> 2 and o_custkey % 7 <> 3 as substitutable from orders""")
def state_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a file was left, gates of bilevel images, severities, the smaller of two and images that may be replaced."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return S.table(spark, sf_dir, "orders").select(
        k.alias("k"), provenance.optimized_state(k % 5 != 0, k % 3 == 0, c % 2 == 0).alias("state"), K.severity(F.when(k % 7 == 0, "broken"), c % 4 == 0).alias("severity"),
        K.jbig2_gate(k % 11 != 0, c % 13 != 0, c % 9, k % 17, c % 8, k % 17, k % 2 != 0, 100).alias("gate"),
        K.keep_smaller(F.col("o_orderpriority"), F.concat(F.lit("#"), (c * 1000).cast("string"))).alias("smaller"), C.substitutable(c % 6 - 1, k % 4 == 1, k % 5 == 2, c % 7 == 3).alias("substitutable"),
    )


# --- checks ---------------------------------------------------------------


@query(f"""with p as ({S.PLACEMENTS}), k as (select *, case m0 when 0 then 3 else width % 9 end as bits, case height % 4 when 0 then 'DeviceRGB' when 1 then 'Lab' else 'DeviceGray' end as space from p where placement_index >= 0),
r as (select case when bits not in (1, 2, 4, 8) then 'bad-depth' when space = 'Lab' then 'bad-colour-space' when filter = 'unknown' then 'bad-filter'
when filter in ('JBIG2Decode', 'CCITTFaxDecode') and bits <> 1 then 'bilevel-depth' else '' end as reason, filter = 'DCTDecode' and space <> 'Lab' and width % 3 <> 0 and height % 5 <> 0 as again from k)
select reason, count(*) as images, count(*) filter (where again) as recompressible from r group by reason""")
def image_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that can't be put into a document, and those that may be coded again."""
    p = S.derive(spark, sf_dir, S.PLACEMENTS).filter("placement_index >= 0")
    bits = F.when(F.col("m0") == 0, 3).otherwise(F.col("width") % 9)
    space = F.when(F.col("height") % 4 == 0, "DeviceRGB").when(F.col("height") % 4 == 1, "Lab").otherwise("DeviceGray")
    no = F.lit(False)
    rows = p.select(
        K.encoded_image_reason(F.col("width"), F.col("height"), bits, space, F.col("filter"), F.lit("x")).alias("reason"),
        K.recompressible(F.col("filter"), space, F.col("width") % 3 == 0, no, no, F.col("height") % 5 == 0).alias("again"),
    )
    return rows.groupBy("reason").agg(F.count("*").alias("images"), F.count_if("again").alias("recompressible"))


@query("""select case when l_partkey % 11 = 0 then 'no-source' when l_linenumber > l_suppkey % 7 then 'no-page' when l_partkey % 360 not in (0, 90, 180, 270) and l_partkey % 2 = 0 then 'bad-rotation'
when l_suppkey % 2 = 0 and l_discount <> 0 then 'cropped' else '' end as reason, count(*) as picks from lineitem group by 1""")
def pick_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that can't be taken over."""
    l = S.table(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey"))
    rotate = F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey") % 360).otherwise(0)
    reason = K.pick_reason(source, F.col("l_linenumber"), F.col("l_suppkey") % 7, rotate, F.col("l_discount"), F.col("l_suppkey") % 2 == 0)
    return l.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("picks"))


@query("""with b as (select l_partkey % 4 as depth, l_suppkey % 3 as surplus, l_quantity % 13 = 0 as broken, l_linenumber <> 7 as filled from lineitem)
select case when not filled then 'empty' when broken then 'lex-error' when depth > 0 and surplus > 0 then 'both' when depth > 0 then 'unclosed' when surplus > 0 then 'surplus' else '' end as reason, count(*) as pages from b group by 1""")
def state_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: content streams by the balance of their saved states."""
    l = S.table(spark, sf_dir, "lineitem")
    error = F.when(F.col("l_quantity") % 13 == 0, "cut off")
    reason = K.balance_reason(F.col("l_linenumber") != 7, F.col("l_partkey") % 4, F.col("l_suppkey") % 3, error)
    return l.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("pages"))


@query(f"""with {_PIXELS_SQL}, b as (select vec_id as image, cast(vec_id % 4 as int) as x0, cast(vec_id % 3 as int) as y0, cast(vec_id % 4 + 4 as int) as x1, cast(vec_id % 3 + 5 as int) as y1, vec_id % 10 <> 0 as has from embeddings),
k as (select px.*, has, x0, y0, x1, y1 from px join b on px.image = b.image where v < 128)
select image as page, count(*) as ink, count(*) filter (where not (has and x >= x0 and x < x1 and y >= y0 and y < y1)) as outside_0,
count(*) filter (where not (has and x >= x0 - 1 and x < x1 + 1 and y >= y0 - 1 and y < y1 + 1)) as outside_1, count(*) filter (where not (has and x >= x0 - 2 and x < x1 + 2 and y >= y0 - 2 and y < y1 + 2)) as outside_2 from k group by image""")
def ink_outside_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink of a rendering outside its raster's box, by guard."""
    px = pixels(spark, sf_dir).select(F.col("image").alias("page"), "x", "y", (F.col("v") < 128).alias("ink"))
    i = F.col("vec_id")
    boxes = S.table(spark, sf_dir, "embeddings").filter(i % 10 != 0).select(i.alias("page"), F.array(i % 4, i % 3, i % 4 + 4, i % 3 + 5).alias("box"))
    return P.ink_outside(px, boxes)


@query(f"""with {_PIXELS_SQL}, w as (select image, x, y, v < 100 as ink, v >= 140 as washed from px), b as (select image, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from w where washed group by image),
k as (select w.*, exists (select 1 from w n where n.image = w.image and n.ink and abs(n.x - w.x) <= 1 and abs(n.y - w.y) <= 1) as near, coalesce(w.x between x0 and x1 and w.y between y0 and y1, false) as within from w left join b on w.image = b.image)
select image as page, count(*) filter (where washed and not near) as deep, count(*) filter (where washed and near) as edge, count(*) filter (where not washed and within) as clear, count(*) filter (where not within) as outside from k group by image""")
def wash_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a background wash by their place."""
    px = pixels(spark, sf_dir)
    return P.wash_classes(px.select(F.col("image").alias("page"), "x", "y", (F.col("v") >= 140).alias("washed"), (F.col("v") < 100).alias("ink")))


@query("""select o_custkey as doc, min(o_orderkey) as o_orderkey_least, case when max(o_orderkey) > min(o_orderkey) then length(bin(max(o_orderkey) - min(o_orderkey))) else 0 end as o_orderkey_bits from orders group by o_custkey""")
def hint_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least values and bits that a hint table needs."""
    return P.extents(S.table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").withColumnRenamed("o_custkey", "doc")


@query(f"with {_PIXELS_SQL} select image, count(*) filter (where v < 128) as ink from px group by image")
def bilevel_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB1-JB5, K8: ink of rasters after a trip through the bilevel codec."""
    from pagelume.operators import jbig2

    def kernel(grey):
        return {"ink": int(jbig2.decode(jbig2.embedded(grey < 128)).sum())}

    return raster.over_rasters(spread(rasters(spark, sf_dir)), kernel, "ink bigint")
