"""Ordered classifiers: the first matching arm names the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelume.functions import geometry as G

BASE_SHARE, PATCH_SHARE = 0.90, 0.02
FILL_TOLERANCE, STROKE_TOLERANCE = 1.0, 1e-3
_STROKES = ("S", "s", "B", "B*", "b", "b*")

IMAGE = "struct<id:int,ctm:array<double>,box:array<double>,clip:array<double>,opaque:boolean,ord:int,bpc:int,image_mask:boolean,smask:boolean,mask:boolean>"
PAINT = "struct<op:string,box:array<double>,clip:array<double>,ctm:array<double>,ord:int>"


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def bitonal(image: Column) -> Column:
    return _yes(image["bpc"] == 1) | _yes(image["image_mask"])


def opaque_cover(image: Column) -> Column:
    """The image hides what is under it; one without facts doesn't."""
    return _yes(image["opaque"]) & image["bpc"].isNotNull() & ~_yes(image["image_mask"]) & ~_yes(image["smask"]) & ~_yes(image["mask"])


def with_image_facts(images: Column) -> Column:
    """Placements with what the page tests ask of each, worked out once: cover, bit, known, quad, aligned, extent."""
    return F.transform(
        images,
        lambda i: F.struct(
            i["ctm"].alias("ctm"), i["box"].alias("box"), i["clip"].alias("clip"), i["ord"].alias("ord"), _yes(i["opaque"]).alias("opaque"),
            _yes(i["image_mask"]).alias("stencil"), _yes(i["smask"]).alias("smask"), _yes(i["mask"]).alias("mask"),
            (i["bpc"].isNotNull() | i["image_mask"].isNotNull()).alias("known"), bitonal(i).alias("bit"), opaque_cover(i).alias("cover"),
            G.unit_quad(i["ctm"]).alias("quad"), G.axis_aligned(i["ctm"]).alias("aligned"),
        ),
    )


def with_paint_facts(paints: Column) -> Column:
    """Paths with their ink, whether they mark, and the slack of hiding them."""
    return F.transform(
        paints,
        lambda p: F.struct(
            p["ord"].alias("ord"), p["ctm"].alias("ctm"), strokes(p).alias("stroke"), ink(p).alias("ink"), marks(p).alias("marks"),
            F.when(strokes(p), STROKE_TOLERANCE).otherwise(FILL_TOLERANCE).alias("slack"),
        ),
    )


def substitutable(obj_nr: Column, smask: Column, mask: Column, image_mask: Column) -> Column:
    return (obj_nr >= 0) & ~_yes(smask) & ~_yes(mask) & ~_yes(image_mask)


def placement_reason(m: Column) -> Column:
    return F.when(G.skew_degrees(m) > G.MAX_SKEW, "rotated-placement").when((m[0] <= 0) | (m[3] <= 0), "flipped-placement").otherwise("")


def strokes(paint: Column) -> Column:
    return paint["op"].isin(*_STROKES)


def ink(paint: Column) -> Column:
    """What a path marks: its box within its clip."""
    return F.when(paint["clip"].isNull(), paint["box"]).otherwise(G.intersect(paint["clip"], paint["box"]))


def marks(paint: Column) -> Column:
    """The path deposits ink at all."""
    c, b = paint["clip"], paint["box"]
    apart = (c[2] <= b[0]) | (c[0] >= b[2]) | (c[3] <= b[1]) | (c[1] >= b[3])
    return F.when(c.isNull(), strokes(paint) | G.has_extent(b)).when(apart, False).otherwise(strokes(paint) | G.has_extent(G.intersect(c, b)))


def _within(inner: Column, outer: Column, tol: Column) -> Column:
    return (inner[0] >= outer[0] - tol) & (inner[1] >= outer[1] - tol) & (inner[2] <= outer[2] + tol) & (inner[3] <= outer[3] + tol)


def hidden(paint: Column, images: Column, quads: bool = True) -> Column:
    """A later opaque image lies over all of the path's ink."""

    def over(image: Column) -> Column:
        held = (image["ord"] >= paint["ord"]) & image["cover"] & _within(paint["ink"], image["box"], paint["slack"])
        if quads:
            held = held & (image["aligned"] | _yes(G.same_rotation(paint["ctm"], image["ctm"])) | _yes(G.quad_contains_box(image["quad"], paint["ink"], paint["slack"])))
        return _yes(held)

    return F.exists(images, over)


def paints_hidden(images: Column, paints: Column, quads: bool = True) -> Column:
    return F.forall(paints, lambda p: ~p["marks"] | hidden(p, images, quads))


def layered(page: Column, images: Column) -> Column:
    """A bilevel layer under others fills the page, and another colour image is more than a speck."""
    whole = G.area(page)
    n = F.size(images)
    base = F.exists(F.filter(images, lambda i, k: i["known"] & i["bit"] & (k < n - 1)), lambda i: G.area(i["box"]) >= BASE_SHARE * whole)
    patch = F.exists(images, lambda i: i["known"] & ~i["bit"] & (G.area(i["box"]) > PATCH_SHARE * whole))
    return (whole > 0) & base & patch


def page_reason(page: Column, images: Column, paints: Column, inked_text: Column, inline_images: Column, shadings: Column, unresolved: Column, quads: bool = True) -> Column:
    """Why a page doesn't reduce to one raster; '' if it does.

    ``images`` and ``paints`` are in paint order, with their facts (see
    ``with_image_facts``), as columns of their own.  ``quads=False`` leaves out
    the tests of turned outlines, as the placement census does.
    """
    n = F.size(images)
    top = F.element_at(images, -1)
    stack = n > 1
    clipped = G.clip_narrowed(top["clip"], top["box"], top["ctm"]) & ~G.has_extent(top["box"])
    place = placement_reason(top["ctm"])
    under = F.slice(images, F.lit(1), F.greatest(n - 1, F.lit(0)))

    def held(u: Column) -> Column:
        inside = G.box_contains(top["box"], u["box"])
        if quads:
            inside = inside & (top["aligned"] | _yes(G.quad_contains_quad(top["quad"], u["quad"])))
        return _yes(inside)

    return (
        F.when(F.coalesce(n, F.lit(0)) <= 0, "no-image")
        .when(inked_text > 0, "has-text")
        .when(inline_images > 0, "inline-image")
        .when(~paints_hidden(images, paints, quads), "vector-paint")
        .when(shadings > 0, "shading")
        .when(F.size(unresolved) > 0, "unresolved-xobject")
        .when(layered(page, images), "mrc-layers")
        .when(clipped, F.when(stack, "multiple-images").otherwise("clipped-away"))
        .when(place != "", F.when(stack, "multiple-images").otherwise(place))
        .when(stack & ~G.box_contains(top["box"], page), "multiple-images")
        .when(stack & ~top["cover"], "transparent-overlay")
        .when(stack & ~F.forall(under, held), "multiple-images")
        .otherwise("")
    )


def clause(paint: Column, image: Column) -> Column:
    """Which test keeps an image from hiding a path.

    F painted before it, A see-through state, U without facts, C stencil, D
    soft mask, M mask, G out of reach; '' if it hides the path.
    """
    return (
        F.when(image["ord"] < paint["ord"], "F")
        .when(~image["opaque"], "A")
        .when(~image["known"], "U")
        .when(image["stencil"], "C")
        .when(image["smask"], "D")
        .when(image["mask"], "M")
        .when(overhang(paint, image) <= STROKE_TOLERANCE, "")
        .otherwise("G")
    )


#: Order in which clauses decide a page.
CLAUSES = ("A", "C", "D", "M", "U", "F", "G")


def overhang(paint: Column, image: Column) -> Column:
    """How far ink reaches past an image, at the worst edge; negative inside."""
    a, b = paint["ink"], image["box"]
    return F.greatest(b[0] - a[0], b[1] - a[1], a[2] - b[2], a[3] - b[3])


def with_clauses(paints: Column, images: Column) -> Column:
    """Marking paths that no image hides: (stroke, met: clauses of the images, reach: least overhang of those out of reach, or infinite)."""
    far = F.lit(float("inf"))
    tested = F.transform(
        F.filter(paints, lambda p: p["marks"]),
        lambda p: F.struct(
            p["stroke"].alias("stroke"),
            F.transform(images, lambda i: clause(p, i)).alias("met"),
            F.coalesce(F.array_min(F.transform(images, lambda i: F.when(clause(p, i) == "G", overhang(p, i)))), far).alias("reach"),
        ),
    )
    return F.filter(tested, lambda t: ~F.array_contains(t["met"], ""))


def deciding_clause(visible: Column) -> Column:
    """First clause, in CLAUSES order, that the first visible path met; '?' if there is no such path or image."""
    met = F.get(visible, F.lit(0))["met"]
    arms = F.when(met.isNull(), "?")
    for c in CLAUSES:
        arms = arms.when(F.array_contains(met, c), c)
    return arms.otherwise("?")


def required_tolerance(visible: Column, fills_only: bool = False) -> Column:
    """Least slack at which every visible path would be hidden: worst path, best image; infinite if none could."""
    far = F.lit(float("inf"))
    need = F.transform(visible, lambda t: F.when(t["stroke"], far).otherwise(t["reach"]) if fills_only else t["reach"])
    return F.coalesce(F.array_max(need), F.lit(0.0))


#: Annotation kinds that viewers draw without an appearance stream.
_VIEWER_DRAWN = ("Caret", "Circle", "FreeText", "Highlight", "Ink", "Line", "PolyLine", "Polygon", "Square", "Squiggly", "StrikeOut", "Text", "Underline")


def annotation_bucket(subtype: Column, flags: Column, rect: Column, has_ap: Column, has_apn: Column) -> Column:
    """What an annotation draws: 'PAINTS', or why it draws nothing."""
    return (
        F.when(F.coalesce(subtype, F.lit("")) == "", "no-subtype")
        .when(subtype == "Popup", "popup")
        .when(flags.bitwiseAND(2) != 0, "hidden")
        .when(flags.bitwiseAND(32) != 0, "noview-print-only")
        .when(rect.isNull(), "no-rect")
        .when(~G.has_extent(rect), "zero-area-rect")
        .when(has_apn, "PAINTS")
        .when(has_ap, "ap-without-n")
        .when(subtype.isin(*_VIEWER_DRAWN), "no-ap-viewer-synthesised")
        .otherwise("no-ap")
    )


def font_class(subtype: Column, to_unicode: Column, encoding: Column, symbolic: Column) -> Column:
    """How a font's codes map to text, A to G; the order of the tests is the rule."""
    return (
        F.when(subtype == "Type3", "G")
        .when(subtype == "Type0", F.when(to_unicode, "A").otherwise("F"))
        .when(to_unicode, "B")
        .when(encoding == "differences", "C")
        .when(symbolic, "E")
        .otherwise("D")
    )


def shown_font(subtype: Column) -> Column:
    """Not a descendant of a composite font."""
    return ~subtype.isin("CIDFontType0", "CIDFontType2")


def encryption_bucket(encrypted: Column, wrong_password: Column, opened: Column) -> Column:
    """1 plain, 2 encrypted but readable, 3 needs a password, 4 unreadable otherwise."""
    return F.when(opened & ~encrypted, 1).when(opened, 2).when(wrong_password, 3).otherwise(4)
