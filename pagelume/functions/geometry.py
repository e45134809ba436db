"""Affine placements, boxes and quadrilaterals as column expressions.

A matrix is array<double> of six (row-vector convention, origin lower left, y
up), a box array<double> of four (llx, lly, urx, ury), a quadrilateral
array<double> of eight in ring order.  Everything is built from codegen'd
expressions; a null argument gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slack of containment tests, in points.
COVER_TOLERANCE = 1.0
#: Largest skew of a page that still counts as upright, in degrees.
MAX_SKEW = 2.0

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _at(a: Column, *indices: int) -> list[Column]:
    return [a[i] for i in indices]


def multiply(a: Column, b: Column) -> Column:
    """``a`` applied before ``b``."""
    out = []
    for row in (0, 2, 4):
        for col in (0, 1):
            cell = a[row] * b[col] + a[row + 1] * b[col + 2]
            out.append(cell + b[4 + col] if row == 4 else cell)
    return F.array(*out)


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def _bounds(points: list[tuple[Column, Column]]) -> Column:
    xs, ys = zip(*points)
    return F.array(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def _corners(m: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> list[tuple[Column, Column]]:
    return [apply(m, x0, y0), apply(m, x1, y0), apply(m, x1, y1), apply(m, x0, y1)]


def unit_box(m: Column) -> Column:
    """Bounds of the unit square under ``m``."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return _bounds(_corners(m, zero, zero, one, one))


def unit_quad(m: Column) -> Column:
    """The unit square under ``m``, corner by corner."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*[c for point in _corners(m, zero, zero, one, one) for c in point])


def map_box(box: Column, m: Column) -> Column:
    """Bounds of ``box`` under ``m``."""
    return _bounds(_corners(m, *_at(box, 0, 1, 2, 3)))


def signed_area2(quad: Column) -> Column:
    """Twice the signed area."""
    terms = [quad[2 * i] * quad[(2 * i + 3) % 8] - quad[(2 * i + 2) % 8] * quad[2 * i + 1] for i in range(4)]
    return terms[0] + terms[1] + terms[2] + terms[3]


def _edges_hold(quad: Column, points: list[tuple[Column, Column]], tolerance: Column | float) -> Column:
    twice = signed_area2(quad)
    turn = F.when(twice < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    good = twice != 0
    for i in range(4):
        px, py = quad[2 * i], quad[2 * i + 1]
        ex, ey = quad[(2 * i + 2) % 8] - px, quad[(2 * i + 3) % 8] - py
        length = F.hypot(ex, ey)
        good = good & (length != 0)
        for tx, ty in points:
            good = good & (turn * (ex * (ty - py) - ey * (tx - px)) >= length * -tolerance)
    return good


def quad_contains_box(quad: Column, box: Column, tolerance: Column | float = COVER_TOLERANCE) -> Column:
    """Every corner of ``box`` lies within ``tolerance`` of the inside; false for a degenerate quadrilateral."""
    x0, y0, x1, y1 = _at(box, 0, 1, 2, 3)
    return _edges_hold(quad, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)], tolerance)


def quad_contains_quad(quad: Column, inner: Column, tolerance: Column | float = COVER_TOLERANCE) -> Column:
    return _edges_hold(quad, [(inner[2 * i], inner[2 * i + 1]) for i in range(4)], tolerance)


def _outward(low: Column, high: Column) -> tuple[Column, Column]:
    flat = (F.round(low) == F.round(high)) & (high > low)
    return F.when(flat, F.floor(low)).otherwise(F.round(low)).cast("int"), F.when(flat, F.ceil(high)).otherwise(F.round(high)).cast("int")


def pixel_rect(box: Column) -> Column:
    """Whole-point bounds: edges rounded half away from zero, a collapsed extent widened outward."""
    (x0, x1), (y0, y1) = _outward(box[0], box[2]), _outward(box[1], box[3])
    return F.array(x0, y0, x1, y1)


def placement_degrees(m: Column) -> Column:
    return F.degrees(F.atan2(m[1], m[0]))


def skew_degrees(m: Column) -> Column:
    """The larger of the two axes' unsigned angles."""
    return F.degrees(F.greatest(F.atan2(F.abs(m[1]), F.abs(m[0])), F.atan2(F.abs(m[2]), F.abs(m[3]))))


def degenerate(m: Column) -> Column:
    """An axis has no length."""
    return ((m[0] == 0) & (m[1] == 0)) | ((m[2] == 0) & (m[3] == 0))


def shear_degrees(m: Column) -> Column:
    """How far the axes are from square; null if degenerate."""
    cross, dot = m[0] * m[3] - m[1] * m[2], m[0] * m[2] + m[1] * m[3]
    return F.when(~degenerate(m), F.abs(90 - F.degrees(F.atan2(F.abs(cross), dot))))


def axis_aligned(m: Column) -> Column:
    return (m[1] == 0) & (m[2] == 0)


def same_rotation(a: Column, b: Column) -> Column:
    """The x axes point the same way, to a millionth."""
    na, nb = F.hypot(a[0], a[1]), F.hypot(b[0], b[1])
    cross, dot = a[0] * b[1] - a[1] * b[0], a[0] * b[0] + a[1] * b[1]
    return (na != 0) & (nb != 0) & (dot > 0) & (F.abs(cross) < 1e-6 * na * nb)


def box_contains(outer: Column, inner: Column, tolerance: float = COVER_TOLERANCE) -> Column:
    return (outer[0] <= inner[0] + tolerance) & (outer[1] <= inner[1] + tolerance) & (outer[2] >= inner[2] - tolerance) & (outer[3] >= inner[3] - tolerance)


def area(box: Column) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def has_extent(box: Column) -> Column:
    return (box[2] > box[0]) & (box[3] > box[1])


def upright(box: Column) -> Column:
    """Corners swapped where they are reversed."""
    return F.array(F.least(box[0], box[2]), F.least(box[1], box[3]), F.greatest(box[0], box[2]), F.greatest(box[1], box[3]))


def intersect(a: Column, b: Column) -> Column:
    """Common part; disjoint boxes give a zero extent at the nearer edge."""
    x, y = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    return F.array(x, y, F.greatest(x, F.least(a[2], b[2])), F.greatest(y, F.least(a[3], b[3])))


def narrow_clip(clip: Column, path: Column) -> Column:
    """A clip narrowed by a path's bounds; a null path leaves it, a null clip is none."""
    return F.when(path.isNull(), clip).when(clip.isNull(), path).otherwise(intersect(clip, path))


def clip_narrowed(clip: Column, box: Column, m: Column) -> Column:
    """A clip cut the placement below its own extent."""
    return clip.isNotNull() & (box != unit_box(m))


def covers_page_rect(rect: Column, page: Column, quad: Column) -> Column:
    """Integer form: no slack for the box; a turned placement is tested by its quadrilateral."""
    whole = (page[2] > page[0]) & (page[3] > page[1])
    inside = (rect[0] <= page[0]) & (rect[1] <= page[1]) & (rect[2] >= page[2]) & (rect[3] >= page[3])
    return whole & inside & (quad.isNull() | F.coalesce(quad_contains_box(quad, page.cast("array<double>")), F.lit(False)))


def covers_page_record(raster: Column, page: Column, quad: Column) -> Column:
    """Float form on a stored record: one point of slack; a degenerate page isn't covered."""
    return has_extent(page) & box_contains(raster, page) & (quad.isNull() | F.coalesce(quad_contains_box(quad, page), F.lit(False)))


def escapes(rect: Column, box: Column, tolerance: float = 1e-3) -> Column:
    """Some edge of ``rect`` is outside ``box``."""
    return (rect[0] < box[0] - tolerance) | (rect[1] < box[1] - tolerance) | (rect[2] > box[2] + tolerance) | (rect[3] > box[3] + tolerance)


def rotate_about(degrees: Column, cx: Column, cy: Column) -> Column:
    """Matrix of a counter-clockwise turn about a point."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.array(c, s, -s, c, cx - cx * c + cy * s, cy - cx * s - cy * c)


def centre(box: Column) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def invert(m: Column) -> Column:
    """Inverse matrix; null if there is none."""
    det = m[0] * m[3] - m[1] * m[2]
    inverse = F.array(m[3] / det, -m[1] / det, -m[2] / det, m[0] / det, (m[2] * m[5] - m[3] * m[4]) / det, (m[1] * m[4] - m[0] * m[5]) / det)
    return F.when(det != 0, inverse)


def quarter_turns(rotate: Column) -> Column:
    """A rotation in [0, 360)."""
    return F.pmod(rotate, F.lit(360))


def page_points(pixels: Column, dpi: Column) -> Column:
    return pixels * 72.0 / dpi


def scaled_pixels(pixels: Column, source_dpi: Column, target_dpi: Column) -> Column:
    """Size after downsampling, at least 1; unchanged if the target isn't lower."""
    return F.when(source_dpi <= target_dpi, pixels).otherwise(F.greatest(F.lit(1), F.round(pixels * target_dpi / source_dpi).cast("int")))


def grey_level(decoded: Column) -> Column:
    """0 to 255 of a decoded sample, clamped; NaN counts as 0."""
    safe = F.when(F.isnan(decoded), 0.0).otherwise(decoded)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), safe)) * 255).cast("int")


def palette_depth(colours: Column) -> Column:
    """Bits of an index into a palette."""
    return F.when(colours <= 2, 1).when(colours <= 4, 2).when(colours <= 16, 4).when(colours <= 256, 8)


def line_scale(m: Column) -> Column:
    """Factor by which a line's width is scaled."""
    return F.sqrt(F.abs(m[0] * m[3] - m[1] * m[2]))


def word_scale(width: Column, height: Column, advance: Column) -> Column:
    """Horizontal scale, in percent, that fits a word of ``advance`` thousandths into a box; null for an empty box or word."""
    return F.when((width > 0) & (height > 0) & (advance > 0), 100.0 * width * 1000.0 / (advance * height))
