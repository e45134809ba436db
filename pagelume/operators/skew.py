"""Skew of scanned text by projection profiles, and convergence of its edges."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelume.operators.raster import otsu

MAX_SIDE, MIN_POINTS, MIN_INK, MAX_INK = 1200, 500, 0.002, 0.60
SEARCH, COARSE, FINE, MIN_CONFIDENCE = 15.0, 0.5, 0.025, 0.15
#: Bands across a page and the points that one needs.
BANDS, BAND_POINTS = 3, 400
#: Slices in which the sides of the text are looked for, points of a slice, slices of a side, and how far in a side lies.
SLICES, SLICE_POINTS, SIDE_SLICES, EDGE_SHARE = 24, 40, 8, 0.05
#: Largest median distance of a side's slices from its line, as a share of the width.
MAX_RESIDUAL = 0.02
#: Angles by points that the search turns at once, so that its arrays stay in a core's cache.
CELLS = 1 << 16


def median(x: np.ndarray) -> float:
    """Mean of the middle two, 0 for none."""
    s, m = np.sort(x), len(x) // 2
    return float(s[m] if len(s) % 2 else (s[m - 1] + s[m]) / 2) if len(s) else 0.0


def block_min(grey: np.ndarray, step: int) -> np.ndarray:
    """Darkest sample of each step x step block."""
    if step == 1:
        return grey
    h, w = grey.shape
    padded = np.pad(grey, ((0, -h % step), (0, -w % step)), constant_values=255)
    return padded.reshape(padded.shape[0] // step, step, padded.shape[1] // step, step).min((1, 3))


def ink_points(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, tuple[int, int]]:
    """(x, y, share of ink, size) of dark blocks, at most MAX_SIDE a side."""
    step = max(1, -(-max(grey.shape) // MAX_SIDE))
    small = block_min(grey, step)
    hist = np.bincount(small.ravel(), minlength=256)
    level = otsu(hist) if np.count_nonzero(hist) > 1 else 128
    y, x = np.nonzero(small <= level if np.count_nonzero(hist) > 1 else small < level)
    return x.astype(np.float64), y.astype(np.float64), len(x) / max(1, small.size), small.shape


@lru_cache(maxsize=256)
def turns(around: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(degrees, cosines, sines) of the coarse angles, or of the fine ones around one of them."""
    if around is None:
        degrees = np.arange(-SEARCH, SEARCH + COARSE / 2, COARSE)
    else:
        fine = np.arange(around - COARSE, around + COARSE + FINE / 2, FINE)
        degrees = fine[np.abs(fine) <= SEARCH + 1e-9]
    a = [np.radians(d) for d in degrees]
    return degrees, np.array([np.cos(r) for r in a]), np.array([np.sin(r) for r in a])


def profile_scores(x: np.ndarray, y: np.ndarray, band: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
    """[band, angle, 0 or 1]: sums of squares of the profile across lines falling to the right by each angle, and of its steps.

    The whole follows the bands: its profile is the sum of theirs, so each point
    is turned once for both.  The angles must be under 90 degrees, so that the
    corners of the points bound their rows.
    """
    out = np.empty((BANDS + 1, len(cos), 2))
    low = np.floor(y.min() * cos - np.maximum(x.min() * sin, x.max() * sin))
    high = np.floor(y.max() * cos - np.minimum(x.min() * sin, x.max() * sin))
    width = int((high - low).max()) + 1
    of = band * float(width)
    many = max(1, CELLS // len(x))
    for i in range(0, len(cos), many):
        c, s = cos[i : i + many, None], sin[i : i + many, None]
        row = y * c
        row -= x * s
        np.floor(row, out=row)
        row += of
        row += np.arange(len(c))[:, None] * float(BANDS * width) - low[i : i + many, None]
        n = np.bincount(row.astype(np.intp).ravel(), minlength=len(c) * BANDS * width).reshape(len(c), BANDS, width)
        n = np.concatenate([n, n.sum(1, keepdims=True)], axis=1).astype(np.float64)
        step = n[..., 1:] - n[..., :-1]
        out[:, i : i + many, 0] = np.einsum("abr,abr->ba", n, n)
        out[:, i : i + many, 1] = (np.einsum("abr,abr->ab", step, step) + n[..., 0] ** 2 + n[..., -1] ** 2).T
    return out


def search(scores: Callable[[float | None], np.ndarray], kinds: int = 2) -> tuple[float, float, float | None, bool]:
    """(degrees, confidence, degrees by the steps of the profile, at the end of the range); counter-clockwise is positive.

    ``scores`` gives both scores of the coarse angles, or of the fine ones
    around one.  Each is searched coarsely, then finely around its own best
    angle, the second only with two ``kinds``.  Rows run downward, so a
    counter-clockwise turn is a fall by its negative.
    """
    coarse, first = turns(None)[0], scores(None)
    found = []
    for which in range(kinds):
        at = int(np.argmax(first[:, which]))
        around, most = coarse[at], first[at, which]
        fine, sharp = turns(around)[0], scores(around)[:, which]
        better = sharp.max() > most  # of equal scores the coarse angle stays
        found.append((float(-fine[np.argmax(sharp)] if better else -around), float(max(most, sharp.max()))))
    middle = median(first[:, 0])
    return found[0][0], (found[0][1] / middle - 1 if middle else 0.0), found[1][0] if kinds > 1 else None, int(np.argmax(first[:, 0])) in (0, len(coarse) - 1)


@lru_cache(maxsize=64)
def pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def fit_line(t: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    """Theil-Sen slope, and the median distance from the line through the median intercept."""
    i, j = pairs(len(t))
    d = t[j] - t[i]
    slope = median((v[j] - v[i])[d != 0] / d[d != 0])
    rest = v - slope * t
    return slope, median(np.abs(rest - median(rest)))


def edges(x: np.ndarray, y: np.ndarray, degrees: float) -> tuple[float, float, float] | None:
    """(left, right, residual): angles of the sides of the text, from vertical, after it is turned back by its own angle; None with too few slices."""
    a = np.radians(degrees)
    across, down = x * np.cos(a) - y * np.sin(a), x * np.sin(a) + y * np.cos(a)
    low, high = down.min(), down.max()
    if high - low < SLICES:
        return None
    step = (high - low) / SLICES
    of = np.minimum(((down - low) / step).astype(int), SLICES - 1)
    t, sides = [], []
    for b in range(SLICES):
        xs = np.sort(across[of == b])
        if len(xs) >= SLICE_POINTS:
            k = int(EDGE_SHARE * len(xs))
            t.append(low + (b + 0.5) * step)
            sides.append((xs[k], xs[-1 - k]))
    if len(t) < SIDE_SLICES:
        return None
    fits = [fit_line(np.array(t), np.array(v)) for v in zip(*sides)]
    left, right = (float(np.degrees(np.arctan(slope))) for slope, _ in fits)
    return left, right, max(r for _, r in fits)


def measure(grey: np.ndarray) -> dict:
    """Skew estimate of one raster, counter-clockwise positive.

    ``ok`` says that the raster has lines to measure; without it the angles are
    0.  ``spread`` is the widest disagreement of bands that can be measured, -1
    with under two.  ``converge`` is the left side's angle less the right
    side's, to be trusted if ``edges_ok``.
    """
    x, y, share, (h, w) = ink_points(grey)
    out = {
        "deg": 0.0, "confidence": 0.0, "alt_deg": 0.0, "ok": False, "points": len(x), "ink": share, "spread": -1.0, "railed": False,
        "left": None, "right": None, "converge": None, "residual": None, "edges_ok": False,
    }
    if len(x) < MIN_POINTS or not MIN_INK <= share <= MAX_INK:
        return out
    band = np.minimum(y.astype(int) // max(h // BANDS, 1), BANDS - 1)
    seen = {}

    def scores(part: int) -> Callable[[float | None], np.ndarray]:
        def of(around: float | None) -> np.ndarray:
            if around not in seen:
                seen[around] = profile_scores(x, y, band, *turns(around)[1:])
            return seen[around][part]

        return of

    deg, confidence, alt, railed = search(scores(BANDS))
    out |= {"confidence": confidence, "railed": railed, "ok": confidence >= MIN_CONFIDENCE and not railed}
    if not out["ok"]:
        return out
    out |= {"deg": deg, "alt_deg": alt}
    parts = [search(scores(k), 1) for k in range(BANDS) if (band == k).sum() >= BAND_POINTS]
    parts = [d for d, c, _, end in parts if c >= MIN_CONFIDENCE and not end]
    if len(parts) >= 2:
        out["spread"] = max(parts) - min(parts)
    sides = edges(x, y, deg)
    if sides:
        left, right, residual = sides
        out |= {"left": left, "right": right, "converge": left - right, "residual": residual, "edges_ok": residual <= MAX_RESIDUAL * w}
    return out


KINDS = "deg double, confidence double, alt_deg double, ok boolean, points bigint, ink double, spread double, railed boolean, left double, right double, converge double, residual double, edges_ok boolean"


@lru_cache(maxsize=128)
def ruling(degrees: float, side: int, pitch: int, thick: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, u, line): pixels of the lines of full length, how far along their line they lie, and its number."""
    y, x = np.indices((side, side)) - (side - 1) / 2
    a = np.radians(-degrees)
    u, v = x * np.cos(a) + y * np.sin(a), y * np.cos(a) - x * np.sin(a)
    line = np.floor((v + side) / pitch).astype(int)
    half = side / 2 - margin
    place = np.flatnonzero((np.abs(v) <= half) & (u >= -half) & (u <= half) & ((v + side) % pitch < thick))
    return place, u.ravel()[place], line.ravel()[place]


def ruled(degrees: float, lengths: np.ndarray, side: int = 192, pitch: int = 8, thick: int = 1, margin: int = 24) -> np.ndarray:
    """A white page with ruled lines turned counter-clockwise by an angle: an even left edge, right ends drawn in by ``lengths`` (0 to 255)."""
    place, u, line = ruling(degrees, side, pitch, thick, margin)
    page = np.full(side * side, 255, np.uint8)
    page[place[u <= side / 2 - margin - lengths[line % len(lengths)] / 16]] = 0
    return page.reshape(side, side)


def census(estimates: DataFrame) -> DataFrame:
    """(pages, extracted, measured): all rows, those with a raster, and those whose estimate can be relied on."""
    return estimates.agg(F.count("*").alias("pages"), F.count("points").alias("extracted"), F.coalesce(F.count_if("ok"), F.lit(0)).alias("measured"))
