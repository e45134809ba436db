"""Kernels over rasters: thresholds, palettes, resampling, morphology, comparison.

Each kernel is a numpy function over one raster and a DataFrame function over
rows of (w, h, pixels), which runs it in Arrow batches.  ``sauvola_windows``
and ``otsu_table`` are the same rules over pixel rows, as plain aggregates and
windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW, K, R = 31, 0.5, 128.0


# --- thresholds -----------------------------------------------------------


def box_sums(a: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum, count) of every square neighbourhood, cut off at the borders."""
    h, w = a.shape
    total = np.zeros((h + 1, w + 1), np.float64)
    total[1:, 1:] = a.astype(np.float64).cumsum(0).cumsum(1)
    y0, y1 = np.clip(np.arange(h) - radius, 0, h), np.clip(np.arange(h) + radius + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - radius, 0, w), np.clip(np.arange(w) + radius + 1, 0, w)
    s = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    return s, (y1 - y0)[:, None] * (x1 - x0)[None, :]


def sauvola(grey: np.ndarray, window: int = WINDOW, k: float = K, r: float = R) -> np.ndarray:
    """Ink where a pixel is darker than m (1 + k (s / r - 1)) of its neighbourhood."""
    s, n = box_sums(grey, window // 2)
    s2, _ = box_sums(grey.astype(np.float64) ** 2, window // 2)
    mean = s / n
    deviation = np.sqrt(np.maximum(s2 / n - mean * mean, 0))
    return grey < mean * (1 + k * (deviation / r - 1))


def otsu(histogram: np.ndarray) -> int:
    """Threshold of the largest variance between classes, the first of equals."""
    n = histogram.sum()
    w = np.cumsum(histogram)[:-1]
    s = np.cumsum(histogram * np.arange(len(histogram)))
    rest = n - w
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = s[:-1] / w - (s[-1] - s[:-1]) / rest
        between = np.where((w > 0) & (rest > 0), w * rest * gap * gap, -1.0)
    return int(np.argmax(between)) if len(between) and between.max() >= 0 else 128


# --- bitmaps --------------------------------------------------------------


def pack_bits(ink: np.ndarray) -> bytes:
    """One bit per pixel, the first in the highest bit, rows padded to bytes, set for ink."""
    return np.packbits(ink.astype(bool), axis=1).tobytes()


def unpack_bits(data: bytes, w: int, h: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(h, -1), axis=1)[:, :w].astype(bool)


def grey_of(ink: np.ndarray, ink_level: int = 0, paper_level: int = 255) -> np.ndarray:
    """Bilevel raster as grey samples."""
    return np.where(ink, np.uint8(ink_level), np.uint8(paper_level))


def dilate(ink: np.ndarray, radius: int) -> np.ndarray:
    """Marked within ``radius`` of a marked pixel, in a square; outside counts as unmarked."""
    s, _ = box_sums(ink, radius)
    return s > 0.5


def erode(ink: np.ndarray, radius: int) -> np.ndarray:
    """Marked with its whole square neighbourhood; outside counts as unmarked."""
    s, _ = box_sums(ink, radius)
    return s > (2 * radius + 1) ** 2 - 0.5


# --- colours --------------------------------------------------------------


def _split(colours: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    axis = int(np.argmax(np.ptp(colours, axis=0)))
    order = np.lexsort((colours[:, 2], colours[:, 1], colours[:, 0], colours[:, axis]))
    half = np.cumsum(counts[order])
    cut = int(np.clip(np.searchsorted(half, half[-1] / 2) + 1, 1, len(order) - 1))
    return order[:cut], order[cut:]


def _spread(colours: np.ndarray, counts: np.ndarray) -> float:
    mean = (colours * counts[:, None]).sum(0) / counts.sum()
    return float((((colours - mean) ** 2).sum(1) * counts).sum())


def median_cut(colours: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Mean colours of boxes, cutting the box of the largest squared spread at the weighted half of its widest channel."""
    boxes = [(colours.astype(np.float64), counts.astype(np.float64))]
    spread = [_spread(*boxes[0])]
    while len(boxes) < size:
        i = int(np.argmax(spread))
        c, n = boxes[i]
        if spread[i] <= 0 or len(c) < 2:
            break
        a, b = _split(c, n)
        boxes[i : i + 1] = [(c[a], n[a]), (c[b], n[b])]
        spread[i : i + 1] = [_spread(c[a], n[a]), _spread(c[b], n[b])]
    return np.array([(c * n[:, None]).sum(0) / n.sum() for c, n in boxes])


def nearest(colours: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Index of the palette colour at the least squared distance, the first of equals."""
    out = np.empty(len(colours), np.int64)
    for at in range(0, len(colours), 4096):
        d = ((colours[at : at + 4096, None, :].astype(np.float64) - palette[None].astype(np.float64)) ** 2).sum(2)
        out[at : at + 4096] = d.argmin(1)
    return out


def refine(palette: np.ndarray, colours: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Moves each palette colour to the mean of its colours, a bounded number of times, until none moves."""
    rounds = int(np.clip(20_000_000 // max(1, len(colours) * len(palette)), 1, 10))
    for _ in range(rounds):
        near = nearest(colours, palette)
        weight = np.bincount(near, counts, len(palette))
        moved = palette.copy()
        used = weight > 0
        for ch in range(3):
            moved[used, ch] = np.bincount(near, counts * colours[:, ch], len(palette))[used] / weight[used]
        if np.array_equal(moved, palette):
            break
        palette = moved
    return palette


def quantize(rgb: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(palette n x 3, index per pixel): up to ``size`` colours, the most frequent first, then by red, green and blue."""
    if not 2 <= size <= 256:
        raise ValueError("a palette has 2 to 256 colours")
    flat = rgb.reshape(-1, 3)
    colours, inverse, counts = np.unique(flat, axis=0, return_inverse=True, return_counts=True)
    palette = colours.astype(np.float64) if len(colours) <= size else refine(median_cut(colours, counts, size), colours.astype(np.float64), counts)
    palette = np.unique(np.rint(palette).astype(np.int64), axis=0)
    near = nearest(colours, palette)
    population = np.bincount(near, counts, len(palette))
    palette, population = palette[population > 0], population[population > 0]
    order = np.lexsort((palette[:, 2], palette[:, 1], palette[:, 0], -population))
    palette = palette[order]
    return palette.astype(np.uint8), nearest(colours, palette)[inverse.ravel()].reshape(rgb.shape[:2])


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    error = ((a.astype(np.float64) - b.astype(np.float64)) ** 2).mean()
    return float("inf") if error == 0 else float(10 * np.log10(255**2 / error))


# --- resampling -----------------------------------------------------------


def _weights(n: int, m: int) -> np.ndarray:
    """Catmull-Rom weights that bring n samples to m, widened to the scale when shrinking."""
    scale = n / m
    support = 2 * max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale - 0.5
    x = np.abs(np.arange(n)[None, :] - centre[:, None]) / max(scale, 1.0)
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))
    w[np.abs(np.arange(n)[None, :] - centre[:, None]) > support] = 0
    return w / w.sum(1, keepdims=True)


def downsample(a: np.ndarray, source_dpi: float, target_dpi: float, bits: int = 8) -> np.ndarray:
    """Resized to the target resolution; as it is if that isn't lower; one-bit rasters take the nearest pixel."""
    if source_dpi <= target_dpi:
        return a
    h, w = (max(1, int(np.floor(n * target_dpi / source_dpi + 0.5))) for n in a.shape[:2])
    if bits == 1:
        y, x = ((np.arange(m) + 0.5) * n / m for n, m in ((a.shape[0], h), (a.shape[1], w)))
        return a[y.astype(int)][:, x.astype(int)]
    wide = a.astype(np.float64).reshape(a.shape[0], a.shape[1], -1)
    out = np.einsum("yi,ijc,xj->yxc", _weights(a.shape[0], h), wide, _weights(a.shape[1], w), optimize=True)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape(h, w, *a.shape[2:])


# --- PNG rows -------------------------------------------------------------


def unfilter(data: bytes, row_bytes: int, step: int) -> np.ndarray:
    """Undo the five row filters of PNG; ``step`` is bytes per pixel, at least 1."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, row_bytes + 1)
    out = np.zeros((len(rows), row_bytes), np.uint8)
    above = np.zeros(row_bytes, np.int64)
    for y, row in enumerate(rows):
        kind, raw = int(row[0]), row[1:].astype(np.int64)
        if kind == 0:
            line = raw
        elif kind == 2:
            line = (raw + above) & 255
        elif kind in (1, 3, 4):
            line = np.zeros(row_bytes, np.int64)
            for i in range(row_bytes):
                left = line[i - step] if i >= step else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above[i]) // 2
                else:
                    corner = above[i - step] if i >= step else 0
                    p = left + above[i] - corner
                    guess = min(((abs(p - left), 0, left), (abs(p - above[i]), 1, above[i]), (abs(p - corner), 2, corner)))[2]
                line[i] = (raw[i] + guess) & 255
        else:
            raise ValueError(f"no row filter {kind}")
        out[y] = line
        above = line
    return out


def largest_samples(rows: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Largest sample of each row of packed samples, padding left out."""
    if bits == 8:
        return rows[:, :width].max(1)
    each = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits)[:, :width]
    return (each * (1 << np.arange(bits)[::-1])).sum(2).max(1)


# --- over tables ----------------------------------------------------------


def over_rasters(rasters: DataFrame, kernel: Callable[[np.ndarray], dict], kinds: str) -> DataFrame:
    """One row of ``kernel``'s values per raster (image, w, h, pixels: grey bytes); null pixels give nulls."""
    names = [k.strip().split(" ")[0] for k in kinds.split(",")]
    schema = f"image {dict(rasters.dtypes)['image']}, {kinds}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("image", *names)}
            for image, w, h, pixels in zip(*(batch.column(c).to_pylist() for c in ("image", "w", "h", "pixels"))):
                got = kernel(np.frombuffer(pixels, np.uint8).reshape(h, w)) if pixels else dict.fromkeys(names)
                out["image"].append(image)
                for n in names:
                    out[n].append(got[n])
            yield pa.RecordBatch.from_pydict(out)

    return rasters.select("image", "w", "h", "pixels").mapInArrow(run, schema)


def sauvola_windows(pixels: DataFrame, radius: int = WINDOW // 2, k: float = K, r: float = R) -> DataFrame:
    """(image, x, y, ink) from pixel rows (image, x, y, v): window sums along x, then along y."""
    along = Window.partitionBy("image", "y").orderBy("x").rowsBetween(-radius, radius)
    down = Window.partitionBy("image", "x").orderBy("y").rowsBetween(-radius, radius)
    first = pixels.select("image", "x", "y", "v", *[f.over(along).alias(n) for n, f in (("s", F.sum("v")), ("q", F.sum(F.col("v") * F.col("v"))), ("n", F.count("v")))])
    both = first.select("image", "x", "y", "v", *[F.sum(c).over(down).alias(c) for c in ("s", "q", "n")])
    mean = F.col("s") / F.col("n")
    deviation = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return both.select("image", "x", "y", (F.col("v") < mean * (1 + k * (deviation / r - 1))).alias("ink"))


def otsu_table(pixels: DataFrame) -> DataFrame:
    """(image, threshold) from pixel rows: histogram per image, running sums, best gap."""
    bins = pixels.groupBy("image", "v").agg(F.count("*").alias("n"))
    up = Window.partitionBy("image").orderBy("v")
    all_ = Window.partitionBy("image")
    sums = bins.select("image", "v", F.sum("n").over(up).alias("w"), F.sum(F.col("n") * F.col("v")).over(up).alias("s"), F.sum("n").over(all_).alias("nn"), F.sum(F.col("n") * F.col("v")).over(all_).alias("ss"))
    rest = F.col("nn") - F.col("w")
    gap = F.col("s") / F.col("w") - (F.col("ss") - F.col("s")) / rest
    scored = sums.filter(rest > 0).withColumn("score", F.col("w") * rest * gap * gap)
    best = F.row_number().over(Window.partitionBy("image").orderBy(F.desc(F.round("score", 6)), "v"))
    return scored.withColumn("rank", best).filter("rank = 1").select("image", F.col("v").alias("threshold"))


def dilate_rows(ink: DataFrame, radius: int, erode: bool = False) -> DataFrame:
    """(image, x, y, ink) dilated or eroded by a square, as two one-way windows; outside counts as unmarked."""
    along = Window.partitionBy("image", "y").orderBy("x").rowsBetween(-radius, radius)
    down = Window.partitionBy("image", "x").orderBy("y").rowsBetween(-radius, radius)
    full = (2 * radius + 1) ** 2
    one = ink.select("image", "x", "y", F.sum(F.col("ink").cast("int")).over(along).alias("s"))
    two = one.select("image", "x", "y", F.sum("s").over(down).alias("s"))
    return two.select("image", "x", "y", (F.col("s") == full if erode else F.col("s") > 0).alias("ink"))


def ink_share(pixels: DataFrame, level: int = 128) -> DataFrame:
    """(image, ink, mean): share of pixels darker than ``level``, and the mean sample."""
    return pixels.groupBy("image").agg(F.round(F.avg((F.col("v") < level).cast("double")), 6).alias("ink"), F.round(F.avg("v"), 6).alias("mean"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image, mean_difference, psnr) of two tables of pixel rows; psnr is null for equal images."""
    both = a.select("image", "x", "y", F.col("v").alias("v")).join(b.select("image", "x", "y", F.col("v").alias("u")), ["image", "x", "y"])
    d = F.col("v") - F.col("u")
    per = both.groupBy("image").agg(F.avg(F.abs(d)).alias("m"), F.avg(d * d).alias("e"))
    return per.select("image", F.round("m", 6).alias("mean_difference"), F.when(F.col("e") > 0, F.round(10 * F.log10(F.lit(65025.0) / F.col("e")), 6)).alias("psnr"))


def nearest_colour(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """(image, x, y, i): nearest palette entry (i, c) of each grey pixel, the first of equals; a palette has at most 256 rows."""
    entries = F.transform(F.col("p"), lambda e: F.struct(((F.col("v") - e["c"]) * (F.col("v") - e["c"])).alias("d"), e["i"].alias("i")))
    listed = palette.agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("p"))
    return pixels.crossJoin(F.broadcast(listed)).select("image", "x", "y", F.array_min(entries)["i"].alias("i"))
