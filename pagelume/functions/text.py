"""String, array and JSON functions of processing records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Capabilities of the current build.
CAPABILITIES = ("inspect", "extract-raster", "build-pdf", "jbig2-generic", "quantize-png", "downsample", "jpeg-recompress", "text-layer", "linearize")


def capability_of(applied: Column) -> Column:
    """An applied step without its numeric parameter, as in downsample-150."""
    return F.regexp_replace(applied, "-[0-9]+$", "")


def refusal_class(reason: Column) -> Column:
    """Coarse class of a fine refusal reason."""
    known = reason.isin("unsupported-codec-jbig2", "unsupported-codec-jpx")
    return (
        F.when(reason == "", "")
        .when(known, reason)
        .when(reason == "unsupported-codec-tif", "unsupported-codec-tiff")
        .when(reason.startswith("unsupported-codec"), "unsupported-codec")
        .otherwise("not-single-raster")
    )


def codec_reason(filter_name: Column) -> Column:
    """Refusal reason of a stream's codec, '' if it can be read."""
    supported = F.coalesce(filter_name, F.lit("")).isin("", "FlateDecode", "DCTDecode", "CCITTFaxDecode", "LZWDecode", "RunLengthDecode")
    kind = F.when(filter_name == "JBIG2Decode", "jbig2").when(filter_name == "JPXDecode", "jpx").otherwise(F.lower(filter_name))
    return F.when(supported, "").when(filter_name == "unknown", "unsupported-codec").otherwise(F.concat(F.lit("unsupported-codec-"), kind))


def union_sorted(a: Column, b: Column) -> Column:
    """Distinct elements of both in order; null counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))


def escape_literal(text: Column) -> Column:
    """A text as the inside of a parenthesised string."""
    return F.regexp_replace(text, r"([\\()])", r"\\$1")


def is_linearized(content: Column) -> Column:
    """The first KiB of a file names the linearization dictionary."""
    return F.locate("/Linearized", F.decode(F.substring(content, 1, 1024), "ISO-8859-1")) > 0


def relative_path(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def number_prefix(token: Column) -> Column:
    """The number that a token starts with, 0 if none: the lenient reading of broken numbers."""
    return F.coalesce(F.regexp_extract(token, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)", 0).try_cast("double"), F.lit(0.0))


def segment_type(message: Column) -> Column:
    """Number after 'segment type', null if none."""
    return F.regexp_extract(message, r"segment type ([0-9]+)", 1).try_cast("int")


def pixel_hash(pixels: Column) -> Column:
    return F.sha2(pixels, 256)


def gate_of(message: Column) -> Column:
    """Which check of a bilevel stream refused it; 'none' if none did."""
    return (
        F.when(F.coalesce(message, F.lit("")) == "", "none")
        .when(message.contains("decode array"), "decode-array")
        .when(message.contains("pixel limit"), "pixel-limit")
        .when(message.contains("size disagrees"), "size-disagreement")
        .when(message.contains("no dictionary"), "no-dictionary")
        .otherwise("coding-mode")
    )


def bucket_labels(edges: tuple[float, ...]) -> list[str]:
    """Names of upper-inclusive bins."""
    out = []
    for i, hi in enumerate(edges):
        top = "inf" if hi == float("inf") else f"{hi:g}"
        out.append(f"[0,{top}]" if i == 0 else f"({edges[i - 1]:g},{top}]")
    return out
