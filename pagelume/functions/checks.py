"""Checks of rows before work is done on them: each gives a reason, '' if there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(*arms: tuple[Column, str]) -> Column:
    out = None
    for bad, reason in arms:
        bad = F.coalesce(bad, F.lit(False))
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return out.otherwise("")


def balance_reason(has_content: Column, depth: Column, surplus: Column, error: Column) -> Column:
    """How the saved states of a content stream fail to balance."""
    return _first((~has_content, "empty"), (error.isNotNull() & (error != ""), "lex-error"), ((depth > 0) & (surplus > 0), "both"), (depth > 0, "unclosed"), (surplus > 0, "surplus"))


def pick_reason(source: Column, page: Column, pages_of_source: Column, rotate: Column, straighten: Column, cropped: Column) -> Column:
    """Why a page can't be taken over into a new document."""
    return _first(
        (source.isNull() | pages_of_source.isNull(), "no-source"),
        ((page < 1) | (page > pages_of_source), "no-page"),
        (~F.coalesce(rotate, F.lit(0)).isin(0, 90, 180, 270), "bad-rotation"),
        (F.isnan(straighten) | (F.abs(straighten) == float("inf")), "bad-angle"),
        (cropped & (F.coalesce(straighten, F.lit(0.0)) != 0), "cropped"),
    )


def encoded_image_reason(width: Column, height: Column, bits: Column, colour_space: Column, filter_name: Column, data: Column) -> Column:
    """Why an encoded image can't be put into a document."""
    return _first(
        (F.coalesce(width, F.lit(0)) <= 0, "no-width"),
        (F.coalesce(height, F.lit(0)) <= 0, "no-height"),
        (~bits.isin(1, 2, 4, 8) | bits.isNull(), "bad-depth"),
        (~colour_space.isin("DeviceGray", "DeviceRGB", "Indexed") | colour_space.isNull(), "bad-colour-space"),
        (~filter_name.isin("FlateDecode", "DCTDecode", "JBIG2Decode", "JPXDecode", "CCITTFaxDecode") | filter_name.isNull(), "bad-filter"),
        ((filter_name.isin("JBIG2Decode", "CCITTFaxDecode")) & (bits != 1), "bilevel-depth"),
        (F.octet_length(data).isNull() | (F.octet_length(data) == 0), "no-data"),
    )


def recompressible(filter_name: Column, colour_space: Column, smask: Column, mask: Column, image_mask: Column, decode: Column) -> Column:
    """An image that may be coded again at lower quality: a plain JPEG without masks or level maps."""
    plain = ~(smask | mask | image_mask | decode)
    return F.coalesce(plain & (filter_name == "DCTDecode") & colour_space.isin("DeviceGray", "DeviceRGB"), F.lit(False))


def keep_smaller(old: Column, new: Column) -> Column:
    """The new bytes where they are strictly fewer."""
    return F.when(F.octet_length(new) < F.octet_length(old), new).otherwise(old)


def severity(error: Column, partial: Column) -> Column:
    """Of a page's diagnostics: 'error' if its content failed, 'warning' if part of it was read."""
    return F.when(error.isNotNull() & (error != ""), "error").when(F.coalesce(partial, F.lit(False)), "warning").otherwise("")


def jbig2_gate(has_dictionary: Column, decode_ok: Column, width: Column, height: Column, coded_width: Column, coded_height: Column, decoded: Column, limit: int = 1 << 26) -> Column:
    """The first check that a bilevel image fails, in the order in which they are made."""
    pixels = width.cast("bigint") * height.cast("bigint")
    return _first((~has_dictionary, "dictionary"), (~decode_ok, "levels"), ((pixels <= 0) | (pixels > limit), "pixels"), ((width != coded_width) | (height != coded_height), "size"), (~decoded, "decode"))
