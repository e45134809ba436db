"""Per-document processing records: reading, merging, and what a newer build could do better."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelume.functions.text import capability_of, union_sorted

PAGE = (
    "struct<applied:array<string>,diverted:string,placement:array<double>,dropped_annots:int,"
    "geometry:struct<raster_box:array<double>,page_box:array<double>,clip_box:array<double>,raster_quad:array<double>>,straightened:struct<deg:double>>"
)
RECORD = f"version string, capabilities array<string>, processed_at timestamp, pages array<{PAGE}>, optimized string"

_STRINGS = "array<string>"
REWRITTEN = "rewritten-linearized"
SOURCE_UNRECORDED = "source-unrecorded"


def read_record(text: Column) -> Column:
    """(status, record) of a stored JSON record: absent, corrupt (record null) or ok.

    Unknown fields are ignored, missing ones null; a null list counts as empty.
    """
    sound = F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*\{")
    status = F.when(text.isNull(), "absent").when(sound, "ok").otherwise("corrupt")
    return F.struct(status.alias("status"), F.when(status == "ok", F.from_json(text, RECORD)).alias("record"))


def write_record(record: Column) -> Column:
    """JSON without absent fields."""
    return F.to_json(record)


def padded_quad(quad: Column) -> Column:
    """A stored quadrilateral as eight numbers, zeros where it is short; null stays null."""
    return F.when(quad.isNotNull(), F.slice(F.concat(quad, F.array_repeat(F.lit(0.0), 8)), 1, 8))


# --- rules ----------------------------------------------------------------

Rule = Callable[[Column], Column]


def _pages(record: Column) -> Column:
    return F.coalesce(record["pages"], F.array().cast(f"array<{PAGE}>"))


def applied(step: str) -> Rule:
    """Some page had this step applied, whatever its parameter."""
    return lambda r: F.exists(_pages(r), lambda p: F.exists(F.coalesce(p["applied"], F.array().cast(_STRINGS)), lambda a: capability_of(a) == step))


def applied_prefix(*prefixes: str) -> Rule:
    def rule(r: Column) -> Column:
        def any_of(a: Column) -> Column:
            out = a.startswith(prefixes[0])
            for p in prefixes[1:]:
                out = out | a.startswith(p)
            return out

        return F.exists(_pages(r), lambda p: F.exists(F.coalesce(p["applied"], F.array().cast(_STRINGS)), any_of))

    return rule


def diverted(*reasons: str) -> Rule:
    return lambda r: F.exists(_pages(r), lambda p: F.coalesce(p["diverted"].isin(*reasons), F.lit(False)))


def _render(r: Column) -> Column:
    lost = F.exists(_pages(r), lambda p: F.coalesce(p["dropped_annots"] > 0, F.lit(False)))
    return lost | diverted("not-single-raster")(r)


def _never(r: Column) -> Column:
    return F.lit(False)


#: When a capability the record lacks is worth running; one without a rule always is.
RULES: dict[str, Rule] = {
    **dict.fromkeys(("inspect", "extract-raster", "build-pdf", "ccitt-g4", "quantize-png", "downsample", "jpeg-recompress", "text-layer"), _never),
    "jbig2-generic": applied("ccitt-g4"),
    "jbig2-symbol": applied("jbig2-generic"),
    "render": _render,
    "decode-jbig2": diverted("unsupported-codec", "unsupported-codec-jbig2"),
    "decode-jpx": diverted("unsupported-codec", "unsupported-codec-jpx"),
    "decode-tiff": diverted("unsupported-codec", "unsupported-codec-tiff"),
    "linearize": lambda r: ~r["optimized"].eqNullSafe(F.lit(REWRITTEN)),
    "page-cleanup": applied_prefix("jbig2-", "ccitt-", "quantize-", "downsample-", "jpeg-"),
    "pdfa": lambda r: F.lit(True),
}

#: Capabilities that are planned but not built.
PLANNED = ("ccitt-g4", "decode-jbig2", "decode-jpx", "decode-tiff", "jbig2-symbol", "page-cleanup", "pdfa", "render")


def upgrade_candidates(record: Column, current: Column) -> Column:
    """Sorted distinct capabilities of ``current`` worth running on a document; all of them for a null record."""
    have = F.coalesce(record["capabilities"], F.array().cast(_STRINGS))
    verdicts = F.create_map(*[x for name, rule in RULES.items() for x in (F.lit(name), rule(record))])
    chosen = F.filter(current, lambda c: ~F.array_contains(have, c) & F.coalesce(F.try_element_at(verdicts, c), F.lit(True)))
    return F.array_sort(F.array_distinct(F.when(record.isNull(), current).otherwise(chosen)))


# --- merging --------------------------------------------------------------


def merge_extraction(old: Column, new: Column) -> Column:
    """A fresh extraction's record with what the earlier one still says.

    Capabilities are united; page by page, steps are united unless the page
    diverted, and the straightening is carried; pages that are no longer there
    go.  A null ``old`` changes nothing.
    """
    empty = F.array().cast(f"array<{PAGE}>")
    earlier = F.coalesce(old["pages"], empty)

    def page(p: Column, i: Column) -> Column:
        was = F.get(earlier, i)
        steps = F.when(F.coalesce(p["diverted"], F.lit("")) == "", union_sorted(was["applied"], p["applied"])).otherwise(p["applied"])
        seen = i < F.size(earlier)
        return F.struct(
            F.when(seen, steps).otherwise(p["applied"]).alias("applied"),
            p["diverted"].alias("diverted"),
            p["placement"].alias("placement"),
            p["dropped_annots"].alias("dropped_annots"),
            p["geometry"].alias("geometry"),
            F.when(seen, was["straightened"]).otherwise(p["straightened"]).alias("straightened"),
        )

    merged = F.struct(
        new["version"].alias("version"),
        union_sorted(old["capabilities"], new["capabilities"]).alias("capabilities"),
        new["processed_at"].alias("processed_at"),
        F.transform(new["pages"], page).alias("pages"),
        F.coalesce(old["optimized"], new["optimized"]).alias("optimized"),
    )
    return F.when(old.isNull(), new).otherwise(merged)


def optimized_state(rewritten: Column, linearized: Column, was_linearized: Column) -> Column:
    """How the last write left a file; '' if nothing was rewritten, or it is unknown.  A rewrite that isn't linearized loses the input's linearization."""
    lost = F.when(F.coalesce(was_linearized, F.lit(False)), "rewritten-delinearized").otherwise("rewritten")
    return F.when(F.coalesce(~rewritten, F.lit(True)), "").when(linearized, REWRITTEN).otherwise(lost)


def common_capabilities(sources: DataFrame, by: str) -> DataFrame:
    """(by, capabilities): what the records of all of a document's sources have in common, sorted.

    ``sources`` has one row per source with its ``capabilities``, null for a
    source without a record, which leaves nothing in common.
    """
    per = sources.groupBy(by).agg(F.count("*").alias("n"), F.count("capabilities").alias("known"), F.collect_list("capabilities").alias("all"))
    first = F.coalesce(F.get("all", F.lit(0)), F.array().cast(_STRINGS))
    shared = F.aggregate(F.col("all"), first, lambda acc, x: F.array_intersect(acc, x))
    return per.select(by, F.when(F.col("n") == F.col("known"), F.array_sort(F.array_distinct(shared))).otherwise(F.array().cast(_STRINGS)).alias("capabilities"))


def build_records(plan: DataFrame, records: DataFrame) -> DataFrame:
    """One row per page of an edited document: (out, position, page, turn).

    ``plan`` (out, position, source, source_page, straighten) names the source
    of each page; ``records`` (source, record) holds what is known of sources.
    A page without a record gets the class source-unrecorded; straightening is
    absolute, so ``turn`` is what has to be added.
    """
    known = records.select("source", F.posexplode(F.col("record.pages")).alias("i", "page")).select("source", (F.col("i") + 1).alias("source_page"), "page")
    joined = plan.join(known, ["source", "source_page"], "left")
    none = F.array().cast(_STRINGS)
    p = F.col("page")
    was = F.coalesce(p["straightened"]["deg"], F.lit(0.0))
    set_ = F.col("straighten").isNotNull()
    steps = F.when(set_, union_sorted(p["applied"], F.array(F.lit("straighten")))).otherwise(F.coalesce(p["applied"], none))
    page = F.struct(
        steps.alias("applied"),
        F.when(p.isNull(), SOURCE_UNRECORDED).otherwise(F.coalesce(p["diverted"], F.lit(""))).alias("diverted"),
        F.when(set_, F.col("straighten")).otherwise(p["straightened"]["deg"]).alias("deg"),
    )
    return joined.select("out", "position", page.alias("page"), F.when(set_, F.col("straighten") - was).otherwise(0.0).alias("turn"))
