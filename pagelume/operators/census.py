"""Corpus counts: populations, outcomes, placements, annotations, fonts, encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelume.functions import classify as C
from pagelume.functions import geometry as G
from pagelume.functions.text import bucket_labels, refusal_class
from pagelume.operators.ranks import floor_percentiles
from pagelume.plans.shared import written

EDGES = (0.0, 0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0, 15.0, float("inf"))
LABELS = bucket_labels(EDGES)
THRESHOLDS = (0.01, 0.05, 0.1, 0.5, 1.0)
SHARES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99, "p99.9": 0.999, "max": 1.0}


def ratio(top: Column, bottom: Column) -> Column:
    """A rate, 0 if nothing was counted."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def population(documents: DataFrame) -> DataFrame:
    """Files, readable documents, unopenable files and pages; the middle two add up to the first."""
    return documents.agg(
        F.count("*").alias("files"),
        F.count_if(~F.col("unopenable")).alias("documents"),
        F.count_if(F.col("unopenable")).alias("unopenable"),
        F.coalesce(F.sum(F.when(~F.col("unopenable"), F.col("pages"))), F.lit(0)).alias("pages"),
    )


def outcome_counters(outcomes: DataFrame) -> DataFrame:
    """Attempts by outcome with their rates, as one row."""
    n = {x: F.count_if(F.col("outcome") == x) for x in ("extracted", "diverted", "failed")}
    all_ = F.count("*")
    return outcomes.agg(
        all_.alias("attempted"),
        *[c.alias(k) for k, c in n.items()],
        F.count_if((F.col("outcome") == "extracted") & F.col("partial")).alias("partial"),
        F.round(ratio(n["diverted"], all_), 6).alias("divert_rate"),
        F.round(ratio(n["diverted"] + n["failed"], all_), 6).alias("unhandled_rate"),
    )


def reason_histogram(outcomes: DataFrame) -> DataFrame:
    """(reason, class, pages) of diverted pages, most frequent first."""
    seen = outcomes.filter(F.col("outcome") == "diverted").groupBy("reason").agg(F.count("*").alias("pages"))
    return seen.select("reason", refusal_class(F.col("reason")).alias("class"), "pages").orderBy(F.desc("pages"), "reason")


def placement_facts(placements: DataFrame) -> DataFrame:
    """Placements with skew, shear, turn and degeneracy of their matrix m0..m5.

    Angles are kept to 1e-9 degrees, so that the last bit of an arctangent
    doesn't move a square placement out of the bin of zero.
    """
    m = F.array(*[F.col(f"m{i}") for i in range(6)])
    angles = {"skew_deg": G.skew_degrees(m), "shear_deg": G.shear_degrees(m), "placement_deg": G.placement_degrees(m)}
    return placements.withColumns({k: F.round(v, 9) for k, v in angles.items()} | {"degenerate": F.coalesce(G.degenerate(m), F.lit(False))})


def bucket(value: Column) -> Column:
    """Number of the first edge that the value doesn't exceed."""
    out = None
    for i, edge in enumerate(EDGES[:-1]):
        out = F.when(value <= edge, i) if out is None else out.when(value <= edge, i)
    return F.when(value.isNotNull(), out.otherwise(len(EDGES) - 1))


def unrolled(df: DataFrame, totals: dict[tuple[str, str], Column]) -> DataFrame:
    """(section, name, value): each total over all rows, 0 if there are none."""
    wide = df.agg(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(totals.values())])
    rows = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.coalesce(F.col(f"x{i}"), F.lit(0.0)).alias("value")) for i, (s, n) in enumerate(totals)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def placement_census(facts: DataFrame) -> DataFrame:
    """(section, name, value) over placements with their facts.

    The facts are worked out once, into a table of what is counted.  Placements
    are counted by shear, for their bins and exact percentiles; pages are
    closed per (doc, page_index) with a few numbers each, then counted;
    documents are counted by themselves, as pages grouped by document would
    move all of their numbers.
    """
    shear, skew = F.col("shear_deg"), F.col("skew_deg")
    real = F.col("placement_index") >= 0
    sound, top = real & ~F.col("degenerate"), F.col("is_top")
    gated = sound & (shear <= G.MAX_SKEW) & (skew <= G.MAX_SKEW)
    slim = written(
        facts.select(
            "doc",
            "page_index",
            F.col("n_placements").alias("n"),
            (F.col("page_reason") != "").alias("refused"),
            real.alias("real"),
            (real & F.col("degenerate")).alias("degenerate"),
            (top & real).alias("top"),
            F.when(sound, shear).alias("shear"),
            gated.alias("gated"),
        ),
        "placements",
    )
    shear, top, gated = F.col("shear"), F.col("top"), F.col("gated")
    counts = written(slim.groupBy("shear", "real", "degenerate").agg(F.count("*").alias("n"), F.count_if(top).alias("tops")), "shears")
    pages = slim.groupBy("doc", "page_index").agg(
        F.max("n").alias("n"),
        F.max("refused").alias("refused"),
        F.max(F.when(top, F.col("degenerate"))).alias("top_degenerate"),
        F.max(F.when(top, shear)).alias("top_shear"),
        F.max(F.when(gated & top, shear)).alias("gated_top"),
        F.max(F.when(gated, shear)).alias("gated_any"),
    )
    by_page = {
        ("total", "pages"): F.count("*"),
        ("total", "image_bearing_pages"): F.count_if(F.col("n") > 0),
        ("total", "degenerate_top_pages"): F.count_if("top_degenerate"),
    }
    by_shear = {
        ("total", "placements"): F.sum(F.when(F.col("real"), F.col("n"))),
        ("total", "degenerate_placements"): F.sum(F.when(F.col("degenerate"), F.col("n"))),
    }
    for i, label in enumerate(LABELS):
        by_shear["placement", label] = F.sum(F.when(bucket(shear) == i, F.col("n")))
        by_page["page_top", label] = F.count_if(bucket(F.col("top_shear")) == i)
    for t in THRESHOLDS:
        for section in ("gated_top", "gated_any"):
            by_page[section, f"{t:g}"] = F.count_if(~F.col("refused") & (F.col(section) > t))
    totals = unrolled(pages, by_page).unionByName(unrolled(counts, by_shear)).unionByName(unrolled(slim, {("total", "documents"): F.countDistinct("doc")}))
    ranks = floor_percentiles(counts, "shear", {"placement_percentile": "n", "page_top_percentile": "tops"}, SHARES)
    return totals.unionByName(ranks).withColumn("value", F.round("value", 6))


def annotation_facts(annots: DataFrame) -> DataFrame:
    """Annotations with their bucket; the rectangle is null if any of its numbers is."""
    rect = F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1"))
    with_rect = annots.withColumn("rect", rect)
    return with_rect.withColumn("bucket", C.annotation_bucket(F.col("subtype"), F.col("flags"), F.col("rect"), F.col("has_ap"), F.col("has_apn")))


def annotation_tally(outcomes: DataFrame, annots: DataFrame, raster: tuple[float, float, float, float], page: tuple[float, float, float, float]) -> DataFrame:
    """(name, value): what extraction loses in annotations, by page outcome, and the histograms of buckets and painted kinds.

    A page without annotations is kept, as one that has none.
    """
    facts = annotation_facts(annots)
    raster_box, page_box = (F.array(*[F.lit(float(x)) for x in b]) for b in (raster, page))
    paints = F.col("bucket") == "PAINTS"
    off = F.coalesce(paints & G.escapes(F.col("rect"), page_box), F.lit(False))
    outside = F.coalesce(paints & ~off & G.escapes(F.col("rect"), raster_box), F.lit(False))
    per_page = facts.groupBy("page").agg(
        F.count_if(paints).alias("painting"),
        F.count_if(outside).alias("outside"),
        F.count_if(off).alias("off_page"),
        F.count_if(F.col("bucket") == "no-ap-viewer-synthesised").alias("maybe"),
    )
    joined = outcomes.join(per_page, "page", "left").na.fill(0, ["painting", "outside", "off_page", "maybe"])
    done, gone = F.col("outcome") == "extracted", F.col("outcome") == "diverted"
    totals = {
        "extracted_with_annot": F.count_if(done & (F.col("painting") > 0)),
        "extracted_not_covering": F.count_if(done & (F.col("painting") > 0) & ~F.col("covers_page")),
        "extracted_outside": F.count_if(done & (F.col("outside") > 0)),
        "extracted_maybe": F.count_if(done & (F.col("painting") == 0) & (F.col("maybe") > 0)),
        "diverted_with_annot": F.count_if(gone & (F.col("painting") > 0)),
        "off_page": F.sum("off_page"),
    }
    wide = joined.agg(*[c.alias(k) for k, c in totals.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(F.col(k), F.lit(0)).cast("bigint").alias("value")) for k in totals])
    counts = wide.select(F.explode(rows).alias("r")).select("r.*")
    kinds = facts.groupBy(F.concat(F.lit("bucket:"), "bucket").alias("name")).agg(F.count("*").alias("value"))
    painted = facts.filter(paints).groupBy(F.concat(F.lit("subtype:"), "subtype").alias("name")).agg(F.count("*").alias("value"))
    return counts.unionByName(kinds).unionByName(painted)


def dropped_annotations(pages: DataFrame, annots: DataFrame) -> DataFrame:
    """(page, dropped): annotations that extraction would lose on each page, 0 if none."""
    painting = annotation_facts(annots).filter(F.col("bucket") == "PAINTS").groupBy("page").agg(F.count("*").alias("dropped"))
    return pages.select("page").join(painting, "page", "left").select("page", F.coalesce("dropped", F.lit(0)).alias("dropped"))


def font_facts(fonts: DataFrame) -> DataFrame:
    """Shown fonts with their class."""
    shown = fonts.filter(C.shown_font(F.col("subtype")))
    return shown.withColumn("class", C.font_class(F.col("subtype"), F.col("to_unicode"), F.col("encoding"), F.col("symbolic")))


def font_totals(fonts: DataFrame) -> DataFrame:
    """(class, fonts, files, named, absent, share) over shown fonts; share is the part of all of them."""
    per = font_facts(fonts).groupBy("class").agg(
        F.count("*").alias("fonts"),
        F.countDistinct("file").alias("files"),
        F.count_if((F.col("class") == "D") & (F.col("encoding") == "named")).alias("named"),
        F.count_if((F.col("class") == "D") & (F.col("encoding") == "absent")).alias("absent"),
    )
    return per.withColumn("share", F.round(F.col("fonts") / F.sum("fonts").over(Window.partitionBy()), 6))


def font_gap(fonts: DataFrame, counted: DataFrame) -> DataFrame:
    """(file, fonts, other, gap_percent): shown fonts per file against another count of them."""
    mine = font_facts(fonts).groupBy("file").agg(F.count("*").alias("fonts"))
    both = mine.join(counted, "file")
    return both.select("file", "fonts", "other", F.round(100 * ratio(F.abs(F.col("fonts") - F.col("other")), F.col("other")), 6).alias("gap_percent"))


def encryption_facts(documents: DataFrame) -> DataFrame:
    return documents.withColumn("bucket", C.encryption_bucket(F.col("encrypted"), F.col("wrong_password"), ~F.col("unopenable") & ~F.col("wrong_password")))


def encryption_tally(facts: DataFrame) -> DataFrame:
    """(bucket, files, pages, inspected, not_inspected, rasters) per bucket; inspection is measured in bucket 2 only."""
    second = F.col("bucket") == 2
    return facts.groupBy("bucket").agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(F.when(F.col("bucket") <= 2, F.col("pages"))), F.lit(0)).alias("pages"),
        F.count_if(second & F.col("inspect_ok")).alias("inspected"),
        F.count_if(second & ~F.col("inspect_ok")).alias("not_inspected"),
        F.coalesce(F.sum(F.when(second & F.col("inspect_ok"), F.col("rasters"))), F.lit(0)).alias("rasters"),
    )


def unopenable_of(tally: DataFrame) -> DataFrame:
    """Totals from a stored tally: buckets 3 and 4 are the files that didn't open."""
    return tally.agg(
        F.sum("files").alias("files"), F.sum(F.when(F.col("bucket") >= 3, F.col("files")).otherwise(0)).alias("unopenable"), F.sum("pages").alias("pages")
    )
