"""Operator 8: removal of lines that many sites share.

Every line's sites go into a HyperLogLog sketch, merged by aggregation.  Lines
whose estimate is near the threshold get an exact distinct count; those clear
of it are decided by the sketch.  Lines over it are boilerplate and leave every
document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelume.llm.storage import row_id, written

#: Sites that make a line boilerplate.
MIN_SITES = 5
#: Shorter lines (in characters, trimmed) aren't judged; 1 judges every line that isn't blank.
MIN_CHARS = 1
#: Sketch size as a power of 2; about 3 % standard error.
LG_K = 10
#: Estimates within this share of MIN_SITES are counted exactly; over four standard errors.
BAND = 0.15


def _rows(docs: DataFrame, site: str) -> DataFrame:
    return written(docs.select(row_id().alias("uid"), "doc_id", F.col(f"`{site}`").cast("string").alias("site"), F.col("text").cast("string").alias("text")), "rows")


def _lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(uid, site, pos, h, g) of each line that is judged; h and g hash the trimmed line."""
    lines = rows.select("uid", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.trim("line")
    return lines.filter(F.length(line) >= max(1, min_chars)).select("uid", "site", "pos", F.xxhash64(line).alias("h"), F.hash(line, F.lit(1)).alias("g"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, g, n_sites) of lines on at least ``min_sites`` distinct sites; n_sites is null where the sketch decided.

    Lines of one site, nearly all there are, leave before any sketch is made.
    """
    least, most = F.min("site"), F.max("site")
    spread = lines.groupBy("h", "g").agg(least.alias("least"), most.alias("most"))
    if min_sites > 1:
        several = written(spread.filter("least < most").select("h", "g"), "lines-of-several")
        lines = lines.join(several, ["h", "g"], "left_semi")
    sketched = lines.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    sketched = written(sketched, "line-sites")
    over = sketched.filter(F.col("sites") > min_sites * (1 + BAND)).select("h", "g", F.lit(None).cast("bigint").alias("n_sites"))
    near = sketched.filter(F.col("sites").between(min_sites * (1 - BAND), min_sites * (1 + BAND))).select("h", "g")
    exact = lines.join(near, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.countDistinct("site").alias("n_sites"))
    return over.union(exact.filter(F.col("n_sites") >= min_sites))


def remove_shared_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every row of ``docs``, its text without boilerplate lines.

    Lines are parts between line feeds, compared without the spaces around
    them; all copies of a line count and go, within a document too.  Lines of
    under ``min_chars`` characters, and blank ones always, stay and aren't
    counted.  A line on just ``min_sites`` sites goes (no tie is left open).  A
    null site counts for no site.  A null text stays null with 0 lines, an
    empty one stays empty with one; repeated rows are treated alike, and no
    text is too long.  The rows are written once with their numbers, which every
    later step reads from there.
    """
    rows = _rows(docs, site)
    lines = _lines(rows, min_chars)
    gone = written(boilerplate(lines, min_sites).select("h", "g"), "boilerplate")
    hits = lines.join(gone, ["h", "g"]).groupBy("uid").agg(F.array_sort(F.collect_list("pos")).alias("gone"))
    both = rows.select("uid", "doc_id", "text").join(hits, "uid", "left")
    parts = F.split("text", "\n")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("gone", i)), "\n")
    return both.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def shared_lines_sql(min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> str:
    """The same as DuckDB SQL, with exact counts throughout."""
    return (
        "with l as (select doc_id, source, line, pos from (select doc_id, source, string_split(text, chr(10)) as ls from documents where text is not null), "
        "lateral (select unnest(ls) as line, generate_subscripts(ls, 1) as pos)), "
        f"b as (select trim(line, ' ') as k from l where length(trim(line, ' ')) >= {max(1, min_chars)} group by 1 having count(distinct source) >= {min_sites}), "
        "m as (select l.*, b.k is not null as gone from l left join b on trim(l.line, ' ') = b.k) "
        "select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text, "
        "count(*) as n_lines, count(*) filter (where gone) as n_removed from m group by doc_id "
        "union all select doc_id, null, 0, 0 from documents where text is null"
    )
