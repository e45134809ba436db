"""Derived stand-in tables for page analytics.

The supplied tables hold no documents to scan, so each input of the operators
is derived from them by a fixed rule, written once in SQL that Spark and other
engines read alike.  None of it describes real documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLACEMENTS = """
select o.o_custkey as doc, o.o_orderkey as page_index,
  cast(case when l.l_orderkey is null then -1 else row_number() over (partition by o.o_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) - 1 end as bigint) as placement_index,
  l.l_orderkey is not null and row_number() over (partition by o.o_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) = count(*) over (partition by o.o_orderkey) as is_top,
  count(l.l_orderkey) over (partition by o.o_orderkey) as n_placements,
  case when l.l_partkey % 97 = 0 then 0e0 else 400e0 + l.l_quantity * 4 end as m0,
  case when l.l_partkey % 97 = 0 then 0e0 when l.l_partkey % 5 < 3 then 0e0 when l.l_suppkey % 11 = 0 then l.l_quantity * 3 else (l.l_tax - 4e-2) * l.l_quantity * 4 end as m1,
  case when l.l_partkey % 5 < 3 then 0e0 else (5e-2 - l.l_discount) * l.l_quantity * 3 end as m2,
  case when l.l_partkey % 41 = 0 then -500e0 else 500e0 + l.l_quantity * 5 end as m3,
  cast(l.l_partkey % 7 as double) as m4, cast(l.l_suppkey % 5 as double) as m5,
  cast(l.l_partkey % 2500 + 100 as int) as width, cast(l.l_suppkey % 3300 + 100 as int) as height,
  l.l_partkey % 4 = 0 as bitonal,
  case l.l_partkey % 6 when 0 then 'DCTDecode' when 1 then 'FlateDecode' when 2 then 'JBIG2Decode' when 3 then 'JPXDecode' when 4 then 'CCITTFaxDecode' else 'unknown' end as filter,
  case when l.l_orderkey is null then 'no-image' when o.o_orderkey % 3 = 0 then 'has-text' else '' end as page_reason
from {orders} o left join {lineitem} l on o.o_orderkey = l.l_orderkey
"""

DOCUMENTS = """
select c_custkey as doc, c_name as path, c_custkey % 19 = 0 as unopenable,
  case when c_custkey % 19 = 0 then 0 else c_custkey % 40 + 1 end as pages,
  c_custkey % 7 = 0 or c_custkey % 38 = 0 as encrypted, c_custkey % 38 = 0 as wrong_password, c_custkey % 5 = 0 as inspect_ok, c_custkey % 9 as rasters
from {customer}
"""

OUTCOMES = """
select o_custkey as doc, o_orderkey as page,
  case when o_orderkey % 29 = 0 then 'failed' when o_orderkey % 3 = 0 then 'extracted' else 'diverted' end as outcome,
  o_orderkey % 3 = 0 and o_orderkey % 21 = 0 as partial,
  case when o_orderkey % 29 = 0 or o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then case o_orderkey % 5 when 0 then 'no-image' when 1 then 'has-text' when 2 then 'vector-paint' when 3 then 'multiple-images' else 'shading' end
    else case o_orderkey % 4 when 0 then 'unsupported-codec-jbig2' when 1 then 'unsupported-codec-jpx' when 2 then 'unsupported-codec-tif' else 'unsupported-codec-wdp' end end as reason,
  o_orderkey % 2 = 0 as covers_page
from {orders}
"""

ANNOTATIONS = """
select l_orderkey as page, l_linenumber as n,
  case l_partkey % 9 when 0 then '' when 1 then 'Popup' when 2 then 'Link' when 3 then 'Text' when 4 then 'Highlight' when 5 then 'Widget' when 6 then 'Stamp' when 7 then 'Ink' else 'Square' end as subtype,
  cast(l_suppkey % 64 as int) as flags,
  case when l_partkey % 10 = 0 then null else 10e0 + l_quantity end as x0, case when l_partkey % 10 = 0 then null else 20e0 + l_quantity end as y0,
  case when l_partkey % 10 = 0 then null when l_partkey % 23 = 0 then 10e0 + l_quantity else 10e0 + l_quantity * (1 + l_partkey % 17) end as x1,
  case when l_partkey % 10 = 0 then null else 20e0 + l_quantity * (1 + l_suppkey % 19) end as y1,
  l_partkey % 3 <> 0 as has_ap, l_partkey % 3 = 1 as has_apn, l_suppkey % 13 = 0 as has_oc
from {lineitem}
"""

FONTS = """
select p_partkey % 500 as file, p_partkey as font,
  case p_partkey % 7 when 0 then 'Type1' when 1 then 'TrueType' when 2 then 'Type0' when 3 then 'Type3' when 4 then 'MMType1' when 5 then 'CIDFontType2' else 'Type1' end as subtype,
  p_size % 3 = 0 as to_unicode, case p_size % 4 when 0 then 'absent' when 1 then 'named' when 2 then 'differences' else 'named' end as encoding, p_size % 5 = 0 as symbolic
from {part}
"""

PROVENANCE = """
select o_custkey as doc, o_orderkey as page, cast(o_orderkey % 3 as int) as dropped_annots,
  case o_orderkey % 8 when 0 then 'ccitt-g4' when 1 then 'jbig2-generic' when 2 then 'downsample-150' when 3 then 'jpeg-recompress-85' when 4 then 'text-layer' when 5 then 'quantize-png-16' else 'straighten' end as step,
  case when o_orderkey % 6 = 0 then case o_orderkey % 4 when 0 then 'unsupported-codec' when 2 then 'not-single-raster' else 'unsupported-codec-jpx' end else '' end as diverted,
  o_custkey % 4 as kind
from {orders}
"""

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A stand-in from the tables that its SQL names in braces."""
    names = [n for n in ("orders", "lineitem", "customer", "part", "supplier", "nation", "region", "embeddings") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def plain(sql: str) -> str:
    """The SQL over tables that go by their own names."""
    for n in ("orders", "lineitem", "customer", "part", "supplier", "nation", "region", "embeddings"):
        sql = sql.replace("{" + n + "}", n)
    return sql.strip()
