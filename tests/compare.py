"""Rows of a query held against the same SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pyarrow as pa

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows_of(table: pa.Table) -> list:
    names = sorted(table.column_names)
    return sorted((tuple(_plain(r[n]) for n in names) for r in table.to_pylist()), key=repr), names


def oracle(sql: str, sf_dir: str = DATA) -> pa.Table:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con.sql(sql).to_arrow_table()


def same(df, sql: str, sf_dir: str = DATA) -> None:
    got, names = rows_of(df.toArrow())
    expected, other = rows_of(oracle(sql, sf_dir))
    assert names == other
    assert len(got) == len(expected)
    wrong = [(g, e) for g, e in zip(got, expected) if g != e]
    assert not wrong, f"{len(wrong)} of {len(got)} rows, first {wrong[:2]}"
