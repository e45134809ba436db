"""Operator 4: mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelume.llm.storage import whole_row, written

#: Target weight of a source is its tokens to this power, made to sum to 1.
ALPHA = 0.5
SEED = 17

_TOKENS = "coalesce(regexp_count({}, '[^ \\\\t\\\\n\\\\r\\\\f]+'), 0)"


def source_rates(docs: DataFrame, alpha: float = ALPHA, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, n_docs, tokens, rate): how often each document of a source is to appear, counted over all documents.

    The targets are ``weights`` (a source that isn't named gets 0), or follow
    ``alpha``.  The sum of tokens stays as it is.  Sources of no tokens have rate 1.
    """
    spark = docs.sparkSession
    per = docs.select(F.col("source").cast("string"), F.expr(f"cast({_TOKENS.format('text')} as bigint)").alias("tokens")).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens")
    )
    if weights is None:
        per = per.withColumn("w", F.pow(F.col("tokens").cast("double"), F.lit(alpha)))
    else:
        given = spark.createDataFrame(sorted(weights.items()) or [("", 0.0)], "source string, w double")
        per = per.join(given, "source", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = per.agg(F.sum("tokens").alias("all_tokens"), F.sum("w").alias("all_w"))
    rate = F.col("all_tokens") * F.col("w") / F.col("all_w") / F.col("tokens")
    return per.crossJoin(F.broadcast(total)).select(
        "source", "n_docs", "tokens", F.round(F.when((F.col("tokens") > 0) & (F.col("all_w") > 0), rate).otherwise(F.lit(1.0)), 6).alias("rate")
    )


def draw(doc_id: str, seed: int = SEED) -> str:
    """Uniform number in [0, 1) from seed and doc_id, as Spark SQL."""
    return f"cast(conv(substr(md5(concat('{seed}:', coalesce(cast({doc_id} as string), ''))), 1, 12), 16, 10) as bigint) / 281474976710656D"


def mix(docs: DataFrame, alpha: float = ALPHA, weights: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with each row floor(rate) times, and once more with the probability of the fraction.

    The draw hashes seed and doc_id, so it is the same in every run and for
    every copy of a row; a null doc_id counts as ''.  A null source is a source
    of its own.  Null and empty texts have no tokens; a row of a source without
    any tokens appears once.  An empty table stays empty.
    """
    rates = written(source_rates(docs, alpha, weights).select(F.col("source").alias("s"), "rate"), "rates")
    rows = docs.select(whole_row(docs).alias("r"), F.col("source").cast("string").alias("source"), F.expr(draw("doc_id", seed)).alias("u"))
    joined = rows.join(rates, F.col("source").eqNullSafe(F.col("s")))
    n = F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("bigint")
    return joined.withColumn("n", n).filter("n > 0").select("r", F.explode(F.expr("sequence(1, n)"))).select("r.*")


def mix_sql(table: str = "documents", columns: str = "*", alpha: float = ALPHA, seed: int = SEED) -> str:
    """The same as DuckDB SQL."""
    return (
        f"with counted as (select source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) as t from {table}), "
        f"per as (select source, cast(sum(t) as bigint) as tokens, pow(cast(sum(t) as double), {alpha}) as w from counted group by source), "
        "rates as (select source, case when tokens > 0 then round(sum(tokens) over () * w / sum(w) over () / tokens, 6) else 1.0e0 end as rate from per), "
        f"drawn as (select d.*, r.rate, cast(('0x' || substr(md5('{seed}:' || coalesce(cast(d.doc_id as varchar), '')), 1, 12)) as bigint) / 281474976710656.0e0 as u "
        f"from {table} d join rates r on d.source is not distinct from r.source), "
        "copies as (select *, cast(floor(rate) as bigint) + case when u < rate - floor(rate) then 1 else 0 end as n from drawn) "
        f"select {columns} from (select *, unnest(range(n)) as copy from copies)"
    )
