"""Operator 7: quality rules, a threshold table compiled into one projection.

``RULES`` is the table; each rule bounds one ratio.  ``compile_rules`` turns it
into built-in column expressions (no user functions), and ``rules_sql`` writes
the same table as SQL.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in a is that for it was on with as be by at from this are or an which not you have had "
            "der die das und in zu den von mit ist im für auf ein eine nicht als auch es dem des sich "
            "le la les de des et un une en que qui dans pour est sur avec par au du pas ne "
            "el los las y una se no por con para su del lo al como más".split()
        )
    )
)


class Rule(NamedTuple):
    """A document passes if low <= metric <= high, if it has under ``min_words`` words, or if the count that ``least`` names is below its number."""

    name: str
    metric: str
    low: float | None
    high: float | None
    min_words: int = 0
    least: tuple[str, int] | None = None


RULES = (
    Rule("words", "n_words", 1, None),
    Rule("word_length", "mean_word_chars", 1.0, 25.0, 20),
    Rule("symbols", "symbol_ratio", None, 0.10, least=("n_symbols", 3)),
    Rule("bars", "bar_ratio", None, 0.20, least=("n_bars", 2)),
    Rule("capitals", "upper_ratio", None, 0.40, least=("n_upper", 10)),
    Rule("stop_words", "stop_ratio", 0.01, None, 50),
    Rule("repeated_words", "repeat_ratio", None, 0.20, least=("n_repeats", 3)),
    Rule("repeated_lines", "same_line_ratio", None, 0.70, 50),
    Rule("bullets", "bullet_line_ratio", None, 0.90, 50),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.30, 50),
)

COUNTS = ("n_words", "n_lines", "n_solid", "n_symbols", "n_bars", "n_upper", "n_repeats")
METRICS = COUNTS + ("mean_word_chars", "symbol_ratio", "bar_ratio", "upper_ratio", "stop_ratio", "repeat_ratio", "same_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio")

_STOP = ", ".join("'" + w + "'" for w in STOP_WORDS)

#: How the two dialects write what the metrics are made of.
_SPARK = {
    "words": "filter(split(text, '[ \\\\t\\\\n\\\\r\\\\f]+'), w -> w != '')",
    "lines": "filter(split(text, '\\\\n'), l -> trim(l) != '')",
    "solid": "length(replace(replace(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), ''), chr(13), ''), chr(12), ''))",
    "symbols": "length(text) - length(regexp_replace(text, '[#$%&*@~^=+<>]+', ''))",
    "upper": "length(text) - length(regexp_replace(text, '[A-Z]+', ''))",
    "stops": f"size(filter(words, w -> lower(w) in ({_STOP})))",
    "repeats": "size(filter(words, (w, i) -> w = get(words, i + 1)))",
    "size": "size({})",
    "distinct": "size(array_distinct(lines))",
    "bullets": "size(filter(lines, l -> substr(trim(l), 1, 2) in ('- ', '* ', '• ')))",
    "ellipses": "size(filter(lines, l -> substr(trim(l), -3) = '...' or substr(trim(l), -1) = '…'))",
}
_DUCK = {
    "words": "list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w != '')",
    "lines": "list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') != '')",
    "solid": "length(translate(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12), ''))",
    "symbols": "length(text) - length(regexp_replace(text, '[#$%&*@~^=+<>]+', '', 'g'))",
    "upper": "length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g'))",
    "stops": f"len(list_filter(words, lambda w: lower(w) in ({_STOP})))",
    "repeats": "len(list_filter(words, lambda w, i: coalesce(w = words[i + 1], false)))",
    "size": "len({})",
    "distinct": "len(list_distinct(lines))",
    "bullets": "len(list_filter(lines, lambda l: substr(trim(l, ' '), 1, 2) in ('- ', '* ', '• ')))",
    "ellipses": "len(list_filter(lines, lambda l: right(trim(l, ' '), 3) = '...' or right(trim(l, ' '), 1) = '…'))",
}


def _counts(d: dict[str, str]) -> dict[str, str]:
    def number(e: str) -> str:
        return f"coalesce(cast({e} as bigint), 0)"

    size = d["size"]
    parts = (size.format("words"), size.format("lines"), d["solid"], d["symbols"], "length(text) - length(replace(text, '|', ''))", d["upper"], d["repeats"])
    return dict(zip(COUNTS, map(number, parts)))


def _ratios(d: dict[str, str]) -> dict[str, str]:
    def ratio(top: str, bottom: str) -> str:
        return f"case when {bottom} > 0 then round(cast({top} as double) / {bottom}, 6) else 0.0e0 end"

    return {
        "mean_word_chars": ratio("n_solid", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_solid"),
        "bar_ratio": ratio("n_bars", "n_words"),
        "upper_ratio": ratio("n_upper", "n_solid"),
        "stop_ratio": ratio(d["stops"], "n_words"),
        "repeat_ratio": ratio("n_repeats", "n_words"),
        "same_line_ratio": ratio(f"n_lines - {d['distinct']}", "n_lines"),
        "bullet_line_ratio": ratio(d["bullets"], "n_lines"),
        "ellipsis_line_ratio": ratio(d["ellipses"], "n_lines"),
    }


def _failed(rule: Rule) -> str:
    out = [f"{rule.metric} < {rule.low}"] * (rule.low is not None) + [f"{rule.metric} > {rule.high}"] * (rule.high is not None)
    counted = f" and {rule.least[0]} >= {rule.least[1]}" if rule.least else ""
    return f"(n_words >= {rule.min_words}{counted} and ({' or '.join(out)}))"


def _codes(rules: tuple[Rule, ...], null: str) -> str:
    return ", ".join(f"case when {_failed(r)} then '{r.name} ' else '{null}' end" for r in rules)


def compile_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` as column r (struct) with every metric, ``failed`` (rule names) and ``keep``."""
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")).selectExpr("r", "cast(r.text as string) as text")
    parts = base.selectExpr("r", "text", f"{_SPARK['words']} as words", f"{_SPARK['lines']} as lines")
    counts = parts.selectExpr("r", "words", "lines", *[f"{e} as {k}" for k, e in _counts(_SPARK).items()])
    metrics = counts.selectExpr("r", *COUNTS, *[f"{e} as {k}" for k, e in _ratios(_SPARK).items()])
    named = metrics.selectExpr("*", f"trim(concat({_codes(rules, '')})) as failed")
    return named.selectExpr("*", "failed = '' as keep")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, metrics, failed, keep) of every row of ``docs``.

    Words are parts between white space; lines are parts between line feeds
    that aren't blank.  Symbols and capitals are counted by characters, against
    those that aren't white space.  The ratios of symbols, bars, capitals and
    repeated words hold from the first word on, given a few of them; rules on
    stop words, lines and word length need longer texts to mean anything.  A
    null, empty or blank text has no words: its ratios are 0 and it fails rule
    ``words``.  Rows are judged one by one, so repeated
    rows and ties get equal results; no text is too long.
    """
    out = compile_rules(docs, rules)
    return out.select(F.col("r.doc_id").alias("doc_id"), *METRICS, "failed", "keep")


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` that pass all rules, all columns as they were.

    The number of the partition keeps the filter above the projection: pushed
    below, it would compute every metric anew in each rule that uses it.
    """
    return compile_rules(docs, rules).withColumn("part", F.spark_partition_id()).filter("keep and part >= 0").select("r.*")


def rules_sql(table: str = "documents", columns: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> str:
    """The same as DuckDB SQL: ``columns``, the metrics, failed, keep."""
    counts, ratios = (", ".join(f"{e} as {k}" for k, e in x.items()) for x in (_counts(_DUCK), _ratios(_DUCK)))
    return (
        f"with parts as (select *, {_DUCK['words']} as words, {_DUCK['lines']} as lines from {table}), "
        f"counts as (select *, {counts} from parts), "
        f"metrics as (select {columns}, {', '.join(COUNTS)}, {ratios} from counts), "
        f"named as (select *, trim(concat({_codes(rules, '')})) as failed from metrics) select *, failed = '' as keep from named"
    )
