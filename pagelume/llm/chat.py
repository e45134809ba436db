"""Operator 2: canonical chat turns from heterogeneous records by schema fingerprint.

A record's fingerprint is the hash of its nested field paths: values and their
types don't matter, names, nesting and lists do (an empty list counts as one
of plain values, a place that holds both objects and plain values as a value).  ``MAPPINGS`` declares, for
each known layout, where the turns are; the mappings are compiled into one
expression that the fingerprint selects from.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALAR = r"\b(STRING|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|BOOLEAN|VOID|VARIANT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\(\d+,\s*\d+\))(?=[,>]|$)"

TURNS = "array<struct<role string, content string>>"


class Mapping(NamedTuple):
    """``layout``: an example of the record.  Turns come from ``items`` (list, role field, content field) or from ``fields`` in order (role, paths joined by a line feed)."""

    name: str
    layout: object
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


MAPPINGS = (
    Mapping("messages", {"messages": [{"role": "", "content": ""}]}, items=("$.messages", "role", "content")),
    Mapping("conversations", {"conversations": [{"from": "", "value": ""}]}, items=("$.conversations", "from", "value")),
    Mapping("nested_messages", {"data": {"turns": [{"speaker": "", "text": ""}]}}, items=("$.data.turns", "speaker", "text")),
    Mapping("prompt_completion", {"prompt": "", "completion": ""}, fields=(("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Mapping("prompt_response", {"prompt": "", "response": ""}, fields=(("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Mapping("instruction", {"instruction": "", "output": ""}, fields=(("user", ("$.instruction",)), ("assistant", ("$.output",)))),
    Mapping("instruction_input", {"instruction": "", "input": "", "output": ""}, fields=(("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Mapping(
        "system_prompt_response",
        {"system": "", "prompt": "", "response": ""},
        fields=(("system", ("$.system",)), ("user", ("$.prompt",)), ("assistant", ("$.response",))),
    ),
    Mapping("question_answer", {"qa": {"question": "", "answer": ""}}, fields=(("user", ("$.qa.question",)), ("assistant", ("$.qa.answer",)))),
)

ROLES = {
    "user": ("user", "human", "prompter", "customer"),
    "assistant": ("assistant", "gpt", "bot", "model", "ai", "agent"),
    "system": ("system", "developer"),
    "tool": ("tool", "function", "observation"),
}


def _shape(layout: object) -> str:
    if isinstance(layout, dict):
        return "OBJECT<" + ", ".join(f"{k}: {_shape(v)}" for k, v in sorted(layout.items())) + ">"
    if isinstance(layout, list):
        return f"ARRAY<{_shape(layout[0]) if layout else '_'}>"
    return "_"


def _without_turns(layout: object) -> object:
    """An example record with its list of turns empty."""
    if isinstance(layout, dict):
        return {k: _without_turns(v) for k, v in layout.items()}
    return [""] if isinstance(layout, list) else layout


def fingerprint_of(layout: object) -> str:
    """Fingerprint of an example record."""
    return hashlib.sha256(_shape(layout).encode()).hexdigest()[:16]


def fingerprint(variant: Column) -> Column:
    """Fingerprint of a variant column; null for null."""
    return F.substring(F.sha2(F.regexp_replace(F.schema_of_variant(variant), _SCALAR, "_"), 256), 1, 16)


def _role(role: str) -> str:
    arms = " ".join(f"when lower(trim({role})) in ({', '.join(repr(x) for x in names)}) then '{canonical}'" for canonical, names in ROLES.items())
    return f"case {arms} else 'unknown' end"


def _turns(m: Mapping) -> str:
    if m.items:
        path, role, content = m.items
        raw = f"try_variant_get(v, '{path}', 'array<struct<`{role}` string, `{content}` string>>')"
        return f"transform({raw}, t -> named_struct('role', {_role(f't.`{role}`')}, 'content', t.`{content}`))"
    parts = []
    for role, paths in m.fields:
        got = [f"try_variant_get(v, '{p}', 'string')" for p in paths]
        content = got[0] if len(got) == 1 else f"concat_ws('\\n', {got[0]}, {', '.join(f'nullif({g}, {chr(39) * 2})' for g in got[1:])})"
        parts.append(f"named_struct('role', '{role}', 'content', {content})")
    return f"array({', '.join(parts)})"


def canonical_turns(records: DataFrame, key: str, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(key, layout, fingerprint, turn, role, content): one row per turn of each JSON record, in order.

    A record that isn't JSON, is null, or has a layout without a mapping (any
    field more or less makes another layout, in one turn too) gives one row of
    layout 'unmapped' with null turn and role, its content the record.  A
    mapped one whose list of turns is empty gives one under its layout's name
    with null content.  Turns of equal content stay apart, in their order; no
    content is too long.  Unknown role names become 'unknown', a null content stays
    null.  Repeated records give repeated rows; an empty table gives none.
    """
    rows = records.select(F.col(f"`{key}`").alias("key"), F.col(f"`{record}`").cast("string").alias("record"))
    v = rows.withColumn("v", F.try_parse_json("record"))
    f = v.withColumn("fingerprint", fingerprint(F.col("v")))
    arms = {fingerprint_of(m.layout): m for m in mappings}
    empty = [(fingerprint_of(_without_turns(m.layout)), m) for m in mappings if m.items]
    layout = (
        "case " + " ".join(f"when fingerprint = '{k}' then '{m.name}'" for k, m in arms.items())
        + " " + " ".join(f"when fingerprint = '{k}' and size(try_variant_get(v, '{m.items[0]}', 'array<variant>')) = 0 then '{m.name}'" for k, m in empty)
        + " else 'unmapped' end"
    )
    turns = "case fingerprint " + " ".join(f"when '{k}' then {_turns(m)}" for k, m in arms.items()) + " end"
    named = f.selectExpr("key", "fingerprint", f"{layout} as layout", f"cast({turns} as {TURNS}) as turns", "record")
    out = named.select("key", "layout", "fingerprint", "record", F.posexplode_outer("turns").alias("turn", "t"))
    return out.select(
        F.col("key").alias(key),
        "layout",
        "fingerprint",
        F.col("turn").cast("bigint").alias("turn"),
        F.col("t.role").alias("role"),
        F.when(F.col("layout") == "unmapped", F.col("record")).otherwise(F.col("t.content")).alias("content"),
    )


def scattered(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation as JSON in one of the layouts, as several sources would deliver it.

    Conversations of one user turn and one answer take any layout, by conv_id;
    others take one that holds a list.  Turns are ordered by turn, then role
    and text; a null conv_id is a conversation of its own.
    """
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    pair = "size(t) = 2 and coalesce(t[0].role = 'user', false) and coalesce(t[1].role = 'assistant', false)"
    u, a = "t[0].text", "t[1].text"
    options = "map('ignoreNullFields', 'false')"

    def items(role: str, content: str, names: str) -> str:
        return f"transform(t, x -> named_struct('{role}', {names}, '{content}', x.text))"

    gpt = "case x.role when 'user' then 'human' when 'assistant' then 'gpt' else x.role end"
    lists = [
        f"to_json(named_struct('messages', {items('role', 'content', 'x.role')}), {options})",
        f"to_json(named_struct('conversations', {items('from', 'value', gpt)}), {options})",
        f"to_json(named_struct('data', named_struct('turns', {items('speaker', 'text', 'upper(x.role)')})), {options})",
    ]
    pairs = [
        f"to_json(named_struct('prompt', {u}, 'completion', {a}), {options})",
        f"to_json(named_struct('prompt', {u}, 'response', {a}), {options})",
        f"to_json(named_struct('instruction', {u}, 'output', {a}), {options})",
        f"to_json(named_struct('qa', named_struct('question', {u}, 'answer', {a})), {options})",
    ]
    n = "coalesce(conv_id, 0)"
    of_pair = f"case pmod({n}, 7) " + " ".join(f"when {i} then {e}" for i, e in enumerate(lists + pairs)) + " end"
    of_list = f"case pmod({n}, 3) " + " ".join(f"when {i} then {e}" for i, e in enumerate(lists)) + " end"
    return turns.selectExpr("conv_id", f"case when {pair} then {of_pair} else {of_list} end as record")


def chat_sql() -> str:
    """The turns of ``scattered`` conversations as DuckDB SQL, straight from the table."""
    names = ["messages", "conversations", "nested_messages", "prompt_completion", "prompt_response", "instruction", "question_answer"]
    of_pair = "case conv_id % 7 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(names)) + " end"
    of_list = "case conv_id % 3 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(names[:3])) + " end"
    role = "case " + " ".join(f"when lower(trim(role)) in ({', '.join(repr(x) for x in xs)}) then '{c}'" for c, xs in ROLES.items()) + " else 'unknown' end"
    prints = " ".join(f"when '{m.name}' then '{fingerprint_of(m.layout)}'" for m in MAPPINGS)
    return (
        "with o as (select *, row_number() over (partition by conv_id order by turn, role, text) - 1 as pos, count(*) over (partition by conv_id) as n from conversations), "
        "k as (select conv_id, coalesce(max(n) = 2 and max(case when pos = 0 then role end) = 'user' and max(case when pos = 1 then role end) = 'assistant', false) as pair from o group by conv_id), "
        f"l as (select o.conv_id, o.pos, o.text, o.role, case when k.pair then {of_pair.replace('conv_id', 'o.conv_id')} else {of_list.replace('conv_id', 'o.conv_id')} end as layout from o join k on o.conv_id is not distinct from k.conv_id) "
        f"select conv_id, layout, case layout {prints} end as fingerprint, pos as turn, {role} as role, text as content from l"
    )
