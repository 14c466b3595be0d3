"""Fragments of DuckDB SQL for the oracles."""

from __future__ import annotations

from inkbasin import rules

_NUMBER = "(?i)[$€£¥]?\\s*(\\d[\\d,]*\\.?\\d*)\\s*(%|[kmb]\\b|million|billion|thousand)?"
_SCALE = "CASE lower({s}) WHEN 'k' THEN 1e3 WHEN 'thousand' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'million' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 'billion' THEN 1e9 ELSE 1.0 END"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def numbers(text: str) -> str:
    pairs = f"list_zip(regexp_extract_all({text}, {quoted(_NUMBER)}, 1), regexp_extract_all({text}, {quoted(_NUMBER)}, 2))"
    values = f"list_transform({pairs}, lambda p: TRY_CAST(replace(p[1], ',', '') AS DOUBLE) * {_SCALE.format(s='p[2]')})"
    return f"list_sort(list_distinct(list_filter({values}, lambda v: v IS NOT NULL)))"


def near(a: str, b: str) -> str:
    return f"({a} = {b} OR ({a} <> 0 AND {b} <> 0 AND abs({a} - {b}) <= 0.01 * greatest(abs({a}), abs({b}))))"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 OR {b} = 0 THEN CAST('inf' AS DOUBLE) ELSE greatest({a}, {b}) / least({a}, {b}) END"


def has_any(text: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(p)})" for p in parts) + ")"


def matches_any(text: str, patterns: list[str]) -> str:
    return f"regexp_matches({text}, {quoted('|'.join(patterns))})"


def first_case(cases: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {default} END"


def in_list(column: str, values: list[str]) -> str:
    return f"{column} IN ({', '.join(map(quoted, values))})"


FILE_TYPE = first_case([(in_list("ext", v), quoted(k)) for k, v in rules.FILE_TYPES.items()], "'unknown'")
TEXT_QUALITY = "CASE WHEN chars = 0 THEN 'none' WHEN chars < 200 THEN 'partial' ELSE 'good' END"
NAME_TYPE = first_case([(f"regexp_matches(filename, {quoted('(?i)' + p)})", quoted(t)) for p, t in rules.NAME_PATTERNS], "NULL")
DOC_TYPE = f"coalesce({NAME_TYPE}, " + first_case(
    [(" AND ".join(has_any("lower(path)", x) for x in (one, other) if x), quoted(t)) for one, other, t in rules.FOLDER_RULES] + [(has_any("lower(filename)", parts), quoted(t)) for parts, t in rules.NAME_KEYWORDS], "'general'"
) + ")"
WORDS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
FACT_WORDS = (
    "list_distinct(list_transform(list_filter(" + WORDS + ", lambda w: NOT (" + in_list("lower(w)", rules.STOP_WORDS) + ") AND length(w) > 2 AND NOT regexp_matches(replace(w, ',', ''), '^[0-9]+$')), lambda w: trim(lower(w), '.,;:!?()')))"
)
MEANINGFUL = "list_filter({n}, lambda v: NOT (v = floor(v) AND v BETWEEN 2000 AND 2099))"
POLARITY = "CASE WHEN {no} = {yes} THEN 'unknown' WHEN {no} THEN 'negative' ELSE 'positive' END".format(no=matches_any("lower(fact)", rules.NEGATIVE), yes=matches_any("lower(fact)", rules.POSITIVE))
SENTIMENT = "CASE WHEN {yes} AND {no} THEN 'mixed' WHEN {yes} THEN 'positive' WHEN {no} THEN 'negative' ELSE 'neutral' END".format(yes=has_any("lower(fact)", rules.POSITIVE_WORDS), no=has_any("lower(fact)", rules.NEGATIVE_WORDS))
