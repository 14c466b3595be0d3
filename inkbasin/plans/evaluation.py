"""Queries on the quality of packages, and on two runs of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbasin.operators import packages
from inkbasin.plans.inputs import table
from inkbasin.plans.register import registry

QUERIES, ORACLE_SQL, query = registry()

_FIELDS = """concat('{"title": "', coalesce(lang, ''), ' ', doc_id % 7, '", "source": "in/', CASE doc_id % 4 WHEN 0 THEN concat('deck', doc_id, '.pptx') WHEN 1 THEN concat('f', doc_id, '.PDF') WHEN 2 THEN concat('talk', doc_id % 20, '.mp4') ELSE '' END,
 '", "extraction_version": ', doc_id % 3, ', "depth": "', CASE WHEN doc_id % 2 = 0 THEN 'deep' ELSE 'standard' END, '", "type": "', CASE WHEN doc_id % 9 = 0 THEN 'document' ELSE 'video' END, '", "topics": [', CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '"a"' ELSE '"a", "b", "c"' END,
 '], "entities_mentioned": ', CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE '["x", "y"]' END, ', "source_path": "p", "extracted_at": "t", "source_hash": "', CASE WHEN doc_id % 6 > 0 THEN 'h' ELSE '' END, '", "key_facts": [',
 CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '"short", "a fact with over thirty characters in it"' WHEN 2 THEN '{"fact": "f", "polarity": "positive", "locator": "p. 1"}, {"fact": "g", "polarity": "unknown"}' WHEN 3 THEN '"text first", {"fact": "f", "polarity": "negative"}' ELSE '"only one fact, which is quite long enough"' END, ']',
 CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ', "rfp_overlay": {"a": "x", "b": [], "c": "", "d": null, "e": ["z"], "f": 0}' ELSE ', "deck_overlay": null' END, '}')"""
_KEPT = "doc_id % 3 > 0 AND doc_id % 20 <> 5"  # what the older run had
_PACKAGE = "coalesce(source, 'none')"


def _sql(name: str, where: str, text: str) -> str:
    """Evaluated notes as a chain of DuckDB subqueries ending in `name`; JSON is read by DuckDB's own functions."""
    value = lambda key, other: f"coalesce(json_extract_string(j, '$.{key}'), {other})"
    items = lambda key: f"CASE WHEN json_type(j, '$.{key}') = 'ARRAY' THEN CAST(json_extract(j, '$.{key}') AS JSON[]) ELSE [] END"
    size = "CASE WHEN json_type(f) = 'VARCHAR' THEN length(f->>'$') ELSE length(CAST(f AS VARCHAR)) END"
    return f"""{name}_p AS (SELECT {_PACKAGE} AS package, count(*) FILTER (doc_id % 3 = 0) AS slides, count(*) FILTER (doc_id % 3 = 1) AS frames, count(*) FILTER (doc_id % 3 = 2) AS images FROM documents WHERE doc_id % 40 = 0 GROUP BY 1),
{name}_j AS (SELECT {_PACKAGE} AS package, 'n' || doc_id AS note, CAST({_FIELDS} AS JSON) AS j, coalesce({text}, '') AS body FROM documents WHERE {where}),
{name}_l AS (SELECT *, string_split(trim(body, ' ' || chr(10) || chr(13) || chr(9)), chr(10)) AS lines, {items('key_facts')} AS facts, list_sort(list_filter(json_keys(j), lambda k: ends_with(k, '_overlay')))[1] AS overlay FROM {name}_j),
{name}_c AS (SELECT l.*, coalesce(slides, 0) AS slides, coalesce(frames, 0) AS frames, {value('title', 'note')} AS title, {value('source', "''")} AS source, CAST({value('extraction_version', "'1'")} AS DOUBLE) AS version, {value('depth', "''")} AS depth, CAST(length(body) AS BIGINT) AS chars,
 len(list_filter(lines, lambda x: starts_with(x, '## '))) AS sections, len(list_filter(lines, lambda x: starts_with(x, '!['))) AS pictures, CAST(len({items('entities_mentioned')}) AS BIGINT) AS entities, len({items('topics')}) AS topics, CAST(len(facts) AS BIGINT) AS key_facts, len(list_filter(facts, lambda f: {size} >= 30)) AS specific,
 CASE WHEN len(facts) > 0 AND json_type(facts[1]) = 'OBJECT' THEN len(list_filter(facts, lambda f: coalesce(f->>'$.polarity', 'unknown') NOT IN ('', 'unknown'))) ELSE 0 END AS polarity_count, CASE WHEN len(facts) > 0 AND json_type(facts[1]) = 'OBJECT' THEN len(list_filter(facts, lambda f: coalesce(f->>'$.locator', '') <> '')) ELSE 0 END AS locator_count,
 overlay IS NOT NULL AS has_overlay, CASE WHEN json_type(j, '$.' || overlay) = 'OBJECT' THEN len(list_filter(json_keys(j, '$.' || overlay), lambda k: json_type(j, '$.' || overlay || '.' || k) <> 'NULL' AND CAST(json_extract(j, '$.' || overlay || '.' || k) AS VARCHAR) NOT IN ('""', '[]'))) ELSE 0 END AS populated,
 {value('source_path', "''")} <> '' AND {value('source_hash', "''")} <> '' AND {value('extracted_at', "''")} <> '' AS fresh, regexp_matches(lower({value('source', "''")}), '\\.(pdf|docx)$') OR {value('type', "''")} IN ('document', 'documentation') AS static FROM {name}_l l LEFT JOIN {name}_p p ON p.package = l.package),
{name} AS (SELECT *, CASE WHEN ends_with(source, '.pptx') AND CASE WHEN slides > 0 THEN slides ELSE pictures END > 0 THEN round_even(sections / CASE WHEN slides > 0 THEN slides ELSE pictures END, 2) END AS slide_coverage, regexp_replace(regexp_replace(source, '^.*/', ''), '(.)\\.[^.]*$', '\\1') AS stem,
 CAST(least(100, least(20, specific * 2) + CASE WHEN NOT has_overlay THEN 0 WHEN static AND populated >= 3 THEN 20 WHEN static THEN 5 + populated * 5 ELSE 5 + least(15, populated * 3) END + CASE WHEN fresh THEN 10 ELSE 0 END + least(10, entities * 2) + least(8, topics) + CASE WHEN chars > 2000 THEN 10 WHEN chars > 1000 THEN 7 WHEN chars > 500 THEN 4 ELSE 0 END
 + CASE WHEN slides > 0 OR frames > 0 THEN 10 ELSE 0 END + CASE WHEN version >= 2 THEN 7 ELSE 0 END + CASE WHEN polarity_count > 0 THEN 3 ELSE 0 END + CASE WHEN locator_count > 0 THEN 2 ELSE 0 END) AS INTEGER) AS score FROM {name}_c)"""


_OLD = _sql("o", _KEPT, "text")
_NEW = _sql("n", "doc_id % 7 > 0", "concat('## ', text, chr(10), '![a](b)')")
_EVERY = _sql("n", "true", "concat('## ', text, chr(10), '![a](b)')")
_TEXT = "concat('## ', coalesce(text, ''), '\\n![a](b)')"


def _evaluated(spark, d, where: str, text: str):
    docs = table(spark, d, "documents")
    notes = docs.filter(where).select(F.expr(_PACKAGE).alias("package"), F.concat(F.lit("n"), "doc_id").alias("note"), F.expr(text).alias("text"), F.parse_json(F.expr(_FIELDS)).alias("fields"))
    kind = F.expr("CASE doc_id % 3 WHEN 0 THEN 'slide' WHEN 1 THEN 'frame' ELSE 'image' END")
    return packages.evaluated(notes, docs.filter("doc_id % 40 = 0").select(F.expr(_PACKAGE).alias("package"), kind.alias("kind")))


def _old(spark, d):
    return _evaluated(spark, d, _KEPT, "text")


def _new(spark, d):
    return _evaluated(spark, d, "doc_id % 7 > 0", _TEXT)


@query(
    f"WITH {_EVERY} SELECT package, note, title, score, key_facts, specific, key_facts - specific AS generic, polarity_count, locator_count, has_overlay, populated, fresh, static, entities, chars, slide_coverage, list_filter([CASE WHEN key_facts = 0 THEN 'no facts' END, CASE WHEN round_even(specific / key_facts, 2) < 0.5 THEN 'generic facts' END,"
    " CASE WHEN chars < 2000 THEN 'low content' END, CASE WHEN depth = 'deep' AND NOT has_overlay THEN 'deep without overlay' END, CASE WHEN slide_coverage < 0.5 THEN 'low slide coverage' END], lambda i: i IS NOT NULL) AS issues FROM n"
)
def package_eval(spark, d):
    return _evaluated(spark, d, "true", _TEXT).select("package", "note", "title", "score", "key_facts", "specific", "generic", "polarity_count", "locator_count", "has_overlay", "populated", "fresh", "static", "entities", "chars", "slide_coverage", "issues")


@query(
    f"WITH {_OLD}, {_NEW}, s AS (SELECT package, stem, arg_max(note, note) AS note FROM o GROUP BY 1, 2), t AS (SELECT package, substring(title, 1, 30) AS t, min(note) AS note FROM o GROUP BY 1, 2), f AS (SELECT package, min(note) AS note FROM o GROUP BY 1),"
    " m AS (SELECT n.*, coalesce(s.note, t.note, f.note) AS old_note, CASE WHEN s.note IS NOT NULL THEN 'source' WHEN t.note IS NOT NULL THEN 'title' WHEN f.note IS NOT NULL THEN 'first' END AS matched_by FROM n LEFT JOIN s ON s.package = n.package AND s.stem = n.stem LEFT JOIN t ON t.package = n.package AND t.t = substring(n.title, 1, 30) LEFT JOIN f ON f.package = n.package)"
    " SELECT m.package, m.note, old_note, matched_by, o.score AS old_score, m.score AS new_score, m.score - o.score AS score_change, m.key_facts - o.key_facts AS key_facts_change, m.chars - o.chars AS chars_change, o.has_overlay AS old_has_overlay, m.fresh AS new_fresh FROM m LEFT JOIN o ON o.note = old_note"
)
def package_compare(spark, d):
    return packages.compared(_old(spark, d), _new(spark, d)).select("package", "note", "old_note", "matched_by", "old_score", "new_score", "score_change", "key_facts_change", "chars_change", "old_has_overlay", "new_fresh")


_SCORES = "{x}_s AS (SELECT p.package, coalesce(CAST(round_even(avg(score), 0) AS INTEGER), 0) AS score FROM (SELECT DISTINCT {package} AS package FROM documents) p LEFT JOIN {x} ON {x}.package = p.package GROUP BY 1)"


@query(f"WITH {_OLD}, {_NEW}, {_SCORES.format(x='o', package=_PACKAGE)}, {_SCORES.format(x='n', package=_PACKAGE)} SELECT package, o_s.score AS old_score, n_s.score AS new_score, n_s.score - o_s.score AS change FROM o_s JOIN n_s USING (package)")
def package_delta(spark, d):
    all_ = table(spark, d, "documents").select(F.expr(_PACKAGE).alias("package")).distinct()
    return packages.package_changes(packages.package_scores(all_, _old(spark, d)), packages.package_scores(all_, _new(spark, d)))
