"""Queries on report quality and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbasin import rules
from inkbasin.operators import reports, scores
from inkbasin.plans import sql as S
from inkbasin.plans.inputs import table
from inkbasin.plans.register import registry
from inkbasin.sources.files import sections

QUERIES, ORACLE_SQL, query = registry()
_SPOKEN = " + ".join(f"CAST(contains(lower(e), {S.quoted(m)}) AS INTEGER)" for m in rules.SPOKEN_MARKS)


@query(f"WITH r AS (SELECT conv_id, text AS e FROM conversations WHERE role = 'assistant'), m AS (SELECT conv_id, count(*) AS total, count(*) FILTER (trim(e) = '') AS empty, count(*) FILTER (length(trim(e)) < 30) AS too_short, count(*) FILTER ({S.has_any('lower(e)', rules.GENERIC_PHRASES)}) AS generic, count(*) FILTER ({_SPOKEN} >= 2) AS raw, round_even(avg(length(e)), 1) AS avg_length FROM r GROUP BY conv_id) SELECT *, empty / total <= 0.1 AND too_short / total <= 0.3 AND generic / total <= 0.5 AND raw / total <= 0.2 AS passed FROM m")
def explanation_check(spark, d):
    c = table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", F.col("text").alias("explanation"))
    return reports.explanation_check(c, "conv_id")


_TITLE = "CASE WHEN page_id % 9 = 0 THEN 'Thank You' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END"


@query(f"WITH t AS (SELECT page_id % 10 AS report, page_id AS pos, {_TITLE} AS title FROM pages), m AS (SELECT report, count(*) AS total, count(*) FILTER ({S.has_any('lower(title)', rules.JUNK_TITLES)}) AS junk, coalesce(list(title ORDER BY pos) FILTER ({S.has_any('lower(title)', rules.JUNK_TITLES)}), [])[1:5] AS junk_titles FROM t GROUP BY report) SELECT *, round_even(junk / total, 3) AS junk_ratio, junk / total <= 0.1 AS passed FROM m")
def junk_check(spark, d):
    title = F.when(F.col("page_id") % 9 == 0, "Thank You").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return reports.junk_check(table(spark, d, "pages").select((F.col("page_id") % 10).alias("report"), F.col("page_id").alias("pos"), title.alias("title")), "report")


@query(f"WITH t AS (SELECT conv_id % 20 AS report, turn, max(text) FILTER (role = 'user') AS question, NULL AS x, conv_id FROM conversations GROUP BY conv_id, turn), q AS (SELECT u.conv_id % 20 AS report, u.text AS question, a.text AS answer, CASE WHEN u.conv_id % 3 > 0 THEN 'c' ELSE '' END AS category, CASE WHEN u.turn % 4 > 0 THEN 'frame' END AS source FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'), m AS (SELECT report, count(*) AS total, count(*) FILTER (answer IS NULL) AS missing_fields, count(*) FILTER (answer IS NOT NULL AND {S.has_any('lower(question)', rules.GENERIC_QUESTIONS)}) AS generic_questions, count(*) FILTER (answer IS NOT NULL AND {S.has_any('lower(answer)', rules.GENERIC_ANSWERS)}) AS generic_answers, count(*) FILTER (answer IS NOT NULL AND category = '') AS missing_category, count(*) FILTER (answer IS NOT NULL AND source IS NULL) AS missing_source, round_even(sum(length(question)) / count(*), 1) AS avg_question, round_even(sum(coalesce(length(answer), 0)) / count(*), 1) AS avg_answer FROM q GROUP BY report) SELECT *, missing_fields = 0 AND generic_questions / total <= 0.5 AND generic_answers / total <= 0.5 AND missing_category / total <= 0.3 AS passed FROM m")
def qa_check(spark, d):
    c = table(spark, d, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    q = u.join(a, ["conv_id", "turn"], "left").select((F.col("conv_id") % 20).alias("report"), "question", "answer", F.when(F.col("conv_id") % 3 > 0, "c").otherwise("").alias("category"), F.when(F.col("turn") % 4 > 0, "frame").alias("source"))
    return reports.qa_check(q, "report")


_LINES = "lines AS (SELECT user_id AS report, event_id AS pos, CASE WHEN event_id % 7 = 0 THEN '# ' || CASE WHEN event_id % 2 = 0 THEN 'General' ELSE event_type END ELSE '## Slide ' || event_id END AS line FROM events)"


def _lines(spark, d):
    i = F.col("event_id")
    line = F.when(i % 7 == 0, F.concat(F.lit("# "), F.when(i % 2 == 0, "General").otherwise(F.col("event_type")))).otherwise(F.concat(F.lit("## Slide "), i))
    return table(spark, d, "events").select(F.col("user_id").alias("report"), i.alias("pos"), line.alias("line"))


_SLIDES = f"{_LINES}, filled AS (SELECT *, last_value(CASE WHEN starts_with(line, '# ') THEN trim(substring(line, 3)) END IGNORE NULLS) OVER (PARTITION BY report ORDER BY pos ROWS UNBOUNDED PRECEDING) AS category FROM lines), slides AS (SELECT report, pos, category, substring(line, 4) AS title FROM filled WHERE starts_with(line, '## ') AND category IS NOT NULL)"


@query(f"WITH {_SLIDES} SELECT * FROM slides")
def slide_categories(spark, d):
    return reports.slide_categories(_lines(spark, d))


@query(
    f"WITH {_LINES}, h AS (SELECT *, starts_with(line, '# ') AS header, count(*) FILTER (starts_with(line, '# ')) OVER (PARTITION BY report ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part FROM lines), "
    "s AS (SELECT report, part, max(CASE WHEN header THEN trim(substring(line, 3)) END) AS category, min(pos) AS pos, count(*) FILTER (starts_with(line, '## ')) AS n FROM h GROUP BY 1, 2), "
    "c AS (SELECT report, category, min(pos) AS pos, arg_max(n, pos) AS n FROM s WHERE category IS NOT NULL GROUP BY 1, 2), "
    f"b AS (SELECT report, sum(n)::BIGINT AS total, count(*) AS categories, coalesce(arg_min(n, pos) FILTER ({S.has_any('lower(category)', rules.GENERAL_CATEGORIES)}), 0) AS general FROM c GROUP BY report), "
    "a AS (SELECT r.report, coalesce(total, 0) AS total, coalesce(categories, 0) AS categories, coalesce(general, 0) AS general FROM (SELECT DISTINCT report FROM lines) r LEFT JOIN b USING (report)) "
    "SELECT *, round_even(general / greatest(total, 1), 3) AS general_ratio, total > 0 AND categories > 1 AND general / greatest(total, 1) <= 0.7 AS passed FROM a"
)
def category_balance(spark, d):
    return reports.category_balance(_lines(spark, d))


_OLD = "old AS (SELECT doc_id AS title, text AS explanation FROM documents WHERE doc_id % 5 > 0), new AS (SELECT doc_id AS title, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || text WHEN 2 THEN substring(text, 1, length(text) // 2) ELSE 'x' || text END AS explanation FROM documents WHERE doc_id % 7 > 0)"


def _runs(spark, d):
    docs, i, t = table(spark, d, "documents"), F.col("doc_id"), F.col("text")
    old = docs.filter("doc_id % 5 > 0").select(i.alias("title"), t.alias("explanation"))
    changed = F.when(i % 4 == 0, t).when(i % 4 == 1, F.concat(t, t)).when(i % 4 == 2, F.expr("substring(text, 1, length(text) div 2)")).otherwise(F.concat(F.lit("x"), t))
    return old, docs.filter("doc_id % 7 > 0").select(i.alias("title"), changed.alias("explanation"))


@query(f"WITH {_OLD} SELECT coalesce(o.title, n.title) AS title, CASE WHEN o.title IS NULL THEN 'added' WHEN n.title IS NULL THEN 'removed' WHEN o.explanation = n.explanation THEN 'same' WHEN length(n.explanation) > length(o.explanation) * 1.2 THEN 'improved' WHEN length(n.explanation) < length(o.explanation) * 0.8 THEN 'degraded' ELSE 'rewritten' END AS change, CAST(length(o.explanation) AS INTEGER) AS old_length, CAST(length(n.explanation) AS INTEGER) AS new_length FROM old o FULL JOIN new n ON o.title = n.title")
def slide_diff(spark, d):
    return reports.slide_changes(*_runs(spark, d))


_SLIDE = "coalesce(source, 'none') AS report, doc_id AS pos, concat('S', doc_id % 90) AS title"
_CHANGED = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat(text, text) WHEN 2 THEN substring(text, 1, 40) ELSE concat('x', text) END"
_COUNTS = "SELECT coalesce(source, 'none') AS report, count(*) AS frames, sum(CASE WHEN doc_id % {n} = 0 THEN 1 ELSE 0 END) AS questions FROM documents WHERE doc_id % 11 <> {n} GROUP BY 1"
_CUT = "substring({x}, 1, 200) || '...'"


@query(
    f"WITH os AS (SELECT {_SLIDE}, coalesce(text, '') AS e FROM documents WHERE doc_id % 3 > 0 OR doc_id % 8 = 0), ns AS (SELECT {_SLIDE}, coalesce({_CHANGED}, '') AS e FROM documents WHERE doc_id % 7 > 0),"
    " o AS (SELECT report, title, arg_max(e, pos) AS e, count(*) AS n FROM os GROUP BY 1, 2), n AS (SELECT report, title, arg_max(e, pos) AS e, count(*) AS n FROM ns GROUP BY 1, 2),"
    " p AS (SELECT coalesce(o.report, n.report) AS report, coalesce(o.title, n.title) AS title, o.n AS onum, n.n AS nnum, o.e AS oe, n.e AS ne, CASE WHEN o.n IS NULL THEN 'added' WHEN n.n IS NULL THEN 'removed' WHEN o.e = n.e THEN 'same' WHEN length(n.e) > length(o.e) * 1.2 THEN 'improved' WHEN length(n.e) < length(o.e) * 0.8 THEN 'degraded' ELSE 'rewritten' END AS kind FROM o FULL JOIN n ON o.report = n.report AND o.title = n.title),"
    f" g AS (SELECT report, coalesce(sum(onum), 0)::BIGINT AS old_slides, coalesce(sum(nnum), 0)::BIGINT AS new_slides, count(*) FILTER (kind = 'added') AS total_added, count(*) FILTER (kind = 'removed') AS total_removed, count(*) FILTER (kind NOT IN ('added', 'removed')) AS common, count(*) FILTER (kind = 'improved') AS improved, count(*) FILTER (kind = 'degraded') AS degraded, count(*) FILTER (kind = 'rewritten') AS rewritten,"
    " coalesce(list(title ORDER BY title) FILTER (kind = 'added'), [])[1:10] AS added_titles, coalesce(list(title ORDER BY title) FILTER (kind = 'removed'), [])[1:10] AS removed_titles,"
    f" list_transform(coalesce(list({{'t': title, 'k': kind, 'o': {_CUT.format(x='oe')}, 'n': {_CUT.format(x='ne')}}} ORDER BY title) FILTER (kind IN ('improved', 'degraded', 'rewritten')), [])[1:5], lambda x: x.t || '|' || x.k || '|' || x.o || '|' || x.n) AS examples FROM p GROUP BY report),"
    f" oc AS ({_COUNTS.format(n=4)}), nc AS ({_COUNTS.format(n=6)})"
    " SELECT g.*, new_slides - old_slides AS slides_change, oc.frames AS old_frames, nc.frames AS new_frames, round_even((nc.frames - oc.frames) / greatest(oc.frames, 1) * 100, 1) AS frames_percent, round_even((nc.questions - oc.questions) / greatest(oc.questions, 1) * 100, 1) AS questions_percent FROM g LEFT JOIN oc ON oc.report = g.report LEFT JOIN nc ON nc.report = g.report"
)
def report_comparison(spark, d):
    docs = table(spark, d, "documents")
    slides = lambda where, e: docs.filter(where).selectExpr("coalesce(source, 'none') AS report", "doc_id AS pos", "concat('S', doc_id % 90) AS title", f"{e} AS explanation")
    counts = lambda n: docs.filter(F.col("doc_id") % 11 != n).groupBy(F.expr("coalesce(source, 'none')").alias("report")).agg(F.count("*").alias("frames"), F.count_if(F.col("doc_id") % n == 0).alias("questions"))
    out = reports.comparison(slides("doc_id % 3 > 0 OR doc_id % 8 = 0", "text"), slides("doc_id % 7 > 0", _CHANGED), counts(4), counts(6))
    shown = F.transform("examples", lambda x: F.concat_ws("|", x["title"], x["change"], x["old_explanation"], x["new_explanation"]))
    return out.withColumn("examples", shown).drop("old_questions", "new_questions")


_METRICS = "m AS (SELECT source AS report, avg(length(text)) FILTER (doc_id % 2 = 0) AS ol, avg(length(text)) FILTER (doc_id % 2 = 1) AS nl, count(*) FILTER (doc_id % 6 = 0) AS oj, count(*) FILTER (doc_id % 5 = 1) AS nj, 100.0 * count(*) FILTER (doc_id % 4 = 0) / count(*) AS og, 100.0 * count(*) FILTER (doc_id % 3 = 0) / count(*) AS ng FROM (SELECT source, (doc_id // 20) AS doc_id, text FROM documents) GROUP BY source)"


@query(f"WITH {_METRICS}, c AS (SELECT *, round_even((nl - ol) / greatest(ol, 1) * 100, 1) AS lc FROM m), s AS (SELECT *, CASE WHEN lc > 10 THEN 1 ELSE 0 END + CASE WHEN nj < oj THEN 1 ELSE 0 END + CASE WHEN ng - og < -10 THEN 1 ELSE 0 END AS good, CASE WHEN lc < -10 THEN 1 ELSE 0 END + CASE WHEN nj > oj THEN 1 ELSE 0 END + CASE WHEN ng - og > 10 THEN 1 ELSE 0 END AS bad FROM c) SELECT report, CAST(good AS INTEGER) AS improvements, CAST(bad AS INTEGER) AS regressions, CASE WHEN good > 0 AND bad > 0 THEN 'mixed' WHEN bad > 0 THEN 'degraded' WHEN good > 0 THEN 'improved' ELSE 'unchanged' END AS verdict FROM s")
def report_verdict(spark, d):
    i, n = F.expr("doc_id div 20"), F.length("text")
    docs = table(spark, d, "documents")
    m = docs.groupBy(F.col("source").alias("report")).agg(
        F.avg(F.when(i % 2 == 0, n)).alias("ol"), F.avg(F.when(i % 2 == 1, n)).alias("nl"), F.count_if(i % 6 == 0).alias("oj"), F.count_if(i % 5 == 1).alias("nj"),
        (100.0 * F.count_if(i % 4 == 0) / F.count("*")).alias("og"), (100.0 * F.count_if(i % 3 == 0) / F.count("*")).alias("ng"),
    )
    run = lambda p: m.select("report", F.col(f"{p}l").alias("avg_length"), F.col(f"{p}j").alias("junk"), F.col(f"{p}g").alias("general_percent"))
    return reports.verdict(run("o"), run("n"), "report").select("report", "improvements", "regressions", "verdict")


_NOTE = "'---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || '## A' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '- ' ELSE '> WARNING ' END || replace(text, chr(10), chr(10) || CASE doc_id % 3 WHEN 0 THEN '- ' WHEN 1 THEN '> ' ELSE '![' END)"


@query(f"WITH t AS (SELECT doc_id, regexp_replace({_NOTE}, '^---[\\s\\S]*?---', '') AS rest FROM documents), l AS (SELECT doc_id, rest, string_split(trim(rest, ' ' || chr(10) || chr(13) || chr(9)), chr(10)) AS lines FROM t) SELECT doc_id, CAST(length(rest) AS INTEGER) AS total_chars, CAST(len(lines) AS INTEGER) AS total_lines, CAST(len(list_filter(lines, lambda x: starts_with(x, '## '))) AS INTEGER) AS sections, CAST(len(list_filter(lines, lambda x: starts_with(x, '!['))) AS INTEGER) AS images, CAST(len(list_filter(lines, lambda x: starts_with(x, '> ') AND NOT contains(x, 'WARNING'))) AS INTEGER) AS quotes, CAST(len(list_filter(lines, lambda x: contains(x, '> WARNING'))) AS INTEGER) AS warnings, CAST(len(list_filter(lines, lambda x: starts_with(trim(x), '- '))) AS INTEGER) AS bullet_points FROM l")
def content_counts(spark, d):
    prefix = F.when(F.col("doc_id") % 2 == 0, "- ").otherwise("> WARNING ")
    mark = F.when(F.col("doc_id") % 3 == 0, "\n- ").when(F.col("doc_id") % 3 == 1, "\n> ").otherwise("\n![")
    note = F.concat(F.lit("---\ntitle: x\n---\n## A\n"), prefix, F.replace("text", F.lit("\n"), mark))
    return table(spark, d, "documents").select("doc_id", scores.content_counts(note).alias("c")).select("doc_id", "c.*")


@query("WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT *, sum(CASE WHEN pos % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l) SELECT doc_id, CAST(section AS BIGINT) AS section, string_agg(line, chr(10) ORDER BY pos) AS text FROM n GROUP BY doc_id, section")
def section_split(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return sections(lines.withColumn("heading", F.col("pos") % 3 == 0), "doc_id", "pos", "heading")
