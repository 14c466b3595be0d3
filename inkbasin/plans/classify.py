"""Queries on document types, names, tags and text measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbasin import rules
from inkbasin.functions import classify as C
from inkbasin.functions import text as T
from inkbasin.plans import sql as S
from inkbasin.plans.inputs import FILES_SQL, NAME, files, table
from inkbasin.plans.register import registry

QUERIES, ORACLE_SQL, query = registry()
_NAMED = f"WITH {FILES_SQL}, named AS (SELECT *, concat(name, ext) AS filename FROM files)"


@query(f"{_NAMED} SELECT doc_id, {S.NAME_TYPE} AS doc_type FROM named")
def doc_type_filename(spark, d):
    return files(spark, d).select("doc_id", C.type_from_name(T.file_name(F.col("path"))).alias("doc_type"))


@query(f"{_NAMED} SELECT doc_id, {S.DOC_TYPE} AS doc_type FROM named")
def doc_type_full(spark, d):
    return files(spark, d).select("doc_id", C.doc_type(F.col("path")).alias("doc_type"))


@query(f"{_NAMED}, t AS (SELECT {S.DOC_TYPE} AS doc_type FROM named) SELECT doc_type, {S.in_list('doc_type', rules.DEEP_TYPES)} AS deep, count(*) AS files FROM t GROUP BY doc_type")
def deep_eligible(spark, d):
    t = files(spark, d).groupBy(C.doc_type(F.col("path")).alias("doc_type")).agg(F.count("*").alias("files"))
    return t.select("doc_type", C.deep(F.col("doc_type")).alias("deep"), "files")


@query(f"WITH {FILES_SQL} SELECT doc_id, {S.first_case([(f'ext = {S.quoted(k)}', S.quoted(v)) for k, v in rules.CONTENT_TYPES.items()], 'source')} AS type, CASE doc_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'fragment' ELSE 'other' END AS quality FROM files")
def type_and_quality(spark, d):
    q = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return files(spark, d).select("doc_id", C.enforced_type(F.col("path"), F.col("source")).alias("type"), C.quality_value(q).alias("quality"))


_NOISE = "lower(name)"
for _n in rules.STEM_NOISE:
    _NOISE = f"replace({_NOISE}, '{_n}', '')"


@query(f"WITH {FILES_SQL} SELECT doc_id, trim(regexp_replace(replace(replace({_NOISE}, '_', ' '), '-', ' '), ' {{2,}}', ' ', 'g')) AS stem FROM files")
def normalize_stem(spark, d):
    return files(spark, d).select("doc_id", T.normalize_stem(F.col("path")).alias("stem"))


@query(f"SELECT doc_id, trim(lower(regexp_replace({NAME}, '(?i)[_\\-\\s]*(slides|notes|transcript|audio|video|recording|deck|doc|docs)$', '')), '_- ') AS prefix FROM documents")
def stem_prefix(spark, d):
    return table(spark, d, "documents").select("doc_id", T.stem_prefix(F.expr(NAME)).alias("prefix"))


@query(f"WITH {FILES_SQL}, s AS (SELECT doc_id, substring(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g'), '\\s+', '_', 'g'), '_'), 1, 64) AS stem, sha256(text) AS h FROM files) SELECT doc_id, '2026-03-22_' || stem || '_' || CASE WHEN doc_id % 10 = 0 THEN '0000' ELSE substring(h, 1, 4) END AS filename FROM s")
def output_filename(spark, d):
    h = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.sha2("text", 256))
    return files(spark, d).select("doc_id", T.output_filename(F.col("path"), F.lit("2026-03-22T10:00:00"), h).alias("filename"))


@query("SELECT page_id, regexp_replace(replace(html, '`', ''), '<[^>]*>', '', 'g') AS text FROM pages")
def sanitize_html(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_markup(F.col("html")).alias("text"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(replace(replace(lower(p_name || ' & ' || p_type), '&', ''), '_', '-'), ' ', '-'), '[^a-z0-9/-]', '', 'g'), '-+', '-', 'g'), '-') AS tag FROM part")
def tag_text(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalize_tag(F.concat("p_name", F.lit(" & "), "p_type")).alias("tag"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '**Links:** [[' || c_mktsegment || ']] . [[' || c_name || ']]' END AS links FROM customer")
def links_line(spark, d):
    c = table(spark, d, "customer")
    none = F.array().cast("array<string>")
    there = F.col("c_custkey") % 5 != 0
    line = T.links_line(F.when(there, F.array("c_mktsegment")), none, F.when(there, F.array(F.concat("c_name", F.lit(" (buyer)")))))
    return c.select("c_custkey", line.alias("links"))


@query("SELECT n_nationkey, sha256(least(n_name, r_name) || '|' || greatest(n_name, r_name)) AS hash FROM nation JOIN region ON n_regionkey = r_regionkey")
def session_hash(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", T.pair_hash(F.col("n_name"), F.col("r_name")).alias("hash"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 11 <= 8 AND o_orderkey % 4 < 3 THEN CASE o_orderkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'slide' ELSE 'section' END END AS kind, CAST(CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 11 <= 8 AND o_orderkey % 4 < 3 THEN o_orderkey % 11 END AS INTEGER) AS number FROM orders")
def locators(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".pptx", ".docx", ".txt"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = table(spark, d, "orders").select("o_orderkey", C.locator((F.col("o_orderkey") % 11).cast("string"), ext, F.lit(8)).alias("l"))
    return o.select("o_orderkey", F.col("l.type").alias("kind"), "l.number")
