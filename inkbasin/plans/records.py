"""Queries on extraction records: defaults, overrides, flags, packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbasin.functions import records as R
from inkbasin.operators.facts import validation
from inkbasin.plans.facts import _CHECKED, AS_OF
from inkbasin.plans.inputs import facts, table
from inkbasin.plans.register import registry

QUERIES, ORACLE_SQL, query = registry()


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS title, CASE WHEN doc_id % 4 = 0 THEN 'en' ELSE lang END AS language, 'medium' AS quality, CASE WHEN doc_id % 5 = 0 THEN [] ELSE [source] END AS topics FROM documents")
def metadata_defaults(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.when(i % 3 > 0, F.col("source")).otherwise(" ").alias("title"), F.when(i % 4 > 0, F.col("lang")).alias("language"), F.when(i % 5 > 0, F.array("source")).alias("topics"))
    return R.with_defaults(rows).select("doc_id", "title", "language", "quality", "topics")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 THEN 'c' || doc_id ELSE lang END AS client, CASE WHEN doc_id % 2 = 0 THEN 'p' ELSE source END AS project FROM documents")
def manifest_override(spark, d):
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    entries = docs.filter("doc_id % 2 = 0").select(i.alias("id"), F.when(i % 3 > 0, F.concat(F.lit("c"), i)).otherwise("").alias("client"), F.lit("p").alias("project"))
    return R.overridden(docs.select(i.alias("id"), F.col("lang").alias("client"), F.col("source").alias("project")), entries)


@query("SELECT conv_id, list(CAST(CASE WHEN turn % 3 = 0 THEN n ELSE turn END AS INTEGER) ORDER BY turn) AS numbers FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def slide_numbers(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 3 == 0, 0).otherwise(F.col("turn")).cast("int").alias("number"), F.col("role").alias("title")))).alias("s"))
    return c.select("conv_id", F.transform(R.numbered_slides(F.col("s")), lambda s: s["number"]).alias("numbers"))


@query(f"{_CHECKED} SELECT customer, count(*) AS facts, count(*) FILTER (status <> 'verified' AND anomalies > 0) AS flagged FROM v GROUP BY customer")
def flagged_facts(spark, d):
    v = facts(spark, d).select("customer", validation(F.col("fact"), F.col("source_text"), AS_OF).alias("v"))
    g = v.groupBy("customer").agg(F.collect_list(F.struct("v.status", "v.anomalies")).alias("all"))  # a customer's facts are one note
    return g.select("customer", F.size("all").cast("long").alias("facts"), F.size(R.flagged(F.col("all"))).cast("long").alias("flagged"))


@query("SELECT l_returnflag AS kind, count(*) AS files, sum(CAST(l_extendedprice AS BIGINT))::BIGINT AS before, sum(CAST(floor(l_extendedprice * 0.6) AS BIGINT))::BIGINT AS after, round_even((1 - sum(CAST(floor(l_extendedprice * 0.6) AS BIGINT)) / sum(CAST(l_extendedprice AS BIGINT))) * 100, 1) AS reduction FROM (SELECT l_returnflag, floor(l_extendedprice) AS l_extendedprice FROM lineitem) GROUP BY 1")
def compression_totals(spark, d):
    p = F.floor("l_extendedprice")
    return R.compression_totals(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), p.alias("before"), F.floor(p.cast("double") * 0.6).alias("after")), "kind")


@query("SELECT user_id AS package, CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'p' || min(event_id) FILTER (event_type = 'click') ELSE 'p' || min(event_id) END AS cover FROM events GROUP BY user_id")
def package_cover(spark, d):
    kind = F.when(F.col("event_type") == "click", "slide").otherwise("frame")
    return R.cover(table(spark, d, "events").select(F.col("user_id").alias("package"), kind.alias("kind"), F.col("event_id").alias("number"), F.concat(F.lit("p"), "event_id").alias("path")))


@query("SELECT doc_id, length(text) < 2000 AS low_content, length(text) / 1048576.0 > 0.01 AS compress, doc_id % 3 > 0 AND doc_id % 5 > 0 AS fresh, CASE doc_id % 4 WHEN 0 THEN 'slides' WHEN 1 THEN 'document' WHEN 2 THEN 'document' ELSE 'audio' END AS type, 'a/f' || doc_id || '_compressed.mp4' AS target FROM documents")
def record_predicates(spark, d):
    i, docs = F.col("doc_id"), table(spark, d, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("presentation", "pdf", "other", "audio"))), (i % 4 + 1).cast("int"))
    fresh = R.has_freshness(F.col("source"), F.when(i % 3 > 0, "h").otherwise(""), F.when(i % 5 > 0, "t"))
    return docs.select("doc_id", R.low_content(F.length("text")).alias("low_content"), R.needs_compression(F.length("text"), 0.01).alias("compress"), fresh.alias("fresh"), R.manifest_type(kind).alias("type"), R.compressed_path(F.concat(F.lit("a/f"), i, F.lit(".mp4")), True).alias("target"))


@query("WITH n AS (SELECT source AS package, count(*) AS files, list_sort(list_distinct(list(lang))) AS types FROM documents GROUP BY source) SELECT package, 'package: ' || package || chr(10) || 'files: ' || files || chr(10) || 'types: [' || array_to_string(types, ', ') || ']' AS text FROM n")
def package_meta(spark, d):
    from inkbasin.sources.sinks import package_meta as meta

    return meta(table(spark, d, "documents").select(F.col("source").alias("package"), F.col("lang").alias("doc_type")))
