"""Queries on files: inventory, scan, routing, cost, resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbasin import rules
from inkbasin.functions.classify import file_type, route_model, scan_tier, select_model, text_quality
from inkbasin.functions.numbers import token_budget
from inkbasin.operators import resume, routing
from inkbasin.plans import sql as S
from inkbasin.plans.inputs import FILES_SQL, files, table
from inkbasin.plans.register import registry

QUERIES, ORACLE_SQL, query = registry()


def _typed(spark, d):
    f = files(spark, d)
    return f.withColumns({"type": file_type(F.col("path")), "quality": text_quality(F.col("chars"), F.lit(0))})


_TYPED = f"WITH {FILES_SQL}, typed AS (SELECT *, {S.FILE_TYPE} AS type, {S.TEXT_QUALITY} AS quality FROM files)"
_TIER = """CASE WHEN type IN ('video', 'audio') THEN 3 WHEN ext = '.pptx' THEN 2 WHEN ext IN ('.xlsx', '.docx') THEN 2
 WHEN quality IN ('none', 'partial') THEN 3 WHEN type IN ('note', 'transcript') AND chars < 5000 THEN 1 ELSE 2 END"""
_COST = "CASE tier WHEN 1 THEN 0.0 WHEN 2 THEN 0.001 ELSE 0.03 END"


@query(f"{_TYPED}, t AS (SELECT {_TIER} AS tier FROM typed), n AS (SELECT tier, count(*) AS files FROM t GROUP BY tier), d AS (SELECT unnest([1, 2, 3]) AS tier) SELECT CAST(d.tier AS INTEGER) AS tier, coalesce(files, 0) AS files, round(coalesce(files, 0) * CASE d.tier WHEN 1 THEN 0.0 WHEN 2 THEN 0.001 ELSE 0.03 END, 6)::DOUBLE AS estimated_cost FROM d LEFT JOIN n USING (tier)")
def tier_cost_estimate(spark, d):
    return routing.cost_by_tier(routing.routed(_typed(spark, d)))


@query(f"{_TYPED}, t AS (SELECT doc_id, type, {_TIER} AS tier, chars, ext, quality FROM typed) SELECT doc_id, CAST(tier AS INTEGER) AS tier, CASE WHEN type IN ('video', 'audio') THEN type || ' requires multimodal processing' WHEN ext = '.pptx' THEN 'PPTX text extraction (' || chars || ' chars)' WHEN ext IN ('.xlsx', '.docx') AND quality = 'none' THEN ext || ' upload blocked by API; text extraction failed, sending what we have' WHEN ext IN ('.xlsx', '.docx') THEN ext || ' upload blocked by API; using extracted text (' || chars || ' chars)' WHEN quality = 'none' THEN 'local extraction failed (no text)' WHEN quality = 'partial' THEN 'partial text extraction (' || chars || ' chars)' WHEN tier = 1 THEN 'small text file (' || chars || ' chars)' ELSE 'good text extraction (' || chars || ' chars, local)' END AS reason, ({_COST})::DOUBLE AS estimated_cost FROM t")
def route_tiers(spark, d):
    return routing.routed(_typed(spark, d)).select("doc_id", "tier", "reason", "estimated_cost")


@query(f"{_TYPED} SELECT doc_id, path, name, type FROM typed WHERE type <> 'unknown' AND folder NOT IN ('.hidden', 'workshop')")
def inventory_classify(spark, d):
    return routing.inventory(files(spark, d).select("doc_id", "path"), excluded=["workshop"]).select("doc_id", "path", "name", "type")


@query("SELECT doc_id, length(text) AS text_chars, substring(text, 1, 2000) AS preview, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents")
def scan_text_metadata(spark, d):
    docs, n = table(spark, d, "documents"), F.length("text")
    return docs.select("doc_id", n.cast("long").alias("text_chars"), F.substring("text", 1, 2000).alias("preview"), (n - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line_count"))


@query(f"WITH {FILES_SQL} SELECT doc_id, CAST(CASE WHEN {S.in_list('ext', rules.FILE_TYPES['video'] + rules.FILE_TYPES['audio'])} THEN 3 WHEN {S.in_list('ext', rules.RICH_EXTENSIONS)} THEN CASE WHEN ext NOT IN ('.csv', '.xlsx') AND chars > 0 THEN 1 ELSE 2 END ELSE 1 END AS INTEGER) AS tier FROM files")
def scan_tiers(spark, d):
    f = files(spark, d)
    known = F.when(~F.col("ext").isin(".csv", ".xlsx"), F.col("chars"))
    return f.select("doc_id", scan_tier(F.col("path"), known).cast("int").alias("tier"))


@query(f"WITH {FILES_SQL} SELECT doc_id, CASE WHEN chars < 5000 THEN 'free' WHEN {S.in_list('ext', [*rules.PRO_EXTENSIONS, '.pdf'])} THEN '{rules.PRO_MODEL}' ELSE '{rules.VISUAL_MODEL}' END AS model, CASE WHEN chars < 5000 THEN 'small_file_local' WHEN ext = '.pptx' THEN 'pptx_multimodal' WHEN {S.in_list('ext', rules.PRO_EXTENSIONS)} THEN 'video_multimodal' WHEN ext = '.pdf' THEN 'pdf_multimodal' ELSE 'text_default' END AS reason FROM files")
def model_selection(spark, d):
    return files(spark, d).select("doc_id", select_model(F.col("path"), F.col("chars")).alias("m")).select("doc_id", "m.model", "m.reason")


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '{rules.VISUAL_MODEL}' WHEN (length(text) * 40) // 4 > 190000 THEN '{rules.LARGE_MODEL}' ELSE '{rules.TEXT_MODEL}' END AS model FROM documents")
def model_route(spark, d):
    return table(spark, d, "documents").select("doc_id", route_model(F.col("doc_id") % 3 + 1, F.length("text") * 40).alias("model"))


@query("SELECT conv_id, max(turn) AS turns, CAST(least(8192 + 280 * count(*), 24576) AS BIGINT) AS deep, CAST(least(6144 + 150 * (sum(length(text)) // 5), 16384) AS BIGINT) AS multimodal, CAST(8192 AS BIGINT) AS standard FROM conversations GROUP BY conv_id")
def token_budgets(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"), F.count("*").alias("slides"), F.sum(F.length("text")).alias("minutes"))
    of = lambda depth: token_budget(F.lit(depth), F.col("slides"), F.col("minutes"))
    return c.select("conv_id", "turns", of("deep").alias("deep"), of("multimodal").alias("multimodal"), of("standard").alias("standard"))


def _status(spark, d):
    docs = table(spark, d, "documents")
    state = F.when(F.col("doc_id") % 3 == 0, "done").when(F.col("doc_id") % 7 == 0, "error").when(F.col("doc_id") % 5 == 0, "skipped").otherwise("pending")
    return docs.select(F.col("doc_id").alias("id"), "source", state.alias("status"), (F.col("doc_id") % 3 + 1).cast("int").alias("t"), (F.col("doc_id") % 4 == 0).alias("batch"), (F.col("doc_id") % 2 + 1).cast("int").alias("tier"))


_STATUS = "status AS (SELECT doc_id AS id, source, CASE WHEN doc_id % 3 = 0 THEN 'done' WHEN doc_id % 7 = 0 THEN 'error' WHEN doc_id % 5 = 0 THEN 'skipped' ELSE 'pending' END AS status, doc_id % 4 = 0 AS batch, doc_id % 2 + 1 AS tier FROM documents)"


@query(f"WITH {_STATUS} SELECT id FROM status WHERE status <> 'done'")
def manifest_status_antijoin(spark, d):
    return resume.pending(table(spark, d, "documents").select(F.col("doc_id").alias("id")), _status(spark, d))


@query(f"WITH {_STATUS}, c AS (SELECT *, CASE WHEN tier = 2 THEN CASE WHEN batch THEN 0.0005 ELSE 0.001 END ELSE 0.0 END AS cost FROM status) SELECT source, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'skipped') AS skipped, round(sum(CASE WHEN status = 'done' THEN cost ELSE 0.0 END), 6)::DOUBLE AS cost, count(*) FILTER (status = 'done' AND tier = 1) AS tier1, count(*) FILTER (status = 'done' AND tier = 2) AS tier2, count(*) FILTER (status = 'done' AND tier = 3) AS tier3 FROM c GROUP BY source")
def batch_summary(spark, d):
    s = _status(spark, d).withColumn("cost", F.when(F.col("tier") == 2, 0.001).otherwise(0.0))
    return routing.batch_summary(s, "source")


@query("SELECT doc_id AS id, 'f' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'File not found: f' || doc_id END AS error FROM documents")
def manifest_missing_files(spark, d):
    e = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("f"), "doc_id").alias("path"))
    return resume.checked(e, e.filter("id % 5 <> 0").select("path")).select("id", "path", "error")


@query("SELECT doc_id, sha256(text) AS source_hash FROM documents")
def source_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"))


@query("SELECT sha256(text) AS source_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return resume.duplicates(table(spark, d, "documents"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def hash_resume(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("path"), F.sha2("text", 256).alias("source_hash"))
    done = f.select("path", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("source_hash")).alias("source_hash"))
    return resume.changed(f, done).select("doc_id")


@query("SELECT doc_id AS key, CASE WHEN doc_id % 9 = 0 OR text = '' THEN 'error' ELSE 'done' END AS status, CASE WHEN doc_id % 9 = 0 OR text = '' THEN NULL ELSE substring(text, 1, 40) END AS text FROM documents")
def batch_response_join(spark, d):
    docs = table(spark, d, "documents")
    part = F.array(F.struct(F.nullif(F.substring("text", 1, 40), F.lit("")).alias("text")))
    line = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(part.alias("parts")).alias("content"))).alias("candidates")).alias("response")))
    from inkbasin.functions.jsonrepair import response_text

    answers = docs.filter("doc_id % 9 <> 0").select(F.col("doc_id").alias("key"), response_text(line).alias("text"))
    return resume.answered(docs.select(F.col("doc_id").alias("key")), answers).select("key", "status", "text")


@query("SELECT strftime(ts, '%Y-%m') AS month, round(sum(abs(value)) / 1000, 4) AS spent, count(*) AS calls, sum(abs(value)) / 1000 >= 0.8 * 50 AS alert, sum(abs(value)) / 1000 >= 50 AS over FROM events GROUP BY 1")
def monthly_spend(spark, d):
    log = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), (F.abs("value") / 1000).alias("cost"))
    return routing.monthly_spend(log, 50.0).withColumn("spent", F.round("spent", 4))


@query(f"{_TYPED}, t AS (SELECT {_TIER} AS tier FROM typed) SELECT CASE tier WHEN 1 THEN 'local' WHEN 2 THEN 'batch' ELSE 'sync' END AS route, count(*) AS count FROM t GROUP BY 1")
def batch_routes(spark, d):
    return routing.routes(routing.routed(_typed(spark, d)))


@query("WITH l AS (SELECT o_custkey AS id, o_orderstatus AS status, o_orderkey AS processed_at FROM orders) SELECT id, max(processed_at) AS processed_at, arg_max(status, processed_at) AS status FROM l GROUP BY id")
def latest_status(spark, d):
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("processed_at"))
    return resume.latest(log).select("id", "processed_at", "status")
