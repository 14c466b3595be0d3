"""Queries on what adapters return and what a package is put together from."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbasin.functions import media
from inkbasin.functions import records as R
from inkbasin.functions.classify import file_type
from inkbasin.operators import frames, taxonomy
from inkbasin.plans import sql as S
from inkbasin.plans.inputs import FACTS_SQL, FILES_SQL, facts, files, table
from inkbasin.plans.register import registry

QUERIES, ORACLE_SQL, query = registry()

_PROBE = """CASE WHEN o_orderkey % 5 = 0 THEN 'broken' ELSE concat('{"format": {"duration": "', o_orderkey, '.5"}, "streams": [{"codec_type": "audio", "codec_name": "aac"}',
 CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE concat(', {"codec_type": "video", "codec_name": "h264", "width": ', o_custkey % 3 * 640, ', "height": 480}') END, ']}') END"""
_VIDEO = "list_filter(CAST(json_extract(j, '$.streams') AS JSON[]), lambda s: json_extract_string(s, '$.codec_type') = 'video')[1]"


@query(
    f"WITH p AS (SELECT o_orderkey AS id, {_PROBE} AS j FROM orders), ok AS (SELECT id, TRY_CAST(json_extract_string(j, '$.format.duration') AS DOUBLE) AS d, {_VIDEO} AS v FROM p WHERE json_valid(j))"
    " SELECT p.id, CAST(round_even(d, 0) AS BIGINT) AS duration_seconds, json_extract_string(v, '$.codec_name') AS codec, CASE WHEN json_extract_string(v, '$.width') <> '0' THEN json_extract_string(v, '$.width') || 'x' || json_extract_string(v, '$.height') END AS resolution FROM p LEFT JOIN ok ON ok.id = p.id"
)
def video_probe(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), media.probe_metadata(F.expr(_PROBE)).alias("m")).select("id", "m.*")


@query(
    "WITH p AS (SELECT doc_id, '[PAGE 1]' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE 'short' END || chr(10) || chr(10) || '[PAGE 2]' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'end' END AS t, doc_id % 3 = 0 OR (doc_id % 2 = 0 AND text IS NULL) AS lost FROM documents)"
    " SELECT doc_id, sha256(t) AS text_hash, CAST(length(t) AS BIGINT) AS chars, CASE WHEN length(t) < 200 OR lost THEN 'partial' ELSE 'good' END AS quality FROM p"
)
def paged_texts(spark, d):
    i = F.col("doc_id")
    pages = F.array(F.when(i % 2 == 0, F.col("text")).otherwise("short"), F.when(i % 3 > 0, "end"))
    p = table(spark, d, "documents").select("doc_id", media.paged_text(pages).alias("p"))
    return p.select("doc_id", F.sha2("p.text", 256).alias("text_hash"), F.col("p.chars").cast("long").alias("chars"), "p.quality")


@query(f"WITH {FILES_SQL}, t AS (SELECT *, {S.FILE_TYPE} AS type FROM files) SELECT doc_id, 'source/' || CASE WHEN type IN ('video', 'audio') THEN 'video' WHEN type IN ('document', 'slides', 'spreadsheet') THEN 'docs' ELSE 'notes' END || '/' || name || ext AS target FROM t")
def source_targets(spark, d):
    return files(spark, d).select("doc_id", F.concat(F.lit("source/"), R.source_subdir(file_type(F.col("path"))), F.lit("/"), "name", "ext").alias("target"))


@query(
    "SELECT doc_id, 'C:/in/' || doc_id || '.txt' AS source_path, sha256(text) AS source_hash, strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%S') || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '.250000' END AS source_mtime, '2025-02-03T04:05:06' AS extracted_at FROM documents"
)
def freshness_fields(spark, d):
    modified = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 0.25 END)")
    path = F.concat(F.lit("C:\\in\\"), "doc_id", F.lit(".txt"))
    f = R.freshness(path, F.col("text"), modified, F.lit("2025-02-03 04:05:06").cast("timestamp_ntz"))
    return table(spark, d, "documents").select("doc_id", f.alias("f")).select("doc_id", "f.*")


@query(f"WITH {FACTS_SQL} SELECT id, fact, 'pptx' AS modality, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS facts, CASE WHEN id % 2 = 0 THEN [fact, source_text] ELSE [fact] END AS key_facts FROM facts")
def second_pass(spark, d):
    rows = facts(spark, d).select("id", "fact", R.tagged(F.array("fact"), "pptx").alias("facts"), F.array("fact").alias("key_facts"), F.when(F.col("id") % 2 == 0, R.tagged(F.array("source_text"), "text")).alias("more"))
    return R.with_second_pass(rows, "more").select("id", "fact", F.get("facts", F.lit(0))["source_modality"].alias("modality"), F.size("facts").cast("long").alias("facts"), "key_facts")


@query("SELECT user_id, arg_max('r' || event_id, (ts, 'r' || event_id)) AS path FROM events GROUP BY user_id")
def latest_reports(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(R.latest_path(F.concat(F.lit("r"), "event_id"), F.col("ts")).alias("path"))


@query("SELECT doc_id AS id, CAST(1 + CASE WHEN length(source) % 2 = 0 THEN 0 ELSE 1 END AS BIGINT) AS warnings FROM documents")
def tag_warnings(spark, d):
    docs = table(spark, d, "documents")
    tags = docs.select(F.col("doc_id").alias("id"), F.explode(F.array(F.concat(F.lit("topic/"), "source"), F.concat(F.lit("domain/"), "lang"), F.concat(F.lit("misc/"), "source"))).alias("tag"))
    known = docs.filter(F.length("source") % 2 == 0).select(F.lit("topic").alias("kind"), F.col("source").alias("value")).distinct()
    return taxonomy.warnings(taxonomy.validated(tags, known))


_PIXELS = "[CAST(event_id * 37 % 97 AS DOUBLE), CAST(event_id * 91 % 97 AS DOUBLE), CAST(event_id * 53 % 97 AS DOUBLE)]"
_SIMILAR = "1.0::DOUBLE - (abs(e.p[1] - k.last[1]) + abs(e.p[2] - k.last[2]) + abs(e.p[3] - k.last[3])) / 765.0::DOUBLE"


@query(
    f"WITH RECURSIVE e AS (SELECT user_id, event_id, {_PIXELS} AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), k AS (SELECT user_id, n, p AS last, [event_id] AS kept FROM e WHERE n = 1"
    f" UNION ALL SELECT e.user_id, e.n, CASE WHEN {_SIMILAR} < 0.85::DOUBLE THEN e.p ELSE k.last END, CASE WHEN {_SIMILAR} < 0.85::DOUBLE THEN list_append(k.kept, e.event_id) ELSE k.kept END FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1)"
    " SELECT user_id, arg_max(kept, n) AS kept FROM k GROUP BY user_id"
)
def frame_dedup_similarity(spark, d):
    pixels = F.array(*((F.col("event_id") * m % 97).cast("double") for m in (37, 91, 53)))
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", pixels.alias("pixels")))).alias("all"))  # the frames of one recording
    return e.select("user_id", F.transform(frames.kept_by_similarity(F.col("all")), lambda f: f["event_id"]).alias("kept"))
