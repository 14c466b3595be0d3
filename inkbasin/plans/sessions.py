"""Queries on related files and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbasin.functions import jsonrepair as J
from inkbasin.operators import correlate
from inkbasin.plans import sql as S
from inkbasin.plans.inputs import FILES_SQL, NAME, files, table
from inkbasin.plans.register import registry

QUERIES, ORACLE_SQL, query = registry()
_ORDER = "CASE type WHEN 'video' THEN 0 WHEN 'audio' THEN 1 WHEN 'slides' THEN 2 WHEN 'document' THEN 3 ELSE 4 END"


@query(f"WITH {FILES_SQL}, t AS (SELECT path, trim(lower(regexp_replace({NAME}, '(?i)[_\\-\\s]*(slides|notes|transcript|audio|video|recording|deck|doc|docs)$', '')), '_- ') || '/' || (doc_id // 50) AS prefix, {S.FILE_TYPE} AS type FROM files), r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY {_ORDER}, path) AS n FROM t) SELECT prefix, min(path) FILTER (n = 1) AS \"primary\", coalesce(list(path ORDER BY path) FILTER (n > 1), []) AS related FROM r GROUP BY prefix")
def stem_prefix_groups(spark, d):
    from inkbasin.functions.classify import file_type

    f = files(spark, d).select("path", F.concat(F.expr(NAME)).alias("name"), file_type(F.col("path")).alias("type"), "doc_id")
    # files of one topic in one folder of fifty
    named = f.withColumn("name", F.concat(correlate.stem_prefix(F.col("name")), F.lit("/"), F.expr("doc_id div 50")))
    return correlate.file_groups(named.select("path", "name", "type"))


def _media(spark, d):
    ext = F.when(F.col("doc_id") % 2 == 0, ".pptx").otherwise(".mp4")
    name = F.concat(F.lit("Session "), F.expr("doc_id div 4"), F.when(F.col("doc_id") % 3 == 0, "_final").otherwise(""), ext)
    return table(spark, d, "documents").select("doc_id", F.expr("doc_id div 20").alias("folder"), F.concat(F.lit("f"), F.expr("doc_id div 20"), F.lit("/"), "doc_id", F.lit(" "), name).alias("path"))


@query()
def filename_similarity(spark, d):
    return correlate.session_candidates(_media(spark, d).select("folder", "path"))


@query()
def session_stage1(spark, d):
    return correlate.assigned(correlate.session_candidates(_media(spark, d).select("folder", "path")))


@query()
def standalone_files(spark, d):
    # every eighth file has a name of its own, so that some have no partner
    alone = F.concat(F.lit("f"), "folder", F.lit("/"), F.sha2(F.col("doc_id").cast("string"), 256), F.when(F.col("doc_id") % 2 == 0, ".pptx").otherwise(".mp4"))
    f = _media(spark, d).select("folder", F.when(F.col("doc_id") % 8 == 0, alone).otherwise(F.col("path")).alias("path"))
    return correlate.standalone(f, correlate.assigned(correlate.session_candidates(f)))


def _extractions(spark, d):
    """Every document as what was extracted from a file of _media: words as topics and facts, some nulls."""
    i, t = F.col("doc_id"), F.split(F.coalesce("text", F.lit("")), " ")
    facts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array_join(F.concat(F.slice(t, F.lit(1) + k * 6, F.lit(6)), F.array(((F.expr("doc_id div 4") % 5 + k) * 10).cast("string"))), " "))
    side = table(spark, d, "documents").select(
        "doc_id", F.sha2(i.cast("string"), 256).alias("hash"), F.when(i % 9 > 0, F.concat(F.lit("Session "), F.expr("doc_id div 8"))).alias("title"), (i % 6 * 2).alias("slides"),
        F.when(i % 7 > 0, F.array(F.lit("T"), F.concat(F.lit("t"), F.expr("doc_id div 6").cast("string")))).alias("topics"), F.array("source").alias("people"), F.when(i % 2 == 0, F.array("lang")).alias("products"),
        F.when(i % 10 > 0, F.to_variant_object(F.struct(F.array(F.col("lang"), F.lit("x")).alias("attendees"), F.when(i % 2 == 0, F.col("source")).alias("theme")))).alias("overlay"), F.when(i % 10 > 0, F.lit("training_overlay")).alias("overlay_type"), F.array(F.col("source"), F.upper("source")).alias("entities"), F.when(i % 11 > 0, facts).alias("facts"), F.lit(None).cast("string").alias("extracted_at"),
    )
    return _media(spark, d).join(side.filter(i % 10 < 9), "doc_id").drop("doc_id", "folder")


@query()
def session_records(spark, d):
    pairs = correlate.confirmed_pairs(_media(spark, d).select("folder", "path"), _extractions(spark, d))
    return correlate.sessions(pairs).withColumn("overlay", F.to_json("overlay"))


_P = "p AS (SELECT o_orderkey AS id, (o_orderkey % 40 + 55) / 100.0 AS similarity, CAST(o_orderkey % 40 + 55 AS INTEGER) AS stage1, o_orderkey % 25 AS ds, (o_orderkey * 7) % 25 AS vs, o_orderpriority AS dt, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus || ' talk' END AS vt, ['A', o_orderstatus, 'C'] AS dp, CASE WHEN o_orderkey % 2 = 0 THEN ['a', lower(o_orderstatus), 'c', 'd'] ELSE [] END AS vp FROM orders)"


@query(
    f"WITH {_P}, w AS (SELECT *, list_distinct({S.WORDS.format(x='lower(dt)')}) AS a, list_distinct({S.WORDS.format(x='lower(vt)')}) AS b, list_distinct(list_transform(dp, lambda x: lower(x))) AS tp, list_distinct(vp) AS tv FROM p), "
    "g AS (SELECT *, (CASE WHEN similarity > 0.65 THEN 1 ELSE 0 END + CASE WHEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) > 0.5 THEN 1 ELSE 0 END + CASE WHEN ds > 0 AND vs > 0 AND (abs(ds - vs) <= 3 OR abs(ds - vs) / greatest(ds, vs) <= 0.25) THEN 1 ELSE 0 END + CASE WHEN len(tv) > 0 AND len(list_intersect(tp, tv)) / (len(tp) + len(tv) - len(list_intersect(tp, tv))) > 0.6 THEN 1 ELSE 0 END) AS signals FROM w) "
    "SELECT id, CAST(signals AS INTEGER) AS signals, CASE WHEN signals >= 2 THEN 'merge' ELSE 'crosslink' END AS decision, (CASE WHEN signals >= 2 THEN least(100, trunc((stage1 + signals * 25) / 2)) ELSE stage1 * 0.5 END)::DOUBLE AS confidence FROM g"
)
def session_stage2(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    pairs = o.select(
        k.alias("id"), ((k % 40 + 55) / 100.0).alias("similarity"), (k % 40 + 55).cast("int").alias("stage1"), (k % 25).alias("deck_slides"), (k * 7 % 25).alias("video_slides"),
        F.col("o_orderpriority").alias("deck_title"), F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise(F.concat("o_orderstatus", F.lit(" talk"))).alias("video_title"),
        F.array(F.lit("A"), "o_orderstatus", F.lit("C")).alias("deck_topics"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lower("o_orderstatus"), F.lit("c"), F.lit("d"))).otherwise(F.array().cast("array<string>")).alias("video_topics"),
    )
    return correlate.confirmed(pairs).select("id", "signals", "decision", "confidence")


def _side(n: str, other: int) -> str:
    """What was extracted from one file of a pair, from an order: lists with ties by case and spaces, nulls and empty ones."""
    pick = lambda k: f"CASE (o_orderkey + {other}) % {k}"
    return (
        f"{pick(7)} WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('{n} ', o_orderpriority) END AS {n}_title, {pick(5)} WHEN 0 THEN NULL WHEN 1 THEN array() ELSE array(o_orderstatus, lower(o_orderstatus), concat(' ', o_orderpriority), concat('t', o_custkey % 3)) END AS {n}_topics, "
        f"{pick(3)} WHEN 0 THEN array(o_clerk, upper(o_clerk)) ELSE array(lower(o_clerk), '') END AS {n}_people, sha2(concat('{n}', o_orderkey % 50), 256) AS {n}_hash"
    )


_PAIRS = f"SELECT o_orderkey, {_side('deck', 0)}, {_side('video', 2)} FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, coalesce(o_orderpriority, '') AS o_clerk FROM orders)"
_JOIN = "list_concat(coalesce(deck_{x}, []), coalesce(video_{x}, []))"
_ONES = "list_filter({l}, lambda x, i: list_position(list_transform({l}, lambda x: lower(trim(x))), lower(trim(x))) = i) AS {x}"


@query(
    f"WITH p AS ({_PAIRS.replace('array(', 'list_value(').replace('sha2(', 'sha256(').replace(', 256)', ')')}) SELECT o_orderkey AS id, substring(replace('deck-' || o_orderkey || '-of-' || o_orderkey % 7, '_', '-'), 1, 50) AS session_id, sha256(least(deck_hash, video_hash) || '|' || greatest(deck_hash, video_hash)) AS session_hash, coalesce(nullif(deck_title, ''), video_title) AS title, "
    f"{_ONES.format(l=_JOIN.format(x='topics'), x='topics')}, {_ONES.format(l=_JOIN.format(x='people'), x='people')} FROM p"
)
def session_merge(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    k = F.col("o_orderkey")
    pairs = spark.sql(_PAIRS).withColumns({"deck": F.concat(F.lit("f/Deck_"), k, F.lit(" of_"), k % 7, F.lit(".pptx")), "video": F.concat(F.lit("f/v"), k, F.lit(".mp4"))})
    return correlate.merged_sessions(pairs.withColumnRenamed("o_orderkey", "id"), "id").select("id", "session_id", "session_hash", "title", "topics", "people")


@query("SELECT e.event_id, e.user_id, CASE WHEN e.event_id % 5 > 0 THEN 'frame_' || e.event_id END AS frame, e.event_id % 5 = 0 AS missing FROM events e")
def slide_frame_join(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("package"), F.col("event_id").alias("frame_index"))
    frames = e.filter("frame_index % 5 > 0").withColumn("path", F.concat(F.lit("frame_"), "frame_index"))
    out = correlate.slide_frames(e, frames)
    return out.select(F.col("frame_index").alias("event_id"), F.col("package").alias("user_id"), "frame", "missing")


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS number FROM conversations WHERE role = 'user'")
def renumber(spark, d):
    return correlate.renumbered(table(spark, d, "conversations").filter("role = 'user'"), "conv_id", "turn").select("conv_id", "turn", "number")


_REPLY = "CASE c_custkey % 5 WHEN 0 THEN '{\"title\": \"' || c_name || '\", \"summary\": \"s\"}' WHEN 1 THEN '```json\n{\"title\": \"' || c_name || '\", \"key_points\": [\"a\",],}\n```' WHEN 2 THEN 'Here it is: {\"title\": \"' || c_name || '\", \"summary\": \"s\"} Bye.' WHEN 3 THEN '[1, 2]' ELSE 'no object' END"


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN c_name END AS title, c_custkey % 5 < 3 AS valid FROM customer")
def llm_json_repair(spark, d):
    text = F.expr(_REPLY.replace("\n", "\\n").replace("||", "||"))
    v = table(spark, d, "customer").select("c_custkey", J.parsed(text).alias("v"))
    return v.select("c_custkey", F.when(J.is_object(F.col("v")), J.field(F.col("v"), "title")).alias("title"), F.coalesce(J.structure_valid(F.col("v")), F.lit(False)).alias("valid"))


@query()
def offline_extraction(spark, d):
    from inkbasin import providers

    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "text", F.lit("general").alias("doc_type"), F.lit("").alias("overlay_fields"))
    asked = providers.prompts(docs, "Extract from a {doc_type} document.").select("key", "prompt", F.lit("rules").alias("model"), F.lit(8192).alias("max_tokens"))
    replies = providers.call(asked)
    return replies.select("key", J.field(J.parsed(F.col("text")), "title").alias("title"), "tokens_in", "tokens_out", "error")


@query(
    "WITH f AS (SELECT l_orderkey AS package, l_linenumber AS pos, CASE WHEN l_linenumber % 3 > 0 THEN CAST((l_partkey % 4) AS VARCHAR) END AS ref, 'Fact ' || l_partkey AS fact FROM lineitem), s AS (SELECT o_orderkey AS package, unnest(range(4)) AS slide FROM orders WHERE o_orderkey % 9 > 0), "
    "g AS (SELECT package, ref, list(fact ORDER BY pos, fact) AS facts FROM f WHERE ref IS NOT NULL GROUP BY 1, 2) SELECT s.package, s.slide, coalesce(array_to_string(g.facts, '|'), '') AS slide_facts FROM s LEFT JOIN g ON g.package = s.package AND g.ref = CAST(s.slide AS VARCHAR)"
)
def slide_facts(spark, d):
    lines, i = table(spark, d, "lineitem"), F.col("l_linenumber")
    facts = lines.select(F.col("l_orderkey").alias("package"), i.alias("pos"), F.concat(F.lit("Fact "), "l_partkey").alias("fact"), F.when(i % 3 > 0, (F.col("l_partkey") % 4).cast("string")).alias("slide_ref"))
    slides = table(spark, d, "orders").filter("o_orderkey % 9 > 0").select(F.col("o_orderkey").alias("package"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("slide"))
    return correlate.slide_facts(slides, facts).withColumn("slide_facts", F.array_join("slide_facts", "|"))


_INPUT = "CASE WHEN doc_id % 11 < 2 THEN concat('few', doc_id // 22) ELSE concat('many', doc_id // 60) END"


@query(
    f"WITH {FILES_SQL}, t AS (SELECT {_INPUT} AS input, path, {NAME} AS name, {S.FILE_TYPE} AS type, CASE WHEN doc_id % 4 = 0 THEN 'Title ' || doc_id WHEN doc_id % 4 = 1 THEN '' END AS title FROM files), "
    "c AS (SELECT *, count(*) OVER (PARTITION BY input) <= 3 AS few, trim(lower(regexp_replace(name, '(?i)[_\\-\\s]*(slides|notes|transcript|audio|video|recording|deck|doc|docs)$', '')), '_- ') AS prefix FROM t), "
    f"r AS (SELECT *, row_number() OVER w AS place, first_value(nullif(title, '')) OVER w AS t1, first_value(name) OVER w AS n1 FROM c WINDOW w AS (PARTITION BY input, CASE WHEN few THEN '' ELSE prefix END ORDER BY {_ORDER}, path)) "
    "SELECT input, path, CASE WHEN NOT few THEN coalesce(t1, nullif(prefix, ''), n1) WHEN t1 IS NOT NULL THEN t1 ELSE array_to_string(list_transform(regexp_extract_all(n1, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '') END AS group, CAST(place AS INTEGER) AS place, CASE WHEN place = 1 THEN 'primary' ELSE 'related' END AS role FROM r"
)
def file_correlation(spark, d):
    from inkbasin.functions.classify import file_type

    i = F.col("doc_id")
    title = F.when(i % 4 == 0, F.concat(F.lit("Title "), i)).when(i % 4 == 1, "")
    f = files(spark, d).select(F.expr(_INPUT.replace("//", "div")).alias("input"), "path", F.expr(NAME).alias("name"), file_type(F.col("path")).alias("type"), title.alias("title"))
    return correlate.correlated(f).select("input", "path", "group", "place", "role")
