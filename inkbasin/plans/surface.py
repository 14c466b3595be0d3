"""Queries through spark.sql's functions, by keyword index and by interval join."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbasin import rules
from inkbasin.functions import sqlsurface
from inkbasin.functions.numbers import rounded
from inkbasin.operators import alignment, keywords
from inkbasin.plans.inputs import FACT, NAME, PATH, table
from inkbasin.plans.register import registry

QUERIES, ORACLE_SQL, query = registry()

_PATTERN = rules.NUMBER.replace("(?i)", "").replace("'", "''")
_FACTOR = "CASE lower(s) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.SUFFIXES.items()) + " ELSE 1.0 END"


@query(
    f"WITH f AS (SELECT o_orderkey AS id, {FACT} AS fact FROM orders), n AS (SELECT id, regexp_extract_all(fact, '{_PATTERN}', 1, 'i') AS vs, regexp_extract_all(fact, '{_PATTERN}', 2, 'i') AS ss FROM f), "
    f"u AS (SELECT id, unnest(range(1, len(vs) + 1)) AS pos, unnest(vs) AS v, unnest(ss) AS s FROM n) SELECT id, CAST(pos AS INTEGER) AS pos, (TRY_CAST(replace(v, ',', '') AS DOUBLE) * {_FACTOR})::DOUBLE AS number FROM u"
)
def lateral_numbers(spark, d):
    sqlsurface.register(spark)
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql(f"SELECT f.id, n.pos, n.number FROM (SELECT o_orderkey AS id, {FACT} AS fact FROM orders) f, LATERAL ink_numbers(f.fact) n")


@query(
    f"WITH p AS (SELECT doc_id, {PATH} AS path, {NAME} AS name FROM documents) SELECT doc_id, regexp_extract(path, '[^/]*$') AS file, lower(regexp_extract(path, '\\.[^./]+$')) AS extension, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]+$', '\\1') AS stem, "
    "trim(lower(regexp_replace(name, '(?i)[_\\-\\s]*(slides|notes|transcript|audio|video|recording|deck|doc|docs)$', '')), '_- ') AS prefix, substring(sha256(path), 1, 12) AS prompt_hash FROM p"
)
def sql_functions(spark, d):
    sqlsurface.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("documents")
    return spark.sql(f"WITH p AS (SELECT doc_id, {PATH} AS path, {NAME} AS name FROM documents) SELECT doc_id, ink_file_name(path) AS file, ink_extension(path) AS extension, ink_stem(path) AS stem, ink_stem_prefix(name) AS prefix, ink_prompt_hash(path) AS prompt_hash FROM p")


#: Keywords of ten categories from the passages of benchmark: runs of one to three of their words.
_RULES = "SELECT concat('c', item_id % 10) AS category, array_join(slice(filter(split(lower(text), '[^\\\\p{L}\\\\p{N}]+'), x -> x <> ''), 3 + item_id % 4, 1 + item_id % 3), ' ') AS keyword FROM benchmark"
_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_PLAIN = "regexp_replace(coalesce(text, ''), '[&/''%-]', ' ', 'g')"


@query(
    f"WITH r AS (SELECT DISTINCT 'c' || item_id % 10 AS category, item_id % 10 AS place, array_to_string(w[3 + item_id % 4 : 2 + item_id % 4 + 1 + item_id % 3], ' ') AS k FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark)), "
    f"t AS (SELECT doc_id, ' ' || array_to_string({_TOKENS.replace('coalesce(text, ' + chr(39) * 2 + ')', _PLAIN)}, ' ') || ' ' AS t FROM documents), "
    "m AS (SELECT doc_id, category, min(place) AS place, count(*) AS n FROM t JOIN r ON r.k <> '' AND contains(t.t, ' ' || r.k || ' ') GROUP BY 1, 2), b AS (SELECT doc_id, arg_min(category, n * -1000 + place) AS category, max(n) AS n FROM m GROUP BY 1) "
    "SELECT doc_id, coalesce(category, 'general') AS category, CAST(coalesce(n, 0) AS BIGINT) AS matched FROM documents LEFT JOIN b USING (doc_id)"
)
def keyword_categories(spark, d):
    table(spark, d, "benchmark").createOrReplaceTempView("benchmark")
    texts = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[&/'%-]", " ").alias("text"))
    order = table(spark, d, "benchmark").select(F.expr("concat('c', item_id % 10)").alias("category"), (F.col("item_id") % 10).cast("int").alias("place")).distinct()
    return keywords.categorized(texts, spark.sql(_RULES), order, "doc_id")


_SLIDES = "event_id % 3 > 0"
_AT = "(epoch_us(ts) / 1e6)::DOUBLE"


@query(
    f"WITH s AS (SELECT user_id % 10 AS recording, event_id AS slide, {_AT} AS at, event_type, CAST(floor(value) AS BIGINT) % 4 AS k FROM events WHERE {_SLIDES}), f AS (SELECT user_id % 10 AS recording, event_id AS frame, {_AT} + event_id % 5 AS at, event_type, CAST(floor(value) AS BIGINT) % 3 AS k FROM events), "
    "p AS (SELECT s.recording, s.slide, s.at AS a, f.frame, f.at AS b, s.event_type AS st, f.event_type AS ft, s.k AS sk, f.k AS fk FROM s JOIN f ON s.recording = f.recording AND f.at >= s.at - 600 AND f.at <= s.at + 1200), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY recording, slide ORDER BY abs(a - b), frame) AS n FROM p), "
    "c AS (SELECT *, 0.5 * CASE WHEN st = ft AND sk = fk THEN 1.0 WHEN st = ft OR sk = fk THEN 1.0 / 3 ELSE 0.0 END + 0.3 * CASE WHEN st = ft THEN 1.0 ELSE 1.0 / 3 END + 0.2 * greatest(0, 1 - abs(a - b) / 900) AS score FROM r WHERE n <= 3), "
    "b AS (SELECT recording, slide, arg_max(frame, round(score, 9) * 1000 - n) AS frame, max(round(score, 6)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY recording, slide ORDER BY score DESC, n) AS best FROM c) WHERE best = 1 GROUP BY 1, 2) "
    "SELECT s.recording, s.slide, b.frame, b.score::DOUBLE AS score FROM s LEFT JOIN b ON b.recording = s.recording AND b.slide = s.slide"
)
def nearest_frames(spark, d):
    at = F.expr("cast(unix_micros(cast(ts as timestamp)) as double) / 1e6")
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("recording"), "event_id", at.alias("at"), "event_type", F.floor("value").alias("v"))
    side = lambda name, k: [F.col("event_id").alias(name), F.array(F.col("event_type"), (F.col("v") % k).cast("string")).alias("tags"), F.concat(F.col("event_type"), F.lit(" seen")).alias("text")]
    slides = e.filter(_SLIDES).select("recording", "at", *side("slide", 4))
    frames = e.select("recording", (F.col("at") + F.col("event_id") % 5).alias("at"), *side("frame", 3))
    found = alignment.nearest_frames(slides, frames, before=600, after=1200, divisor=900)
    return found.select("recording", "slide", "frame", rounded(F.col("score"), 6).alias("score"))
