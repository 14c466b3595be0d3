"""Queries on facts: numbers, verification, polarity, matching, deduplication, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbasin import rules
from inkbasin.functions import classify as C
from inkbasin.functions import numbers as N
from inkbasin.operators import facts as O
from inkbasin.operators import scores
from inkbasin.plans import sql as S
from inkbasin.plans.inputs import FACTS_SQL, facts, table
from inkbasin.plans.register import registry

QUERIES, ORACLE_SQL, query = registry()
AS_OF = 2026

_NUMS = f"WITH {FACTS_SQL}, n AS (SELECT *, {S.numbers('fact')} AS fn, {S.numbers('source_text')} AS sn FROM facts)"
_MATCHED = f"list_filter(fn, lambda a: len(list_filter(sn, lambda b: {S.near('a', 'b')})) > 0)"
_MISSING = f"list_filter(fn, lambda a: len(list_filter(sn, lambda b: {S.near('a', 'b')})) = 0)"
_HIGH = f"len(list_filter(regexp_extract_all(fact, '(\\d[\\d,]*\\.?\\d*)\\s*%', 1), lambda v: TRY_CAST(replace(v, ',', '') AS DOUBLE) > 100 AND NOT {S.has_any('lower(fact)', rules.GROWTH_WORDS)}))"
_LARGE = "list_filter(fn, lambda v: v >= 1000)"
_SPREAD = f"list_sum(list_transform({_LARGE}, lambda a: len(list_filter({_LARGE}, lambda b: b > a AND b / a > 400))))"
_FAR = f"len(list_filter(regexp_extract_all(fact, '\\b(20\\d{{2}})\\b', 1), lambda y: CAST(y AS INTEGER) > {AS_OF + 1}))"
_OFF = f"len(list_filter(missing, lambda a: list_min(list_transform(sn, lambda b: {S.ratio('a', 'b')})) > 100))"
_CHECKED = f"{_NUMS}, m AS (SELECT *, {_MATCHED} AS matched, {_MISSING} AS missing FROM n), odd AS (SELECT *, {_HIGH} AS high, coalesce({_SPREAD}, 0) AS spread, {_FAR} AS far, {_OFF} AS off FROM m), v AS (SELECT *, CAST(high + spread + far + off AS BIGINT) AS anomalies, CASE WHEN len(missing) = 0 THEN 'verified' WHEN high + spread + far + off > 0 THEN 'flagged_mismatch' ELSE 'unverified' END AS status FROM odd)"


def _checked(spark, d):
    return facts(spark, d).withColumn("v", O.validation(F.col("fact"), F.col("source_text"), AS_OF))


@query(f"{_NUMS} SELECT id, fn AS fact_numbers, sn AS source_numbers FROM n")
def extract_numbers(spark, d):
    return facts(spark, d).select("id", N.numbers(F.col("fact")).alias("fact_numbers"), N.numbers(F.col("source_text")).alias("source_numbers"))


@query("WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || '-' || (p_size + 3) || '%' WHEN 1 THEN '$' || p_size || '.5M' WHEN 2 THEN p_size || ',706 units' WHEN 3 THEN 'about ' || p_size || ' thousand' ELSE 'none' END AS x, p_size AS s FROM part) SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN s * 1.0 WHEN 1 THEN (s + 0.5) * 1e6 WHEN 2 THEN s * 1000.0 + 706 WHEN 3 THEN s * 1000.0 END::DOUBLE AS value FROM t")
def normalize_number(spark, d):
    p = table(spark, d, "part")
    s = F.col("p_size").cast("string")
    x = F.element_at(F.array(F.concat(s, F.lit("-"), (F.col("p_size") + 3).cast("string"), F.lit("%")), F.concat(F.lit("$"), s, F.lit(".5M")), F.concat(s, F.lit(",706 units")), F.concat(F.lit("about "), s, F.lit(" thousand")), F.lit("none")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", N.normalize_number(x).alias("value"))


@query(f"{_CHECKED} SELECT id, status, CAST(len(fn) AS INTEGER) AS numbers, matched, missing, anomalies FROM v")
def fact_verification(spark, d):
    v = _checked(spark, d)
    return v.select("id", "v.status", F.size("v.fact_numbers").alias("numbers"), "v.matched", "v.missing", F.size("v.anomalies").cast("long").alias("anomalies"))


@query(f"{_CHECKED} SELECT status, id % 6 AS kind, count(*) AS facts, sum(anomalies)::BIGINT AS anomalies FROM v GROUP BY 1, 2")
def fact_status_counts(spark, d):
    v = _checked(spark, d).select("v.status", (F.col("id") % 6).alias("kind"), F.size("v.anomalies").alias("n"))
    return v.groupBy("status", "kind").agg(F.count("*").alias("facts"), F.sum("n").alias("anomalies"))


@query(f"{_NUMS} SELECT id, round(list_min(list_transform(sn, lambda b: {S.ratio('fn[1]', 'b')})), 6) AS ratio FROM n WHERE len(fn) > 0")
def fact_magnitude(spark, d):
    out = facts(spark, d).filter(F.size(N.numbers(F.col("fact"))) > 0)
    return out.select("id", N.rounded(O.closest_ratio(F.col("fact"), F.col("source_text")), 6).alias("ratio"))


_OVER = f"list_transform(list_filter(list_transform(regexp_extract_all(fact, '(\\d[\\d,]*\\.?\\d*)\\s*%', 1), lambda v: TRY_CAST(replace(v, ',', '') AS DOUBLE)), lambda v: v > 100 AND NOT {S.has_any('lower(fact)', rules.GROWTH_WORDS)}), lambda v: 'Percentage over 100%: ' || CAST(v AS VARCHAR) || '%')"
_SPREADS = "flatten(list_transform(range(1, len(large) + 1), lambda i: list_transform(list_filter(range(i + 1, len(large) + 1), lambda j: large[j] / large[i] > 400), lambda j: 'Suspicious magnitude spread: ' || CAST(large[i] AS VARCHAR) || ' vs ' || CAST(large[j] AS VARCHAR) || ' (' || CAST(round_even(large[j] / large[i], 0) AS BIGINT) || 'x)')))"
_FUTURE = f"list_transform(list_filter(regexp_extract_all(fact, '\\b(20\\d{{2}})\\b', 1), lambda y: CAST(y AS INTEGER) > {AS_OF + 1}), lambda y: 'Future date: ' || y)"


@query(f"{_NUMS}, o AS (SELECT *, {_LARGE} AS large FROM n) SELECT id, list_concat({_OVER}, {_SPREADS}, {_FUTURE}) AS anomalies FROM o")
def fact_anomalies(spark, d):
    return facts(spark, d).select("id", C.anomalies(F.col("fact"), AS_OF).alias("anomalies"))


@query(f"WITH {FACTS_SQL} SELECT id, {S.POLARITY} AS polarity, {S.SENTIMENT} AS sentiment FROM facts")
def fact_polarity(spark, d):
    return facts(spark, d).select("id", C.polarity(F.col("fact")).alias("polarity"), C.keyword_polarity(F.col("fact")).alias("sentiment"))


_NOTE = f"WITH {FACTS_SQL}, p AS (SELECT customer, {S.SENTIMENT} AS s FROM facts), n AS (SELECT customer, count(*) FILTER (s = 'positive') AS pos, count(*) FILTER (s = 'negative') AS neg FROM p GROUP BY customer)"


@query(f"{_NOTE} SELECT customer, pos, neg, CASE WHEN pos > neg * 2 THEN 'positive' WHEN neg > pos * 2 THEN 'negative' WHEN pos > 0 AND neg > 0 THEN 'mixed' ELSE 'neutral' END AS polarity FROM n")
def note_polarity(spark, d):
    n = facts(spark, d).withColumn("s", C.keyword_polarity(F.col("fact"))).groupBy("customer").agg(F.count_if(F.col("s") == "positive").alias("pos"), F.count_if(F.col("s") == "negative").alias("neg"))
    return n.withColumn("polarity", C.dominant_polarity(F.col("pos"), F.col("neg")))


@query(f"{_CHECKED} SELECT id, CASE WHEN id % 5 > 0 THEN CAST(id % 5 AS INTEGER) END AS page, {S.POLARITY} AS polarity, CASE WHEN id % 10 = 0 THEN NULL ELSE status END AS verification_status FROM v")
def fact_enrichment(spark, d):
    f = facts(spark, d).withColumns({"source_text": F.when(F.col("id") % 10 != 0, F.col("source_text")), "source_date": F.lit("2026-01"), "reference": (F.col("id") % 5).cast("string"), "ext": F.lit(".pdf"), "max_pages": F.lit(10)})
    return O.enriched(f, AS_OF).select("id", F.col("locator.number").alias("page"), "polarity", "verification_status")


_PAIRS = f"WITH {FACTS_SQL}, a AS (SELECT *, {S.numbers('fact')} AS n, {S.FACT_WORDS.format(x='fact')} AS w, row_number() OVER (PARTITION BY customer ORDER BY id) AS rn FROM facts), p AS (SELECT x.id AS a_id, y.id AS b_id, {S.MEANINGFUL.format(n='x.n')} AS an, {S.MEANINGFUL.format(n='y.n')} AS bn, x.w AS aw, y.w AS bw FROM a x JOIN a y ON x.customer = y.customer AND x.rn + 1 = y.rn), s AS (SELECT *, len(list_filter(an, lambda u: len(list_filter(bn, lambda t: {S.near('u', 't')})) > 0)) > 0 AS same, CASE WHEN len(aw) > 0 AND len(bw) > 0 THEN len(list_intersect(aw, bw)) / least(len(aw), len(bw)) END AS overlap FROM p)"


@query(f"{_PAIRS} SELECT a_id, b_id, len(an) > 0 AND len(bn) > 0 AND same AND coalesce(overlap > 0.2, true) AS matches, coalesce(len(an) > 0 AND len(bn) > 0 AND overlap >= 0.3 AND NOT same, false) AS conflicts FROM s")
def fact_pairs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("customer").orderBy("id")
    p = facts(spark, d).select(F.lag("id").over(w).alias("a_id"), F.col("id").alias("b_id"), F.lag("fact").over(w).alias("a"), F.col("fact").alias("b")).filter("a_id is not null")
    return p.select("a_id", "b_id", O.facts_match(F.col("a"), F.col("b")).alias("matches"), O.facts_conflict(F.col("a"), F.col("b")).alias("conflicts"))


@query()
def fact_dedup_greedy(spark, d):
    f = facts(spark, d).select(F.col("customer").alias("session"), F.when(F.col("id") % 2 == 0, "pptx").otherwise("mp4").alias("modality"), F.col("id").alias("pos"), "fact")
    return O.deduplicated(f)


@query(f"WITH {FACTS_SQL}, r AS (SELECT customer, fact, row_number() OVER (PARTITION BY customer ORDER BY length(fact) DESC, id) AS rank FROM facts) SELECT customer, CAST(rank AS INTEGER) AS rank, fact FROM r WHERE rank <= 10")
def top_facts(spark, d):
    return O.top_facts(facts(spark, d).withColumn("pos", F.col("id")), "customer")


@query(f"WITH {FACTS_SQL} SELECT customer, count(*) AS n, CAST(round_even(avg(length(fact)), 0) AS BIGINT) AS avg_length, count(*) FILTER (length(fact) >= 30) AS specific, count(*) FILTER (length(fact) < 30) AS generic, round_even(count(*) FILTER (length(fact) >= 30) / count(*), 2) AS quality_ratio FROM facts GROUP BY customer")
def fact_quality(spark, d):
    return scores.fact_quality(facts(spark, d), "customer")


_SCORED = f"{_CHECKED}, c AS (SELECT customer, count(*) AS n, count(*) FILTER (length(fact) >= 30) AS specific, count(*) FILTER (status = 'verified') AS verified, sum(length(source_text)) AS chars FROM v GROUP BY customer)"


@query(f"{_SCORED} SELECT customer, CAST(least(100, least(30, specific * 2) + least(20, trunc(verified / n * 20)) + least(20, (customer % 7) * 4) + least(15, trunc(chars / 1000 * 3)) + least(15, (customer % 5) * 3)) AS INTEGER) AS score FROM c")
def quality_score(spark, d):
    v = _checked(spark, d)
    c = v.groupBy("customer").agg(F.count("*").alias("n"), F.count_if(F.length("fact") >= 30).alias("specific"), F.count_if(F.col("v.status") == "verified").alias("verified"), F.sum(F.length("source_text")).alias("chars"))
    return c.select("customer", scores.quality_score(F.col("specific"), F.col("n"), F.col("verified"), F.col("customer") % 7, F.col("chars"), F.col("customer") % 5).alias("score"))


_EVAL = "e AS (SELECT doc_id, source, length(text) AS chars, doc_id % 13 AS specific, doc_id % 3 > 0 AS has_overlay, doc_id % 6 AS populated, doc_id % 2 = 0 AS static, doc_id % 4 > 0 AS fresh, doc_id % 8 AS entities, doc_id % 11 AS topics, doc_id % 2 AS images, doc_id % 3 AS version, doc_id % 5 > 0 AS has_polarity, doc_id % 7 > 0 AS has_locator FROM documents), s AS (SELECT doc_id, source, CAST(least(100, least(20, specific * 2) + CASE WHEN has_overlay THEN 5 + CASE WHEN static THEN CASE WHEN populated >= 3 THEN 15 ELSE least(15, populated * 5) END ELSE least(15, populated * 3) END ELSE 0 END + CASE WHEN fresh THEN 10 ELSE 0 END + least(10, entities * 2) + least(8, topics) + CASE WHEN chars > 2000 THEN 10 WHEN chars > 1000 THEN 7 WHEN chars > 500 THEN 4 ELSE 0 END + CASE WHEN images > 0 THEN 10 ELSE 0 END + CASE WHEN version >= 2 THEN 7 ELSE 0 END + CASE WHEN has_polarity THEN 3 ELSE 0 END + CASE WHEN has_locator THEN 2 ELSE 0 END) AS INTEGER) AS score FROM e)"


def _evaluated(spark, d):
    i = F.col("doc_id")
    e = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("chars"), (i % 13).alias("specific"), (i % 3 > 0).alias("has_overlay"), (i % 6).alias("populated"), (i % 2 == 0).alias("static"), (i % 4 > 0).alias("fresh"), (i % 8).alias("entities"), (i % 11).alias("topics"), (i % 2).alias("images"), (i % 3).alias("version"), (i % 5 > 0).alias("has_polarity"), (i % 7 > 0).alias("has_locator"))
    return e.select("doc_id", "source", scores.evaluator_score(e).alias("score"))


@query(f"WITH {_EVAL} SELECT doc_id, score FROM s")
def eval_score(spark, d):
    return _evaluated(spark, d).select("doc_id", "score")


@query(f"WITH {_EVAL} SELECT source, CAST(round_even(avg(score), 0) AS INTEGER) AS score, count(*) AS files FROM s GROUP BY source")
def package_score(spark, d):
    return scores.package_score(_evaluated(spark, d), "source", "score")


@query(f"WITH {FACTS_SQL} SELECT customer, count(*) FILTER ({S.POLARITY} <> 'unknown') AS polarity_count, count(*) FILTER (id % 5 > 0) AS locator_count, bool_or(id % 3 = 0) AS has_source_date FROM facts GROUP BY customer")
def enrichment_counts(spark, d):
    f = facts(spark, d).select("customer", C.polarity(F.col("fact")).alias("polarity"), C.locator((F.col("id") % 5).cast("string"), F.lit(".pdf"), F.lit(0)).alias("locator"), F.when(F.col("id") % 3 == 0, "2026-01").alias("source_date"))
    return scores.enrichment_counts(f, "customer")


@query(f"SELECT o_orderkey, round_even(floor(o_totalprice) * 2 * CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 4.0 ELSE 1.0 END / 1000000, 6) AS blended FROM orders")
def blended_costs(spark, d):
    m = F.element_at(F.array(*map(F.lit, ("gemini-3-flash-preview", "gemini-3.1-flash-lite", "gemini-3.1-pro-preview", "another"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", N.blended_cost(m, F.floor("o_totalprice") * 2).alias("blended"))
