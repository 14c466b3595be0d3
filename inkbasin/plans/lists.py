"""Queries on lists, taxonomy, tags and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbasin import rules
from inkbasin.functions import arrays as A
from inkbasin.functions import overlays
from inkbasin.functions import text as T
from inkbasin.operators import taxonomy
from inkbasin.plans import sql as S
from inkbasin.plans.inputs import table
from inkbasin.plans.register import registry

QUERIES, ORACLE_SQL, query = registry()
_W = S.WORDS.format(x="lower(text)")


@query(f"WITH w AS (SELECT doc_id, source, lang, list_distinct({S.WORDS.format(x='lower(text)')}) AS w, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents) SELECT x.doc_id AS a, y.doc_id AS b, round(CASE WHEN len(x.w) = 0 AND len(y.w) = 0 THEN 1.0 ELSE len(list_intersect(x.w, y.w)) / greatest(len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)), 1) END, 6)::DOUBLE AS jaccard FROM w x JOIN w y ON x.source = y.source AND x.lang = y.lang AND x.rn + 1 = y.rn")
def word_jaccard(spark, d):
    from pyspark.sql import Window

    # a source may hold a third of all rows: only ids are sorted by it, the words come by their ids
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    docs = table(spark, d, "documents")
    pairs = docs.select(F.lag("doc_id").over(w).alias("a"), F.col("doc_id").alias("b")).filter("a is not null")
    said = docs.select("doc_id", F.array_distinct(T.words(F.lower("text"))).alias("w"))
    side = lambda n, name: said.select(F.col("doc_id").alias(n), F.col("w").alias(name))
    pairs = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return pairs.select("a", "b", F.round(A.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("WITH o AS (SELECT o_custkey AS id, list(o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'X ' END ORDER BY o_orderkey) AS l FROM orders GROUP BY 1) SELECT id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: trim(lower(y))), trim(lower(x))) = i) AS items FROM o")
def list_dedup(spark, d):
    o = table(spark, d, "orders")
    item = F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise("X "))
    lists = o.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("x")))).alias("l"))
    return lists.select("id", A.dedupe(F.transform("l", lambda s: s["x"])).alias("items"))


@query("WITH c AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Builders' WHEN 'MACHINERY' THEN 'Makers' ELSE c_mktsegment END AS a FROM customer) SELECT id, [a] AS products FROM c")
def product_alias(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), A.aliased(F.array("c_mktsegment", F.concat("c_mktsegment", F.lit(" "))), {"BUILDING": "Builders", "MACHINERY": "Makers"}).alias("p")).select("id", F.array_distinct(F.transform("p", lambda x: F.trim(x))).alias("products"))


@query("SELECT n_nationkey, list_concat(['product/' || lower(n_name), 'topic/' || lower(replace(r_name, ' ', '-')), 'domain/sales'], CASE WHEN n_nationkey % 2 = 0 THEN ['client/client-' || n_nationkey] ELSE [] END, ['type/product-doc']) AS tags FROM (SELECT n_nationkey, trim(regexp_replace(regexp_replace(replace(replace(n_name, '_', '-'), ' ', '-'), '[^A-Za-z0-9/-]', '', 'g'), '-+', '-', 'g'), '-') AS n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)")
def tags(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    client = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Client "), "n_nationkey"))
    return j.select("n_nationkey", A.tags(F.array("n_name", "n_name"), F.array("r_name"), F.array(F.lit("Sales")), client, F.lit("product_doc"), F.lit("")).alias("tags"))


@query("WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'topic/' || lower(c_mktsegment) WHEN 1 THEN 'topic/unheard' WHEN 2 THEN 'note/' || c_custkey ELSE 'client/c' || c_custkey END AS tag FROM customer) SELECT id, tag, id % 4 <> 2 AS valid, CASE id % 4 WHEN 0 THEN 'validated' WHEN 1 THEN 'unvalidated' WHEN 2 THEN 'unknown_prefix' ELSE 'validated' END AS reason FROM t")
def tag_validation(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    tag = F.when(k % 4 == 0, F.concat(F.lit("topic/"), F.lower("c_mktsegment"))).when(k % 4 == 1, "topic/unheard").when(k % 4 == 2, F.concat(F.lit("note/"), k)).otherwise(F.concat(F.lit("client/c"), k))
    known = c.select(F.lit("topic").alias("kind"), F.lower("c_mktsegment").alias("value")).distinct()
    return taxonomy.validated(c.select(k.alias("id"), tag.alias("tag")), known)


_TERMS = "terms AS (SELECT o_custkey AS id, 'topics' AS kind, o_orderkey AS pos, CASE o_orderkey % 3 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN o_orderpriority ELSE 'new ' || (o_orderkey % 5) END AS term FROM orders), known AS (SELECT DISTINCT o_orderpriority AS canonical, lower(o_orderpriority) AS a FROM orders), n AS (SELECT id, kind, pos, term, coalesce(canonical, term) AS canonical, canonical IS NULL AS unknown FROM terms LEFT JOIN known ON a = lower(trim(term)))"


def _terms(spark, d):
    o = table(spark, d, "orders")
    term = F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).otherwise(F.concat(F.lit("new "), F.col("o_orderkey") % 5))
    known = o.select(F.lit("topics").alias("kind"), F.lower("o_orderpriority").alias("alias"), F.col("o_orderpriority").alias("canonical")).distinct()
    return taxonomy.normalized(o.select(F.col("o_custkey").alias("id"), F.lit("topics").alias("kind"), F.col("o_orderkey").alias("pos"), term.alias("term")), known)


@query(f"WITH {_TERMS} SELECT id, pos, canonical, unknown, canonical <> term AS changed FROM n")
def taxonomy_normalize(spark, d):
    return _terms(spark, d).select("id", "pos", "canonical", "unknown", "changed")


@query(f"WITH {_TERMS}, f AS (SELECT id, kind, canonical, min(pos) AS pos FROM n GROUP BY ALL), l AS (SELECT id, kind, list(canonical ORDER BY pos) AS l FROM f GROUP BY id, kind) SELECT id, kind, l[1:8] AS terms FROM l")
def taxonomy_caps(spark, d):
    return taxonomy.lists(_terms(spark, d))


@query(
    f"WITH {_TERMS}, r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE c_name END AS title, CASE WHEN c_custkey % 11 > 0 THEN c_name END AS summary FROM customer), f AS (SELECT id, kind, canonical, min(pos) AS pos FROM n GROUP BY ALL), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY pos, canonical) AS place FROM f), c AS (SELECT id, kind, pos, 0 AS o, kind || ': ' || term || ' -> ' || canonical AS t FROM n WHERE canonical <> term UNION ALL SELECT id, kind, pos, 1, kind || ': ' || canonical || ' dropped' FROM g WHERE place > 8), "
    "l AS (SELECT id, string_agg(t, '; ' ORDER BY kind, pos, o, t) AS changes, max(o) AS dropped FROM c GROUP BY id), u AS (SELECT id, count(*) AS unknown FROM n WHERE unknown GROUP BY id) "
    "SELECT r.id, coalesce(l.changes, '') AS changes, coalesce(u.unknown, 0) AS unknown, CASE WHEN trim(title) = '' OR summary IS NULL THEN 'quarantine' WHEN coalesce(dropped, 0) = 1 OR u.unknown > 0 THEN 'warnings' ELSE 'valid' END AS result FROM r LEFT JOIN l ON l.id = r.id LEFT JOIN u ON u.id = r.id"
)
def taxonomy_outcomes(spark, d):
    i = F.col("c_custkey")
    records = table(spark, d, "customer").select(i.alias("id"), F.when(i % 6 == 0, " ").otherwise(F.col("c_name")).alias("title"), F.when(i % 11 > 0, F.col("c_name")).alias("summary"))
    return taxonomy.outcomes(records, _terms(spark, d)).select("id", F.array_join("changes", "; ").alias("changes"), "unknown", "result")


@query(f"WITH {_TERMS} SELECT DISTINCT kind, term FROM n WHERE unknown AND term <> 'new 1'")
def review_terms(spark, d):
    unknown = _terms(spark, d).filter("unknown").select("kind", "term")
    return taxonomy.unseen(unknown, spark.createDataFrame([("topics", "new 1")], "kind string, term string"))


@query("SELECT r_name AS kind, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def taxonomy_prompt(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return taxonomy.for_prompt(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("kind"), F.col("n_name").alias("canonical")))


#: Overlays of orders as JSON texts: null, empty, texts, objects and both in lists, ties by case and spaces.
_DECK = """CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '{}' WHEN 2 THEN '[1]' ELSE concat('{"action_items":[{"action":"Call ', o_custkey % 3, '","owner":"', o_orderstatus, '"},{"owner":"none"},"call ', o_orderkey % 4, ' "],"attendees":["Ann","ann ","Bo ', o_orderkey % 3, '"],"level":', o_orderkey % 2, ',"theme":"', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END, '"}') END"""
_VIDEO = """CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE concat('{"action_items":[{"action":"CALL ', o_custkey % 2, '"},{"action":"","decision":"call 1"},{"owner":"none"}],"attendees":[{"name":"ANN"},{"name":"Cy","role":"x"},null],"next_steps":', CASE WHEN o_orderkey % 2 = 0 THEN '[]' ELSE '["go"]' END, ',"theme":"T"}') END"""
_OBJECT = "CASE WHEN json_type({x}) = 'OBJECT' AND len(json_keys({x})) > 0 THEN {x} END"
_KEY = "lower(trim(CASE WHEN json_type(x) = 'OBJECT' THEN coalesce(" + ", ".join(f"nullif(x->>'$.{k}', '')" for k in rules.OVERLAY_KEYS) + ", CAST(x AS VARCHAR)) ELSE coalesce(x->>'$', 'null') END))"
_JOINED = "list_concat(coalesce(CAST(json_extract(a, '$.{f}') AS JSON[]), []), coalesce(CAST(json_extract(b, '$.{f}') AS JSON[]), []))"
_UNIQUE = f"list_filter({{l}}, lambda x, i: list_position(list_transform({{l}}, lambda x: {_KEY}), {_KEY}) = i)"


def _field(name: str) -> str:
    """The items of a list field of the merged overlay as a text; null where it has none."""
    union = _UNIQUE.format(l=_JOINED.format(f=name))
    one = lambda j: f"CAST(json_extract({j}, '$.{name}') AS JSON[])"
    items = f"CASE WHEN b IS NULL THEN {one('a')} WHEN a IS NULL THEN {one('b')} ELSE {union} END"
    return f"nullif(array_to_string(list_transform({items}, lambda x: coalesce(CAST(x AS VARCHAR), 'null')), ' '), '') AS {name}"


@query(
    f"WITH j AS (SELECT o_orderkey AS id, CAST({_DECK} AS JSON) AS d, CAST({_VIDEO} AS JSON) AS v FROM orders), o AS (SELECT id, {_OBJECT.format(x='d')} AS a, {_OBJECT.format(x='v')} AS b FROM j) "
    f"SELECT id, {_field('action_items')}, {_field('attendees')}, {_field('next_steps')}, CASE WHEN b IS NULL THEN a->>'$.theme' ELSE coalesce(nullif(a->>'$.theme', ''), b->>'$.theme') END AS theme, CASE WHEN b IS NULL THEN a->>'$.level' ELSE nullif(a->>'$.level', '0') END AS level FROM o"
)
def overlay_merge(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), overlays.merged(F.try_parse_json(F.expr(_DECK)), F.try_parse_json(F.expr(_VIDEO))).alias("m"))
    items = lambda k: F.nullif(F.array_join(F.transform(F.try_variant_get("m", f"$.{k}", "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null"))), " "), F.lit("")).alias(k)
    return m.select("id", items("action_items"), items("attendees"), items("next_steps"), *(F.try_variant_get("m", f"$.{k}", "string").alias(k) for k in ("theme", "level")))
