"""Queries on broken replies, quoted CSV, notes from layouts and overlays as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbasin.functions import csvtext, overlays
from inkbasin.functions import jsonrepair as J
from inkbasin.operators import notes
from inkbasin.plans.inputs import table
from inkbasin.plans.register import registry

QUERIES, ORACLE_SQL, query = registry()

#: Whole texts without quotes, brackets and backslashes, which would be part of the damage.
_PLAIN = "trim(translate(coalesce(text, ''), concat('\"{}[]:', chr(39), chr(92)), '        '))"
_DAMAGED = [
    "concat('{\"id\": ', doc_id, ', \"text\": \"x', t, 'x')",  # cut off in a text
    "concat('{id: ', doc_id, ', text: ', chr(39), 'x', t, 'x', chr(39), ', last: [a, b,],}')",  # bare keys and words, single quotes, commas too many
    "concat('Here you are: {\"id\": ', doc_id, ', \"text\": \"say \"x', t, 'x\" now\"} I hope it helps')",  # inner quotes, prose around it
    "concat('{\"id\": ', doc_id, ' \"text\": \"x', t, 'x\" \"list\": [1 2 3]}')",  # commas that are missing
    "concat('```json', chr(10), '{\"id\": ', doc_id, ', \"text\": \"x', t, 'x\", \"deep\": {\"list\": [1, {\"a\": 2')",  # open brackets
    "concat('{', chr(39), 'id', chr(39), ': ', doc_id, ', text: \"x', t, 'x\", yes: True, ', chr(39), 'none', chr(39), ': None, gone:}')",  # another language's spelling, a value that is missing
]
_DAMAGE = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {d}" for i, d in enumerate(_DAMAGED)) + " END"


@query(
    f"WITH t AS (SELECT doc_id, 'x' || {_PLAIN} || 'x' AS t, lang FROM documents) SELECT doc_id, doc_id AS id, sha256(CASE WHEN doc_id % 6 = 2 THEN 'say \"' || t || '\" now' ELSE t END) AS text_hash, "
    "CASE doc_id % 6 WHEN 1 THEN '[\"a\",\"b\"]' WHEN 3 THEN '[1,2,3]' END AS list, CASE WHEN doc_id % 6 = 4 THEN '{\"list\":[1,{\"a\":2}]}' END AS deep, CASE WHEN doc_id % 6 = 5 THEN true END AS yes FROM t"
)
def damaged_replies(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.expr(_PLAIN).alias("t"))
    v = t.select("doc_id", J.parsed(F.expr(_DAMAGE)).alias("v"))
    part = lambda p: F.to_json(F.try_variant_get("v", p, "variant"))
    return v.select("doc_id", F.try_variant_get("v", "$.id", "long").alias("id"), F.sha2(F.try_variant_get("v", "$.text", "string"), 256).alias("text_hash"), F.coalesce(part("$.list"), part("$.last")).alias("list"), part("$.deep").alias("deep"), F.try_variant_get("v", "$.yes", "boolean").alias("yes"))


_CSV = "concat('id,text,\"a \"\"q\"\"\"', chr(10), doc_id, ',\"', replace(coalesce(text, ''), '\"', '\"\"'), '\",', chr(13), chr(10), chr(10), ' ,,', chr(10), 'end,', coalesce(lang, ''), ',x\"y')"


@query("SELECT doc_id, sha256('id | text | a \"q\"' || chr(10) || doc_id || ' | ' || coalesce(text, '') || ' | ' || chr(10) || 'end | ' || coalesce(lang, '') || ' | x\"y') AS text_hash, CAST(5 AS INTEGER) AS row_count FROM documents")
def quoted_csv(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.expr(_CSV).alias("c"))
    return c.select("doc_id", F.sha2(csvtext.joined(F.col("c")), 256).alias("text_hash"), F.size(csvtext.records(F.col("c"))).alias("row_count"))


_Q = "replace(replace({x}, '\\', '\\\\'), '\"', '\\\"')"


@query(
    "WITH d AS (SELECT doc_id, text, coalesce(lang, 'xx') AS l, source, coalesce(source, 'none') AS s FROM documents) SELECT 'p/extract/2024-05-06_f' || doc_id || '_0000.md' AS path, sha256('---' || chr(10) || 'source: \"in/F' || doc_id || '.pdf\"' || chr(10) || 'type: \"note\"' || chr(10) || "
    f"'title: \"T \\\"' || {_Q.format(x='s')} || '\\\"\"' || chr(10) || 'date: 2024-05-06' || chr(10) || 'source_type: \"documentation\"' || chr(10) || 'layer: \"learning\"' || chr(10) || 'domains: []' || chr(10) || 'topics: [\"' || l || '\"]' || chr(10) || 'people: []' || chr(10) || 'products: []' || chr(10) || "
    "'confidentiality: \"internal\"' || chr(10) || 'authority: \"tribal\"' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'client: \"C' || doc_id || '\"' || chr(10) ELSE '' END || 'language: \"' || l || '\"' || chr(10) || 'quality: \"\"' || chr(10) || 'model: \"\"' || chr(10) || 'routing_reason: \"unknown\"' || chr(10) || 'prompt_version: \"standard_v1\"' || chr(10) || "
    "'tokens_used: 0' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'quality_score: ' || doc_id % 100 || chr(10) ELSE '' END || 'source_tool: \"knowledge-extractor\"' || chr(10) || 'schema_version: 2' || chr(10) || 'extraction_version: 1' || chr(10) || 'depth: \"standard\"' || chr(10) || "
    "'tags: [\"topic/' || l || '\"' || CASE WHEN doc_id % 2 = 0 THEN ', \"client/c' || doc_id || '\"' ELSE '' END || ']' || chr(10) || '---' || chr(10) || chr(10) || '# T \"' || s || '\"' || chr(10) || chr(10) || '**Links:** [[' || l || ']]' || chr(10) || chr(10) || '> Source: [Open original](file:///in/F' || doc_id || '.pdf)' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || "
    "CASE WHEN doc_id % 5 = 0 THEN '## Section 1: S' || doc_id || chr(10) || '*0:10*' || chr(10) || chr(10) || '![Section 1](../source/frames/slide_001.png)' || chr(10) || chr(10) || 'seen' || chr(10) || chr(10) || chr(10) || chr(10) || '**Key facts:**' || chr(10) || '- a' || chr(10) || '- b' || chr(10) || chr(10) || '---' || chr(10) ELSE '' END || chr(10) || chr(10) || "
    "CASE WHEN doc_id % 4 = 0 THEN '## Key Takeaways' || chr(10) || chr(10) || '- ' || l || chr(10) ELSE '' END || chr(10) || chr(10)) AS note_hash FROM d"
)
def extraction_notes(spark, d):
    i, docs = F.col("doc_id"), table(spark, d, "documents")
    slide = F.struct(F.lit(1).alias("slide_number"), F.lit(0).alias("frame_index"), F.concat(F.lit("S"), i).alias("slide_title"), F.lit("0:10").alias("timestamp_approx"), F.lit("seen").alias("speaker_insight"), F.lit("").alias("so_what"), F.lit(None).cast("string").alias("critical_notes"), F.array(F.lit("a"), F.lit("b")).alias("key_facts"))
    lang = F.coalesce("lang", F.lit("xx"))
    rows = docs.select(
        F.lit("p").alias("package"), F.concat(F.lit("in\\F"), i, F.lit(".pdf")).alias("path"), F.concat(F.lit('T "'), F.coalesce("source", F.lit("none")), F.lit('"')).alias("title"), F.col("text").alias("summary"), F.lit("note").alias("content_type"), F.array(lang).alias("topics"), lang.alias("language"),
        F.when(i % 2 == 0, F.concat(F.lit("C"), i)).alias("client"), F.when(i % 3 == 0, i % 100).cast("int").alias("quality_score"), F.when(i % 5 == 0, F.array(slide)).alias("slides"), F.when(i % 4 == 0, F.array(lang)).alias("key_points"),
    )
    made = notes.note_files(notes.complete(rows, F.lit("2024-05-06 07:08:09").cast("timestamp")))
    return made.select("path", F.sha2("value", 256).alias("note_hash"))


_OVERLAY = "concat('{\"action_items\":', CASE WHEN o_orderkey % 4 = 0 THEN '[]' WHEN o_orderkey % 4 = 1 THEN '[\"a\",\"b 1\"]' ELSE concat('[{\"action\":\"Call ', o_custkey, '\",\"owner\":\"', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, '\"},{\"action\":\"go\",\"done\":true}]') END, ',\"level\":', o_orderkey % 3, ',\"main_theme\":\"', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END, '\"}')"


@query(
    "WITH o AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '- **Action Items:** a, b 1' ELSE '- **Action Items:** action: Call ' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ', owner: ' || o_orderstatus END || chr(10) || '- **Action Items:** action: go, done: true' END AS items, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '- **Main Theme:** ' || o_orderpriority END AS theme, o_orderkey FROM orders) "
    "SELECT id, CASE WHEN items = '' AND theme = '' THEN 'No details available.' WHEN items = '' THEN theme WHEN theme = '' THEN items ELSE items || chr(10) || theme END AS lines, CAST(1 + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS INTEGER) AS populated FROM o"
)
def overlay_lines(spark, d):
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.parse_json(F.expr(_OVERLAY)).alias("v"))
    return v.select("id", overlays.rendered(F.col("v")).alias("lines"), overlays.populated(F.col("v")).alias("populated"))
