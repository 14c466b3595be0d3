"""Packages of notes as files: extraction notes, sidecars, indexes, meta files, syntheses, transcripts, from records.

Everything is a row (path, value) that sources/filewriter.py puts under its own name. Notes and sidecars need no
shuffle; an index groups the few short fields of a package's records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkbasin import layouts
from inkbasin.functions import jsonrepair as J
from inkbasin.functions.arrays import dedupe, tags
from inkbasin.functions.template import compiled
from inkbasin.functions.text import file_name, links_line, output_filename, slashes, stem
from inkbasin.operators.scores import record_quality
from inkbasin.sources import filewriter

#: Fields of a record with their types; what a record lacks is null, lists are empty.
FIELDS = {
    "package": "string", "path": "string", "name": "string", "title": "string", "summary": "string", "content_type": "string", "source_type": "string", "layer": "string", "confidentiality": "string", "authority": "string",
    "client": "string", "project": "string", "valid_to": "string", "language": "string", "quality": "string", "duration_min": "int", "model": "string", "routing_reason": "string", "prompt_version": "string", "tokens_used": "long", "quality_score": "int",
    "tag_validation_warnings": "int", "extraction_cost_usd": "double", "source_tool": "string", "extraction_version": "int", "depth": "string", "doc_type": "string", "transcript_excerpt": "string", "validation_result": "string", "source_date": "string", "slides_subdir": "string",
    "topics": "array<string>", "people": "array<string>", "products": "array<string>", "domains": "array<string>", "key_points": "array<string>", "key_facts": "array<variant>", "entities_mentioned": "array<variant>", "overlay": "variant",
    "slides": "array<struct<slide_number:int,frame_index:int,slide_title:string,timestamp_approx:string,speaker_insight:string,so_what:string,critical_notes:string,key_facts:array<string>>>", "slide_summaries": "array<struct<slide_number:int,title:string,content:string>>",
    "facts": "array<struct<fact:string,verification_status:string,anomalies:array<string>>>", "freshness": "struct<source_path:string,source_hash:string,source_mtime:string,extracted_at:string>", "raw": "variant",
}
_DEFAULTS = {"tokens_used": 0, "validation_result": "valid", "prompt_version": "standard_v1", "routing_reason": "unknown"}


def complete(records: DataFrame, now: Column) -> DataFrame:
    """Records with all FIELDS, what notes derive from them, and the name of their files (file). A score is counted where none is given."""
    out = {}
    for name, kind in FIELDS.items():
        c = F.col(name) if name in records.columns else F.lit(None).cast(kind)
        if kind.startswith("array"):
            c = F.coalesce(c, F.array().cast(kind))
        elif name in _DEFAULTS:
            c = F.coalesce(c, F.lit(_DEFAULTS[name]).cast(kind))
        out[name] = c
    rows = records.select(*(c for c in records.columns if c not in FIELDS), *(c.alias(n) for n, c in out.items()))
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")
    file = output_filename(file_name(F.col("path")), F.coalesce("freshness.extracted_at", stamp), F.coalesce("freshness.source_hash", F.lit("")))
    flagged = F.filter("facts", lambda f: f["verification_status"].isin("flagged_mismatch", "unverified") & (F.size(f["anomalies"]) > 0))
    if "quality_score" not in records.columns:
        rows = rows.withColumn("quality_score", record_quality(*(F.col(c) for c in ("key_facts", "facts", "overlay", "summary", "key_points", "entities_mentioned"))))
    return rows.withColumns({
        "source_file": slashes(F.col("path")), "date": F.substring(stamp, 1, 10), "now": stamp, "file": file, "flagged_facts": flagged, "links_line": links_line(F.col("topics"), F.col("products"), F.col("people")),
        "tags": tags(*(F.col(c) for c in ("products", "topics", "domains", "client", "doc_type", "source_type"))),
    })


def _in(package: Column, *parts: Column | str) -> Column:
    return F.concat(package, F.lit("/"), *(p if isinstance(p, Column) else F.lit(p) for p in parts)).alias("path")


def note_files(rows: DataFrame, layout: str = layouts.NOTE) -> DataFrame:
    """The note of each of rows (complete)."""
    return rows.select(_in(F.col("package"), "extract/", F.col("file"), ".md"), compiled(layout, rows).alias("value"))


def sidecar_files(rows: DataFrame, own_prompt: bool = False) -> DataFrame:
    """The JSON sidecar of each of rows (complete), nulls included.

    own_prompt: the replies to a user's own prompt are written as they came (`raw`), after source_file and processed_at.
    """
    if own_prompt:
        reply = F.coalesce(F.to_json("raw"), F.lit("{}"))
        head = F.to_json(F.struct("source_file", F.col("now").alias("processed_at")))
        # a reply's own field of these names comes last, as it does in the object
        value = F.when((reply == "{}") | ~J.is_object(F.col("raw")), head).otherwise(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substr(reply, F.lit(2))))
        return rows.select(_in(F.col("package"), "extract/", F.col("file"), ".json"), value.alias("value"))
    derived = {"schema_version": F.lit(2), "id": F.col("file"), "slides_count": F.size("slides"), "processed_at": F.col("now")}
    fields = F.struct(*(derived.get(k, F.col(k)).alias(k) for k in layouts.SIDECAR))
    return rows.select(_in(F.col("package"), "extract/", F.col("file"), ".json"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def transcript_files(transcripts: DataFrame, layout: str = layouts.TRANSCRIPT) -> DataFrame:
    """Notes of transcripts (package, source_path, title, text, status, duration_min, word_count, linked_extraction) that are complete and not empty."""
    there = transcripts.filter((F.col("status") == "complete") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return there.select(_in(F.col("package"), "extract/", stem(F.col("source_path")), "_transcript.md"), compiled(layout, there).alias("value"))


def _replies(packages: DataFrame, syntheses: DataFrame | None) -> DataFrame:
    """packages with what their synthesis (package, reply as VARIANT) says."""
    if syntheses is None:
        joined = packages.withColumn("reply", F.lit(None).cast("variant"))
    else:
        joined = packages.join(syntheses.select("package", "reply"), "package", "left")
    lists = {k: F.filter(F.try_variant_get("reply", f"$.{k}", "array<string>"), lambda x: x.isNotNull()) for k in ("key_takeaways", "all_people", "all_products", "action_items", "open_questions")}
    texts = {k: J.field(F.col("reply"), k) for k in ("executive_summary", "relationships")}
    return joined.withColumns({"available": J.is_object(F.col("reply")), "synthesis_title": J.field(F.col("reply"), "title"), **lists, **texts})


def package_texts(rows: DataFrame, syntheses: DataFrame | None = None, pictures: DataFrame | None = None, model: str = "", pipeline_version: str = "", prompt_hash: str = "", index: str = layouts.INDEX, meta: str = layouts.META, synthesis: str = layouts.SYNTHESIS) -> DataFrame:
    """Index, meta file and synthesis of each package of rows (complete; pos orders a package, then path; group names a
    group of files, the file's own name where there is none).

    syntheses: (package, reply as VARIANT); without one the first record's summary and points stand in. pictures:
    (package, kind slide or frame, name) of the package's source folder.
    """
    columns = rows.columns
    pos = F.col("pos") if "pos" in columns else F.lit(0)
    group = F.coalesce(F.col("group") if "group" in columns else F.lit(None).cast("string"), F.col("name"), F.col("file"))
    size = F.col("size") if "size" in columns else F.lit(None).cast("long")
    item = F.struct(pos.alias("pos"), F.col("source_file"), F.coalesce("name", "file").alias("name"), F.coalesce("content_type", F.lit("unknown")).alias("type"), group.alias("group"), size.alias("size"), "topics", "people", "products")
    first = F.min_by(F.struct("summary", "key_points"), F.struct(pos, F.col("source_file")))
    packages = rows.groupBy("package").agg(F.array_sort(F.collect_list(item)).alias("all"), first.alias("first"), F.max("date").alias("date"), F.max("now").alias("extracted_at"))
    union = lambda f: dedupe(F.flatten(F.transform("all", lambda x: x[f])), trim=False)
    named = lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))
    members = lambda g: F.filter("all", lambda x: x["group"] == g)
    groups = F.transform(F.array_distinct(F.transform("all", lambda x: x["group"])), lambda g: F.struct(g.alias("group_name"), named(F.get(members(g), F.lit(0))).alias("primary"), F.transform(F.slice(members(g), F.lit(2), F.size(members(g))), named).alias("related")))
    full = _replies(packages, syntheses).withColumns({
        "id": F.replace(F.lower("package"), F.lit(" "), F.lit("-")), "title": F.coalesce("synthesis_title", "package"), "types": F.array_sort(F.array_distinct(F.transform("all", lambda x: x["type"]))), "file_count": F.size("all"), "model": F.lit(model),
        **{f: F.slice(union(f), 1, 20) for f in ("topics", "people", "products")}, "groups": groups, "summary": F.coalesce("executive_summary", "first.summary"), "takeaways": F.slice(F.when(F.size("key_takeaways") > 0, F.col("key_takeaways")).otherwise(F.slice("first.key_points", 1, 5)), 1, 10),
        **{f"all_{f}": F.slice(dedupe(F.when(F.size(f"all_{f}") > 0, F.col(f"all_{f}")).otherwise(union(f)), trim=False), 1, 20) for f in ("people", "products")},
        "pipeline_version": F.lit(pipeline_version), "prompt_hash": F.lit(prompt_hash), "source_files": F.transform("all", lambda x: F.struct(x["source_file"].alias("path"), x["type"].alias("type"), x["size"].alias("size_bytes"))),
    })
    if pictures is None:
        full = full.withColumns({"cover_slide": F.lit(None).cast("string"), "cover_frame": F.lit(None).cast("string")})
    else:
        cover = pictures.groupBy("package").agg(F.max(F.when((F.col("kind") == "slide") & (F.col("name") == "slide_001.png"), "slides/slide_001.png")).alias("cover_slide"), F.min(F.when(F.col("kind") == "frame", F.concat(F.lit("frames/"), "name"))).alias("cover_frame"))
        full = full.join(cover, "package", "left").withColumn("cover_frame", F.when(F.col("cover_slide").isNull(), F.col("cover_frame")))
    said = full.withColumn("said", compiled(synthesis, full))
    said = said.withColumns({"executive_summary": F.col("summary"), "key_takeaways": F.col("takeaways")})
    made = {"index.md": compiled(index, said), "extract/_meta.yaml": compiled(meta, said), "extract/synthesis.md": F.col("said")}
    return said.select(F.explode(F.array(*(F.struct(_in(F.col("package"), name), value.alias("value")) for name, value in made.items()))).alias("f")).select("f.path", "f.value")


def package_files(records: DataFrame, now: Column | None = None, transcripts: DataFrame | None = None, own_prompt: bool = False, layout: str = layouts.NOTE, **options) -> DataFrame:
    """(path, value) of every file of the packages of records; options are those of package_texts."""
    rows = complete(records, F.current_timestamp() if now is None else now)
    parts = [note_files(rows, layout), sidecar_files(rows, own_prompt), package_texts(rows, **options)]
    if transcripts is not None:
        parts.append(transcript_files(transcripts))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def write_files(files: DataFrame, root: str, mode: str = "append", unit: int = 0, history: str = "") -> None:
    """files (path, value) below root; see sources/filewriter.py for unit and history."""
    filewriter.register(files.sparkSession)
    files.select(F.col("path").cast(T.StringType()), F.coalesce("value", F.lit("")).alias("value")).write.format("inkbasin_files").options(unit=unit, history=history).mode(mode).save(root)
