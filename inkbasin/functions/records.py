"""Defaults, overrides and predicates of extraction records, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbasin import rules
from inkbasin.functions import jsonrepair as J
from inkbasin.functions.arrays import strings

#: Defaults of an extraction's fields.
TEXT_DEFAULTS = {"title": "", "summary": "", "language": "en", "quality": "medium", "content_type": "document", "confidentiality": "internal"}
LIST_DEFAULTS = ["topics", "people", "products", "domains", "key_points"]
REPLY_DEFAULTS = {"summary": "", "language": "en", "quality": "medium", "transcript_excerpt": "", "source_type": "documentation", "layer": "learning", "confidentiality": "internal", "authority": "tribal"}
OUTCOMES = {"document": "document", "presentation": "slides", "spreadsheet": "spreadsheet", "video": "video", "audio": "audio", "note": "note", "transcript": "transcript", "pdf": "document"}


def filled(column: Column, default: str | None = None) -> Column:
    """Null for missing, empty or blank text, then the default."""
    there = F.nullif(F.trim(column), F.lit(""))
    return there if default is None else F.coalesce(there, F.lit(default))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Records with the default of every field that is missing or empty."""
    out = {c: filled(F.col(c), d) if c in rows.columns else F.lit(d) for c, d in TEXT_DEFAULTS.items()}
    out |= {c: F.coalesce(c, F.array().cast("array<string>")) if c in rows.columns else F.array().cast("array<string>") for c in LIST_DEFAULTS}
    return rows.withColumns(out)


def reply_fields(reply: Column, name: Column) -> dict[str, Column]:
    """The fields of an extraction from a model's reply (VARIANT), each with its default: where it is missing, null or empty.

    Lists of texts take objects by their name or title and role; slides without a number get their place.
    """
    text = lambda key, other=None: F.coalesce(J.field(reply, key), *([] if other is None else [F.lit(other)]))
    items = lambda key: F.coalesce(F.try_variant_get(reply, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
    out = {"title": F.coalesce(J.field(reply, "title"), name), "content_type": F.coalesce(J.field(reply, "content_type"), J.field(reply, "type"), F.lit("unknown"))}
    out |= {key: text(key, other) for key, other in REPLY_DEFAULTS.items()}
    out |= {key: strings(F.filter(items(key), lambda x: ~F.is_variant_null(x))) for key in LIST_DEFAULTS}
    out |= {key: text(key) for key in ("client", "project", "valid_to", "doc_type", "relationships")}
    points = F.try_variant_get(F.parse_json(F.to_json(out["key_points"])), "$", "array<variant>")
    facts = items("key_facts")
    return out | {
        "duration_min": F.try_variant_get(reply, "$.duration_min", "int"),
        "key_facts": F.when(F.size(facts) > 0, facts).otherwise(points),
        "entities_mentioned": items("entities_mentioned"),
        "slides": F.transform(items("slides"), _slide),
        "slide_summaries": F.transform(items("slide_summaries"), lambda s: F.struct(F.try_variant_get(s, "$.slide_number", "int").alias("slide_number"), J.field(s, "title").alias("title"), J.field(s, "content").alias("content"))),
    }


def _slide(s: Column, i: Column) -> Column:
    text = lambda key: F.coalesce(J.field(s, key), F.lit(""))
    whole = lambda key: F.nullif(F.try_variant_get(s, f"$.{key}", "int"), F.lit(0))
    facts = strings(F.coalesce(F.try_variant_get(s, "$.key_facts", "array<variant>"), F.array().cast("array<variant>")))
    fields = [F.coalesce(whole("slide_number"), i + 1).alias("slide_number"), F.coalesce(whole("frame_index"), F.lit(0)).alias("frame_index"), *(text(k).alias(k) for k in ("slide_title", "timestamp_approx", "speaker_insight", "so_what"))]
    return F.struct(*fields, J.field(s, "critical_notes").alias("critical_notes"), facts.alias("key_facts"))


def overridden(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Records (id) with the client and project of their manifest entry, where it has them."""
    own = entries.select("id", F.col("client").alias("_c"), F.col("project").alias("_p"))
    joined = rows.join(own, "id", "left")
    return joined.withColumns({"client": F.coalesce(filled(F.col("_c")), "client"), "project": F.coalesce(filled(F.col("_p")), "project")}).drop("_c", "_p")


def numbered_slides(slides: Column) -> Column:
    """Slides (number, title) with their place for a number that is missing or zero."""
    return F.transform(slides, lambda s, i: F.struct(F.coalesce(F.nullif(s["number"], F.lit(0)), i + 1).cast("int").alias("number"), F.coalesce(s["title"], F.lit("")).alias("title")))


def flagged(facts: Column) -> Column:
    """Facts (status, anomalies) that are not verified and have an anomaly."""
    return F.filter(facts, lambda f: f["status"].isin("flagged_mismatch", "unverified") & (F.size(F.coalesce(f["anomalies"], F.array().cast("array<string>"))) > 0))


def low_content(chars: Column) -> Column:
    return chars < 2000


def needs_compression(size: Column, threshold_mb: float = 50) -> Column:
    return size / (1 << 20) > threshold_mb


def has_freshness(path: Column, hash_: Column, mtime: Column) -> Column:
    return filled(path).isNotNull() & filled(hash_).isNotNull() & filled(mtime).isNotNull()


def populated(overlay: Column) -> Column:
    """Fields of a map of lists that hold something."""
    return F.size(F.map_filter(overlay, lambda _, v: v.isNotNull() & (F.size(v) > 0)))


def manifest_type(doc_type: Column) -> Column:
    out = F.lit("document")
    for name, kind in OUTCOMES.items():
        out = F.when(doc_type == name, kind).otherwise(out)
    return out


def compressed_path(path: Column, in_place: bool) -> Column:
    """Where the compressed copy of a recording goes: beside it with a suffix, or under the same name elsewhere."""
    return F.regexp_replace(path, r"(\.[^./]+)$", "_compressed$1") if in_place else path


def compression_totals(rows: DataFrame, *by: str) -> DataFrame:
    """rows (before, after): totals and the reduction in percent."""
    out = rows.groupBy(*by).agg(F.count("*").alias("files"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    return out.withColumn("reduction", F.bround((1 - F.col("after") / F.greatest(F.col("before"), F.lit(1))) * 100, 1))


def cover(slides: DataFrame) -> DataFrame:
    """The cover of a package: its first slide's picture, else its first frame. slides (package, kind, number, path)."""
    order = F.struct(F.when(F.col("kind") == "slide", 0).otherwise(1).alias("o"), "number", "path")
    return slides.groupBy("package").agg(F.min(order).alias("m")).select("package", F.col("m.path").alias("cover"))


def source_subdir(file_type: Column) -> Column:
    """The folder of a package that holds the sources of a type."""
    out = F.lit("notes")
    for kind, folder in rules.SOURCE_SUBDIRS.items():
        out = F.when(file_type == kind, folder).otherwise(out)
    return out


def freshness(path: Column, content: Column, modified: Column, now: Column) -> Column:
    """Where a record comes from, the hash of its source, and both times in ISO form; null for what is missing."""
    return F.struct(F.replace(path, F.lit("\\"), F.lit("/")).alias("source_path"), F.sha2(content, 256).alias("source_hash"), _iso(modified).alias("source_mtime"), _iso(now).alias("extracted_at"))


def _iso(time: Column) -> Column:
    """Microseconds only where there are any."""
    fraction = F.date_format(time, "SSSSSS")
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)))


def tagged(facts: Column, modality: str) -> Column:
    """Facts as texts, as records with their modality; null facts go."""
    return F.transform(F.filter(facts, lambda f: f.isNotNull()), lambda f: F.struct(f.alias("fact"), F.lit(modality).alias("source_modality")))


def retagged(facts: Column, modality: str) -> Column:
    """Facts as records, with their modality set; null facts go."""
    return F.transform(F.filter(facts, lambda f: f.isNotNull()), lambda f: f.withField("source_modality", F.lit(modality)))


def with_second_pass(rows: DataFrame, found: str) -> DataFrame:
    """Records (facts, key_facts) with the facts of a second pass at their end, not compared with the others; `found` goes."""
    more = F.filter(found, lambda f: f.isNotNull())
    none = F.array().cast("array<string>")
    some = F.coalesce(F.size(more) > 0, F.lit(False))
    facts = F.when(some, F.concat(F.coalesce("facts", F.slice(more, 1, 0)), more)).otherwise(F.col("facts"))
    keys = F.when(some, F.concat(F.coalesce("key_facts", none), F.transform(more, lambda f: f["fact"]))).otherwise(F.col("key_facts"))
    return rows.withColumns({"facts": facts, "key_facts": keys}).drop(found)


def latest_path(path: Column, modified: Column) -> Column:
    """Aggregate: the path changed last, the greatest of equal ones; files without a time come last."""
    return F.max(F.struct(modified.alias("modified"), path.alias("path")))["path"]
