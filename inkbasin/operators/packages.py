"""Evaluation of packages of notes, and comparison of two extractions of one package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbasin.functions.text import extension, stem
from inkbasin.operators.scores import content_counts, evaluator_score, package_score

_FALSE = ["", "0", "0.0", "false", "[]", "{}"]


def _map(json: Column) -> Column:
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def _list(json: Column) -> Column:
    """Items of a JSON list as text, objects as JSON; a null or another value is an empty list."""
    return F.filter(F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())


def evaluated(notes: DataFrame, pictures: DataFrame) -> DataFrame:
    """notes (package, note, text, fields as VARIANT), pictures (package, kind slide, frame or image): a row for each note
    with its counts, flags, score from 0 to 100 and issues.

    Nothing but the counts of pictures is shuffled for it. Of several overlays the first by name counts; a fact that is
    an object is as long as its compact JSON. Enrichment counts where the first fact is an object.
    """
    c = F.col
    seen = pictures.groupBy("package").agg(*(F.count_if(c("kind") == k).alias(f"{k}s") for k in ("slide", "frame", "image")))
    m = notes.select("package", "note", content_counts(F.coalesce("text", F.lit(""))).alias("content"), _map(F.to_json("fields")).alias("m"))
    text = lambda key, other: F.coalesce(c("m")[key], F.lit(other))
    overlay_key = F.array_min(F.filter(F.map_keys("m"), lambda k: k.endswith("_overlay")))
    read = m.select(
        "package", "note", "content", "m", F.coalesce(c("m")["title"], stem(c("note"))).alias("title"), text("source", "").alias("source"), text("model", "unknown").alias("model"),
        F.coalesce(c("m")["extraction_version"].try_cast("double"), F.lit(1.0)).alias("version"), text("depth", "standard").alias("depth"), text("doc_type", "general").alias("doc_type"), text("type", "").alias("type"), text("quality", "unknown").alias("quality"),
        _list(c("m")["key_facts"]).alias("facts"), overlay_key.alias("overlay_key"), F.forall(F.array(*(text(k, "") for k in ("source_path", "source_hash", "extracted_at"))), lambda v: ~v.isin(_FALSE)).alias("fresh"),
        *(F.size(_list(c("m")[key])).alias(name) for key, name in (("entities_mentioned", "entities"), ("topics", "topics"), ("products", "products"), ("people", "people"))),
    ).withColumn("overlay", _map(F.element_at("m", c("overlay_key"))))
    of_object = F.coalesce(F.get("facts", F.lit(0)), F.lit("")).startswith("{")
    enriched = lambda key: F.when(of_object, F.size(F.filter("facts", lambda f: ~F.coalesce(F.get_json_object(f, f"$.{key}"), F.lit("")).isin("", "unknown" if key == "polarity" else "")))).otherwise(0)
    ext = F.lower(extension(c("source")))
    counted = read.join(seen, "package", "left").withColumns(
        {
            **{k: F.coalesce(k, F.lit(0)) for k in ("slides", "frames", "images")},
            "key_facts": F.size("facts"), "specific": F.size(F.filter("facts", lambda f: F.length(f) >= 30)),
            "polarity_count": enriched("polarity"), "locator_count": enriched("locator"),
            "has_overlay": c("overlay_key").isNotNull(), "overlay_type": F.replace("overlay_key", F.lit("_overlay"), F.lit("")),
            "overlay_fields": F.size("overlay"), "populated": F.size(F.map_filter("overlay", lambda _, v: v.isNotNull() & ~v.isin("", "[]"))),
            "static": ext.isin(".pdf", ".docx") | c("type").isin("document", "documentation"), "chars": c("content.total_chars"), "low_content": c("content.total_chars") < 2000,
        }
    )
    expected = F.when(c("slides") > 0, c("slides")).otherwise(c("content.images"))
    pictures_in = counted.withColumns({
        "generic": c("key_facts") - c("specific"), "has_polarity": c("polarity_count") > 0, "has_locator": c("locator_count") > 0,
        "slide_coverage": F.when(c("source").endswith(".pptx") & (expected > 0), F.bround(F.try_divide(c("content.sections"), expected), 2)),
    })
    points = evaluator_score(pictures_in).alias("score")
    visual = pictures_in.withColumn("_images", c("images")).withColumn("images", c("slides") + c("frames"))  # what the score takes as pictures
    scored = visual.select("*", points).withColumn("images", c("_images"))
    issue = lambda when, name: F.when(when, F.lit(name))
    issues = F.array_compact(F.array(
        issue(c("key_facts") == 0, "no facts"), issue(F.bround(F.try_divide("specific", "key_facts"), 2) < 0.5, "generic facts"), issue(c("low_content"), "low content"),
        issue((c("depth") == "deep") & ~c("has_overlay"), "deep without overlay"), issue(c("quality") == "fragment", "fragment"), issue(c("slide_coverage") < 0.5, "low slide coverage"),
    ))
    return scored.withColumn("issues", issues).drop("m", "overlay", "overlay_key", "facts", "_images", "type")


def package_scores(packages: DataFrame, files: DataFrame) -> DataFrame:
    """packages (package) with the rounded mean of their notes; one without notes scores 0 and says so."""
    out = packages.select("package").join(package_score(files, "package", "score"), "package", "left")
    return out.select("package", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("files", F.lit(0)).alias("files"), F.when(F.col("files").isNull(), "no notes").alias("issue"))


_COMPARED = ("score", "key_facts", "entities", "chars", "slides", "version")


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """Evaluated notes of two runs: every new note beside the old one of its package that it replaces, with the changes.

    That is the one whose source has the same stem (the last by note, if several), else the first with the same 30 first
    characters of the title, else the first of the package. Old notes are reduced to one a key before they are joined.
    """
    source, title = stem(F.col("source")), F.substring("title", 1, 30)
    one = F.struct("note", *_COMPARED, "has_overlay", "fresh")
    by_source = old.groupBy("package", source.alias("_stem")).agg(F.max_by(one, "note").alias("_s"))
    by_title = old.groupBy("package", title.alias("_title")).agg(F.min_by(one, "note").alias("_t"))
    first = old.groupBy("package").agg(F.min_by(one, "note").alias("_f"))
    keyed = new.withColumns({"_stem": source, "_title": title})
    both = keyed.join(by_source, ["package", "_stem"], "left").join(by_title, ["package", "_title"], "left").join(first, "package", "left")
    o = F.coalesce("_s", "_t", "_f")
    matched = F.when(F.col("_s").isNotNull(), "source").when(F.col("_t").isNotNull(), "title").when(F.col("_f").isNotNull(), "first")
    change = [f(x) for x in _COMPARED for f in (lambda x: o[x].alias(f"old_{x}"), lambda x: F.col(x).alias(f"new_{x}"), lambda x: (F.col(x) - o[x]).alias(f"{x}_change"))]
    flags = [f(x) for x in ("has_overlay", "fresh") for f in (lambda x: o[x].alias(f"old_{x}"), lambda x: F.col(x).alias(f"new_{x}"))]
    return both.select("package", "note", "title", o["note"].alias("old_note"), matched.alias("matched_by"), *change, *flags)


def package_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scores of packages of two runs (package, score) and the difference; null where a run lacks the package."""
    a, b = (t.select("package", F.col("score").alias(n)) for t, n in ((old, "old_score"), (new, "new_score")))
    return a.join(b, "package", "full_outer").withColumn("change", F.col("new_score") - F.col("old_score"))
