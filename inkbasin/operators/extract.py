"""Extraction as one plan: routed texts, replies of a provider or the text itself, enriched facts, a package of notes.

Strategies are a column, not a loop: local rows never leave the JVM, the others go to a provider in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbasin import providers
from inkbasin.functions import jsonrepair as J
from inkbasin.functions.records import reply_fields, with_defaults
from inkbasin.functions.text import extension
from inkbasin.operators import notes
from inkbasin.operators.facts import enriched

def local(texts: DataFrame) -> DataFrame:
    """texts (path, name, type, text) as records without a call: the name as title, the first 2,000 characters as summary."""
    return texts.select("path", "name", F.col("name").alias("title"), F.substring("text", 1, 2000).alias("summary"), F.col("type").alias("content_type"), F.lit("en").alias("language"), F.lit("local").alias("quality"), F.lit(None).cast("string").alias("error"))


def asked(texts: DataFrame, template: str, model: str, provider: Callable | str = "rules", context: str = "") -> DataFrame:
    """texts (path, name, type, text, doc_type) as records from a provider's replies; one without a valid structure has an error."""
    keyed = texts.withColumns({"key": F.col("path"), "overlay_fields": F.lit("")})
    requests = providers.prompts(keyed, template, context=context).select("key", "prompt", F.lit(model).alias("model"), F.lit(8192).alias("max_tokens"))
    replies = providers.call(requests, provider).select(F.col("key").alias("path"), "error", J.parsed(F.col("text")).alias("v"))
    v = F.coalesce(F.try_variant_get("v", "$.base", "variant"), F.col("v"))
    error = F.coalesce("error", F.when(~F.coalesce(J.structure_valid(F.col("v")), F.lit(False)), "reply without a title and a summary"))
    joined = texts.select("path", "name", F.col("doc_type").alias("_type")).join(replies.withColumn("error", error), "path")
    fields = reply_fields(v, F.col("name")) | {"doc_type": F.coalesce(J.field(v, "doc_type"), "_type"), "overlay": J.overlay(F.col("v"), F.coalesce("_type", F.lit("general"))), "raw": F.col("v"), "model": F.lit(model)}
    return joined.select("path", "name", "error", *(c.alias(k) for k, c in fields.items()))


def extracted(texts: DataFrame, template: str, model: str, provider: Callable | str = "rules", context: str = "") -> DataFrame:
    """texts (path, name, type, text, doc_type, tier): tier 1 locally, the rest by the provider, with defaults filled."""
    both = asked(texts.filter("tier > 1"), template, model, provider, context).unionByName(local(texts.filter("tier = 1")), allowMissingColumns=True)
    return with_defaults(both)


def facts_of(records: DataFrame, texts: DataFrame, as_of_year: int, source_date: Column | None = None) -> DataFrame:
    """The facts of records checked against their text: path, pos, fact, locator, polarity, verification_status, anomalies.

    Facts that a reply (`raw`) gives as objects, with the page, slide or section they name, else the key points.
    """
    none = F.array().cast("array<variant>")
    given = F.coalesce(F.try_variant_get("raw", "$.facts", "array<variant>"), F.try_variant_get("raw", "$.base.facts", "array<variant>"), none) if "raw" in records.columns else none
    objects = F.transform(given, lambda f: F.struct(F.coalesce(J.field(f, "fact"), J.field(f, "text"), F.lit("")).alias("fact"), F.coalesce(J.field(f, "page"), J.field(f, "slide"), J.field(f, "section")).alias("reference")))
    points = F.transform("key_points", lambda p: F.struct(p.alias("fact"), F.lit(None).cast("string").alias("reference")))
    said = F.when(J.is_object(F.get(given, F.lit(0))), objects).otherwise(points)
    rows = records.select("path", F.posexplode(said).alias("pos", "f")).select("path", "pos", "f.fact", "f.reference").join(texts.select("path", F.col("text").alias("source_text")), "path")
    date = F.lit(None).cast("string") if source_date is None else source_date
    ready = rows.withColumns({"source_date": date, "ext": extension(F.col("path")), "max_pages": F.lit(0)})
    return enriched(ready, as_of_year).drop("source_text", "reference", "ext", "max_pages")


def package(records: DataFrame, facts: DataFrame | None, root: str, now: Column | None = None, history: str = "", unit: int = 2, **options) -> None:
    """Packages of records (package and an extraction's fields; operators/notes.py) as folders below root.

    facts: (path, fact, verification_status, anomalies), gathered to their record. Each package's `extract` folder is
    replaced as a whole when all files are written; with `history` the one before is kept in the package's .history. With
    unit 0 files are put beside those that are there.
    """
    if facts is not None:
        item = F.struct("pos", "fact", "verification_status", "anomalies")
        own = facts.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("_facts"))
        kept = F.transform("_facts", lambda f: F.struct(f["fact"].alias("fact"), f["verification_status"].alias("verification_status"), f["anomalies"].alias("anomalies")))
        records = records.drop("facts").join(own, "path", "left").withColumn("facts", kept).drop("_facts")
    notes.write_files(notes.package_files(records, now, **options), root, unit=unit, history=history)


def comparison_note(verdicts: DataFrame, by: str) -> DataFrame:
    """Verdicts of reports.verdict as text: by, text."""
    row = lambda title, c: F.concat(F.lit(f"| {title} | "), F.format_number(F.col(f"old_{c}"), 1), F.lit(" | "), F.format_number(F.col(f"new_{c}"), 1), F.lit(" |"))
    text = F.concat_ws("\n", F.concat(F.lit("# Comparison of "), F.col(by).cast("string")), F.lit(""), F.concat(F.lit("Verdict: "), "verdict"), F.lit(""), F.lit("| Metric | Old | New |"), F.lit("|---|---|---|"), row("Explanation length", "avg_length"), row("Junk slides", "junk"), row("General category, percent", "general_percent"))
    return verdicts.select(by, text.alias("text"))
