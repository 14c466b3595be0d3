"""Whole runs: a folder, a manifest or an existing package to notes as files, with status rows; comparison of report folders."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbasin.functions.classify import file_type
from inkbasin.functions.records import overridden
from inkbasin.functions.text import slashes, stem
from inkbasin.operators import extract, reports, resume, routing
from inkbasin.sources import files, sinks, work

PROMPT = "Extract title, summary and key points from a {doc_type} document."


def folder_texts(spark: SparkSession, path: str, force_tier: int | None = None) -> DataFrame:
    """Text files of a folder, routed: path, name, type, text, doc_type, tier, freshness."""
    whole = files.texts(spark, path).withColumn("type", file_type(F.col("path"))).filter("type in ('note', 'transcript', 'spreadsheet')")
    routed = routing.routed(whole, force=force_tier) if force_tier else routing.routed(whole)
    fresh = F.struct(slashes(F.col("path")).alias("source_path"), F.sha2("text", 256).alias("source_hash"), F.lit(None).cast("string").alias("source_mtime"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("extracted_at"))
    return routed.withColumns({"name": stem(F.col("path")), "doc_type": F.lit("general"), "freshness": fresh})


def records_of(texts: DataFrame, template: str = PROMPT, model: str = "rules", provider="rules", context: str = "", as_of_year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of texts (path, name, type, text, doc_type, tier, freshness), asked for once, and the facts of those without an error."""
    done = work.kept(extract.extracted(texts, template, model, provider, context).join(texts.select("path", "freshness", F.length("text").cast("long").alias("size")), "path"))
    return done, extract.facts_of(done.filter("error IS NULL"), texts, as_of_year or datetime.date.today().year)


def package_folder(spark: SparkSession, path: str, root: str, name: str, own_prompt: bool = False, force_tier: int | None = None, history: str = "", **options) -> DataFrame:
    """The package `name` below root from the texts of a folder; returns the files that failed (path, error).

    Nothing is written, and it is an error, where no file could be extracted; a package that is there stays as it is.
    """
    records, facts = records_of(folder_texts(spark, path, force_tier), **options)
    records = records.withColumns({"package": F.lit(name), "pos": F.lit(0)})
    good = records.filter("error IS NULL")
    if not good.take(1):
        raise RuntimeError(f"nothing was extracted from {path}")
    extract.package(good, facts, root, own_prompt=own_prompt, model=options.get("model", "rules"), history=history)
    return records.filter("error IS NOT NULL").select("path", "error")


def reextract(spark: SparkSession, package: str, **options) -> DataFrame:
    """Extract a package anew from its own `source` folder; the old `extract` goes to .history/{time}_{model}/extract.

    The package must have both folders. Where nothing could be extracted, it stays as it is.
    """
    at = files.root_path(spark, files.absolute(spark, package))
    for part in ("source", "extract"):
        files.root_path(spark, f"{at}/{part}")
    root, _, name = at.rpartition("/")
    stamp = f"{datetime.datetime.now(datetime.timezone.utc):%Y%m%d_%H%M%S}_{options.get('model', 'rules').replace('-', '_')}"
    return package_folder(spark, f"{at}/source", root, name, history=stamp, **options)


def run_manifest(spark: SparkSession, manifest: str, root: str, status: str, out: str | None = None, force: bool = False, **options) -> DataFrame:
    """Extract the entries of a manifest that are not done: notes below its output_dir (or out), a status row each.

    A missing file, or one that can't be extracted, is an error of its entry; the entries of a project are a package.
    Returns the latest status of the manifest's entries.
    """
    entries = files.manifest(spark, manifest)
    base = files.root_path(spark, files.absolute(spark, root))
    todo = resume.pending(entries, resume.latest(files.status(spark, status)), force).withColumn("path", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(base + "/"), "path")))
    todo = resume.checked(todo, files.listing(spark, root))
    wanted = todo.filter("error IS NULL").select("path", "id", F.col("doc_type").alias("_type"), "name", "client", "project", "user_context")
    texts = folder_texts(spark, root).drop("name", "doc_type").join(wanted, "path").withColumnRenamed("_type", "doc_type")
    records, facts = records_of(texts, **options)
    records = overridden(records.join(wanted.select("path", "id"), "path").withColumns({c: F.col(c) if c in records.columns else F.lit(None).cast("string") for c in ("client", "project")}), todo)
    records = records.withColumns({"package": F.coalesce("project", F.lit("unknown")), "pos": F.lit(0)})
    target = out or entries.select("output_dir").first()["output_dir"]
    good = records.filter("error IS NULL")
    if good.take(1):
        # entry by entry: notes of earlier runs stay, indexes cover the entries of this run
        extract.package(good, facts, files.absolute(spark, target), unit=0, model=options.get("model", "rules"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    outcome = todo.select("id", "path", F.col("error").alias("_missing")).join(records.select("id", "error", F.lit(True).alias("_read")), "id", "left").join(texts.select("path", "tier"), "path", "left")
    error = F.coalesce("_missing", "error", F.when(F.col("_read").isNull(), "no text that can be read"))
    rows = outcome.select("id", F.when(error.isNull(), "done").otherwise("error").alias("status"), error.alias("error"), F.col("tier").cast("int").alias("tier"), now.alias("processed_at"), F.lit(None).cast("string").alias("skipped_reason"), F.lit(False).alias("batch"))
    sinks.write_status(rows, status)
    return resume.latest(files.status(spark, status)).join(entries.select("id"), "id", "left_semi")


def report_metrics(slides: DataFrame, lines: DataFrame) -> DataFrame:
    """avg_length, junk, general_percent of each report of files.report_folders: what verdicts compare."""
    said = reports.explanation_check(slides.withColumn("explanation", F.coalesce("explanation", F.lit(""))), "report").select("report", "avg_length", "total")
    junk = reports.junk_check(slides, "report").select("report", "junk")
    general = reports.category_balance(lines).select("report", "general")
    both = said.join(junk, "report").join(general, "report", "left")
    return both.select("report", "avg_length", F.col("junk").cast("int").alias("junk"), (100.0 * F.coalesce("general", F.lit(0)) / F.greatest("total", F.lit(1))).alias("general_percent"))


def compare_reports(spark: SparkSession, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Two folders of reports: reports.comparison of all, and the verdict on those that both runs have."""
    a, b = files.report_folders(spark, old), files.report_folders(spark, new)
    shown = reports.comparison(a.slides, b.slides, a.counts, b.counts)
    return shown, reports.verdict(report_metrics(a.slides, a.lines), report_metrics(b.slides, b.lines), "report")
