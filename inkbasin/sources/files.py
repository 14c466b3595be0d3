"""Files as tables: listings, text, CSV rows, manifests, notes, reports, logs."""

from __future__ import annotations

import os
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkbasin import rules
from inkbasin.functions import csvtext, jsonrepair
from inkbasin.functions.classify import scan_tier, text_quality
from inkbasin.functions.text import extension, file_name, frontmatter, pdf_month
from inkbasin.sources import tree

HASH_LIMIT = 500 << 20
#: Records of a CSV file that are shown: the header and three more.
HEAD_RECORDS = 4
MANIFEST = ("schema_version int, project string, output_dir string, config map<string,string>, files array<struct<id string, path string, doc_type string, name string, client string, project string, user_context string>>")


def absolute(spark: SparkSession, path: str) -> str:
    """A relative path by the driver's working folder, where files are local by default; others as they are."""
    if "://" in path or path.startswith(("/", "file:")):
        return path
    default = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration())
    return os.path.abspath(path) if default.getScheme() == "file" else path


def root_path(spark: SparkSession, root: str) -> str:
    """The absolute path of a folder, without scheme; no folder there is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise ValueError(f"not a folder: {root}")
    return fs.makeQualified(path).toUri().getPath().rstrip("/")


def plain_path(uri: Column, encoded: bool = False) -> Column:
    """The path of a URI; encoded: as `_metadata.file_path` has it, with %20 for a space."""
    path = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path


def below(root: str, path: Column) -> Column:
    """What a path (plain_path) has after the root (root_path)."""
    return F.substr(path, F.lit(len(root) + 2))


def listing(spark: SparkSession, path: str, recursive: bool = True, content: bool = False, exclude: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """path, relative, size, modified (and content) of the files of a folder, empty ones included (sources/tree.py).

    Hidden and excluded names are left out, with all below them. ordered: by path. A missing folder is an error.
    """
    path = absolute(spark, path)
    root_path(spark, path)
    tree.register(spark)
    options = {"path": path, "recursive": str(recursive).lower(), "content": str(content).lower(), "exclude": ",".join(exclude), "content_limit": HASH_LIMIT}
    found = spark.read.format("inkbasin_tree").options(**options).load()
    return found.orderBy("path") if ordered else found


def without_target(files: DataFrame, targets: DataFrame, target: Column) -> DataFrame:
    """The files whose target path is not among those of targets (path)."""
    return files.withColumn("_target", target).join(targets.select(F.col("path").alias("_target")), "_target", "left_anti").drop("_target")


def recordings(spark: SparkSession, path: str, extensions: tuple[str, ...] = tuple(rules.SESSION_VIDEO)) -> DataFrame:
    """The recordings directly in a folder, by path; the extension is tested while listing."""
    return listing(spark, path, recursive=False).filter(F.col("extension").isin(*extensions)).orderBy("path")


def scanned(spark: SparkSession, path: str, recursive: bool = True, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row a file: hash (up to 500 MiB), text measures of text files, tier. Unreadable bytes become a row's error."""
    files = listing(spark, path, recursive, content=True, exclude=exclude)
    small = F.col("size") <= HASH_LIMIT
    text = F.when(extension(F.col("path")).isin(".txt", ".md", ".markdown", ".rst", ".log", ".srt", ".vtt") & small, F.try_validate_utf8(F.col("content").cast("string")))
    out = files.withColumn("text", text).withColumns({
        "filename": file_name(F.col("path")), "extension": extension(F.col("path")),
        "file_hash": F.when(small, F.concat(F.lit("sha256:"), F.sha2("content", 256))),
        "text_chars": F.length("text"), "preview": F.substring("text", 1, 2000), "line_count": F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1,
        "error": F.when(text.isNull() & extension(F.col("path")).isin(".txt", ".md"), "not valid UTF-8"),
    })
    return out.withColumn("tier", scan_tier(F.col("path"), F.col("text_chars"))).drop("content", "text")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """path, relative, text of the files below a folder that Spark shows (no empty ones), or of one file."""
    path = absolute(spark, path)
    found = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(plain_path(F.col("_metadata.file_path"), encoded=True).alias("path"), F.col("value").alias("text"))
    try:
        root = root_path(spark, path)
    except ValueError:
        return found.withColumn("relative", file_name(F.col("path")))
    return found.withColumn("relative", below(root, F.col("path")))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text, chars and quality of text files; CSV records as cells joined by ` | `, without blank ones."""
    files = _whole(spark, path).select("path", "text")
    text = F.when(extension(F.col("path")) == ".csv", csvtext.joined(F.col("text"))).otherwise(F.col("text"))
    return files.withColumn("text", text).withColumn("chars", F.length("text")).withColumn("quality", text_quality(F.col("chars"), F.lit(0)))


def _borders(batches):
    """Of each piece of a file: lines, how many of them end a record if the piece begins outside (a) or inside (b) a
    quoted cell, whether it changes sides, and the first records where the file begins."""
    piece, out = None, None
    for batch in batches:
        names, starts, lines = batch.column("file").to_pylist(), batch.column("start").to_pylist(), batch.column("line")
        quotes = pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False)
        at = 0
        for k in range(len(names)):
            if (names[k], starts[k]) != piece:
                if out:
                    yield pa.RecordBatch.from_pylist([out])
                piece, at = (names[k], starts[k]), 0
                out = {"file": names[k], "start": starts[k], "a": 0, "b": 0, "turned": False, "head": "" if starts[k] == 0 else None}
            out["turned"] ^= bool(quotes[k] % 2)
            if out["head"] is not None and out["a"] < HEAD_RECORDS:
                out["head"] += lines[k].as_py().decode("utf-8", "replace") + "\n"
            out["b" if out["turned"] else "a"] += 1
    if out:
        yield pa.RecordBatch.from_pylist([out])


def csv_metadata(spark: SparkSession, path: str) -> DataFrame:
    """file, row_count (header and blank records included), headers and sample_rows (records 2 to 4) of CSV files.

    A large file is read in pieces: a line ends a record where the quotes up to it are even in number, and whether a
    piece begins inside a cell follows from the pieces before it, a row each. Nothing but these rows is shuffled.
    """
    lines = spark.read.text(path).select(plain_path(F.col("_metadata.file_path"), encoded=True).alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    pieces = lines.mapInArrow(_borders, "file string, start long, a long, b long, turned boolean, head string")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("turned").cast("int")).over(before), F.lit(0)) % 2 == 1
    counted = pieces.select("file", "head", F.when(inside, F.col("b")).otherwise(F.col("a")).alias("n"), (inside != F.col("turned")).alias("open"), (F.lead("start").over(Window.partitionBy("file").orderBy("start")).isNull()).alias("last"))
    # a quote that is never closed makes the rest of the file one more record
    rows = counted.groupBy("file").agg((F.sum("n") + F.sum((F.col("last") & F.col("open")).cast("int"))).alias("row_count"), F.max("head").alias("head"))
    first = F.slice(csvtext.records(F.col("head")), 1, HEAD_RECORDS)
    return rows.select("file", "row_count", F.get(first, F.lit(0)).alias("headers"), F.slice(first, 2, HEAD_RECORDS - 1).alias("sample_rows"))


def sections(lines: DataFrame, by: str, order: str, heading: str) -> DataFrame:
    """lines (by, order, line, heading boolean) as numbered sections with their text."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.col(heading).cast("int")).over(w)
    numbered = lines.withColumn("section", n)
    return numbered.groupBy(by, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest with defaults; another version than 1 is an error."""
    read = spark.read.schema(MANIFEST).json(path, multiLine=True)
    version = F.when(F.col("schema_version") == 1, F.col("schema_version")).otherwise(F.raise_error(F.concat(F.lit("manifest version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("missing")))))
    rows = read.select(version.alias("schema_version"), F.col("project").alias("default_project"), "output_dir", F.explode("files").alias("f"))
    f = F.col("f")
    return rows.select("schema_version", "output_dir", f["id"].alias("id"), f["path"].alias("path"), F.coalesce(f["doc_type"], F.lit("document")).alias("doc_type"), F.coalesce(f["name"], f["id"]).alias("name"), f["client"].alias("client"), F.coalesce(f["project"], F.col("default_project")).alias("project"), F.coalesce(f["user_context"], F.lit("")).alias("user_context"))


def status(spark: SparkSession, path: str) -> DataFrame:
    """The status log, empty where there is none yet."""
    schema = "id string, status string, error string, tier int, processed_at string, skipped_reason string, batch boolean"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes of packages without index, synthesis, transcripts and session notes: path, frontmatter block, text."""
    files = _whole(spark, path)
    name = file_name(F.col("path"))
    kept = files.filter(name.endswith(".md") & ~name.rlike(r"^(index|synthesis)\.md$|_transcript\.md$|^session_"))
    return kept.withColumn("frontmatter", frontmatter(F.col("text")))


def yaml_values(notes_: DataFrame) -> DataFrame:
    """The frontmatter of notes as VARIANT; a bad or missing block is an empty object."""
    @F.pandas_udf(T.StringType())
    def as_json(blocks: pd.Series) -> pd.Series:
        import json

        import yaml

        def one(block):
            try:
                value = yaml.safe_load(block or "")
                return json.dumps(value if isinstance(value, dict) else {}, default=str, ensure_ascii=False)
            except yaml.YAMLError:
                return "{}"

        return blocks.map(one)

    return notes_.withColumn("fields", F.parse_json(as_json("frontmatter")))


def package_notes(spark: SparkSession, root: str) -> DataFrame:
    """Notes under a folder of packages, with the package (the first folder below root) and the fields of the frontmatter."""
    named = notes(spark, root).filter(F.contains("relative", F.lit("/"))).withColumns({"package": F.substring_index("relative", "/", 1), "note": file_name(F.col("path"))})
    return yaml_values(named).select("package", "note", "text", "fields")


def package_pictures(spark: SparkSession, root: str) -> DataFrame:
    """PNG files in the source folders of packages: package, kind (slide, frame, image). File contents are not read."""
    root = absolute(spark, root)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(root).select(below(root_path(spark, root), plain_path(F.col("path"))).alias("path"))
    kind = F.regexp_extract("path", r"^[^/]+/source/(slide|frame|image)s/[^/]+$", 1)
    return found.select(F.substring_index("path", "/", 1).alias("package"), kind.alias("kind"), file_name(F.col("path")).alias("name")).filter("kind <> ''")


def report_slides(reports: DataFrame) -> DataFrame:
    """reports (report, text): title and explanation of every `## ` slide, in order."""
    parts = F.slice(F.split("text", r"(?m)^## "), F.lit(2), F.greatest(F.size(F.split("text", r"(?m)^## ")) - 1, F.lit(0)))
    rows = reports.select("report", F.posexplode(parts).alias("pos", "part"))
    explanation = F.trim(F.regexp_extract("part", r"(?s)\*\*Speaker Explanation:\*\*\s*(.+?)(?:\n\n|\*\*|\z)", 1))
    return rows.select("report", "pos", F.trim(F.substring_index("part", "\n", 1)).alias("title"), explanation.alias("explanation"))


class Reports(NamedTuple):
    """The reports of a folder: slides (report, pos, title, explanation), lines (report, pos, line), counts (report, frames, questions), pairs (report, question, answer, category, source)."""

    slides: DataFrame
    lines: DataFrame
    counts: DataFrame
    pairs: DataFrame


def report_folders(spark: SparkSession, root: str) -> Reports:
    """Reports below a folder, one in each of its folders (report.md, knowledge.jsonl, frames/*.png), or the one in it.

    Each report has a row of counts, without a file zero; lines of JSON that can't be read are left out. A missing
    folder is an error.
    """
    found = listing(spark, root)
    name = F.when(F.col("relative").rlike(r"^(report\.md|knowledge\.jsonl|metadata\.json|frames/[^/]+)$"), ".").otherwise(F.substring_index("relative", "/", 1))
    inner = F.when(name == ".", F.col("relative")).otherwise(F.regexp_replace("relative", r"^[^/]+/", ""))
    placed = found.select(name.alias("report"), inner.alias("inner"))
    texts_ = _whole(spark, root).select(F.col("text"), F.when(F.col("relative").isin("report.md", "knowledge.jsonl"), ".").otherwise(F.substring_index("relative", "/", 1)).alias("report"), F.regexp_extract("relative", r"^(?:[^/]+/)?(report\.md|knowledge\.jsonl)$", 1).alias("file"))
    marked = texts_.filter("file = 'report.md'").select("report", "text")
    lines = marked.select("report", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    schema = "question string, answer string, category string, source string"
    said = texts_.filter("file = 'knowledge.jsonl'").select("report", F.explode(F.split("text", "\n")).alias("line")).filter(F.trim("line") != "")
    pairs = said.select("report", F.try_parse_json("line").alias("v")).filter("v IS NOT NULL").select("report", F.from_json(F.to_json("v"), schema).alias("q")).select("report", "q.*")
    frames = placed.groupBy("report").agg(F.count_if(F.col("inner").rlike(r"^frames/[^/]+\.png$")).alias("frames"))
    counts = frames.join(pairs.groupBy("report").agg(F.count("*").alias("questions")), "report", "left").withColumn("questions", F.coalesce("questions", F.lit(0)))
    return Reports(report_slides(marked), lines, counts, pairs)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without those that can't be read."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def batch_results(spark: SparkSession, path: str) -> DataFrame:
    """key and text of batch results; lines with an error or without text are left out."""
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.key").alias("key"), jsonrepair.response_text(F.col("value")).alias("text")).filter("key is not null and text is not null")


def source_date(files: DataFrame) -> DataFrame:
    """files (pdf_date, core_modified, modified) with the month of the first that is there."""
    return files.withColumn("source_date", F.coalesce(pdf_month(F.col("pdf_date")), F.date_format("core_modified", "yyyy-MM"), F.date_format("modified", "yyyy-MM")))
