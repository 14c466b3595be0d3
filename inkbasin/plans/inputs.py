"""Inputs that queries derive from the driver's tables, as SQL expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(key: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


FOLDER = pick("doc_id", ["01_product_docs", "02_training", "03_competitive", "security", "misc", "rfp/response", "workshop", "discovery", ".hidden", "plain"])
NAME = pick("doc_id", ["Technical_Overview_v2", "client_RFP", "session", "Pricing_Sheet_final", "meeting_notes", "Platform Roadmap", "gdpr-report", "battlecard", "Deep_Dive_draft", "notes", "Annual Report", "lab", "handbook"])
EXT = pick("doc_id", [".pdf", ".docx", ".pptx", ".xlsx", ".csv", ".md", ".txt", ".mp4", ".srt", ".mp3", ".bin"])
STEM = f"concat({NAME}, '_', doc_id)"
PATH = f"concat({FOLDER}, '/', {STEM}, {EXT})"

AMOUNT = "CAST(floor(o_totalprice * CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1.004 END) AS BIGINT)"
FACT = """CASE o_orderkey % 6
 WHEN 0 THEN concat('Order ', o_orderkey, ' totals $', CAST(floor(o_totalprice / 1000) AS BIGINT), 'K')
 WHEN 1 THEN concat('Usage of ', o_orderkey, ' shows 250% growth and offers better savings')
 WHEN 2 THEN concat('Project ', o_orderkey, ' is 250% complete and does not support exports')
 WHEN 3 THEN concat('Completion of ', o_orderkey, ' is expected in 2035 and includes 1,700 users')
 WHEN 4 THEN concat('Costs of ', o_orderkey, ' went from $2M to $950M despite risk')
 ELSE 'The platform provides native storage without limitation' END"""
SOURCE = f"concat('Ledger shows ', o_orderkey, ' at $', {AMOUNT}, ' overall, 1,706 users and 2 million in costs')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: doc_id, path, folder, name, ext, text, chars."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", "lang", "source", F.expr(PATH).alias("path"), F.expr(FOLDER).alias("folder"), F.expr(STEM).alias("name"), F.expr(EXT).alias("ext"), F.length("text").cast("long").alias("chars"))


FILES_SQL = f"files AS (SELECT doc_id, text, lang, source, {PATH} AS path, {FOLDER} AS folder, {STEM} AS name, {EXT} AS ext, length(text) AS chars FROM documents)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as facts: id, customer, fact, source_text."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.expr(FACT).alias("fact"), F.expr(SOURCE).alias("source_text"))


FACTS_SQL = f"facts AS (SELECT o_orderkey AS id, o_custkey AS customer, {FACT} AS fact, {SOURCE} AS source_text FROM orders)"
