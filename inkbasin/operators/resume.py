"""Work already done: by status, by content hash, by response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(entries: DataFrame, status: DataFrame, force: bool = False) -> DataFrame:
    """entries (id) without those that are done; all of them if forced."""
    return entries if force else entries.join(status.filter("status = 'done'").select("id"), "id", "left_anti")


def checked(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """entries (id, path) with an error where the listing (path) lacks the file."""
    there = listing.select("path").distinct().withColumn("_there", F.lit(True))
    return entries.join(there, "path", "left").withColumn("error", F.when(F.col("_there").isNull(), F.concat(F.lit("File not found: "), "path"))).drop("_there")


def changed(files: DataFrame, extracted: DataFrame) -> DataFrame:
    """files (path, source_hash) that no extract has with the same hash."""
    return files.join(extracted.select("path", "source_hash"), ["path", "source_hash"], "left_anti")


def reusable(files: DataFrame, extracted: DataFrame) -> DataFrame:
    return files.join(extracted.select("path", "source_hash"), ["path", "source_hash"], "left_semi")


def answered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests (key) with the text of their response, or an error."""
    out = requests.join(responses.select("key", "text"), "key", "left")
    return out.withColumn("status", F.when(F.col("text").isNull(), "error").otherwise("done")).withColumn("error", F.when(F.col("text").isNull(), "no response"))


def latest(log: DataFrame, key: str = "id", order: str = "processed_at") -> DataFrame:
    """The last entry of each key of an append-only status log, of equal times the greatest; tasks send one row a key."""
    whole = F.struct(*[c for c in log.columns if c != key])
    rows = log.groupBy(key).agg(F.max_by(whole, F.struct(order, F.to_json(whole))).alias("_r"))
    return rows.select(*(F.col(c) if c == key else F.col(f"_r.{c}") for c in log.columns))


def duplicates(files: DataFrame, content: str = "text") -> DataFrame:
    """Contents that several files have: hash, copies, first id. Counts combine before the shuffle."""
    hashed = files.groupBy(F.sha2(content, 256).alias("source_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return hashed.filter("copies > 1")
