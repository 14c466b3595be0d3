"""Sidecars, logs and batch requests as files; notes and packages are in operators/notes.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def package_meta(notes: DataFrame) -> DataFrame:
    meta = notes.groupBy("package").agg(F.count("*").alias("files"), F.array_sort(F.collect_set("doc_type")).alias("types"))
    return meta.select("package", F.concat_ws("\n", F.concat(F.lit("package: "), F.col("package").cast("string")), F.concat(F.lit("files: "), F.col("files").cast("string")), F.concat(F.lit("types: ["), F.array_join("types", ", "), F.lit("]"))).alias("text"))


def write_sidecars(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_status(rows: DataFrame, path: str) -> None:
    """Append; the latest entry of an id holds."""
    rows.write.mode("append").json(path)


def write_costs(rows: DataFrame, path: str) -> None:
    rows.select("timestamp", "model", "provider", "input_tokens", "output_tokens", "cost").write.mode("append").json(path)


def batch_requests(requests: DataFrame) -> DataFrame:
    """value: lines of a bulk request file from key and prompt."""
    part = F.array(F.struct(F.col("prompt").alias("text")))
    body = F.struct(F.array(F.struct(part.alias("parts"), F.lit("user").alias("role"))).alias("contents"), F.struct(F.lit("application/json").alias("response_mime_type")).alias("generation_config"))
    return requests.select(F.to_json(F.struct("key", body.alias("request"))).alias("value"))


def write_scan(scanned: DataFrame, path: str) -> None:
    """A scan below path: its rows as JSON lines in `results`, written by the tasks, and date and count in `summary`."""
    scanned.write.mode("overwrite").json(f"{path}/results")
    back = scanned.sparkSession.read.schema(scanned.schema).json(f"{path}/results")
    back.agg(F.current_date().alias("scan_date"), F.count("*").alias("total_files")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def archive(df: DataFrame, path: str, history: str) -> str:
    """Write a new version beside the old one, and move the old one to the history only if that worked.

    Where the new version has no rows, the old one stays in place and it is an error.
    """
    spark = df.sparkSession
    jvm, fresh = spark.sparkContext._jvm, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.json(fresh)
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not spark.read.schema(df.schema).json(fresh).take(1):
        fs.delete(p(fresh), True)
        raise RuntimeError(f"nothing was extracted; {path} stays as it was")
    kept = f"{history.rstrip('/')}/{uuid.uuid4().hex}"
    if fs.exists(p(path)):
        fs.mkdirs(p(history))
        fs.rename(p(path), p(kept))
    fs.rename(p(fresh), p(path))
    return kept
