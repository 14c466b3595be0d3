"""Inventory, routing and cost of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbasin import rules
from inkbasin.functions.classify import file_type, route_tier, tier_cost
from inkbasin.functions.text import file_name, slashes, stem


def inventory(files: DataFrame, relative: str = "path", excluded: list[str] | None = None, keep_unknown: bool = False) -> DataFrame:
    """files (path, size) with name and type; without hidden parts, excluded folders and unknown types."""
    parts = F.split(slashes(F.col(relative)), "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") & (p != ".") & (p != ".."))
    inside = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(excluded or []))
    out = files.filter(~hidden & ~inside).withColumns({"name": stem(F.col("path")), "type": file_type(F.col("path"))})
    return out if keep_unknown else out.filter("type <> 'unknown'")


def routed(files: DataFrame, **options) -> DataFrame:
    """files (path, type, chars, quality) with tier, reason and cost."""
    choice = route_tier(F.col("path"), F.col("type"), F.col("chars"), F.col("quality"), **options)
    return files.withColumn("_r", choice).select(*files.columns, "_r.tier", "_r.reason", F.col("_r.cost").alias("estimated_cost"))


def cost_by_tier(files: DataFrame) -> DataFrame:
    """Files and cost of each tier, those without files included."""
    tiers = files.sparkSession.createDataFrame([(t,) for t in rules.TIER_COST], "tier int")
    counted = files.groupBy("tier").agg(F.count("*").alias("files"))
    out = tiers.join(F.broadcast(counted), "tier", "left")  # at most one row per tier
    files_ = F.coalesce("files", F.lit(0))
    return out.select("tier", files_.cast("long").alias("files"), F.bround(files_ * tier_cost(F.col("tier")), 6).alias("estimated_cost"))


def batch_summary(status: DataFrame, *by: str) -> DataFrame:
    """status (status, tier, cost, batch): totals by outcome; tier 2 in a batch costs half."""
    cost = F.when((F.col("tier") == 2) & F.col("batch"), F.col("cost") * 0.5).otherwise(F.col("cost"))
    done = F.col("status") == "done"
    return status.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(F.col("status") == "error").alias("error"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.bround(F.sum(F.when(done, cost).otherwise(0.0)), 6).alias("cost"), *(F.count_if(done & (F.col("tier") == t)).alias(f"tier{t}") for t in rules.TIER_COST),
    )


def monthly_spend(log: DataFrame, budget: float, alert_share: float = 0.8) -> DataFrame:
    """log (timestamp, cost) by month: spent, and whether it alerts or is over the budget."""
    out = log.groupBy(F.substring("timestamp", 1, 7).alias("month")).agg(F.sum("cost").alias("spent"), F.count("*").alias("calls"))
    return out.withColumns({"alert": F.col("spent") >= alert_share * budget, "over": F.col("spent") >= budget})


def routes(files: DataFrame, batch: bool = True) -> DataFrame:
    """How many files run locally, in a batch, or one by one."""
    route = F.when(F.col("tier") == 1, "local").when((F.col("tier") == 2) & F.lit(batch), "batch").otherwise("sync")
    return files.groupBy(route.alias("route")).count()


def scan_name(files: DataFrame) -> DataFrame:
    return files.withColumn("filename", file_name(F.col("path")))
