"""Scores from 0 to 100, and the counts that they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbasin.functions.text import body


def quality_score(specific: Column, facts: Column, verified: Column, overlay_fields: Column, chars: Column, entities: Column) -> Column:
    """Facts 30, verified share 20, overlay 20, length 15, entities 15."""
    share = F.when(facts > 0, (verified / facts * 20).cast("int")).otherwise(0)
    total = F.least(F.lit(30), specific * 2) + F.least(F.lit(20), share) + F.least(F.lit(20), overlay_fields * 4)
    total += F.least(F.lit(15), (chars / 1000 * 3).cast("int")) + F.least(F.lit(15), entities * 3)
    return F.least(F.lit(100), total).cast("int")


def record_quality(key_facts: Column, facts: Column, overlay: Column, summary: Column, key_points: Column, entities: Column) -> Column:
    """The quality score of a record from its lists: key_facts (VARIANTs), facts (fact, verification_status), overlay (VARIANT).

    Of key facts and facts the larger number of specific ones (30 characters or more) counts; verification is that of
    the facts. The content is the summary and the points.
    """
    text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    long_ = F.size(F.filter(key_facts, lambda v: F.length(text(v)) >= 30)), F.size(F.filter(facts, lambda f: F.length(f["fact"]) >= 30))
    specific = F.greatest(*(F.greatest(n, F.lit(0)) for n in long_))
    verified = F.size(F.filter(facts, lambda f: f["verification_status"] == "verified"))
    points = F.aggregate(key_points, F.lit(0), lambda n, p: n + F.coalesce(F.length(p), F.lit(0)))
    chars = F.coalesce(F.length(summary), F.lit(0)) + F.coalesce(points, F.lit(0))
    fields = F.coalesce(F.size(F.map_keys(F.try_variant_get(overlay, "$", "map<string,variant>"))), F.lit(0))
    some = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return quality_score(specific, some(facts), F.greatest(F.coalesce(verified, F.lit(0)), F.lit(0)), fields, chars, some(entities))


def evaluator_score(n: DataFrame) -> Column:
    """Of a row with specific, has_overlay, populated, static, fresh, entities, topics, chars, images, version, has_polarity, has_locator."""
    c = F.col
    static = F.when(c("populated") >= 3, 15).otherwise(F.least(F.lit(15), c("populated") * 5))
    overlay = F.when(c("has_overlay"), 5 + F.when(c("static"), static).otherwise(F.least(F.lit(15), c("populated") * 3))).otherwise(0)
    depth = F.when(c("chars") > 2000, 10).when(c("chars") > 1000, 7).when(c("chars") > 500, 4).otherwise(0)
    flag = lambda x, points: F.when(x, points).otherwise(0)
    total = F.least(F.lit(20), c("specific") * 2) + overlay + flag(c("fresh"), 10) + F.least(F.lit(10), c("entities") * 2) + F.least(F.lit(8), c("topics")) + depth
    total += flag(c("images") > 0, 10) + flag(c("version") >= 2, 7) + flag(c("has_polarity"), 3) + flag(c("has_locator"), 2)
    return F.least(F.lit(100), total).cast("int")


def content_counts(text: Column) -> Column:
    """struct of the counts of a markdown note after its frontmatter."""
    rest = body(text)
    lines = F.split(F.btrim(rest, F.lit(" \n\r\t")), "\n")
    n = lambda f: F.size(F.filter(lines, f))
    return F.struct(
        F.length(rest).alias("total_chars"), F.size(lines).alias("total_lines"), n(lambda x: x.startswith("## ")).alias("sections"),
        n(lambda x: x.startswith("![")).alias("images"), n(lambda x: x.startswith("> ") & ~x.contains("WARNING")).alias("quotes"),
        n(lambda x: x.contains("> WARNING")).alias("warnings"), n(lambda x: F.trim(x).startswith("- ")).alias("bullet_points"),
    )


def fact_quality(facts: DataFrame, *by: str) -> DataFrame:
    """Counts, average length and share of facts of 30 characters or more, by group."""
    size = F.length("fact")
    out = facts.groupBy(*by).agg(F.count("*").alias("n"), F.bround(F.avg(size), 0).cast("long").alias("avg_length"), F.count_if(size >= 30).alias("specific"), F.count_if(size < 30).alias("generic"))
    return out.withColumn("quality_ratio", F.bround(F.col("specific") / F.col("n"), 2))


def enrichment_counts(facts: DataFrame, *by: str) -> DataFrame:
    return facts.groupBy(*by).agg(F.count_if(F.col("polarity") != "unknown").alias("polarity_count"), F.count_if(F.col("locator").isNotNull()).alias("locator_count"), F.coalesce(F.bool_or(F.coalesce(F.col("source_date"), F.lit("")) != ""), F.lit(False)).alias("has_source_date"))


def package_score(scores: DataFrame, package: str, score: str) -> DataFrame:
    """The rounded mean (half to even) of the scores of a package's files."""
    return scores.groupBy(package).agg(F.bround(F.avg(score), 0).cast("int").alias("score"), F.count("*").alias("files"))
