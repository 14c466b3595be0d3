"""Names against a taxonomy (kind, alias, canonical), tags, review lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkbasin import rules


def normalized(terms: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """terms (id, kind, pos, term): the canonical name, whether it changed, whether it is unknown. Case doesn't matter."""
    known = taxonomy.select("kind", F.lower(F.trim("alias")).alias("_a"), "canonical").unionByName(taxonomy.select("kind", F.lower(F.trim("canonical")).alias("_a"), "canonical"))
    known = known.groupBy("kind", "_a").agg(F.min("canonical").alias("canonical"))
    out = terms.withColumn("_a", F.lower(F.trim("term"))).join(known, ["kind", "_a"], "left").drop("_a")
    return out.withColumns({"unknown": F.col("canonical").isNull(), "canonical": F.coalesce("canonical", "term")}).withColumn("changed", F.col("canonical") != F.col("term"))


def lists(terms: DataFrame) -> DataFrame:
    """Normalised terms as lists by id and kind: the first of equal ones, in order, no more than the cap of the kind."""
    first = terms.groupBy("id", "kind", "canonical").agg(F.min("pos").alias("pos"))
    out = first.groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "canonical"))).alias("_l"))
    cap = F.lit(2**31 - 1)
    for kind, n in rules.CAPS.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    return out.select("id", "kind", F.slice(F.transform("_l", lambda x: x["canonical"]), F.lit(1), cap).alias("terms"))


def outcomes(records: DataFrame, terms: DataFrame) -> DataFrame:
    """records (id, title, summary) with the outcome of their terms (normalized): result, changes and unknown terms.

    changes: `kind: term -> canonical` of each term that was renamed and `kind: term dropped` of each beyond the cap of
    its kind, in order. quarantine: a record without a title or a summary; warnings: an unknown or a dropped term;
    else valid.
    """
    cap = F.lit(2**31 - 1)
    for kind, n in rules.CAPS.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    first = terms.groupBy("id", "kind", "canonical").agg(F.min("pos").alias("_at"))
    placed = first.withColumn("_place", F.row_number().over(Window.partitionBy("id", "kind").orderBy("_at", "canonical"))).filter(F.col("_place") > cap)
    dropped = placed.select("id", F.struct("kind", F.col("_at").alias("pos"), F.lit(1).alias("o"), F.concat("kind", F.lit(": "), "canonical", F.lit(" dropped")).alias("text")).alias("c"), F.lit(True).alias("warn"))
    renamed = terms.filter("changed").select("id", F.struct("kind", "pos", F.lit(0).alias("o"), F.concat("kind", F.lit(": "), "term", F.lit(" -> "), "canonical").alias("text")).alias("c"), F.lit(False).alias("warn"))
    log = dropped.unionAll(renamed).groupBy("id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["text"]).alias("changes"), F.bool_or("warn").alias("_warn"))
    odd = terms.filter("unknown").groupBy("id").agg(F.count("*").alias("unknown"))
    out = records.join(log, "id", "left").join(odd, "id", "left").withColumns({"changes": F.coalesce("changes", F.array().cast("array<string>")), "unknown": F.coalesce("unknown", F.lit(0))})
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    result = F.when(blank("title") | blank("summary"), "quarantine").when(F.coalesce("_warn", F.lit(False)) | (F.col("unknown") > 0), "warnings").otherwise("valid")
    return out.withColumn("result", result).drop("_warn")


def validated(tags: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """tags (id, tag) with valid and reason: unknown_prefix, unvalidated (not among the known values) or validated."""
    prefix, value = F.substring_index("tag", "/", 1), F.regexp_replace("tag", "^[^/]*/", "")
    known = taxonomy.select(F.col("kind").alias("_k"), F.col("value").alias("_v")).distinct()
    kinds = known.select("_k").distinct().withColumn("_any", F.lit(True))
    fits = F.col("tag").contains("/") & prefix.isin(rules.TAG_PREFIXES)
    out = tags.withColumns({"_k": prefix, "_v": value, "_fits": fits}).join(known.withColumn("_in", F.lit(True)), ["_k", "_v"], "left").join(F.broadcast(kinds), "_k", "left")  # kinds: a handful by definition
    reason = F.when(~F.col("_fits"), "unknown_prefix").when(F.col("_any") & F.col("_in").isNull(), "unvalidated").otherwise("validated")
    return out.select(*tags.columns, F.col("_fits").alias("valid"), reason.alias("reason"))


def warnings(results: DataFrame, by: str = "id") -> DataFrame:
    """Per id, how many of its validated tags (reason) call for a look."""
    return results.groupBy(by).agg(F.count(F.when(F.col("reason").isin("unknown_prefix", "unvalidated"), 1)).alias("warnings"))


def unseen(terms: DataFrame, review: DataFrame) -> DataFrame:
    """Unknown terms (kind, term) that the review list lacks, once each."""
    return terms.select("kind", "term").distinct().join(review, ["kind", "term"], "left_anti")


def for_prompt(taxonomy: DataFrame) -> DataFrame:
    """kind and its names as one line."""
    return taxonomy.select("kind", "canonical").distinct().groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("canonical")), ", ").alias("names"))
