"""Checks of report quality, and comparison of two reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkbasin import rules
from inkbasin.functions.numbers import percent_change
from inkbasin.functions.text import change_type, contains_any


def _share(n: str) -> Column:
    return F.col(n) / F.greatest(F.col("total"), F.lit(1))


def explanation_check(rows: DataFrame, *by: str, least: int = 30) -> DataFrame:
    """rows (explanation): counts and whether at most 10 % are empty, 30 % short, 50 % generic, 20 % raw transcript."""
    e = F.col("explanation")
    spoken = reduce(lambda a, b: a + b, [F.contains(F.lower(e), F.lit(m)).cast("int") for m in rules.SPOKEN_MARKS])
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.trim(e) == "").alias("empty"), F.count_if(F.length(F.trim(e)) < least).alias("too_short"), F.count_if(contains_any(F.lower(e), rules.GENERIC_PHRASES)).alias("generic"), F.count_if(spoken >= 2).alias("raw"), F.bround(F.avg(F.length(e)), 1).alias("avg_length"))
    return out.withColumn("passed", (_share("empty") <= 0.1) & (_share("too_short") <= 0.3) & (_share("generic") <= 0.5) & (_share("raw") <= 0.2))


def junk_check(rows: DataFrame, *by: str, order: str = "pos", examples: int = 5) -> DataFrame:
    """rows (title, pos): junk titles, the first of them in order, and whether they are 10 % at most.

    Only the first junk titles of a report are shuffled for the examples.
    """
    junk = contains_any(F.lower("title"), rules.JUNK_TITLES)
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(junk).alias("junk"))
    first = rows.filter(junk).withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, "title"))).filter(F.col("_rank") <= examples)
    titles = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "title"))), lambda x: x["title"]).alias("junk_titles"))
    out = out.join(titles, list(by), "left").withColumn("junk_titles", F.coalesce("junk_titles", F.array().cast("array<string>")))
    return out.withColumns({"junk_ratio": F.bround(_share("junk"), 3), "passed": _share("junk") <= 0.1})


def qa_check(rows: DataFrame, *by: str) -> DataFrame:
    """rows (question, answer, category, source): counts of what is missing or generic, and whether that is little."""
    there = F.col("question").isNotNull() & F.col("answer").isNotNull()
    out = rows.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(~there).alias("missing_fields"), F.count_if(there & contains_any(F.lower("question"), rules.GENERIC_QUESTIONS)).alias("generic_questions"),
        F.count_if(there & contains_any(F.lower("answer"), rules.GENERIC_ANSWERS)).alias("generic_answers"), F.count_if(there & (F.coalesce("category", F.lit("")) == "")).alias("missing_category"), F.count_if(there & F.col("source").isNull()).alias("missing_source"),
        F.bround(F.sum(F.coalesce(F.length("question"), F.lit(0))) / F.count("*"), 1).alias("avg_question"), F.bround(F.sum(F.coalesce(F.length("answer"), F.lit(0))) / F.count("*"), 1).alias("avg_answer"),
    )
    return out.withColumn("passed", (F.col("missing_fields") == 0) & (_share("generic_questions") <= 0.5) & (_share("generic_answers") <= 0.5) & (_share("missing_category") <= 0.3))


def slide_categories(lines: DataFrame, report: str = "report", order: str = "pos") -> DataFrame:
    """lines (report, pos, line): every `## ` title with the `# ` category above it. A report's lines are read in order."""
    w = Window.partitionBy(report).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    category = F.last(F.when(F.col("line").startswith("# "), F.trim(F.substring("line", 3, 1 << 30))), ignorenulls=True).over(w)
    return lines.withColumn("category", category).filter(F.col("line").startswith("## ") & F.col("category").isNotNull()).select(report, order, "category", F.substring("line", 4, 1 << 30).alias("title"))


def category_balance(lines: DataFrame, report: str = "report", order: str = "pos") -> DataFrame:
    """lines (report, pos, line): fails without a category or slide, with one category only, or over 70 % in a general one.

    A category is a `# ` header, also one without slides (`## ` lines); where a header is repeated, the slides after its
    last occurrence count. The general category is the first in the report that is named like one.
    """
    header = F.col("line").startswith("# ")
    w = Window.partitionBy(report).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = lines.withColumn("_part", F.count_if(header).over(w)).groupBy(report, "_part").agg(
        F.max(F.when(header, F.trim(F.substring("line", 3, 1 << 30)))).alias("category"), F.min(order).alias("_at"), F.count_if(F.col("line").startswith("## ")).alias("n")
    )
    each = parts.groupBy(report, "category").agg(F.min("_at").alias("_at"), F.max_by("n", "_at").alias("n"))
    named = F.col("category").isNotNull()
    general = named & contains_any(F.lower("category"), rules.GENERAL_CATEGORIES)
    total = F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0))
    out = each.groupBy(report).agg(total.alias("total"), F.count("category").alias("categories"), F.coalesce(F.min_by(F.when(general, F.col("n")), F.when(general, F.col("_at"))), F.lit(0)).alias("general"))
    return out.withColumns({"general_ratio": F.bround(_share("general"), 3), "passed": (F.col("total") > 0) & (F.col("categories") > 1) & (_share("general") <= 0.7)})


def all_passed(checks: DataFrame, *by: str) -> DataFrame:
    return checks.groupBy(*by).agg(F.bool_and("passed").alias("passed"))


def slide_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two tables (title, explanation): title with added, removed, same, improved, degraded or rewritten."""
    o = old.select("title", F.col("explanation").alias("o"), F.lit(True).alias("_o"))
    n = new.select("title", F.col("explanation").alias("n"), F.lit(True).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("n")), "same").otherwise(change_type(F.length("o"), F.length("n")))
    return o.join(n, "title", "full_outer").select("title", kind.alias("change"), F.length("o").alias("old_length"), F.length("n").alias("new_length"))


def comparison(old: DataFrame, new: DataFrame, old_counts: DataFrame, new_counts: DataFrame, titles: int = 10, examples: int = 5) -> DataFrame:
    """Slides (report, pos, title, explanation) and counts (report, frames, questions) of two runs: a row for each report.

    Numbers of slides, frames and questions with their changes, the first added and removed titles in order, the number
    of common titles and of changed explanations, and the first of those, cut to 200 characters. Of slides with one
    title the last counts. A report that a run lacks has no slides there, and null frames and questions.
    """
    one = lambda t, n: t.groupBy("report", "title").agg(F.max_by(F.coalesce("explanation", F.lit("")), "pos").alias(f"_{n}"), F.count("*").alias(f"_{n}n"))
    pairs = one(old, "o").join(one(new, "n"), ["report", "title"], "full_outer")
    c = F.col
    kind = F.when(c("_o").isNull(), "added").when(c("_n").isNull(), "removed").when(c("_o") == c("_n"), "same").otherwise(change_type(F.length("_o"), F.length("_n")))
    grouped = F.when(c("kind").isin("added", "removed", "same"), c("kind")).otherwise("changed")
    ranked = pairs.withColumn("kind", kind).withColumn("_rank", F.row_number().over(Window.partitionBy("report", grouped).orderBy("title")))
    cut = lambda x: F.concat(F.substring(x, 1, 200), F.lit("..."))
    example = F.struct("title", c("kind").alias("change"), cut("_o").alias("old_explanation"), cut("_n").alias("new_explanation"), F.length("_o").alias("old_length"), F.length("_n").alias("new_length"))
    first = lambda when, value, n: F.array_sort(F.collect_list(F.when(when & (c("_rank") <= n), value)))
    changed = ~c("kind").isin("added", "removed", "same")
    is_ = lambda k: c("kind") == k
    out = ranked.groupBy("report").agg(
        F.coalesce(F.sum("_on"), F.lit(0)).alias("old_slides"), F.coalesce(F.sum("_nn"), F.lit(0)).alias("new_slides"), F.count_if(is_("added")).alias("total_added"), F.count_if(is_("removed")).alias("total_removed"),
        F.count_if(~is_("added") & ~is_("removed")).alias("common"), *(F.count_if(is_(k)).alias(k) for k in ("improved", "degraded", "rewritten")),
        first(is_("added"), c("title"), titles).alias("added_titles"), first(is_("removed"), c("title"), titles).alias("removed_titles"), first(changed, example, examples).alias("examples"),
    ).withColumn("slides_change", c("new_slides") - c("old_slides"))
    for n, counts in (("old", old_counts), ("new", new_counts)):
        out = out.join(counts.select("report", *(c(x).alias(f"{n}_{x}") for x in ("frames", "questions"))), "report", "left")
    return out.withColumns({f"{x}_percent": percent_change(c(f"old_{x}"), c(f"new_{x}")) for x in ("frames", "questions")})


def verdict(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Metrics of two runs (avg_length, junk, general_percent) by report: improvements, regressions and the verdict."""
    m = ["avg_length", "junk", "general_percent"]
    both = old.select(by, *(F.col(x).alias(f"old_{x}") for x in m)).join(new.select(by, *(F.col(x).alias(f"new_{x}") for x in m)), by)
    change = percent_change(F.col("old_avg_length"), F.col("new_avg_length"))
    junk, general = F.col("new_junk") - F.col("old_junk"), F.col("new_general_percent") - F.col("old_general_percent")
    n = lambda *c: reduce(lambda a, b: a + b, [F.when(x, 1).otherwise(0) for x in c])
    out = both.withColumns({"length_change": change, "improvements": n(change > 10, junk < 0, general < -10), "regressions": n(change < -10, junk > 0, general > 10)})
    good, bad = F.col("improvements") > 0, F.col("regressions") > 0
    return out.withColumn("verdict", F.when(good & bad, "mixed").when(bad, "degraded").when(good, "improved").otherwise("unchanged"))
