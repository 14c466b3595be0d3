"""Keyword categories and filters as tables: an index of keywords by word n-grams, joined by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of a text or a keyword.
TOKEN = r"[\p{L}\p{N}]+(?:[&/'%-][\p{L}\p{N}]+)*+%?+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def grams(words: Column, n: int) -> Column:
    """Runs of n words, in order: each word joined to the next ones, array to array, so the work is linear."""
    out = words
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - k, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    # the last runs lack a word and are null
    return F.filter(out, lambda x: x.isNotNull()) if n > 1 else out


def index(rules: DataFrame) -> DataFrame:
    """rules (category, keyword) as rows (category, gram, n): words of a keyword with a space between; blank ones go."""
    words = rules.select("category", tokens(F.col("keyword")).alias("w"))
    return words.filter(F.size("w") > 0).select("category", F.array_join("w", " ").alias("gram"), F.size("w").alias("n")).distinct()


def matches(texts: DataFrame, rules: DataFrame, key: str, longest: int | None = None) -> DataFrame:
    """(key, category, gram) of the keywords of rules (category, keyword) that are in texts (key, text), as whole words.

    Only runs of as many words as some keyword has are made; they meet the keywords by an equi-join, so the rules may be
    many, and only what matches goes on. longest: words of the longest keyword, else it is read from the rules.
    """
    indexed = index(rules)
    sizes = range(1, longest + 1) if longest else [r[0] for r in indexed.select("n").distinct().collect()]
    found = None
    words = texts.select(F.col(key), tokens(F.col("text")).alias("_words"))
    for n in sizes:
        runs = words.select(F.col(key), F.explode(grams(F.col("_words"), n)).alias("gram"))
        part = runs.join(indexed.filter(F.col("n") == n).select("category", "gram"), "gram").select(key, "category", "gram").distinct()
        found = part if found is None else found.unionAll(part)
    return texts.sparkSession.createDataFrame([], f"{key} {texts.schema[key].dataType.simpleString()}, category string, gram string") if found is None else found


def categorized(texts: DataFrame, rules: DataFrame, order: DataFrame, key: str, other: str = "general") -> DataFrame:
    """key, category, matched: the category of which most keywords are in a text, ties by order (category, place); `other` without any."""
    counted = matches(texts, rules, key).groupBy(key, "category").agg(F.count("*").alias("m"))
    placed = counted.join(order.select("category", "place"), "category", "left")
    best = placed.groupBy(key).agg(F.min(F.struct((-F.col("m")).alias("m"), F.coalesce("place", F.lit(1 << 30)).alias("place"), "category")).alias("b"))
    return texts.select(key).join(best, key, "left").select(key, F.coalesce("b.category", F.lit(other)).alias("category"), F.coalesce(-F.col("b.m"), F.lit(0)).cast("long").alias("matched"))


def without(texts: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """The texts that hold none of the keywords of rules (category, keyword)."""
    return texts.join(matches(texts, rules, key).select(key).distinct(), key, "left_anti")
