"""Numbers in prose, and arithmetic on them, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkbasin import rules


def _double(digits: Column) -> Column:
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def scaled(value: Column, suffix: Column) -> Column:
    """A value times what its suffix (%, K, million, ...) stands for."""
    out = F.lit(1.0)
    for name, factor in rules.SUFFIXES.items():
        out = F.when(F.lower(suffix) == name, F.lit(factor)).otherwise(out)
    return value * out


def numbers(text: Column) -> Column:
    """The distinct numbers of a text, ascending; empty for null."""
    pattern = F.lit(rules.NUMBER)
    text = F.coalesce(text, F.lit(""))
    pairs = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda v, s: scaled(_double(v), s))
    return F.array_sort(F.array_distinct(F.filter(pairs, lambda x: x.isNotNull())))


def normalize_number(text: Column) -> Column:
    """The first number of a text; of a range at its start, the lower bound with the range's suffix; null without one."""
    text = F.trim(text)
    ranged = F.regexp_extract(text, rules.NUMBER_RANGE, 1)
    first = scaled(_double(F.regexp_extract(text, rules.NUMBER, 1)), F.regexp_extract(text, rules.NUMBER, 2))
    return F.when(ranged != "", scaled(_double(ranged), F.regexp_extract(text, rules.NUMBER_RANGE, 3))).otherwise(first)


def numbers_match(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Equal, or both not zero and within the tolerance of the larger."""
    return (a == b) | ((a != 0) & (b != 0) & (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))))


def magnitude_ratio(a: Column, b: Column) -> Column:
    """How many times the larger is the smaller; infinite with a zero."""
    return F.when((a == 0) | (b == 0), F.lit(float("inf"))).otherwise(F.greatest(a, b) / F.least(a, b))


def rounded(value: Column, digits: int) -> Column:
    """A double rounded as SQL engines do it: its product with the power of ten to a whole number, half away from zero.

    F.round goes by the digits that are shown, so that what lies a little under a half goes up.
    """
    scaled_up = value * 10.0**digits
    return F.when(F.abs(scaled_up) < float("inf"), F.round(scaled_up, 0) / 10.0**digits).otherwise(value)


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body refers to it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shown(x: Column) -> Column:
    """A number with the digits it needs and one after the point at least, whatever its size."""
    plain = F.regexp_replace(x.cast("decimal(30,6)").cast("string"), r"(\.\d*?)0+$", "$1")
    return F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)


def times(a: Column, b: Column) -> Column:
    """How many times the larger is the smaller, as a whole number; inf with a zero."""
    return bound(magnitude_ratio(a, b), lambda r: F.when(r == float("inf"), "inf").otherwise(F.bround(r, 0).cast("decimal(30,0)").cast("string")))


def meaningful(values: Column) -> Column:
    """Without what looks like a year (2000 to 2099)."""
    return F.filter(values, lambda n: ~((n == F.floor(n)) & n.between(2000, 2099)))


def share_number(a: Column, b: Column) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: numbers_match(x, y)))


def blended_cost(model: Column, tokens: Column) -> Column:
    rate = F.lit(1.0)
    for name, price in rules.BLENDED.items():
        rate = F.when(model == name, F.lit(price)).otherwise(rate)
    return F.bround(tokens * rate / 1_000_000, 6)


def provider_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """By the table of prices; null for a model without one."""
    out = F.lit(None).cast("double")
    for name, (i, o) in rules.PRICES.items():
        out = F.when(model == name, F.bround((tokens_in * i + tokens_out * o) / 1_000_000, 6)).otherwise(out)
    return out


def token_budget(depth: Column, slides: Column, minutes: Column) -> Column:
    deep = F.least(8192 + slides * 280, F.lit(24576))
    blocks = F.when(minutes > 0, F.floor(minutes / 5)).otherwise(0)
    return F.when(depth == "deep", deep).when(depth == "multimodal", F.least(6144 + blocks * 150, F.lit(16384))).otherwise(8192).cast("long")


def percent_change(old: Column, new: Column) -> Column:
    return F.bround((new - old) / F.greatest(old, F.lit(1)) * 100, 1)
