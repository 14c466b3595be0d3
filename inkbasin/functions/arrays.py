"""Lists, sets and maps as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkbasin import rules
from inkbasin.functions.text import normalize_tag

EMPTY = "array<string>"


def listed(items: Column) -> Column:
    return F.coalesce(items, F.array().cast(EMPTY))


def dedupe(items: Column, trim: bool = True) -> Column:
    """The first of those that agree but for case (and outer spaces), in order."""
    key = (lambda x: F.btrim(F.lower(x))) if trim else F.lower
    keys = F.transform(listed(items), key)
    return F.filter(listed(items), lambda x, i: F.array_position(keys, key(x)) == i + 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; both empty: 1, one empty: 0."""
    a, b = F.array_distinct(listed(a)), F.array_distinct(listed(b))
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection by the smaller size; null if one is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def aliased(items: Column, aliases: dict[str, str]) -> Column:
    """Canonical names for aliases, then the first of equal ones."""
    if not aliases:
        return F.array_distinct(listed(items))
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.array_distinct(F.transform(listed(items), lambda x: F.coalesce(F.try_element_at(table, F.trim(x)), x)))


def capped(items: Column, kind: str) -> Column:
    return F.slice(listed(items), 1, rules.CAPS[kind])


def tags(products: Column, topics: Column, domains: Column, client: Column, doc_type: Column, source_type: Column) -> Column:
    def prefixed(prefix: str, items: Column) -> Column:
        return F.transform(listed(items), lambda x: F.concat(F.lit(prefix + "/"), normalize_tag(x)))

    parts = [prefixed(*x) for x in (("product", products), ("topic", topics), ("domain", domains))]
    for prefix, one in (("client", client), ("type", doc_type), ("source", source_type)):
        there = F.coalesce(one, F.lit("")) != ""
        parts.append(F.when(there, F.array(F.concat(F.lit(prefix + "/"), normalize_tag(one)))).otherwise(F.array().cast(EMPTY)))
    return F.array_distinct(F.concat(*parts))


def strings(items: Column) -> Column:
    """An array of VARIANT as strings: name or title with the role, else the value (an object as JSON)."""
    def one(v: Column) -> Column:
        get = lambda k: F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
        name = F.coalesce(get("name"), get("title"))
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(F.concat(name, F.lit(" ("), get("role"), F.lit(")")), name, F.to_json(v))).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))

    return F.transform(items, one)


def padded(items: Column, n: Column, filler: Column) -> Column:
    """Cut or filled to length n."""
    return F.slice(F.concat(items, F.array_repeat(filler, n)), F.lit(1), n)


def pruned(fields: Column) -> Column:
    """A map of lists without its empty entries."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & (F.size(v) > 0))
