"""Overlays of extractions as VARIANT objects: merge of two, first-wins lists of texts and objects, counts, rendering.

An overlay is an object of fields that a document type adds. Its lists hold texts, objects or both. All of it is Column
functions: an object is taken apart as a map of VARIANT and put together again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkbasin import rules
from inkbasin.functions.jsonrepair import is_object
from inkbasin.functions.text import title_case

_LIST, _MAP = "array<variant>", "map<string,variant>"


def kind(value: Column) -> Column:
    """VOID, OBJECT, ARRAY, STRING, ... of a VARIANT."""
    return F.regexp_extract(F.coalesce(F.schema_of_variant(value), F.lit("VOID")), r"^[A-Z]+", 0)


def filled(value: Column) -> Column:
    """Whether a value says something: not null, false, zero, nor an empty text, array or object."""
    return ~F.coalesce(F.to_json(value), F.lit("null")).isin("null", "false", "0", "0.0", '""', "[]", "{}")


def fields(overlay: Column) -> Column:
    """An overlay as a map; empty for null and for what is no object."""
    return F.coalesce(F.when(is_object(overlay), F.try_variant_get(overlay, "$", _MAP)), F.create_map().cast(_MAP))


def populated(overlay: Column) -> Column:
    """Fields whose value is not null, an empty text or an empty array."""
    there = lambda _, v: ~F.coalesce(F.to_json(v), F.lit("null")).isin("null", '""', "[]")
    return F.size(F.map_filter(fields(overlay), there))


def items(value: Column) -> Column:
    """A list's items; a single value that says something is a list of one."""
    one = F.when(filled(value), F.array(value)).otherwise(F.array().cast(_LIST))
    return F.coalesce(F.when(kind(value) == "ARRAY", F.try_variant_get(value, "$", _LIST)), one)


def item_key(item: Column) -> Column:
    """What makes two items the same: the first of the naming fields that an object has, else its JSON; a text itself."""
    get = lambda k: F.when(filled(F.try_variant_get(item, f"$.{k}", "variant")), F.try_variant_get(item, f"$.{k}", "string"))
    named = F.coalesce(*(get(k) for k in rules.OVERLAY_KEYS), F.to_json(item))
    plain = F.coalesce(F.try_variant_get(item, "$", "string"), F.to_json(item))
    return F.btrim(F.lower(F.when(is_object(item), named).otherwise(plain)), F.lit(" \t\n\r"))


def deduped(list_: Column) -> Column:
    """The first of the items with one key, in order."""
    both = F.transform(list_, lambda x: F.struct(x.alias("item"), item_key(x).alias("key")))
    bound = F.transform(F.array(both), lambda b: _firsts(b))
    return F.get(bound, F.lit(0))


def _firsts(both: Column) -> Column:
    keys = F.transform(both, lambda x: x["key"])
    return F.transform(F.filter(both, lambda x, i: F.array_position(keys, x["key"]) == i + 1), lambda x: x["item"])


def merged(first: Column, second: Column) -> Column:
    """Two overlays as one: list fields joined and deduplicated, others from the first that says something, empty ones left out.

    Where one has no fields, the other is kept as it is; where both have none, the result is an empty object.
    """
    a, b = fields(first), fields(second)
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    none = F.array().cast(_LIST)
    of = lambda m, k: F.coalesce(items(get(m, k)), none)
    lists = F.map_from_arrays(F.array(*map(F.lit, rules.OVERLAY_LISTS)), F.array(*(F.to_variant_object(deduped(F.concat(of(a, k), of(b, k)))) for k in rules.OVERLAY_LISTS)))
    others = F.map_zip_with(a, b, lambda k, x, y: F.when(filled(x), x).otherwise(y))
    others = F.map_filter(others, lambda k, v: ~k.isin(*rules.OVERLAY_LISTS))
    both = F.to_variant_object(F.map_filter(F.map_concat(lists, others), lambda _, v: filled(v)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.parse_json(F.lit("{}"))).when(F.size(b) == 0, first).when(F.size(a) == 0, second).otherwise(both)


def first_name(json: Column) -> Column:
    """The first field of a reply's JSON text whose name ends with _overlay, by place; null without one."""
    return F.get(F.filter(F.json_object_keys(json), lambda k: k.endswith("_overlay")), F.lit(0))


def rendered(overlay: Column) -> Column:
    """An overlay as lines: `- **Label:** a, b`, one line for each object of a list. Known lists come first, then the rest by name."""
    order = F.array(*map(F.lit, rules.OVERLAY_LISTS))
    m = fields(overlay)
    rest = F.array_sort(F.filter(F.map_keys(m), lambda k: ~k.isin(*rules.OVERLAY_LISTS)))
    keys = F.concat(F.filter(order, lambda k: F.map_contains_key(m, k)), rest)
    text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v), F.lit("None"))

    def of_object(v: Column) -> Column:
        pairs = F.filter(F.map_entries(fields(v)), lambda e: filled(e["value"]))
        return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), text(e["value"]))), ", ")

    def lines(k: Column) -> Column:
        v = F.try_element_at(m, k)
        head = F.concat(F.lit("- **"), title_case(F.replace(k, F.lit("_"), F.lit(" "))), F.lit(":** "))
        all_ = F.try_variant_get(v, "$", _LIST)
        objects = F.transform(all_, lambda x: F.concat(head, F.when(is_object(x), of_object(x)).otherwise(text(x))))
        joined = F.array(F.concat(head, F.array_join(F.transform(all_, text), ", ")))
        none = F.array().cast("array<string>")
        list_ = F.when(F.size(all_) == 0, none).when(is_object(F.get(all_, F.lit(0))), objects).otherwise(joined)
        return F.when(kind(v) == "ARRAY", list_).when((kind(v) == "STRING") & filled(v), F.array(F.concat(head, text(v)))).otherwise(none)

    out = F.array_join(F.flatten(F.transform(keys, lines)), "\n")
    return F.when(out == "", "No details available.").otherwise(out)
