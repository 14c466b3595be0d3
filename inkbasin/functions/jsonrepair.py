"""JSON objects out of model replies, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(text: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.btrim(text, F.lit(" \n\r\t")), r"\A```(?:json)?\s*", ""), r"\s*```\z", "")
    return F.btrim(inner, F.lit(" \n\r\t"))


def _no_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def parsed(text: Column) -> Column:
    """VARIANT of a reply: as it is, without trailing commas, its part from the first { to the last }, mended; else null."""
    plain = unfenced(text)
    block = F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit(""))
    repaired = F.try_parse_json(mended(plain))
    return F.coalesce(*(F.try_parse_json(x) for x in (plain, _no_trailing_commas(plain), block, _no_trailing_commas(block))), F.when(is_object(repaired) & (F.to_json(repaired) != "{}"), repaired))


#: What follows the quote that ends a text: a colon, the end of an object or array, the end, a quoted key whose comma is missing, or a comma before a value or key.
_AFTER = r"""\s*+(?:[:}\]]|\z|["']\w[^"'\n]{0,80}+["']\s*+:|,\s*+(?:["'{\[}\]\-\d]|true|false|null|\w++\s*+:|\z))"""
#: Texts in double or single quotes, brackets and marks, other runs. Loops are possessive, so that long texts need no stack.
_TOKEN = rf"""("[^"\\]*+(?:(?:\\.|"(?!{_AFTER})|\\(?=\z))[^"\\]*+)*+(?:"|\z)|'[^'\\]*+(?:(?:\\.|'(?!{_AFTER})|\\(?=\z))[^'\\]*+)*+(?:'|\z)|[{{}}\[\]:,]|[^\s{{}}\[\]:,"']++)"""
_WORDS = {"true": "true", "false": "false", "null": "null", "none": "null", "undefined": "null", "nan": "null"}


def _quoted(inner: Column) -> Column:
    """The inside of a text as JSON: inner quotes and control characters escaped, escapes that JSON lacks made plain."""
    pairs = F.replace(inner, F.lit("\\\\"), F.lit("\x01"))
    plain = F.regexp_replace(pairs, r"\\(?![\"/bfnrtu])", "")
    kept = F.replace(plain, F.lit('\\"'), F.lit("\x02"))
    kept = F.replace(kept, F.lit('"'), F.lit('\\"'))
    for raw, escape in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\x02", '\\"'), ("\x01", "\\\\")):
        kept = F.replace(kept, F.lit(raw), F.lit(escape))
    return F.concat(F.lit('"'), kept, F.lit('"'))


def _token(t: Column, key: Column) -> Column:
    """A token as JSON. Bare words are texts but for true, false and null in any language's spelling, as keys always."""
    first = F.substring(t, 1, 1)
    closed = (F.length(t) > 1) & (F.substring(t, -1, 1) == first)
    inner = F.substr(t, F.lit(2), F.length(t) - F.when(closed, 2).otherwise(1))
    word = F.lit(None).cast("string")
    for name, value in _WORDS.items():
        word = F.when(F.lower(t) == name, value).otherwise(word)
    number = F.when(t.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), t)
    return F.when(first.isin('"', "'"), _quoted(inner)).when(first.isin("{", "}", "[", "]", ":", ","), t).when(key, _quoted(t)).otherwise(F.coalesce(word, number, _quoted(t)))


def mended(text: Column) -> Column:
    """Broken JSON of an object as JSON that may parse: from the first { on, up to the bracket that ends it.

    Mends single quotes, bare keys and words, quotes and line breaks inside texts, commas that are missing or too many,
    keys without a value, and texts, arrays and objects that are cut off. Only brackets pass through a fold, with the
    open ones as its state; all else looks at a token's neighbours.
    """
    tokens = F.regexp_extract_all(F.regexp_extract(text, r"(?s)\{.*+", 0), F.lit(_TOKEN), F.lit(1))
    placed = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin("{", "}", "[", "]"))
    start = F.struct(F.lit("").alias("open"), F.lit(-1).alias("end"))

    def step(state: Column, x: Column) -> Column:
        close = F.when(x["t"] == "{", "}").when(x["t"] == "[", "]")
        stack = F.when(close.isNotNull(), F.concat(close, state["open"])).when(F.substring(state["open"], 1, 1) == x["t"], F.substring(state["open"], 2, 1 << 30)).otherwise(state["open"])
        ended = (stack == "") & (state["end"] < 0)
        return F.when(state["end"] >= 0, state).otherwise(F.struct(stack.alias("open"), F.when(ended, x["i"]).otherwise(-1).alias("end")))

    def whole(a: Column, state: Column) -> Column:
        a = F.when(state["end"] >= 0, F.slice(a, F.lit(1), state["end"] + 1)).otherwise(a)
        return F.concat(F.array_join(F.transform(a, lambda t, i: _placed(a, t, i)), ""), F.when(state["end"] < 0, state["open"]).otherwise(""))

    both = F.struct(tokens.alias("tokens"), F.aggregate(placed, start, step).alias("state"))
    # bound once, as the parts below name it often
    return F.get(F.transform(F.array(both), lambda b: whole(b["tokens"], b["state"])), F.lit(0))


def _placed(a: Column, t: Column, i: Column) -> Column:
    """A token with the comma or value that is missing before or after it; a comma too many is empty."""
    before, after = F.coalesce(F.get(a, i - 1), F.lit("{")), F.coalesce(F.get(a, i + 1), F.lit("}"))
    mark = t.isin("}", "]", ":", ",")
    comma = F.when(~mark & ~before.isin("{", "[", ":", ","), ",").otherwise("")
    nothing = F.when((t == ":") & after.isin("}", "]", ","), "null").otherwise("")
    extra = (t == ",") & (after.isin("}", "]", ",") | before.isin("{", "["))
    return F.when(extra, "").otherwise(F.concat(comma, _token(t, after == ":"), nothing))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def field(value: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(value, f"$.{path}", "string"), F.lit(""))


def structure_valid(value: Column) -> Column:
    """An object with a title, and a summary or key points; of a reply with `base`, that part counts."""
    base = F.coalesce(F.try_variant_get(value, "$.base", "variant"), value)
    points = F.coalesce(F.size(F.try_variant_get(base, "$.key_points", "array<variant>")), F.lit(0)) > 0
    return is_object(value) & field(base, "title").isNotNull() & (field(base, "summary").isNotNull() | points)


def overlay(value: Column, doc_type: Column) -> Column:
    """What a reply holds under `overlay`, or under the name of its document type."""
    named = F.try_variant_get(value, F.concat(F.lit("$."), doc_type, F.lit("_overlay")), "variant")
    return F.coalesce(F.try_variant_get(value, "$.overlay", "variant"), named)


def response_text(line: Column) -> Column:
    """The first text of a line of batch results."""
    return F.get_json_object(line, "$.response.candidates[0].content.parts[0].text")
