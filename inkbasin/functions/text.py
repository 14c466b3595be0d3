"""Strings, paths, hashes and rendering as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkbasin import rules


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def extension(path: Column) -> Column:
    """Lower-case, with its dot; empty without one or for a dot file."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def normalize_stem(path: Column) -> Column:
    name = reduce(lambda c, noise: F.replace(c, F.lit(noise), F.lit("")), rules.STEM_NOISE, F.lower(stem(path)))
    return F.btrim(F.regexp_replace(F.regexp_replace(name, "[_-]", " "), " {2,}", " "))


def stem_prefix(name: Column) -> Column:
    return F.btrim(F.lower(F.regexp_replace(name, rules.RELATED_SUFFIX, "")), F.lit("_- "))


def normalize_tag(value: Column) -> Column:
    tag = F.translate(F.replace(F.lower(value), F.lit("&"), F.lit("")), "_ ", "--")
    return F.btrim(F.regexp_replace(F.regexp_replace(tag, "[^a-z0-9/-]", ""), "-+", "-"), F.lit("-"))


def output_filename(source: Column, extracted_at: Column, source_hash: Column) -> Column:
    """{date}_{clean stem, 64 characters at most}_{first four of the hash, or 0000}."""
    name = F.regexp_replace(F.lower(stem(source)), r"[^a-z0-9\s]", "")
    name = F.substring(F.btrim(F.regexp_replace(name, r"\s+", "_"), F.lit("_")), 1, 64)
    short = F.when(F.coalesce(source_hash, F.lit("")) == "", "0000").otherwise(F.substring(source_hash, 1, 4))
    return F.concat_ws("_", F.substring(extracted_at, 1, 10), name, short)


def collapse_names(text: Column, names: list[tuple[str, str]]) -> Column:
    """Of two-word names, a repeated first word becomes one."""
    return reduce(lambda c, n: F.regexp_replace(c, rf"(?i)\b({n[0]}\s+){{2,}}{n[1]}\b", f"{n[0]} {n[1]}"), names, text)


def strip_markup(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("`"), F.lit("")), "<[^>]*>", "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def fact_words(text: Column) -> Column:
    """Distinct words for comparing facts: longer than two, no stop words or digits; then lower-cased and stripped."""
    kept = F.filter(words(text), lambda w: ~F.lower(w).isin(rules.STOP_WORDS) & (F.length(w) > 2) & ~F.replace(w, F.lit(","), F.lit("")).rlike(r"^\d+$"))
    return F.array_distinct(F.transform(kept, lambda w: F.btrim(F.lower(w), F.lit(".,;:!?()"))))


def session_id(path: Column) -> Column:
    return F.substring(F.translate(F.lower(stem(path)), " _", "--"), 1, 50)


def person(name: Column) -> Column:
    return F.trim(F.substring_index(name, "(", 1))


def links_line(topics: Column, products: Column, people: Column) -> Column:
    """**Links:** [[a]] . [[b]]; empty without any."""
    none = F.array().cast("array<string>")
    parts = F.concat(F.coalesce(topics, none), F.coalesce(products, none), F.transform(F.coalesce(people, none), person))
    line = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), " . ")
    return F.when(F.size(parts) == 0, "").otherwise(F.concat(F.lit("**Links:** "), line))


def label(key: Column) -> Column:
    """A field name as a title: words by _ or space, each with a capital."""
    return F.array_join(F.transform(F.split(F.replace(key, F.lit("_"), F.lit(" ")), " "), lambda w: F.initcap(w)), " ")


def section_word(extension_: Column) -> Column:
    return F.when(extension_.isin(".pdf", ".docx"), "Section").otherwise("Slide")


def source_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def pair_hash(a: Column, b: Column) -> Column:
    """The same for either order."""
    return F.sha2(F.array_join(F.array_sort(F.array(a, b)), "|"), 256)


def prompt_hash(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt, 256), 1, 12)


def pdf_month(date: Column) -> Column:
    """YYYY-MM of a PDF date (D:YYYYMM...)."""
    return F.when(date.rlike(r"^D:\d{6}"), F.concat(F.substring(date, 3, 4), F.lit("-"), F.substring(date, 7, 2)))


def years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))


def frontmatter(text: Column) -> Column:
    """The block between a leading --- and the next; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\A---\n(.*?)\n?---", 1), F.lit(""))


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---.*?---", "")


def change_type(old_length: Column, new_length: Column) -> Column:
    return F.when(new_length > old_length * 1.2, "improved").when(new_length < old_length * 0.8, "degraded").otherwise("rewritten")


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first and the rest small, also after digits and marks."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")
