"""Classification and routing as CASE expressions over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkbasin import rules
from inkbasin.functions.numbers import bound, magnitude_ratio, numbers, shown, times
from inkbasin.functions.text import contains_any, extension, file_name, slashes, years


def _first(cases: list[tuple[Column, Column]], default: Column) -> Column:
    return reduce(lambda acc, c: acc.when(*c), cases[1:], F.when(*cases[0])).otherwise(default)


def file_type(path: Column, types: dict[str, list[str]] | None = None) -> Column:
    ext = extension(path)
    return _first([(ext.isin(v), F.lit(k)) for k, v in (types or rules.FILE_TYPES).items()], F.lit("unknown"))


def type_from_name(name: Column) -> Column:
    return _first([(name.rlike("(?i)" + p), F.lit(t)) for p, t in rules.NAME_PATTERNS], F.lit(None).cast("string"))


def doc_type(path: Column) -> Column:
    """By patterns of the file name, then parts of the path, then parts of the name, else general."""
    whole, name = F.lower(slashes(path)), F.lower(file_name(path))
    cases = [(contains_any(whole, one) & contains_any(whole, other) if other else contains_any(whole, one), F.lit(t)) for one, other, t in rules.FOLDER_RULES]
    cases += [(contains_any(name, parts), F.lit(t)) for parts, t in rules.NAME_KEYWORDS]
    return F.coalesce(type_from_name(file_name(path)), _first(cases, F.lit("general")))


def deep(doc_type_: Column) -> Column:
    return doc_type_.isin(rules.DEEP_TYPES)


def text_quality(chars: Column, pages: Column) -> Column:
    sparse = (pages > 0) & (chars / F.greatest(pages, F.lit(1)) < 100)
    return F.when(chars == 0, "none").when(sparse | (chars < 200), "partial").otherwise("good")


def image_heavy(slides: Column, chars: Column) -> Column:
    return (slides >= 5) & ((chars < 500) | (chars / F.greatest(slides, F.lit(1)) < 50))


def route_tier(path: Column, type_: Column, chars: Column, quality: Column, *, slides: Column | None = None, renderer: bool = False, force: int | None = None, error: Column | None = None, extractor: Column | None = None) -> Column:
    """struct(tier, reason, cost, model): the cheapest way to read a file that is good enough."""
    ext, count = extension(path), F.concat(F.lit(" ("), chars.cast("string"), F.lit(" chars)"))
    slides = F.lit(0) if slides is None else slides
    error = F.coalesce(error, F.lit("no text")) if error is not None else F.lit("no text")
    extractor = F.coalesce(extractor, F.lit("local")) if extractor is not None else F.lit("local")
    if force is not None:
        tier, reason = F.lit(force), F.lit(f"forced to tier {force}")
    else:
        cases = [
            (type_.isin("video", "audio"), 3, F.concat(type_, F.lit(" requires multimodal processing"))),
            ((type_ == "slides") & (ext == ".pptx") & image_heavy(slides, chars) & F.lit(renderer), 3, F.lit("PPTX image-heavy, rendering slides for multimodal extraction")),
            ((type_ == "slides") & (ext == ".pptx"), 2, F.concat(F.lit("PPTX text extraction"), count)),
            (type_.isin("spreadsheet", "document") & ext.isin(".xlsx", ".docx") & (quality == "none"), 2, F.concat(ext, F.lit(" upload blocked by API; text extraction failed, sending what we have"))),
            (type_.isin("spreadsheet", "document") & ext.isin(".xlsx", ".docx"), 2, F.concat(ext, F.lit(" upload blocked by API; using extracted text"), count)),
            (quality == "none", 3, F.concat(F.lit("local extraction failed ("), error, F.lit(")"))),
            (quality == "partial", 3, F.concat(F.lit("partial text extraction"), count)),
            (type_.isin("note", "transcript") & (chars < 5000), 1, F.concat(F.lit("small text file"), count)),
        ]
        good = F.concat(F.lit("good text extraction ("), chars.cast("string"), F.lit(" chars, "), extractor, F.lit(")"))
        tier = _first([(c, F.lit(t)) for c, t, _ in cases], F.lit(2))
        reason = _first([(c, r) for c, _, r in cases], good)
    return F.struct(tier.cast("int").alias("tier"), reason.alias("reason"), tier_cost(tier).alias("cost"), tier_model(tier).alias("model"))


def tier_model(tier: Column) -> Column:
    """The model that a tier asks; null for the one that asks none."""
    return _first([(tier == t, F.lit(m)) for t, m in rules.TIER_MODELS.items() if m], F.lit(None).cast("string"))


def tier_cost(tier: Column) -> Column:
    return _first([(tier == t, F.lit(c)) for t, c in rules.TIER_COST.items()], F.lit(None).cast("double"))


def scan_tier(path: Column, text_chars: Column) -> Column:
    ext = extension(path)
    rich = F.when(F.coalesce(text_chars, F.lit(0)) > 0, 1).otherwise(2)
    return F.when(ext.isin(rules.FILE_TYPES["video"] + rules.FILE_TYPES["audio"]), 3).when(ext.isin(rules.RICH_EXTENSIONS), rich).otherwise(1)


def select_model(path: Column, size: Column, override: str | None = None) -> Column:
    """struct(model, reason)."""
    if override:
        return F.struct(F.lit(rules.MODEL_NAMES.get(override, override)).alias("model"), F.lit("manual_override").alias("reason"))
    ext = extension(path)
    model = F.when(size < 5000, "free").when(ext.isin([*rules.PRO_EXTENSIONS, ".pdf"]), rules.PRO_MODEL).otherwise(rules.VISUAL_MODEL)
    reason = F.when(size < 5000, "small_file_local").when(ext == ".pptx", "pptx_multimodal").when(ext.isin(rules.PRO_EXTENSIONS), "video_multimodal").when(ext == ".pdf", "pdf_multimodal").otherwise("text_default")
    return F.struct(model.alias("model"), reason.alias("reason"))


def route_model(tier: Column, chars: Column, override: str | None = None, batch: bool = False, text_key: bool = True) -> Column:
    if override:
        return F.lit(override)
    large = F.floor(chars / 4) > 190_000
    return F.when(tier == 3, rules.VISUAL_MODEL).when(F.lit(batch) | large | ~F.lit(text_key), rules.LARGE_MODEL).otherwise(rules.TEXT_MODEL)


def polarity(text: Column) -> Column:
    """positive, negative or unknown; unknown if both."""
    low = F.lower(F.coalesce(text, F.lit("")))
    no, yes = low.rlike("|".join(rules.NEGATIVE)), low.rlike("|".join(rules.POSITIVE))
    return F.when(no == yes, "unknown").when(no, "negative").otherwise("positive")


def keyword_polarity(text: Column) -> Column:
    """positive, negative, mixed or neutral."""
    low = F.lower(F.coalesce(text, F.lit("")))
    yes, no = contains_any(low, rules.POSITIVE_WORDS), contains_any(low, rules.NEGATIVE_WORDS)
    return F.when(yes & no, "mixed").when(yes, "positive").when(no, "negative").otherwise("neutral")


def dominant_polarity(positive: Column, negative: Column) -> Column:
    return F.when(positive > negative * 2, "positive").when(negative > positive * 2, "negative").when((positive > 0) & (negative > 0), "mixed").otherwise("neutral")


def anomalies(text: Column, as_of_year: int) -> Column:
    """What looks wrong in a fact: shares over 100 % without growth, spreads over 400 among numbers from 1000 on, far years."""
    text = F.coalesce(text, F.lit(""))
    shares = F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d,]*\.?\d*)\s*%"), F.lit(1)), lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double"))
    high = F.filter(shares, lambda v: (v > 100) & ~contains_any(F.lower(text), rules.GROWTH_WORDS))
    pair = lambda a, b: F.concat(F.lit("Suspicious magnitude spread: "), shown(a), F.lit(" vs "), shown(b), F.lit(" ("), times(a, b), F.lit("x)"))
    spread = bound(F.filter(numbers(text), lambda n: n >= 1000), lambda large: F.flatten(F.transform(large, lambda a, i: F.transform(F.filter(large, lambda b, j: (j > i) & (magnitude_ratio(a, b) > 400)), lambda b: pair(a, b)))))
    far = F.filter(years(text), lambda y: y > as_of_year + 1)
    return F.concat(
        F.transform(high, lambda v: F.concat(F.lit("Percentage over 100%: "), shown(v), F.lit("%"))),
        spread,
        F.transform(far, lambda y: F.concat(F.lit("Future date: "), y.cast("string"))),
    )


def locator(reference: Column, ext: Column, most: Column) -> Column:
    """struct(type, number) of a page, slide or section from 1 to most (0: no limit), else null."""
    n = reference.try_cast("int")
    kind = F.when(ext == ".pdf", "pdf").when(ext == ".pptx", "slide").when(ext == ".docx", "section")
    return F.when((n >= 1) & ((most <= 0) | (n <= most)) & kind.isNotNull(), F.struct(kind.alias("type"), n.alias("number")))


def enforced_type(path: Column, type_: Column) -> Column:
    return _first([(extension(path) == e, F.lit(t)) for e, t in rules.CONTENT_TYPES.items()], type_)


def quality_value(quality: Column) -> Column:
    return _first([(quality == k, F.lit(v)) for k, v in rules.QUALITY_VALUES.items()], quality)
