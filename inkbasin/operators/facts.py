"""Facts: verification against source text, enrichment, matching, deduplication across modalities."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from inkbasin.functions.arrays import overlap
from inkbasin.functions.classify import anomalies, keyword_polarity, locator, polarity
from inkbasin.functions.numbers import bound, magnitude_ratio, meaningful, numbers, numbers_match, share_number, shown, times
from inkbasin.functions.text import fact_words


def validation(fact: Column, source: Column, as_of_year: int) -> Column:
    """struct(status, fact_numbers, matched, missing, anomalies).

    verified: no number, or each one in the source within 1 %. Else flagged_mismatch with an anomaly of the fact or a
    number over 100 times off the closest in the source, and unverified without.
    """
    def checked(p: Column) -> Column:
        matched = F.filter(p["own"], lambda a: F.exists(p["theirs"], lambda b: numbers_match(a, b)))
        missing = F.filter(p["own"], lambda a: ~F.exists(p["theirs"], lambda b: numbers_match(a, b)))
        return F.struct(p["own"].alias("own"), p["theirs"].alias("theirs"), matched.alias("matched"), missing.alias("missing"))

    def judged(q: Column) -> Column:
        closest = lambda a: F.array_min(F.transform(q["theirs"], lambda b: F.struct(magnitude_ratio(a, b).alias("r"), b.alias("b"))))
        far = F.filter(F.transform(q["missing"], lambda a: F.struct(a.alias("a"), closest(a).alias("best"))), lambda x: x["best"]["r"] > 100)
        off = F.transform(far, lambda x: F.concat(F.lit("Magnitude error: "), shown(x["a"]), F.lit(" not in source (closest is "), times(x["a"], x["best"]["b"]), F.lit("x off)")))
        return F.struct(q["own"].alias("own"), q["matched"].alias("matched"), q["missing"].alias("missing"), F.concat(anomalies(fact, as_of_year), off).alias("odd"))

    def verdict(v: Column) -> Column:
        status = F.when((F.size(v["own"]) == 0) | (F.size(v["missing"]) == 0), "verified").when(F.size(v["odd"]) > 0, "flagged_mismatch").otherwise("unverified")
        return F.struct(status.alias("status"), v["own"].alias("fact_numbers"), v["matched"].alias("matched"), v["missing"].alias("missing"), v["odd"].alias("anomalies"))

    both = F.struct(numbers(fact).alias("own"), numbers(source).alias("theirs"))
    return bound(both, lambda p: bound(checked(p), lambda q: bound(judged(q), verdict)))


def closest_ratio(fact: Column, source: Column) -> Column:
    """For the first number of a fact: how far off the closest number of the source is; null without numbers."""
    return bound(F.get(numbers(fact), F.lit(0)), lambda first: F.array_min(F.transform(numbers(source), lambda b: magnitude_ratio(first, b))))


def enriched(facts: DataFrame, as_of_year: int) -> DataFrame:
    """facts (fact, source_text, source_date, reference, ext, max_pages) with locator, polarity, status and anomalies."""
    checked = F.when(F.coalesce("source_text", F.lit("")) != "", validation(F.col("fact"), F.col("source_text"), as_of_year))
    out = facts.withColumns({"locator": locator(F.col("reference"), F.col("ext"), F.col("max_pages")), "polarity": polarity(F.col("fact")), "sentiment": keyword_polarity(F.col("fact")), "_v": checked})
    return out.withColumns({"verification_status": F.col("_v.status"), "anomalies": F.col("_v.anomalies")}).drop("_v")


def facts_match(a: Column, b: Column) -> Column:
    """A number other than a year in common, and over 0.2 of the smaller set of words (if both have words)."""
    x, y = meaningful(numbers(a)), meaningful(numbers(b))
    shared = overlap(fact_words(a), fact_words(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), False).otherwise(share_number(x, y) & F.coalesce(shared > 0.2, F.lit(True)))


def facts_conflict(a: Column, b: Column) -> Column:
    """Numbers on both sides, none in common, and 0.3 of the smaller set of words or more."""
    x, y = meaningful(numbers(a)), meaningful(numbers(b))
    shared = overlap(fact_words(a), fact_words(b))
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & (shared >= 0.3) & ~share_number(x, y), F.lit(False))


def _greedy(rows: list[dict]) -> list[dict]:
    """Facts of one session in order: deck facts, then those of the recording, each against what is kept so far."""
    kept = [r for r in rows if r["modality"] == "pptx"]
    late = []
    for r in rows:
        if r["modality"] != "mp4":
            continue
        for k in kept:
            verdict = _verdict(k, r)
            if verdict == "match":
                k["modality"] = "both"
                break
            if verdict == "conflict":
                k["conflict"] = r["conflict"] = True
                kept.append(r)
                break
        else:
            late.append(r)
    return kept + late


def _sessions(schema: pa.Schema):
    def sessions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (session, pos)."""
        out: list[dict] = []
        rows = (r for batch in batches for r in batch.to_pylist())
        for session, own in itertools.groupby(rows, lambda r: r["session"]):
            out += [{"session": session, "rank": i, "fact": r["fact"], "modality": r["modality"], "conflict": r["conflict"]} for i, r in enumerate(_greedy(list(own)), 1)]
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    return sessions


def _verdict(a: dict, b: dict) -> str:
    x, y = list(a["numbers"]), list(b["numbers"])
    if not x or not y:
        return "none"
    same = any(p == q or (p and q and abs(p - q) <= 0.01 * max(abs(p), abs(q))) for p in x for q in y)
    u, v = set(a["words"]), set(b["words"])
    shared = len(u & v) / min(len(u), len(v)) if u and v else None
    if same:
        return "match" if shared is None or shared > 0.2 else "none"
    return "conflict" if shared is not None and shared >= 0.3 else "none"


def deduplicated(facts: DataFrame) -> DataFrame:
    """facts (session, modality pptx or mp4, pos, fact) merged: session, rank, fact, modality, conflict.

    The outcome depends on the order, so a session is merged as a whole; numbers and words are found by Catalyst
    before. A session is what one deck and one recording say, so its size is bounded.
    """
    ready = facts.select("session", "modality", F.col("pos").cast("long").alias("pos"), "fact", meaningful(numbers(F.col("fact"))).alias("numbers"), fact_words(F.col("fact")).alias("words"), F.lit(False).alias("conflict"))
    kind = facts.schema["session"].dataType
    out = StructType([StructField("session", kind), StructField("rank", LongType()), StructField("fact", StringType()), StructField("modality", StringType()), StructField("conflict", BooleanType())])
    return ready.repartition("session").sortWithinPartitions("session", "pos").mapInArrow(_sessions(to_arrow_schema(out)), out)


def top_facts(facts: DataFrame, group: str, n: int = 10) -> DataFrame:
    """The n longest facts of each group, ties by position: group, rank, fact."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.length("fact").desc(), "pos"))
    return facts.withColumn("rank", rank).filter(F.col("rank") <= n).select(group, "rank", "fact")
