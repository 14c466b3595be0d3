"""Table-driven cases of numbers, verification, anomalies, polarity and merging."""

import math

import pytest
from pyspark.sql import functions as F

from inkbasin.functions import classify as C
from inkbasin.functions import numbers as N
from inkbasin.operators import facts as O


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "value"), [("1706", 1706), ("1,706", 1706), ("$950K", 950_000), ("$2M", 2e6), ("$2m", 2e6), ("$1.7B", 1.7e9), ("10.8%", 10.8), ("1.7 million", 1.7e6), ("5 thousand", 5000), ("2.5 billion", 2.5e9), ("5-8%", 5), ("hello world", None), ("", None), ("€500K", 500_000)])
def test_normalize_number(spark, text, value):
    got = one(spark, N.normalize_number(F.col("t")), t=text)
    assert got is None if value is None else math.isclose(got, value)


def test_numbers(spark):
    assert one(spark, N.numbers(F.col("t")), t="Reduced from $2M to $950K in 15 weeks") == [15, 950_000, 2_000_000]
    assert one(spark, N.numbers(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(
    ("fact", "source", "status", "odd"),
    [
        ("1706 customers onboarded", "The platform has 1,706 active customers across all regions.", "verified", 0),
        ("Achieved $950M in savings", "Cost reduction achieved $950K in annual savings over 15 weeks.", "flagged_mismatch", 1),
        ("Uses a warehouse for data", "The platform uses a warehouse and a lake.", "verified", 0),
        ("Approximately 1700 users", "System has 1,706 registered users.", "verified", 0),
        ("42 integrations available", "The platform supports multiple integrations with various systems.", "unverified", 0),
    ],
)
def test_validation(spark, fact, source, status, odd):
    got = one(spark, O.validation(F.col("f"), F.col("s"), 2026), f=fact, s=source)
    assert got.status == status
    assert len(got.anomalies) == odd


@pytest.mark.parametrize(
    ("fact", "found"),
    [("250% increase in throughput", []), ("Project is 250% complete", ["Percentage over 100%: 250.0%"]), ("Reduced costs from $2M to $950M annually", ["Suspicious magnitude spread: 2000000.0 vs 950000000.0 (475x)"]), ("Expected completion in 2035", ["Future date: 2035"]), ("Reduced from $2M to $950K in 15 weeks", [])],
)
def test_anomalies(spark, fact, found):
    assert one(spark, C.anomalies(F.col("f"), 2026), f=fact) == found


@pytest.mark.parametrize(("fact", "plain", "words"), [("It does not support exports", "unknown", "negative"), ("It does not do exports", "negative", "negative"), ("Provides native storage", "positive", "neutral"), ("Available but not included", "unknown", "neutral"), ("", "unknown", "neutral"), ("Faster growth at some risk", "unknown", "mixed"), ("It cannot fail", "negative", "negative")])
def test_polarity(spark, fact, plain, words):
    assert one(spark, C.polarity(F.col("f")), f=fact) == plain
    assert one(spark, C.keyword_polarity(F.col("f")), f=fact) == words


@pytest.mark.parametrize(
    ("deck", "video", "expected"),
    [
        ("1706 customers onboarded", "1706 customers onboarded across regions", [("1706 customers onboarded", "both", False)]),
        ("1706 customers onboarded", "Speaker mentioned 42 integrations available", [("1706 customers onboarded", "pptx", False), ("Speaker mentioned 42 integrations available", "mp4", False)]),
        ("Revenue was $2M in 2025", "Revenue reached $3M in 2025", [("Revenue was $2M in 2025", "pptx", True), ("Revenue reached $3M in 2025", "mp4", True)]),
        ("Serving 1,706 customers globally", "1706 total customers served", [("Serving 1,706 customers globally", "both", False)]),
        ("30-50% reduction in stockholding", "30-50% reduction in stockholding", [("30-50% reduction in stockholding", "both", False)]),
        ("7-9% stockholding reduction", "7.5% stockholding reduction", [("7-9% stockholding reduction", "pptx", True), ("7.5% stockholding reduction", "mp4", True)]),
    ],
)
def test_deduplicated(spark, deck, video, expected):
    rows = spark.createDataFrame([("s", "pptx", 0, deck), ("s", "mp4", 0, video)], "session string, modality string, pos int, fact string")
    got = O.deduplicated(rows).orderBy("rank").collect()
    assert [(r.fact, r.modality, r.conflict) for r in got] == expected


def test_token_budget(spark):
    of = lambda depth, slides, minutes: one(spark, N.token_budget(F.lit(depth), F.lit(slides), F.lit(minutes)))
    assert [of("standard", 0, 0), of("deep", 10, 0), of("deep", 60, 0), of("multimodal", 0, 30), of("multimodal", 0, 90), of("multimodal", 0, 600)] == [8192, 10992, 24576, 7044, 8844, 16384]


def test_costs(spark):
    assert one(spark, N.blended_cost(F.lit("unheard of"), F.lit(1_000_000))) == 1.0
    assert one(spark, N.provider_cost(F.lit("claude-sonnet-4-6"), F.lit(1_000_000), F.lit(100_000))) == 4.5
    assert one(spark, N.provider_cost(F.lit("unheard of"), F.lit(1), F.lit(1))) is None


def test_magnitude_error(spark):
    got = one(spark, O.validation(F.col("f"), F.col("s"), 2026), f="It costs $2M and 7 or 12.50", s="Only 7 of 1,500")
    assert got.status == "flagged_mismatch" and got.missing == [12.5, 2_000_000.0] and got.matched == [7.0]
    assert got.anomalies == ["Magnitude error: 2000000.0 not in source (closest is 1333x off)"]


def test_dedup_by_the_rules(spark):
    """Deck facts first; a fact of the recording joins what it matches, stands beside what it contradicts, else comes last."""
    said = [("s", "pptx", 1, "Costs fell by 40 percent in Europe"), ("s", "pptx", 2, "Team has 12 engineers"), ("s", "mp4", 1, "Sales reached 900 units"), ("s", "mp4", 2, "Costs fell by 40 percent in Europe last year"), ("s", "mp4", 3, "Team has 15 engineers"), ("t", "mp4", 1, "Team has 15 engineers")]
    got = O.deduplicated(spark.createDataFrame(said, "session string, modality string, pos int, fact string")).collect()
    assert sorted((r.session, r["rank"], r.fact, r.modality, r.conflict) for r in got) == [
        ("s", 1, "Costs fell by 40 percent in Europe", "both", False), ("s", 2, "Team has 12 engineers", "pptx", True), ("s", 3, "Team has 15 engineers", "mp4", True), ("s", 4, "Sales reached 900 units", "mp4", False), ("t", 1, "Team has 15 engineers", "mp4", False),
    ]


def test_rounded(spark):
    """As the SQL of fact_magnitude rounds: by the product, also where the digits shown end in a half."""
    duckdb = pytest.importorskip("duckdb")
    values = [(i * 1_000_000 + 500_000 + k * 1_000_000_000_000) / 1e12 for i in range(400) for k in range(4)] + [1.0211875, 2.0763125, 0.0, -1.0211875, 2.5e-7, 1e300, 4e15 + 0.5, float("inf"), -float("inf"), None]
    values += [a / b for a, b in ((55_266_000 + i * 7, 54_119_000) for i in range(500))]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.x for r in frame.orderBy("i").select(N.rounded(F.col("v"), 6).alias("x")).collect()]
    asked = duckdb.connect().execute("SELECT round(v, 6) FROM (SELECT unnest(range(len($1))) AS i, unnest($1::DOUBLE[]) AS v) ORDER BY i", [values])
    assert got == [x for (x,) in asked.fetchall()]
    assert any(x != v and abs(x - v) > 5e-7 for x, v in zip(got, values) if v is not None and abs(v) < 10)
    assert math.isnan(one(spark, N.rounded(F.lit(float("nan")), 6)))


def test_magnitudes_as_their_sql(spark, tmp_path):
    """Rows of fact_magnitude whose ratio ends in a half at the seventh digit."""
    duckdb = pytest.importorskip("duckdb")
    from inkbasin.plans import registry

    spark.range(10_000, 12_000).selectExpr("id * 6 AS o_orderkey", "id AS o_custkey", "cast(16000 + id % 1000 AS double) AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    mine = {r.id: r.ratio for r in registry.QUERIES["fact_magnitude"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    theirs = dict(con.execute(registry.ORACLE_SQL["fact_magnitude"]).fetchall())
    assert len(mine) == 2000 and mine == theirs
