"""Every query with SQL gives the rows that DuckDB finds, on the smallest tables; the others match a restatement."""

import os

import pytest

from inkbasin.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())
    assert mine == theirs


def test_flagship(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["fact_verification"](spark, DATA).count() > 0


def test_similarity_restated(spark):
    from difflib import SequenceMatcher

    from inkbasin.functions.text import normalize_stem

    got = registry.QUERIES["filename_similarity"](spark, DATA)
    rows = got.select("deck", "video", "similarity", normalize_stem(got["deck"]).alias("a"), normalize_stem(got["video"]).alias("b")).collect()
    assert rows and all(r.similarity == SequenceMatcher(None, r.a, r.b).ratio() >= 0.6 for r in rows)


def test_assignment_invariants(spark):
    pairs = registry.QUERIES["session_stage1"](spark, DATA).collect()
    for side in ("deck", "video"):
        assert len({r[side] for r in pairs}) == len(pairs)


def test_dedup_restated(spark):
    """No fact is lost but those merged into another one, and a second run over the result of one side changes nothing."""
    got = registry.QUERIES["fact_dedup_greedy"](spark, DATA).collect()
    assert {r.modality for r in got} <= {"pptx", "mp4", "both"}
    ranks = {}
    for r in got:
        ranks.setdefault(r.session, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())


def test_offline_provider(spark):
    rows = registry.QUERIES["offline_extraction"](spark, DATA).collect()
    assert rows and all(r.error is None for r in rows)


def test_escalation(spark):
    from pyspark.sql import functions as F

    from inkbasin import providers

    class Broken:
        name = "broken"

        def extract(self, prompt, model, max_tokens):
            if "b" in prompt:
                raise ValueError("no")
            return "not json" if "c" in prompt else '{"title": "t", "summary": "s"}'

    asked = spark.createDataFrame([("1", "CONTENT:\na", "m", 1), ("2", "CONTENT:\nb. B.", "m", 1), ("3", "CONTENT:\nc. C.", "m", 1)], "key string, prompt string, model string, max_tokens int")
    replies = providers.call(asked, lambda: Broken())
    assert {r.key: r.error is None for r in replies.collect()} == {"1": True, "2": False, "3": True}
    done = providers.validated(asked, replies, "rules", "second")
    assert {r.key: (r.model, r.valid) for r in done.collect()} == {"1": ("m", True), "2": ("second", True), "3": ("second", True)}
    with pytest.raises(ValueError, match="unknown provider"):
        providers.get_provider("none")
    assert done.filter(F.col("provider") == "rules").count() == 2


def test_retries(spark):
    from inkbasin import providers

    class Flaky:
        name = "flaky"

        def __init__(self):
            self.calls = {}

        def extract(self, prompt, model, max_tokens):
            n = self.calls[prompt] = self.calls.get(prompt, 0) + 1
            if n <= int(prompt):
                raise ValueError(f"call {n}")
            return f"after {n}"

    asked = spark.createDataFrame([("a", "0", "m", 1), ("b", "2", "m", 1), ("c", "3", "m", 1)], "key string, prompt string, model string, max_tokens int")
    got = {r.key: (r.text, r.error) for r in providers.call(asked, lambda: Flaky(), attempts=3, base=0.01).collect()}
    assert got == {"a": ("after 1", None), "b": ("after 3", None), "c": (None, "ValueError: call 3")}
    assert {r.key: r.error for r in providers.call(asked, lambda: Flaky()).collect()}["b"] == "ValueError: call 1"


def test_archive_keeps_what_it_cannot_replace(spark, tmp_path):
    from inkbasin.sources import sinks

    path, history = str(tmp_path / "extract"), str(tmp_path / "history")
    row = lambda v: spark.createDataFrame([(v,)], "v int")
    sinks.archive(row(1), path, history)
    with pytest.raises(RuntimeError, match="nothing was extracted"):
        sinks.archive(row(2).limit(0), path, history)
    assert [r.v for r in spark.read.json(path).collect()] == [1] and not list(tmp_path.glob("extract.*"))
    kept = sinks.archive(row(3), path, history)
    assert [r.v for r in spark.read.json(path).collect()] == [3] and [r.v for r in spark.read.json(kept).collect()] == [1]


def test_streaming(spark, tmp_path):
    from inkbasin.streaming.ingest import event_counts, ingest

    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check"), event_counts)
    out = spark.read.parquet(str(tmp_path / "out"))
    whole = event_counts(spark.read.parquet(f"{DATA}/events.parquet"))
    assert out.count() == out.distinct().count() <= whole.count()
    assert out.exceptAll(whole).count() == 0


def test_category_balance(spark):
    from inkbasin.operators import reports

    lines = {
        "empty and full": ["# A", "## 1", "# B", "text"],
        "one": ["# A", "## 1", "## 2"],
        "general first": ["# Other", "## 1", "## 2", "## 3", "# General", "# A", "## 4"],
        "repeated": ["# General", "## 1", "## 2", "## 3", "# A", "## 4", "# General", "## 5"],
        "none": ["## 1", "text"],
        "no slides": ["# A", "# B"],
    }
    table = spark.createDataFrame([(k, i, x) for k, own in lines.items() for i, x in enumerate(own)], "report string, pos int, line string")
    got = {r.report: (r.total, r.categories, r.general, r.passed) for r in reports.category_balance(table).collect()}
    assert got == {"empty and full": (1, 2, 0, True), "one": (2, 1, 0, False), "general first": (4, 3, 3, False), "repeated": (2, 2, 1, True), "none": (0, 0, 0, False), "no slides": (0, 2, 0, False)}


def test_stage_1_confidence(spark):
    from inkbasin.operators import correlate

    pairs = spark.createDataFrame([("f", "a.pptx", "a.mp4", 0.9167), ("f", "b.pptx", "b.mp4", 1.0), ("f", "a.pptx", "b.mp4", 0.95)], "folder string, deck string, video string, similarity double")
    assert sorted((r.deck, r.video, r.stage1) for r in correlate.assigned(pairs).collect()) == [("b.pptx", "b.mp4", 100), ("a.pptx", "a.mp4", 91)][::-1]


def test_comparison_of_reports(spark):
    from inkbasin.operators import reports

    slides = "report string, pos int, title string, explanation string"
    old = spark.createDataFrame([("r", 1, "A", "x" * 300), ("r", 2, "A", "short"), ("r", 3, "B", None), ("r", 4, "C", "same"), ("gone", 1, "A", "t")], slides)
    new = spark.createDataFrame([("r", 1, "A", "short but longer"), ("r", 2, "C", "same"), ("r", 3, "D", ""), ("come", 1, "A", "t")] + [("r", i, f"E{i:02}", "") for i in range(4, 24)], slides)
    counts = lambda *rows: spark.createDataFrame(list(rows), "report string, frames long, questions long")
    got = {r.report: r for r in reports.comparison(old, new, counts(("r", 0, 4), ("gone", 1, 1)), counts(("r", 3, 3))).collect()}
    r = got["r"]
    assert (r.old_slides, r.new_slides, r.slides_change, r.total_added, r.total_removed, r.common, r.improved, r.degraded, r.rewritten) == (4, 23, 19, 21, 1, 2, 1, 0, 0)
    assert r.added_titles == ["D"] + [f"E{i:02}" for i in range(4, 13)] and r.removed_titles == ["B"]
    assert [(x.title, x.change, x.old_explanation, x.new_length) for x in r.examples] == [("A", "improved", "short...", 16)]
    assert (r.frames_percent, r.questions_percent) == (300.0, -25.0)
    assert (got["gone"].new_slides, got["gone"].new_frames, got["come"].old_slides, got["come"].added_titles) == (0, None, 0, ["A"])


def test_title_case(spark):
    from pyspark.sql import functions as F

    from inkbasin.functions.text import title_case

    names = ["session1_slides", "o'neil report-2a", "ÉTÉ à paris", "", "x"]
    got = [r.t for r in spark.createDataFrame([(n,) for n in names], "n string").select(title_case(F.col("n")).alias("t")).collect()]
    assert got == [n.title() for n in names]


def test_session_records_restated(spark):
    from hashlib import sha256

    from inkbasin.operators import correlate
    from inkbasin.plans import sessions

    got = registry.QUERIES["session_records"](spark, DATA).collect()
    known = {r.path: r for r in sessions._extractions(spark, DATA).collect()}
    matched = registry.QUERIES["session_stage1"](spark, DATA).collect()
    expected = {}
    for p in matched:
        if p.deck not in known or p.video not in known:
            continue
        a, b = known[p.deck], known[p.video]
        signals = p.similarity > 0.65
        words = [set((r.title or "").lower().split()) for r in (a, b)]
        signals += bool(words[0] | words[1]) and len(words[0] & words[1]) / len(words[0] | words[1]) > 0.5
        if a.slides and b.slides:
            signals += abs(a.slides - b.slides) <= 3 or abs(a.slides - b.slides) / max(a.slides, b.slides) <= 0.25
        topics = [{t.lower() for t in r.topics or []} for r in (a, b)]
        signals += bool(topics[0] and topics[1]) and len(topics[0] & topics[1]) / len(topics[0] | topics[1]) > 0.6
        if signals >= 2:
            expected[p.deck, p.video] = min(100, int((p.stage1 + signals * 25) / 2))
    assert expected and {(r.deck, r.video): r.confidence for r in got} == expected and len(expected) < len(matched)
    for r in got:
        a, b = known[r.deck], known[r.video]
        assert r.title == (a.title or b.title or "Untitled Session")
        assert r.session_hash == sha256("|".join(sorted([a.hash, b.hash])).encode()).hexdigest()
        assert [tuple(x)[:4] for x in r.sources] == [("mp4", r.video, b.hash, ""), ("pptx", r.deck, a.hash, "")]
        assert [x["rank"] for x in r.key_facts] == list(range(1, len(r.key_facts) + 1))
        said = {"pptx": set(a.facts or []), "mp4": set(b.facts or [])}
        assert {x.fact for x in r.key_facts} <= said["pptx"] | said["mp4"]
        assert bool(r.key_facts) == bool(a.facts or b.facts)
        assert r.method == "filename_similarity + title_match" and "overlay" in r.sources[1].contribution
        assert r.entities == list({t.lower(): t for t in reversed((a.entities or []) + (b.entities or []))}.values())[::-1]
        assert r.overlay_type == (a.overlay_type or b.overlay_type) and r.domains == []
        assert r.topics == list({t.lower(): t for t in reversed((a.topics or []) + (b.topics or []))}.values())[::-1]
    crossed = correlate.sessions(correlate.confirmed_pairs(spark.createDataFrame([], "folder string, path string"), sessions._extractions(spark, DATA)))
    assert crossed.count() == 0
