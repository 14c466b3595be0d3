"""What adapters return and what packages hold, on small inputs with nulls and broken values."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from inkbasin.functions import media
from inkbasin.functions import records as R
from inkbasin.operators import frames


def test_probe(spark):
    video = {"codec_type": "video", "codec_name": "h264", "width": 1280, "height": 720}
    cases = {
        json.dumps({"format": {"duration": "2.5"}, "streams": [{"codec_type": "audio", "codec_name": "aac"}, video, {**video, "codec_name": "png"}]}): (2, "h264", "1280x720"),
        json.dumps({"format": {"duration": "3.5"}}): (4, None, None),
        json.dumps({"streams": [{**video, "width": 0}]}): (None, "h264", None),
        json.dumps({"format": {"duration": "long"}, "streams": [video]}): (None, None, None),
        "not json": (None, None, None),
        "": (None, None, None),
        None: (None, None, None),
    }
    rows = spark.createDataFrame([(i, j) for i, j in enumerate(cases)], "i int, j string").select("i", media.probe_metadata(F.col("j")).alias("m")).orderBy("i").collect()
    assert [tuple(r.m) for r in rows] == list(cases.values())


def test_paged_text(spark):
    long = "x" * 300
    cases = [([long, long], "good"), ([long, None], "partial"), (["", ""], "partial"), ([long] + [""] * 5, "partial"), ([], "none")]
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p array<string>").select("i", media.paged_text(F.col("p")).alias("t")).orderBy("i").collect()
    assert [r.t.quality for r in rows] == [q for _, q in cases]
    assert rows[1].t.text == f"[PAGE 1]\n{long}\n\n[PAGE 2]\n" and rows[1].t.chars == len(rows[1].t.text)


def test_source_subdir(spark):
    kinds = ["video", "audio", "document", "slides", "spreadsheet", "note", "transcript", "unknown", None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "i int, k string").select("i", R.source_subdir(F.col("k")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == ["video", "video", "docs", "docs", "docs", "notes", "notes", "notes", "notes"]


def test_freshness(spark):
    whole, part = datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.datetime(2024, 1, 2, 3, 4, 5, 120)
    rows = spark.createDataFrame([("a\\b.txt", b"x", whole), (None, None, part)], "p string, c binary, t timestamp_ntz").select(R.freshness(F.col("p"), F.col("c"), F.col("t"), F.col("t")).alias("f")).collect()
    assert rows[0].f.source_path == "a/b.txt" and len(rows[0].f.source_hash) == 64
    assert rows[1].f.source_path is None and rows[1].f.source_hash is None
    assert [r.f.source_mtime for r in rows] == [whole.isoformat(), part.isoformat()]


def test_second_pass(spark):
    rows = spark.createDataFrame([(1, ["a", None], ["b", "a"]), (2, ["a"], None), (3, ["a"], []), (4, None, ["b"])], "id int, old array<string>, new array<string>")
    rows = rows.select("id", R.tagged(F.col("old"), "pptx").alias("facts"), F.col("old").alias("key_facts"), R.retagged(R.tagged(F.col("new"), "x"), "second").alias("more"))
    got = {r.id: ([tuple(f) for f in r.facts], r.key_facts) for r in R.with_second_pass(rows, "more").collect()}
    one, two, again = ("a", "pptx"), ("b", "second"), ("a", "second")
    assert got == {1: ([one, two, again], ["a", None, "b", "a"]), 2: ([one], ["a"]), 3: ([one], ["a"]), 4: ([two], ["b"])}


def test_latest_path(spark):
    rows = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b"), ("g", 2, "c"), ("g", None, "z"), ("h", None, "y")], "g string, t int, p string")
    assert {r.g: r.p for r in rows.groupBy("g").agg(R.latest_path(F.col("p"), F.col("t")).alias("p")).collect()} == {"g": "c", "h": "y"}


def test_kept_by_similarity(spark):
    """As a loop over the frames finds them; compared with the last one kept, not the last one seen."""
    runs = [[[0, 0], [30, 30], [60, 60], [60, 61], [255, 0]], [[5, 5]], [], [[10, 10], [10]]]
    rows = spark.createDataFrame([(i, [(j, [float(x) for x in p]) for j, p in enumerate(run)]) for i, run in enumerate(runs)], "i int, f array<struct<n:int,pixels:array<double>>>")
    got = {r.i: [f.n for f in r.k] for r in rows.select("i", frames.kept_by_similarity(F.col("f")).alias("k")).collect()}
    for i, run in enumerate(runs):
        kept = []
        for j, p in enumerate(run):
            last = run[kept[-1]] if kept else None
            if last is None or len(last) != len(p) or 1 - sum(abs(a - b) for a, b in zip(last, p)) / (255 * len(p)) < 0.85:
                kept.append(j)
        assert got[i] == kept


def test_evaluation_of_folders(spark, tmp_path):
    pytest.importorskip("yaml")
    from inkbasin.operators import packages
    from inkbasin.sources import files

    for run, facts in (("old", "[short]"), ("new", "[a fact that has over thirty characters, second]")):
        package = tmp_path / run / "p1"
        (package / "source" / "slides").mkdir(parents=True)
        (package / "source" / "slides" / "s1.png").write_bytes(b"x")
        (package / "source" / "other.png").write_bytes(b"x")
        front = f"title: Deck\nsource: in/{run}/deck.pptx\nextraction_version: 2\nkey_facts: {facts}\nrfp_overlay:\n  a: 1\n  b: []\ntopics: [x, y]\nentities_mentioned: null\n"
        (package / "deck.md").write_text(f"---\n{front}---\n## One\n" + "t" * 600)
        (package / "session_x.md").write_text("---\ntitle: s\n---\n")
        (package / "bad.md").write_text("---\n: [\n---\n")
    old, new = (packages.evaluated(files.package_notes(spark, str(tmp_path / r)), files.package_pictures(spark, str(tmp_path / r))) for r in ("old", "new"))
    rows = {r.note: r for r in new.collect()}
    assert set(rows) == {"deck.md", "bad.md"}
    r = rows["deck.md"]
    # facts 2, overlay 5 + 3, topics 2, length 4, pictures 10, version 7
    assert (r.score, r.key_facts, r.specific, r.populated, r.overlay_fields, r.slides, r.slide_coverage, r.fresh) == (33, 2, 1, 1, 2, 1, 1.0, False)
    assert rows["bad.md"].title == "bad" and rows["bad.md"].score == 10 and rows["bad.md"].issues == ["no facts", "low content"]
    scores = [packages.package_scores(f.select("package").distinct(), f) for f in (old, new)]
    assert [tuple(x) for x in packages.package_changes(*scores).collect()] == [("p1", 20, 22, 2)]
    got = {x.note: (x.old_note, x.matched_by, x.score_change) for x in packages.compared(old, new).collect()}
    assert got == {"deck.md": ("deck.md", "source", 2), "bad.md": ("bad.md", "source", 0)}
    none = packages.package_scores(spark.createDataFrame([("empty",)], "package string"), new.limit(0)).collect()
    assert [tuple(x) for x in none] == [("empty", 0, 0, "no notes")]
    assert packages.compared(old.limit(0), new).filter("matched_by is not null").count() == 0
