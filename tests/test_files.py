"""Names, classification, routing, scanning, notes and sessions."""

import json

import pytest
from pyspark.sql import functions as F

from inkbasin.functions import arrays as A
from inkbasin.functions import classify as C
from inkbasin.functions import jsonrepair as J
from inkbasin.functions import text as T
from inkbasin.operators import correlate, frames, resume, routing, scores
from inkbasin.operators import notes
from inkbasin.sources import files, sinks


def each(spark, column, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in rows.select(column.alias("y"), "i").orderBy("i").collect()]


def test_names(spark):
    x = F.col("x")
    assert each(spark, T.normalize_stem(x), ["Report_final_v2.pptx", "my-file_name.mp4", "file  _  name.txt"]) == ["report", "my file name", "file name"]
    assert each(spark, T.stem_prefix(x), ["session1", "session1_slides", "meeting_notes", "training", "session2_notes"]) == ["session1", "session1", "meeting", "training", "session2"]
    assert each(spark, T.normalize_tag(x), ["Platform & Architecture", "product_doc"]) == ["platform-architecture", "product-doc"]
    assert each(spark, T.output_filename(x, F.lit("2026-03-22T01"), F.lit("b3c4d5")), ["Platform  Architecture v2.pdf", "a-b_c.pdf"]) == ["2026-03-22_platform_architecture_v2_b3c4", "2026-03-22_abc_b3c4"]
    assert each(spark, T.output_filename(x, F.lit("2026-03-22"), F.lit("")), ["a" * 80 + ".pdf"]) == ["2026-03-22_" + "a" * 64 + "_0000"]
    assert each(spark, T.collapse_names(x, [("Blue", "Sky")]), ["blue Blue Sky rises"]) == ["Blue Sky rises"]
    assert each(spark, T.extension(x), ["a/B.PDF", "a/.hid", "a/none", "x.tar.gz"]) == [".pdf", "", "", ".gz"]
    assert each(spark, T.pdf_month(x), ["D:20250317", "2025"]) == ["2025-03", None]


def test_doc_types(spark):
    paths = {"/data/training/session1.pdf": "training", "/docs/compliance/gdpr_report.pdf": "security", "C:/50_RFP/Response/client_rfp.docx": "rfp_response", "C:/Projects/Discovery/initial_call.docx": "meeting", "/generic/Technical_Deep_Dive.pdf": "architecture", "/generic/Pricing_Sheet_2026.xlsx": "commercial", "/generic/x.pdf": "general"}
    assert each(spark, C.doc_type(F.col("x")), list(paths)) == list(paths.values())


def test_routing(spark):
    rows = [("a.mp4", 0, 3), ("a.pptx", 100, 2), ("a.docx", 0, 2), ("a.pdf", 0, 3), ("a.pdf", 150, 3), ("a.md", 300, 1), ("a.md", 5000, 2), ("a.pdf", 5000, 2), ("a.srt", 300, 1)]
    t = spark.createDataFrame([(i, p, n) for i, (p, n, _) in enumerate(rows)], "i int, path string, chars int")
    t = t.withColumns({"type": C.file_type(F.col("path")), "quality": C.text_quality(F.col("chars"), F.lit(0))})
    got = routing.routed(t).orderBy("i").collect()
    assert [r.tier for r in got] == [r[2] for r in rows]
    assert {r.tier: r.estimated_cost for r in got} == {1: 0.0, 2: 0.001, 3: 0.03}
    assert [r.tier for r in routing.routed(t, force=1).collect()] == [1] * len(rows)
    assert [tuple(r) for r in routing.cost_by_tier(routing.routed(t).filter("tier = 3")).orderBy("tier").collect()] == [(1, 0, 0.0), (2, 0, 0.0), (3, 3, 0.09)]


def test_inventory(spark):
    f = spark.createDataFrame([("a/x.pdf",), ("a/.x.pdf",), (".git/x.pdf",), ("skip/x.pdf",), ("a/x.zzz",)], "path string")
    assert [r.path for r in routing.inventory(f, excluded=["skip"]).collect()] == ["a/x.pdf"]


def test_similarity_and_sessions(spark):
    f = spark.createDataFrame([(1, "f/Session1.pptx"), (1, "f/Session1.mp4"), (1, "f/Session2.mp4"), (1, "f/Budget.pptx"), (2, "g/Session1.mp4")], "folder int, path string")
    pairs = correlate.assigned(correlate.session_candidates(f))
    assert [(r.deck, r.video, r.stage1) for r in pairs.collect()] == [("f/Session1.pptx", "f/Session1.mp4", 100)]
    assert sorted(r.path for r in correlate.standalone(f, pairs).collect()) == ["f/Budget.pptx", "f/Session2.mp4", "g/Session1.mp4"]


@pytest.mark.parametrize(
    ("sim", "titles", "slides", "topics", "decision"),
    [(0.8, ("a b c", "a b c"), (0, 0), ([], []), "merge"), (0.7, ("a", "b"), (20, 19), ([], []), "merge"), (0.65, ("a", "b"), (0, 0), ([], []), "crosslink"), (0.75, ("a", "b"), (0, 0), ([], []), "crosslink"), (0.5, ("a", "b"), (20, 18), (["a", "b", "c"], ["A", "B", "C", "d"]), "merge")],
)
def test_stage2(spark, sim, titles, slides, topics, decision):
    row = spark.createDataFrame([(sim, int(sim * 100), *titles, *slides, *topics)], "similarity double, stage1 int, deck_title string, video_title string, deck_slides int, video_slides int, deck_topics array<string>, video_topics array<string>")
    assert correlate.confirmed(row).first().decision == decision


def test_lists(spark):
    a = spark.createDataFrame([(["A", "a ", "B"], ["x"], []), (None, None, None)], "x array<string>, y array<string>, z array<string>")
    assert [r[0] for r in a.select(A.dedupe(F.col("x"))).collect()] == [["A", "B"], []]
    assert [r[0] for r in a.select(A.jaccard(F.col("z"), F.col("z"))).collect()] == [1.0, 1.0]
    assert a.select(A.jaccard(F.col("x"), F.col("z"))).first()[0] == 0.0
    assert a.select(A.tags(F.array(F.lit("WMS"), F.lit("WMS")), F.col("z"), F.col("z"), F.lit(None), F.lit(None), F.lit(None))).first()[0] == ["product/wms"]
    v = spark.sql("""SELECT array(parse_json('{"name":"Rob","role":"PM"}'), parse_json('{"title":"Azure"}'), parse_json('42'), parse_json('{}'), parse_json('"s"')) AS v""")
    assert v.select(A.strings(F.col("v"))).first()[0] == ["Rob (PM)", "Azure", "42", "{}", "s"]


def test_json_repair(spark):
    texts = ['{"title": "a", "summary": "b"}', '```json\n{"title": "a", "summary": "b",}\n```', 'Sure: {"title": "a", "key_points": ["x"]} done', "[1]", "no", '{"base": {"title": "a", "summary": "s"}}', '{"title": ""}']
    assert each(spark, F.coalesce(J.structure_valid(J.parsed(F.col("x"))), F.lit(False)), texts) == [True, True, True, False, False, True, False]


def test_frames(spark):
    row = spark.range(1)
    get = lambda c: row.select(c).first()[0]
    times = F.array(*(F.lit(float(i)) for i in range(70)))
    assert get(F.size(frames.with_breaker(times))) == 35
    assert get(frames.with_breaker(times))[:3] == [0.0, 2.0, 4.0]
    assert get(frames.with_floor(F.array(F.lit(10.0)), F.lit(700.0)))[:3] == [0.0, 10.0, 45.0]
    assert get(frames.with_floor(F.array(F.lit(10.0)), F.lit(500.0))) == [10.0]
    assert get(frames.kept_by_change(F.array(*map(F.lit, (0.0, 0.5, 1.2, 1.3, 3.0))), 1.0)) == [0.0, 1.2, 3.0]
    assert get(frames.scene_times(F.lit("pts_time:1.5 x\npts_time: 20 y"))) == [1.5, 20.0]


def test_resume(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    log = spark.createDataFrame([("a", "error", 1), ("a", "done", 2), ("b", "error", 1)], "id string, status string, processed_at int")
    status = resume.latest(log)
    assert [r.id for r in resume.pending(ids, status).collect()] == ["b"]
    assert resume.pending(ids, status, force=True).count() == 2


def test_quality_score(spark):
    of = lambda *x: spark.range(1).select(scores.quality_score(*map(F.lit, x))).first()[0]
    assert of(0, 0, 0, 0, 0, 0) == 0
    assert of(99, 99, 99, 99, 10**6, 99) == 100
    assert of(24, 24, 0, 0, 0, 0) == 30
    assert of(0, 10, 8, 0, 0, 0) == 16


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("Line 1\nLine 2\nLine 3")
    (tmp_path / "in/sub/b.csv").write_text("h1,h2\n1, 2\n\n3,4\n")
    (tmp_path / "in/bad.md").write_bytes(b"\xff\xfe")
    rows = {r.filename: r for r in files.scanned(spark, str(tmp_path / "in")).collect()}
    assert (rows["a.txt"].text_chars, rows["a.txt"].line_count, rows["a.txt"].tier) == (20, 3, 1)
    assert rows["bad.md"].error and len(rows) == 3
    texts = {r.path.rsplit("/")[-1]: r for r in files.texts(spark, str(tmp_path / "in/sub")).collect()}
    assert texts["b.csv"].text == "h1 | h2\n1 |  2\n3 | 4"
    meta = files.csv_metadata(spark, str(tmp_path / "in/sub/b.csv")).first()
    assert (meta.row_count, meta.headers, meta.sample_rows) == (4, ["h1", "h2"], [["1", " 2"], [], ["3", "4"]])
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"schema_version": 1, "project": "p", "output_dir": "o", "files": [{"id": "x", "path": "a.pdf"}]}))
    entry = files.manifest(spark, str(m)).first()
    assert (entry.name, entry.doc_type, entry.project) == ("x", "document", "p")
    m.write_text(json.dumps({"schema_version": 2, "files": [{"id": "x", "path": "a.pdf"}]}))
    with pytest.raises(Exception, match="manifest version"):
        files.manifest(spark, str(m)).collect()
    assert files.status(spark, str(tmp_path / "none")).count() == 0
    line = json.loads(sinks.batch_requests(spark.createDataFrame([("k", "ask")], "key string, prompt string")).first()[0])
    assert line["request"]["contents"][0]["parts"][0]["text"] == "ask"


def test_note_round_trip(spark, tmp_path):
    slide = (1, 0, "S", "0:10", "i", "so", "careful", ["f"])
    row = ("p", "a.pdf", 'A "b"', "general", "Sum.", ["t"], ["one"], [slide], [("odd", "unverified", ["why", "how"]), ("fine", "verified", [])])
    schema = f"package string, path string, title string, doc_type string, summary string, topics array<string>, key_points array<string>, slides {notes.FIELDS['slides']}, facts {notes.FIELDS['facts']}"
    made = notes.complete(spark.createDataFrame([row], schema), F.lit("2024-05-06 07:08:09").cast("timestamp"))
    (path, text), = ((r.path, r.value) for r in notes.note_files(made).collect())
    assert path == "p/extract/2024-05-06_a_0000.md"
    (tmp_path / "a.md").write_text(text)
    (tmp_path / "index.md").write_text("no")
    back = files.yaml_values(files.notes(spark, str(tmp_path))).select(J.field(F.col("fields"), "title").alias("t"), J.field(F.col("fields"), "source").alias("s"), J.field(F.col("fields"), "tags[1]").alias("tag")).collect()
    assert [(r.t, r.s, r.tag) for r in back] == [('A "b"', "a.pdf", "type/general")]
    body = text.split("---\n", 2)[2]
    assert body == (
        '\n# A "b"\n\n**Links:** [[t]]\n\n> Source: [Open original](file:///a.pdf)\n\nSum.\n\n'
        "## Section 1: S\n*0:10*\n\n![Section 1](../source/frames/slide_001.png)\n\ni\n\n**So what:** so\n\n> WARNING: careful\n\n**Key facts:**\n- f\n\n---\n\n\n"
        "## Key Takeaways\n\n- one\n\n\n## Flagged Facts\n\n> **UNVERIFIED:** odd> why; how\n"
    )
