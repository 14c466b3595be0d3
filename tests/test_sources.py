"""Files under their own names: listing, writing with commit and abort, templates, packages in folders with odd names."""

import json
import os

import pytest
from pyspark.sql import functions as F

from inkbasin import layouts
from inkbasin.functions.template import TemplateError, compiled
from inkbasin.operators import extract, notes, packages
from inkbasin.sources import files, tree


def below(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


@pytest.fixture
def some(tmp_path):
    root = tmp_path / "in put"
    for name in ("b.txt", "a.MD", "z/empty.txt", "z/deep/er/c.mp4", ".hidden/x.txt", "z/.h.txt", "skip/y.txt", "e%20f/g+h.csv", "z/skip/no.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("" if "empty" in name else name)
    return root


def test_listing(spark, some, monkeypatch):
    found = files.listing(spark, str(some), exclude=("skip",), ordered=True).collect()
    assert [r.relative for r in found] == ["a.MD", "b.txt", "e%20f/g+h.csv", "z/deep/er/c.mp4", "z/empty.txt"]
    assert [r.size for r in found] == [4, 5, 13, 15, 0] and [r.extension for r in found] == [".md", ".txt", ".csv", ".mp4", ".txt"]
    assert [r.relative for r in files.listing(spark, str(some), recursive=False, ordered=True).collect()] == ["a.MD", "b.txt"]
    monkeypatch.chdir(some)
    assert [r.relative for r in files.listing(spark, "z", ordered=True).collect()] == ["deep/er/c.mp4", "empty.txt", "skip/no.txt"]
    assert {r.relative: r.content for r in files.listing(spark, f"file:{some}", content=True).filter("extension = '.txt'").collect()}["z/empty.txt"] == b""
    for bad in ("none", "b.txt"):
        with pytest.raises(ValueError, match="not a folder"):
            files.listing(spark, str(some / bad))
    scanned = {r.filename: r for r in files.scanned(spark, str(some), exclude=("skip",)).collect()}
    assert scanned["empty.txt"].text_chars == 0 and len(scanned) == 5
    (some / "v1.mp4").write_text("1")
    (some / "v2.MOV").write_text("1")
    videos = files.recordings(spark, str(some))
    assert [r.name for r in videos.collect()] == ["v1.mp4", "v2.MOV"]
    done = spark.createDataFrame([(str(some / "v1_compressed.mp4"),)], "path string")
    target = F.regexp_replace("path", r"(\.[^./]+)$", "_compressed$1")
    assert [r.name for r in files.without_target(videos, done, target).collect()] == ["v2.MOV"]


def test_listing_prunes(spark, some):
    """Excluded folders are not entered, filters are taken, and every folder is listed by one partition."""
    reader = tree.TreeReader({"path": str(some), "exclude": "skip", "folders": "2"})
    left = list(reader.pushFilters([tree.EqualTo(("extension",), ".txt"), tree.GreaterThan(("size",), 0), tree.EqualTo(("relative",), "b.txt")]))
    assert [f.attribute for f in left] == [("relative",)]
    parts = reader.partitions()
    assert len(parts) == 3 and not any("skip" in p.path or "hidden" in p.path for p in parts)
    assert [r["name"] for p in parts for b in reader.read(p) for r in b.to_pylist()] == ["b.txt"]
    plan = files.listing(spark, str(some)).filter("extension = '.txt' AND size > 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" not in plan or "extension" in plan


def test_writer(spark, tmp_path):
    root = tmp_path / "out put"
    write = lambda rows, mode="append", **options: notes.write_files(spark.createDataFrame(rows, "path string, value string").repartition(3), str(root), mode, **options)
    write([("a/x.md", "1"), ("a/b/y é.md", "ü\n"), ("z.json", None)])
    assert below(root) == {"a/x.md": "1", "a/b/y é.md": "ü\n", "z.json": ""}
    write([("a/x.md", "2")])
    assert below(root)["a/x.md"] == "2" and len(below(root)) == 3
    with pytest.raises(Exception, match="not a path below"):
        write([("a/x.md", "3"), ("../out.md", "no"), *((f"n/{i}", "x") for i in range(50))])
    assert below(root) == {"a/x.md": "2", "a/b/y é.md": "ü\n", "z.json": ""} and os.listdir(tmp_path) == ["out put"]
    write([("p/extract/1.md", "old"), ("p/index.md", "old")], unit=2)
    write([("p/extract/2.md", "new"), ("p/index.md", "new")], unit=2, history="run1")
    kept = {k: v for k, v in below(root).items() if k.startswith("p/")}
    assert kept == {"p/extract/2.md": "new", "p/index.md": "new", "p/.history/run1/extract/1.md": "old", "p/.history/run1/index.md": "old"}
    write([("only.md", "1")], "overwrite")
    assert below(root) == {"only.md": "1"}


def test_writer_attempts(spark, tmp_path):
    """A task that fails after some files runs again, and one that dies each time leaves nothing."""
    root, marks = tmp_path / "out", tmp_path / "marks"
    marks.mkdir()

    def failing(always):
        def run(batches):
            for batch in batches:
                yield batch
            if always or not (marks / "one").exists():
                (marks / "one").write_text("")
                raise RuntimeError("lost")

        return run

    rows = spark.createDataFrame([(f"p{i}/n.md", str(i)) for i in range(40)], "path string, value string").coalesce(1)
    with pytest.raises(Exception, match="lost"):
        notes.write_files(rows.mapInArrow(failing(True), "path string, value string"), str(root), unit=1)
    assert not root.exists() or os.listdir(root) == []
    from inkbasin.sources.filewriter import FileWriter

    writer = FileWriter({"path": str(root), "unit": "1"}, False)
    first, again = (writer.write(iter([{"path": "p/a.md", "value": v}, {"path": "p/b.md", "value": v}])) for v in ("1", "1"))
    writer.commit([None, again])
    assert below(root) == {"p/a.md": "1", "p/b.md": "1"} and first == again


def test_templates(spark):
    row = spark.sql("""SELECT 'a "b"' AS t, array('x', 'y "q"') AS l, CAST(NULL AS STRING) AS nothing, 3 AS n, 0.12345D AS cost, 'x/y.pdf' AS f, true AS yes, map('k', array('z')) AS m, parse_json('{"a": [1, {"b": null}]}') AS v,
      array(named_struct('i', 1, 'facts', array('p', 'q')), named_struct('i', 2, 'facts', CAST(NULL AS ARRAY<STRING>))) AS s, CAST(array() AS ARRAY<STRING>) AS e""")
    cases = {
        "plain {# note #}text": "plain text",
        "{{ t }} {{ nothing }} {{ missing }} {{ n }} {{ yes }}": 'a "b"   3 True',
        "{{ t | escaped }} {{ l | tojson }} {{ m | tojson }} {{ v | tojson }} {{ s | tojson }}": 'a \\"b\\" ["x", "y \\"q\\""] {"k": ["z"]} {"a":[1,{"b":null}]} [{"i": 1, "facts": ["p", "q"]}, {"i": 2, "facts": null}]',
        "{% if nothing %}a{% elif n > 2 and not e %}b{% else %}c{% endif %}": "b",
        "{{ missing | default('d') }} {{ nothing | default('e') }} {{ nothing or t }} {{ '%.4f' | format(cost) }} {{ '%03d' | format(n) }}": 'd e a "b" 0.1235 003',
        "{% set w = 'S' if f.endswith('.pdf') else 'T' %}\n{% for x in s %}\n{{ w }}{{ x.i }}{{ index }}:{% for y in x.facts %} {{ y }}{{ w }}{% endfor %}\n;\n{% endfor %}\nend": "S11: pS qS;\nS22:;\nend",
        "{{ 'x' in l }}{{ 'zz' not in t }}{{ n == 3 }}{{ missing is defined }}{{ t is defined }} {{ l | length }} {{ l | first | upper }} {{ l | join('; ') }} {{ f | replace('/', '\\\\') }}": 'TrueTrueTrueFalseTrue 2 X x; y "q" x\\y.pdf',
        "{% for x in missing %}no{% endfor %}{{ missing.deep }}{{ v.a }}": '[1,{"b":null}]',
        "{% if n is defined and n > 5 %}\nline\n{% endif %}\nnext": "next",
    }
    for text, expected in cases.items():
        assert row.select(compiled(text, row)).first()[0] == expected, text
    for bad in ("{% if t %}", "{{ t | nofilter }}", "{% endfor %}", "{{ t + }}", "{% for x in n %}{% endfor %}", "{{ open('x') }}", "{{ t.deep }}"):
        with pytest.raises(TemplateError):
            compiled(bad, row)
    from inkbasin.functions.template import Value

    own = {"shout": lambda v: Value(F.concat(v.text(), F.lit("!")), v.kind)}
    assert row.select(compiled("{{ f | shout }}", row, own)).first()[0] == "x/y.pdf!"


def test_package_of_records(spark, tmp_path):
    """Index, meta file, synthesis, transcript and both sidecar layouts by hand."""
    rows = [("My Pack", "in/Deck One.pptx", 0, "Deck", "deck", "Sum one.", "presentation", ["A", "b"], ["Ann"], ["p1", "p2"], "g"), ("My Pack", "in/Deck One.mp4", 1, "Film", "film", "Sum two.", "video", ["B", "c"], ["ann", "Bo"], ["p3"], "g"), ("Other", "x/solo.txt", 0, "Solo", "solo", "Alone.", "note", [], [], [], None)]
    records = spark.createDataFrame(rows, "package string, path string, pos int, title string, name string, summary string, content_type string, topics array<string>, people array<string>, key_points array<string>, group string")
    records = records.withColumn("raw", F.parse_json(F.lit('{"mine": [1], "processed_at": "then"}')))
    replies = spark.sql("""SELECT 'My Pack' AS package, parse_json('{"title": "Whole", "executive_summary": "Both.", "key_takeaways": ["k1", "k2"], "action_items": ["do"], "open_questions": ["q1", "q2"]}') AS reply""")
    pictures = spark.createDataFrame([("My Pack", "slide", "slide_001.png"), ("My Pack", "frame", "f.png"), ("Other", "frame", "f2.png"), ("Other", "frame", "f1.png")], "package string, kind string, name string")
    spoken = spark.createDataFrame([("My Pack", "in\\Deck One.mp4", "Film", "said", "complete", 3, 1, "l.md"), ("My Pack", "b.mp4", "t", "x", "failed", 3, 1, "l.md"), ("My Pack", "c.mp4", "t", " ", "complete", 3, 1, "l.md")], "package string, source_path string, title string, text string, status string, duration_min int, word_count int, linked_extraction string")
    now = F.lit("2024-05-06 07:08:09").cast("timestamp")
    made = notes.package_files(records, now, transcripts=spoken, syntheses=replies, pictures=pictures, model="m", pipeline_version="2", prompt_hash="h")
    notes.write_files(made, str(tmp_path / "out"), unit=2)
    found = below(tmp_path / "out")
    assert set(found) == {"My Pack/index.md", "My Pack/extract/_meta.yaml", "My Pack/extract/synthesis.md", "My Pack/extract/2024-05-06_deck_one_0000.md", "My Pack/extract/2024-05-06_deck_one_0000.json", "My Pack/extract/Deck One_transcript.md", "Other/index.md", "Other/extract/_meta.yaml", "Other/extract/synthesis.md", "Other/extract/2024-05-06_solo_0000.md", "Other/extract/2024-05-06_solo_0000.json"}
    assert found["My Pack/extract/synthesis.md"] == "# Synthesis\n\n## Executive Summary\n\nBoth.\n\n## Key Takeaways\n\n- k1\n- k2\n\n## Action Items\n\n- do\n\n## Open Questions\n\n- q1\n- q2"
    assert found["Other/extract/synthesis.md"] == "# Synthesis\n\n_Synthesis not available._\n"
    assert found["My Pack/index.md"] == (
        '---\nid: "my-pack"\ntitle: "Whole"\ndate: 2024-05-06\ntypes: ["presentation", "video"]\ntopics: ["A", "b", "c"]\npeople: ["Ann", "Bo"]\nproducts: []\nfile_count: 2\nmodel: "m"\n---\n\n# Whole\n\nBoth.\n\n## Contents\n\n'
        "### g\n\n- **Primary:** `deck` (presentation)\n- **Related:**\n  - `film` (video)\n\n\n## Key Takeaways\n\n- k1\n- k2\n\n## People Mentioned\n\n- Ann\n- Bo\n\n\n## Action Items\n\n- do\n\n## Open Questions\n\n- q1\n- q2\n"
    )
    assert found["Other/extract/_meta.yaml"] == 'extracted_at: "2024-05-06T07:08:09"\nmodel: "m"\npipeline_version: "2"\nprompt_hash: "h"\ncover_frame: "frames/f1.png"\nsource_files:\n  - path: "x/solo.txt"\n    type: "note"\n    size_bytes: \n'
    assert 'cover_slide: "slides/slide_001.png"' in found["My Pack/extract/_meta.yaml"] and "cover_frame" not in found["My Pack/extract/_meta.yaml"]
    assert found["My Pack/extract/Deck One_transcript.md"] == '---\ntype: transcript\nsource: in/Deck One.mp4\ntitle: "Film — Full Transcript"\nduration_min: 3\nword_count: 1\nlinked_extraction: l.md\n---\n\nsaid'
    side = json.loads(found["Other/extract/2024-05-06_solo_0000.json"])
    assert list(side) == layouts.SIDECAR and side["title"] == "Solo" and side["client"] is None and side["slides_count"] == 0
    own = {r.path: json.loads(r.value) for r in notes.sidecar_files(notes.complete(records, now), own_prompt=True).collect()}
    assert own["Other/extract/2024-05-06_solo_0000.json"] == {"source_file": "x/solo.txt", "processed_at": "then", "mine": [1]}


def test_package_names(spark, tmp_path, monkeypatch):
    """Roots with spaces, marks and relative ones, and folders inside a package that are named like the root."""
    pytest.importorskip("yaml")
    root = tmp_path / "my %20out+"
    for name in ("pkg a/extract/n 1.md", "pkg a/my %20out+/m.md", "b%c/x.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("---\ntitle: t\n---\n")
    (root / "top.md").write_text("---\ntitle: t\n---\n")
    (root / "pkg a/source/slides").mkdir(parents=True)
    (root / "pkg a/source/slides/s 1.png").write_bytes(b"x")
    monkeypatch.chdir(root)
    for path in (str(root), f"{root}/", f"../{root.name}", "."):
        assert sorted((r.package, r.note) for r in files.package_notes(spark, path).collect()) == [("b%c", "x.md"), ("pkg a", "m.md"), ("pkg a", "n 1.md")], path
        assert [(r.package, r.kind, r.name) for r in files.package_pictures(spark, path).collect()] == [("pkg a", "slide", "s 1.png")], path
    assert {r.slides for r in packages.evaluated(files.package_notes(spark, "."), files.package_pictures(spark, ".")).collect() if r.package == "pkg a"} == {1}
    assert {r.path for r in files.texts(spark, ".").collect() if r.path.endswith(".md")} == {r.path for r in files.listing(spark, ".").filter("extension = '.md'").collect()}


def test_reply_fields(spark):
    from inkbasin.functions.records import reply_fields

    replies = spark.sql("""SELECT parse_json('{"title": "", "type": "video", "topics": ["a", {"name": "N", "role": "r"}, null, 3], "slides": [{"slide_title": "x", "critical_notes": ""}, {"slide_number": "bad"}, {"slide_number": 7, "key_facts": ["f"]}], "duration_min": 4, "key_points": ["p"], "layer": "deep"}') AS v
      UNION ALL SELECT parse_json('[1]') UNION ALL SELECT CAST(NULL AS VARIANT)""")
    got = replies.select(*(c.alias(k) for k, c in reply_fields(F.col("v"), F.lit("file")).items())).collect()
    one = got[0]
    assert (one.title, one.content_type, one.layer, one.authority, one.topics, one.duration_min) == ("file", "video", "deep", "tribal", ["a", "N (r)", "3"], 4)
    assert [(s.slide_number, s.slide_title, s.critical_notes, s.key_facts) for s in one.slides] == [(1, "x", None, []), (2, "", None, []), (7, "", None, ["f"])]
    assert [str(x) for x in one.key_facts] == ['"p"'] or len(one.key_facts) == 1
    for r in got[1:]:
        assert (r.title, r.content_type, r.summary, r.language, r.topics, r.slides, r.client) == ("file", "unknown", "", "en", [], [], None)


def test_large_csv(spark, tmp_path):
    """Pieces of a file that begin inside a cell."""
    import csv

    rows = [["h1", "h, 2"], *([str(i), "line\n" * (i % 50) + '"quoted", x'] for i in range(4000)), [], ["end"]]
    with open(tmp_path / "big one.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
    (tmp_path / "open.csv").write_text('a,b\n"never closed\nc')
    (tmp_path / "short.csv").write_text("only")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(tmp_path / "big one.csv")).rdd.getNumPartitions() > 5
        got = {r.file.rpartition("/")[2]: r for r in files.csv_metadata(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    big = got["big one.csv"]
    assert (big.row_count, big.headers, big.sample_rows) == (len(rows), rows[0], rows[1:4])
    assert (got["open.csv"].row_count, got["open.csv"].sample_rows) == (2, [["never closed\nc\n"]])
    assert (got["short.csv"].row_count, got["short.csv"].headers, got["short.csv"].sample_rows) == (1, ["only"], [])


def test_facts_and_quality(spark):
    """Facts of a reply as objects with places, else its points; the larger of two sources of specific facts."""
    raw = '{"facts": [{"fact": "Uptime of 99 percent", "page": 3}, {"text": "Half of 40 units", "slide": "2"}, {"page": 1}]}'
    records = spark.createDataFrame([("a.pdf", raw, ["p"]), ("b.txt", '{"facts": ["x"]}', ["Costs of 7 units"]), ("c.txt", None, None)], "path string, raw string, key_points array<string>").withColumn("raw", F.parse_json("raw"))
    texts = spark.createDataFrame([("a.pdf", "99 percent and 40"), ("b.txt", "8"), ("c.txt", "")], "path string, text string")
    got = [(r.path, r.pos, r.fact, r.verification_status) for r in extract.facts_of(records, texts, 2026).orderBy("path", "pos").collect()]
    assert got == [("a.pdf", 0, "Uptime of 99 percent", "verified"), ("a.pdf", 1, "Half of 40 units", "verified"), ("a.pdf", 2, "", "verified"), ("b.txt", 0, "Costs of 7 units", "unverified")]
    long = "A fact that says more than thirty characters."
    row = ("p", "x", [long] * 3, [(long, "verified", []), ("short", "unverified", [])], '{"a": 1, "b": []}', "s" * 900, ["t" * 100], ["e"])
    one = spark.createDataFrame([row], f"package string, path string, key_facts array<string>, facts {notes.FIELDS['facts']}, overlay string, summary string, key_points array<string>, entities_mentioned array<string>")
    as_variants = lambda c: F.try_variant_get(F.parse_json(F.to_json(c)), "$", "array<variant>")
    one = one.withColumns({"key_facts": as_variants("key_facts"), "entities_mentioned": as_variants("entities_mentioned"), "overlay": F.parse_json("overlay")})
    # three specific facts, half verified, two overlay fields, a thousand characters, one entity
    assert notes.complete(one, F.current_timestamp()).first().quality_score == 6 + 10 + 8 + 3 + 3
