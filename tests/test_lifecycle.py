"""From files to a package: scan, route, extract, check facts, write notes; a second run has nothing to do."""

from pyspark.sql import functions as F

from inkbasin.functions import jsonrepair as J
from inkbasin.functions import text as T
from inkbasin.functions.classify import file_type
from inkbasin.operators import extract, packages, reports, resume, routing
from inkbasin.sources import files, sinks


def test_files_to_package(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/small.md").write_text("A note on storage. " * 20)
    (tmp_path / "in/large.txt").write_text("Sales grew to 42 units. " + "The platform serves regions. " * 300)
    (tmp_path / "in/short.txt").write_text("Little.")
    texts = files.texts(spark, str(tmp_path / "in")).withColumns({"type": file_type(F.col("path")), "name": T.stem(F.col("path")), "doc_type": F.lit("general")})
    routed = routing.routed(texts)
    assert {r.name: r.tier for r in routed.collect()} == {"small": 1, "large": 2, "short": 3}
    done = extract.extracted(routed, "Extract from a {doc_type} document.", "rules")
    got = {r.name: r for r in done.collect()}
    assert got["small"].title == "small" and got["small"].quality == "local"
    assert got["large"].key_points == ["Sales grew to 42 units."] and got["large"].error is None
    assert got["short"].title == "Little."
    facts = extract.facts_of(done, texts, 2026)
    assert [(r.fact, r.verification_status) for r in facts.collect()] == [("Sales grew to 42 units.", "verified")]
    ready = done.filter("error is null").withColumn("package", F.lit("My Package"))
    root = tmp_path / "out put"
    extract.package(ready, facts, str(root))
    written = {str(p.relative_to(root / "My Package")) for p in root.rglob("*") if p.is_file()}
    day = written_day(written)
    names = [f"extract/{day}_{n}_0000" for n in ("small", "large", "short")]
    assert written == {*(n + ".md" for n in names), *(n + ".json" for n in names), "index.md", "extract/_meta.yaml", "extract/synthesis.md"}
    back = {r.note: r for r in packages.evaluated(files.package_notes(spark, str(root)), files.package_pictures(spark, str(root))).collect()}
    assert set(back) == {n.removeprefix("extract/") + ".md" for n in names} and {r.package for r in back.values()} == {"My Package"}
    assert back[f"{day}_large_0000.md"].key_facts == 1 and back[f"{day}_large_0000.md"].title == got["large"].title
    side = {r.title: r for r in spark.read.json(str(root / "My Package/extract")).filter("schema_version = 2").collect()}
    assert side["Little."].depth is None and side["Little."].source_type == "documentation" and side["Little."].id == f"{day}_short_0000"
    hashed = texts.select("path", F.sha2("text", 256).alias("source_hash"))
    assert resume.changed(hashed, hashed).count() == 0


def written_day(paths):
    """The day in the names of notes: a run may cross midnight."""
    return next(p for p in paths if p.endswith("_small_0000.md")).removeprefix("extract/")[:10]


def test_notes(spark):
    run = lambda *x: spark.createDataFrame([("r", *x)], "report string, avg_length double, junk int, general_percent double")
    for old, new, verdict in (((100.0, 1, 10.0), (120.0, 1, 10.0), "improved"), ((100.0, 1, 10.0), (80.0, 1, 10.0), "degraded"), ((100.0, 1, 10.0), (120.0, 2, 10.0), "mixed"), ((100.0, 1, 10.0), (105.0, 1, 15.0), "unchanged")):
        got = reports.verdict(run(*old), run(*new), "report")
        assert got.first().verdict == verdict
        assert f"Verdict: {verdict}" in extract.comparison_note(got, "report").first().text


def test_archive(spark, tmp_path):
    path, history = str(tmp_path / "extract"), str(tmp_path / "history")
    sinks.archive(spark.range(2), path, history)
    sinks.archive(spark.range(5), path, history)
    assert spark.read.json(path).count() == 5
    assert spark.read.option("recursiveFileLookup", "true").json(history).count() == 2


def test_overlay_by_type(spark):
    v = spark.sql("""SELECT parse_json('{"base": {}, "training_overlay": {"attendees": ["A"]}}') AS v, 'training' AS t""")
    assert v.select(F.to_json(J.overlay(F.col("v"), F.col("t")))).first()[0] == '{"attendees":["A"]}'
