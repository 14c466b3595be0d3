"""Whole runs of folders, packages, manifests and reports; status of streams that are interrupted; state that expires."""

import datetime
import json

import pytest

from inkbasin import cli, providers
from inkbasin.operators import process
from inkbasin.sources import files
from inkbasin.streaming import status

LONG = "Sales grew to 42 units. " + "The platform serves regions. " * 300


def picky():
    class Picky(providers.RuleProvider):
        def extract(self, prompt, model, max_tokens):
            if "refuse" in prompt:
                raise ValueError("no")
            return providers.RuleProvider().extract(prompt, model, max_tokens)

    return lambda: Picky()


def texts_in(folder, **texts):
    folder.mkdir(parents=True)
    for name, text in texts.items():
        (folder / f"{name}.md").write_text(text)


def test_package_and_reextract(spark, tmp_path):
    pack = tmp_path / "packs/My Pack"
    texts_in(pack / "source", good=LONG, bad=LONG + "refuse")
    failed = process.package_folder(spark, str(pack / "source"), str(tmp_path / "packs"), "My Pack", provider=picky()).collect()
    assert [(r.path.rpartition("/")[2], r.error) for r in failed] == [("bad.md", "ValueError: no")]
    first = {p.name for p in (pack / "extract").iterdir()}
    assert len(first) == 4 and {"_meta.yaml", "synthesis.md"} < first and (pack / "index.md").exists()
    (pack / "extract/mine.txt").write_text("x")
    process.reextract(spark, str(pack), model="m-2").count()
    assert len(list((pack / "extract").iterdir())) == 6
    kept = list((pack / ".history").glob("*_m_2/extract/*"))
    assert {p.name for p in kept} == first | {"mine.txt"}
    (pack / "extract/mine.txt").write_text("y")

    class Never(providers.RuleProvider):
        def extract(self, *a):
            raise ValueError("down")

    with pytest.raises(RuntimeError, match="nothing was extracted"):
        process.reextract(spark, str(pack), provider=lambda: Never())
    assert (pack / "extract/mine.txt").read_text() == "y" and len(list((pack / ".history").iterdir())) == 1
    with pytest.raises(ValueError, match="not a folder"):
        process.reextract(spark, str(tmp_path / "packs"))


def test_own_prompt(spark, tmp_path):
    texts_in(tmp_path / "in", a=LONG)
    process.package_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), "p", own_prompt=True, template="Mine {doc_type}").count()
    (side,) = (tmp_path / "out/p/extract").glob("*.json")
    assert set(json.loads(side.read_text())) == {"source_file", "processed_at", "title", "summary", "key_points"}


def test_manifest_run(spark, tmp_path):
    texts_in(tmp_path / "in", one=LONG, two=LONG + "refuse", three="Short note of a few words. " * 20)
    m = tmp_path / "m.json"
    entry = lambda i, **more: {"id": i, "path": f"{i}.md", **more}
    m.write_text(json.dumps({"schema_version": 1, "project": "P", "output_dir": str(tmp_path / "out"), "files": [entry("one", client="C", project="Q"), entry("two"), entry("three", doc_type="note"), entry("gone")]}))
    run = lambda **more: {r.id: (r.status, r.error) for r in process.run_manifest(spark, str(m), str(tmp_path / "in"), str(tmp_path / "status"), provider=picky(), **more).collect()}
    assert run() == {"one": ("done", None), "two": ("error", "ValueError: no"), "three": ("done", None), "gone": ("error", f"File not found: {tmp_path}/in/gone.md")}
    (note,) = (tmp_path / "out/Q/extract").glob("*_one_*.md")
    assert 'client: "C"' in note.read_text() and 'project: "Q"' in note.read_text()
    (tmp_path / "in/gone.md").write_text(LONG)
    assert run()["gone"] == ("done", None) and run()["two"][0] == "error"
    assert {p.name[11:15] for p in (tmp_path / "out/P/extract").glob("*.json")} == {"thre", "gone"}


def test_report_folders(spark, tmp_path, monkeypatch):
    def report(run, name, explanation, frames, lines):
        folder = tmp_path / run / name
        (folder / "frames").mkdir(parents=True)
        (folder / "report.md").write_text(f"# A\n\n## One\n**Speaker Explanation:** {explanation}\n\n# B\n## Two\n**Speaker Explanation:** {explanation}\n")
        (folder / "knowledge.jsonl").write_text("".join(json.dumps({"question": q, "answer": "a"}) + "\n" for q in lines) + "broken\n\n")
        for i in range(frames):
            (folder / f"frames/f{i}.png").write_bytes(b"x")

    report("old", "r 1", "word " * 40, 2, ["q"])
    report("new", "r 1", "word " * 20, 3, ["q", "p"])
    report("new", "r2", "word " * 20, 0, [])
    shown, verdicts = process.compare_reports(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    rows = {r.report: r for r in shown.collect()}
    assert (rows["r 1"].old_frames, rows["r 1"].new_frames, rows["r 1"].old_questions, rows["r 1"].new_questions, rows["r 1"].degraded) == (2, 3, 1, 2, 2)
    assert rows["r2"].new_questions == 0 and rows["r2"].old_frames is None
    assert [(r.report, r.verdict, r.regressions) for r in verdicts.collect()] == [("r 1", "degraded", 1)]
    alone = files.report_folders(spark, str(tmp_path / "old/r 1"))
    assert [(r.report, r.frames, r.questions) for r in alone.counts.collect()] == [(".", 2, 1)]
    with pytest.raises(ValueError, match="not a folder"):
        files.report_folders(spark, str(tmp_path / "none"))
    monkeypatch.setattr(cli, "session", lambda: spark)
    arguments = ["compare", str(tmp_path / "old"), str(tmp_path / "new")]
    assert cli.main(arguments) == 0 and cli.main([*arguments, "--fail-on-regression"]) == 1


SCHEMA = "id string, status string, processed_at string"


def test_status_table(spark, tmp_path, monkeypatch):
    """A crash between writing and commit, a replay, equal times, snapshots and reading an older version."""
    landing, out = tmp_path / "in", tmp_path / "table"
    landing.mkdir()
    table = status.StatusTable(spark, str(out), SCHEMA, snapshot_every=2)
    state = lambda **k: {r.id: r.status for r in table.read(**k).collect()}
    follow = lambda: table.follow(spark.readStream.schema(SCHEMA).json(str(landing)), str(tmp_path / "check"))
    put = lambda name, *rows: (landing / f"{name}.json").write_text("".join(json.dumps(dict(zip(("id", "status", "processed_at"), r))) + "\n" for r in rows))
    assert state() == {} and table.version() == -1
    put("a", ("x", "pending", "1"), ("x", "error", "2"), ("y", "done", "1"))
    follow()
    assert state() == {"x": "error", "y": "done"} and table.version() == 0
    put("b", ("x", "done", "3"), ("y", "late", "0"), ("z", "done", "1"))
    commit = table._commit

    def crashed(rows, name):
        rows.write.mode("overwrite").parquet(f"{out}/_new-{name}")
        raise RuntimeError("lost")

    monkeypatch.setattr(table, "_commit", crashed)
    with pytest.raises(Exception, match="lost"):
        follow()
    assert state() == {"x": "error", "y": "done"}
    monkeypatch.setattr(table, "_commit", commit)
    follow()
    after = {"x": "done", "y": "done", "z": "done"}
    assert state() == after and table._there("s") == [1] and not list(out.glob("_new-*"))
    table.merge(spark.createDataFrame([("x", "again", "9")], SCHEMA), 1)
    table.merge(spark.createDataFrame([("x", "again", "9")], SCHEMA), 0)
    assert state() == after and state(version=0) == {"x": "error", "y": "done"}
    table.merge(spark.createDataFrame([("x", "same time", "3")], SCHEMA), 5)
    assert state() == {**after, "x": "same time"} and table.version() == 5


def test_first_seen(spark, tmp_path):
    """Copies in one batch, in a later one and after expiry; late rows; a rerun."""
    landing = tmp_path / "in"
    landing.mkdir()
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m).isoformat()
    batches = [[("a", at(10)), ("a", at(10)), ("b", at(10, 5))], [("a", at(10, 30)), ("c", at(12)), (None, at(12))], [("a", at(12, 30)), ("d", at(9)), ("c", at(12, 10)), (None, at(12, 1))]]
    seen = []

    def run():
        stream = spark.readStream.schema("source_hash string, arrived timestamp").option("maxFilesPerTrigger", 1).json(str(landing))
        fresh = status.first_seen(stream, within="1 hour")
        fresh.writeStream.foreachBatch(lambda rows, n: seen.extend((r.source_hash, r.arrived.strftime("%H:%M")) for r in rows.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    for i, rows in enumerate(batches):
        (landing / f"{i}.json").write_text("".join(json.dumps({"source_hash": h, "arrived": t}) + "\n" for h, t in rows))
        run()
        run()
    assert sorted(seen, key=str) == sorted([("a", "10:00"), ("b", "10:05"), ("c", "12:00"), (None, "12:00"), ("a", "12:30")], key=str)
