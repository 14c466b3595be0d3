"""Command line: python -m inkbasin.cli COMMAND ... (scan, info, process, manifest, reextract, evaluate, compare_packages, compare, query)."""

from __future__ import annotations

import argparse
import os
import sys

from inkbasin.operators import extract, packages, routing
from inkbasin.operators import process as whole
from inkbasin.session import session
from inkbasin.sources import files, sinks


def scan(spark, a):
    rows = files.scanned(spark, a.path, not a.flat).drop("preview")
    sinks.write_scan(rows, a.out) if a.out else rows.select("filename", "extension", "size", "tier", "error").show(1000, False)


def info(spark, a):
    """What a folder would cost by tier."""
    routing.cost_by_tier(whole.folder_texts(spark, a.path)).orderBy("tier").show()


def _prompt(a) -> dict:
    return {"template": open(a.prompt_file).read() if a.prompt_file else whole.PROMPT, "own_prompt": bool(a.prompt_file)}


def process(spark, a):
    """Route, extract and write a package; with --dry-run only the cost."""
    if a.dry_run:
        return routing.cost_by_tier(whole.folder_texts(spark, a.path, a.tier)).orderBy("tier").show()
    name = a.name or os.path.basename(files.absolute(spark, a.path).rstrip("/"))
    whole.package_folder(spark, a.path, files.absolute(spark, a.out), name, force_tier=a.tier, model=a.model, provider=a.provider, context=a.context or "", **_prompt(a)).show(1000, False)


def manifest(spark, a):
    """Extract what a manifest names and is not done yet, and show where its entries stand."""
    whole.run_manifest(spark, a.path, a.root, a.status, a.out, a.force, model=a.model, provider=a.provider).orderBy("id").show(1000, False)


def reextract(spark, a):
    """Extract a package anew from its sources; the notes before go to its .history."""
    whole.reextract(spark, a.path, model=a.model, provider=a.provider).show(1000, False)


def _files(spark, root: str):
    return packages.evaluated(files.package_notes(spark, root), files.package_pictures(spark, root))


def _folders(spark, root: str):
    return files.package_notes(spark, root).select("package").distinct()


def evaluate(spark, a):
    """Scores of the packages in a folder and of their notes."""
    each = _files(spark, a.path)
    packages.package_scores(_folders(spark, a.path), each).orderBy("package").show(1000, False)
    shown = ("package", "note", "title", "score", "key_facts", "specific", "entities", "topics", "chars", "overlay_type", "populated", "fresh", "slides", "frames", "slide_coverage", "issues")
    each.select(*shown).orderBy("package", "note").show(1000, False)


def compare_packages(spark, a):
    """Two runs of the packages in a folder: scores and the changes of every note."""
    old, new = _files(spark, a.old), _files(spark, a.new)
    scores = [packages.package_scores(_folders(spark, p), f) for p, f in ((a.old, old), (a.new, new))]
    packages.package_changes(*scores).orderBy("package").show(1000, False)
    packages.compared(old, new).orderBy("package", "note").show(1000, False)


def compare(spark, a):
    """Two folders of reports; with --fail-on-regression the exit code is 1 if one got worse."""
    shown, verdicts = whole.compare_reports(spark, a.old, a.new)
    shown.orderBy("report").show(1000, False)
    verdicts.orderBy("report").show(1000, False)
    for r in extract.comparison_note(verdicts, "report").toLocalIterator():
        print(r.text)
    if a.fail_on_regression and verdicts.filter("regressions > 0").take(1):
        return 1


def query(spark, a):
    from inkbasin.plans.registry import QUERIES

    QUERIES[a.name](spark, a.data).show(a.rows, False)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="inkbasin")
    commands = top.add_subparsers(required=True)

    def command(f, *arguments):
        p = commands.add_parser(f.__name__, help=f.__doc__)
        for names, options in arguments:
            p.add_argument(*names, **options)
        p.set_defaults(run=f)

    flag = {"action": "store_true"}
    path = (["path"], {})
    asked = ((["--model"], {"default": "rules"}), (["--provider"], {"default": "rules"}))
    command(scan, path, (["--out"], {}), (["--flat"], flag))
    command(info, path)
    command(process, path, (["--out"], {"default": "extract"}), (["--dry-run"], flag), (["--name"], {}), (["--tier"], {"type": int}), (["--prompt-file"], {}), (["--context"], {}), *asked)
    command(manifest, path, (["--status"], {"default": "status"}), (["--root"], {"default": "."}), (["--out"], {}), (["--force"], flag), *asked)
    command(reextract, path, *asked)
    command(evaluate, path)
    command(compare_packages, (["old"], {}), (["new"], {}))
    command(compare, (["old"], {}), (["new"], {}), (["--fail-on-regression"], flag))
    command(query, (["name"], {}), (["data"], {}), (["--rows"], {"type": int, "default": 20}))
    a = top.parse_args(argv)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    return a.run(spark, a) or 0


if __name__ == "__main__":
    sys.exit(main())
