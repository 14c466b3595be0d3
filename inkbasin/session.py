"""The session that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | None = None, **settings: str) -> SparkSession:
    """A session with UTC, ANSI and AQE on; local unless a master is set."""
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    builder = SparkSession.builder.appName("inkbasin").config(map=conf)
    if not os.environ.get("MASTER"):
        builder = builder.master(f"local[{cores}]")
    return builder.getOrCreate()
