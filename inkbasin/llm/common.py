"""Helpers shared by the operators: a shared work folder, tables that cut lineage, row keys."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but space and \\t to \\r.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows go to and from Python in batches of at most so many bytes (and one row at least), however long texts are.
BATCH_BYTES = 8 << 20


def work_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir, in it a folder of this application alone.

    Where the setting is missing, a local session gets a temporary folder; on a cluster that is an error, as executors
    would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="inkbasin-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/inkbasin/{spark.sparkContext.applicationId}"


def small_batches(spark: SparkSession) -> None:
    """Hold the Arrow batches of this session to BATCH_BYTES; a smaller limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.sparkContext._jvm.org.apache.spark.sql.internal.SQLConf.get().arrowMaxBytesPerBatch()
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Return what a reused Python worker has freed to the system; else Arrow's pool and the C heap keep it."""
    from inkbasin.llm import shingles

    shingles._powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(rows):
    """A function over batches that gives memory back when its task is over."""

    @functools.wraps(rows)
    def run(batches):
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def runs_of(batches, *keys: str):
    """Tables of rows with equal keys (integer columns), from batches sorted by them; a table may span batches."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        columns = [rows[k].to_numpy() for k in keys]
        new = functools.reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))
        at = [0, *(np.flatnonzero(new) + 1).tolist()]
        rows = rows.combine_chunks()
        for a, b in zip(at, at[1:]):
            yield rows.slice(a, b - a)
        held = rows.slice(at[-1])
    if held is not None:
        yield held


def lean_group(group):
    """The same for a function of one group, after each."""

    @functools.wraps(group)
    def run(rows):
        try:
            return group(rows)
        finally:
            give_back()

    return run


def lean_groups(groups):
    """The same for a function of two groups."""

    @functools.wraps(groups)
    def run(left, right):
        try:
            return groups(left, right)
        finally:
            give_back()

    return run


#: Spark's own clean-up of the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Queries within leave no shuffle files behind; a stage that needs them again is run again by Spark."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # small row groups: a writer holds one in memory
    with tidy(spark):
        df.write.option("parquet.block.size", 32 << 20).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing will read any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def purge(spark: SparkSession) -> None:
    """Delete every table that stored() wrote in this application; call it when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores before it until no column has it, upper and lower case alike."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(column: str = "doc_id"):
    """The id as text; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_keys(docs: DataFrame, column: str = "doc_id", tie: str = "text", name: str = "_rid") -> DataFrame:
    """Add `name`, a long that no two rows share and that orders rows by (column with nulls last, tie).

    Where the ids are distinct and not null, it is the id. Else the rows are sorted by range and numbered in a
    stored table, so that a recomputed task can't number them anew.
    """
    repeated = docs.groupBy(column).agg(F.count("*").alias("_n")).filter(F.col("_n").__gt__(1) | F.col(column).isNull()).limit(1)
    if not repeated.take(1):
        return docs.withColumn(name, F.col(column).cast("long"))
    ordered = docs.orderBy(F.col(column).asc_nulls_last(), F.col(tie).asc_nulls_first())
    return stored(ordered.withColumn(name, F.monotonically_increasing_id()), "keys")


def partitions_for(total: int, each: int) -> int:
    return max(1, -(-int(total or 0) // each))
