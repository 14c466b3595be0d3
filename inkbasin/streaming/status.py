"""A status table that streams keep: the latest row of each id, a version a batch, replays without effect.

Every batch is a folder of its own, `v-<batch>`, that appears by one rename when it is written; a batch whose folder is
there was committed before and is skipped, so a replay after a crash adds nothing. A crash between writing and renaming
leaves a folder that readers don't see and the next run of the batch replaces. Readers take the latest row of each id
from the last snapshot and the batches after it; a snapshot is made every few batches, so a batch costs its own rows
and not the table's.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StatusTable:
    """Rows of `schema` with an id and an order column below `root`; `snapshot_every` batches are merged into one."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "id", order: str = "processed_at", snapshot_every: int = 20):
        self.spark, self.root, self.schema, self.key, self.order, self.every = spark, root.rstrip("/"), schema, key, order, snapshot_every
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, kind: str) -> list[int]:
        """Numbers of the batches (v) or snapshots (s) that are committed."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{kind}-(\d+)", n)))

    def _commit(self, rows: DataFrame, name: str) -> bool:
        """Write rows under another name and rename; False if someone else was first."""
        fresh, final = self._path(f"{self.root}/_new-{name}"), self._path(f"{self.root}/{name}")
        rows.write.mode("overwrite").parquet(fresh.toString())
        if self._fs.exists(final) or not self._fs.rename(fresh, final):
            self._fs.delete(fresh, True)
            return False
        return True

    def version(self) -> int:
        """The last batch that is committed, -1 before the first."""
        return max([-1, *self._there("v"), *self._there("s")])

    def _latest(self, rows: DataFrame) -> DataFrame:
        names = [f for f in rows.columns if f not in (self.key, "_batch")]
        whole = F.struct(*names, "_batch")
        # of equal times the later batch holds, then the greater row
        return rows.groupBy(self.key).agg(F.max_by(whole, F.struct(self.order, "_batch", F.to_json(whole))).alias("_r")).select(self.key, *(f"_r.{n}" for n in names), "_r._batch")

    def _all(self, upto: int | None = None) -> DataFrame:
        batches, snapshots = self._there("v"), self._there("s")
        if upto is not None:
            batches, snapshots = [b for b in batches if b <= upto], [s for s in snapshots if s <= upto]
        last = snapshots[-1] if snapshots else -1
        paths = [f"{self.root}/s-{last:012d}"] * bool(snapshots) + [f"{self.root}/v-{b:012d}" for b in batches if b > last]
        schema = f"{self.schema}, _batch long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The latest row of each id, as of a batch or now."""
        return self._latest(self._all(version)).drop("_batch")

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Commit the rows of a batch, once: what foreachBatch calls."""
        if batch <= max([-1, *self._there("s")]) or batch in self._there("v"):
            return
        named = rows.select(*(f.partition(" ")[0] for f in self.schema.split(", "))).withColumn("_batch", F.lit(batch).cast("long"))
        self._commit(self._latest(named), f"v-{batch:012d}")
        last = max([-1, *self._there("s")])
        if sum(b > last for b in self._there("v")) >= self.every:
            self._commit(self._latest(self._all(batch)), f"s-{batch:012d}")

    def follow(self, stream: DataFrame, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None):
        """Merge what has arrived in a stream of status rows (or of what process makes status rows of), batch by batch."""
        query = stream.writeStream.foreachBatch(lambda rows, batch: self.merge(process(rows) if process else rows, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query


def first_seen(files: DataFrame, content: str = "source_hash", arrived: str = "arrived", within: str = "1 day") -> DataFrame:
    """A stream of files without those whose content came before, by keyed state that expires.

    A content is remembered for `within` after its first row. The same content later than that is new again; a row that
    is older than the latest one seen (over all batches before) by more than `within` is late and dropped. Null contents
    count as one.
    """
    return files.withWatermark(arrived, within).dropDuplicatesWithinWatermark([content])
