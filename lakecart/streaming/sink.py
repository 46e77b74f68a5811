"""A keyed table that a stream writes exactly once (idempotent delivery).

A micro-batch may be written, and the run then stop before the stream knows: it comes again
with the same batch id.  And a log may bring the same event twice, in any two batches.

* Each batch has its own folder, replaced as a whole when the batch comes again.
* A batch counts once its id is in the manifest, which is written after its rows; rows of a
  batch that stopped in between are not read.
* Readers keep one row per key, whichever batches brought it, the first (or last) in the
  order asked for.  :meth:`compact` folds committed batches into one.

All folders are below the table's path, on storage that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter


class KeyedTable:
    """Rows by ``keys``; of several rows of a key that of the smallest ``order`` is kept (the
    largest with ``latest``)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str],
                 latest: bool = False):
        self.spark, self.path, self.schema, self.keys, self.order, self.latest = spark, path.rstrip("/"), schema, keys, order, latest

    def _one_per_key(self, rows: DataFrame) -> DataFrame:
        others = [c for c in self.schema.names if c not in self.keys]
        pick = F.max_by if self.latest else F.min_by
        # ties of the order are settled by the whole row
        rank = F.struct(*self.order, F.xxhash64(*self.schema.names))
        return rows.groupBy(*self.keys).agg(pick(F.struct(*others), rank).alias("_r")).select(
            *[F.col(c) if c in self.keys else F.col(f"_r.{c}").alias(c) for c in self.schema.names])

    def write_rows(self, batch: DataFrame, batch_id: int) -> None:
        """The batch's rows, not yet committed."""
        rows = self._one_per_key(batch.select(*self.schema.names))
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")

    def commit(self, batch_id: int, replaces: list[int] | None = None) -> None:
        """Enter a batch in the manifest; batches it replaces no longer count."""
        row = self.spark.createDataFrame([(batch_id, replaces or [])], "batch long, replaces array<long>")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/entry={batch_id}")

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: rows first, then the manifest.  A batch that the manifest
        has is the same batch again: nothing to do."""
        if batch_id not in self.committed():
            self.write_rows(batch, batch_id)
            self.commit(batch_id)

    def _exists(self, folder: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def committed(self) -> list[int]:
        """Ids of the batches that count."""
        if not self._exists("manifest"):
            return []
        entries = self.spark.read.schema("batch long, replaces array<long>").parquet(f"{self.path}/manifest")
        gone = entries.select(F.explode("replaces").alias("batch"))
        return [r["batch"] for r in entries.join(gone, "batch", "left_anti").select("batch").collect()]

    def read(self) -> DataFrame:
        """One row per key from the committed batches."""
        folders = [f"{self.path}/rows/batch={b}" for b in self.committed()]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self._one_per_key(self.spark.read.schema(self.schema).parquet(*folders))

    def compact(self) -> None:
        """Fold the committed batches into one, which takes a negative id; readers see the
        old ones or the new one, never both."""
        ids = self.committed()
        if len(ids) > 1:
            into = min(0, *ids) - 1
            self.read().write.mode("overwrite").parquet(f"{self.path}/rows/batch={into}")
            self.commit(into, ids)


def deliver(events: DataFrame, table: KeyedTable, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """A writer that delivers a stream to a keyed table; start it with a trigger."""
    return events.writeStream.foreachBatch(table.write_batch).outputMode(mode).option("checkpointLocation", checkpoint)
