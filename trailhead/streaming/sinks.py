"""Stream sinks that a replayed batch doesn't change: the batch's number is committed together with its rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailhead.sources.snapshots import BucketTable, Snapshots


class _Sink:
    def write(self, batch: DataFrame, number: int) -> bool:
        raise TypeError("a sink defines how it writes")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Write a stream here. A folder takes one stream: another one's batch numbers mean nothing to it."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.write(batch, number) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class AppendSink(_Sink):
    """Rows of a stream as a table that grows by a folder a batch. A batch whose number was committed is ignored; one that failed before the
    commit left files that no state names."""

    def __init__(self, spark: SparkSession, path: str, ddl: str):
        self.spark, self.path = spark, path
        self.snapshots, self.schema = Snapshots(spark, path), spark.createDataFrame([], ddl).schema

    def _state(self) -> tuple[int, dict]:
        n = self.snapshots.number()
        return n, self.snapshots.state(n) if n >= 0 else {"last": -1, "parts": []}

    def write(self, batch: DataFrame, number: int) -> bool:
        """Whether the batch was new."""
        n, state = self._state()
        if number <= state["last"]:
            return False
        part = f"{number}-{uuid.uuid4().hex}"
        batch.select(*self.schema.names).write.parquet(f"{self.path}/data/{part}")
        self.snapshots.commit({"last": number, "parts": [*state["parts"], part]}, n)
        return True

    def frame(self) -> DataFrame:
        parts = self._state()[1]["parts"]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{p}" for p in parts])


class LatestSink(_Sink):
    """The latest row per key of a stream, by an order column, in a bucketed table: a batch rewrites the buckets of its keys only. Rows older than what
    is there don't replace it, so late batches don't either."""

    def __init__(self, spark: SparkSession, path: str, ddl: str, key: str, order: str, buckets: int = 16):
        self.table, self.key, self.order = BucketTable(spark, path, ddl, key, buckets), key, order

    def write(self, batch: DataFrame, number: int) -> bool:
        n = self.table.snapshots.number()
        if n >= 0 and number <= self.table.snapshots.state(n).get("last", -1):
            return False
        names = self.table.schema.names
        rows = batch.select(*names).where(F.col(self.key).isNotNull())
        had = self.table.frame().join(rows.select(self.key).distinct(), self.key, "left_semi").select(*names)
        best = rows.union(had).withColumn("r", F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc(self.order), *[F.desc(c) for c in names])))
        self.table.apply(best.where("r = 1").drop("r"), tag={"last": number})
        return True

    def frame(self) -> DataFrame:
        return self.table.frame()
