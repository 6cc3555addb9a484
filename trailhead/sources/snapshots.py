"""Committed state in a folder: a pointer that switches atomically, and a bucketed table on it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhead.operators.graph import shared_dir


class Conflict(RuntimeError):
    """Another writer committed first; the state that was read is no longer the latest."""


class Snapshots:
    """Numbered states of a folder, each a small JSON document. A state is there whole or not at all: it is written aside and renamed to its
    number, which fails if that exists. Readers name a number or take the latest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), conf)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def number(self) -> int:
        """The latest state's number; -1 before the first."""
        return max((int(n.removesuffix(".json")) for n in self.names(f"{self.path}/states") if n.endswith(".json")), default=-1)

    def state(self, number: int) -> dict:
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/states/{number}.json").collect()  # one small document
        return json.loads(rows[0][0])

    def commit(self, state: dict, after: int) -> int:
        """Make state the one after number ``after``; Conflict if that one was followed already."""
        aside, final = f"{self.path}/states/.{uuid.uuid4().hex}", f"{self.path}/states/{after + 1}.json"
        out = self._fs.create(self._path(aside), False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(self._path(aside), self._path(final), none)
        except Exception as e:
            self.delete(aside)
            if self._fs.exists(self._path(final)):
                raise Conflict(f"state {after + 1} of {self.path} exists") from e
            raise
        return after + 1


class BucketTable:
    """A keyed table in buckets of a hash of its key. A change rewrites the buckets that it touches, beside the old ones, and then switches the
    pointer: a failed write leaves the old state, and untouched buckets keep their files."""

    def __init__(self, spark: SparkSession, path: str, ddl: str, key: str, buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.snapshots = Snapshots(spark, path)
        self.schema = spark.createDataFrame([], ddl).schema

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def frame(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a state, the latest by default, or of some of its buckets."""
        number = self.snapshots.number() if number is None else number
        at = self.snapshots.state(number)["buckets"] if number >= 0 else {}
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in at.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def apply(self, upserts: DataFrame | None, deletes: DataFrame | None = None, tag: dict | None = None) -> int:
        """Commit upserts (all columns; of rows with one key the greatest stays) and deletes (column key); the new state's number.

        A key that is in both is upserted. Rows without a key are left out. tag: what else is committed in the same state.
        """
        names = self.schema.names
        new = self.spark.createDataFrame([], self.schema) if upserts is None else upserts.select(*names)
        new = new.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*names)).alias("r")).select("r.*")
        gone = new.select(self.key) if deletes is None else new.select(self.key).union(deletes.select(self.key)).distinct()
        number = self.snapshots.number()
        touched = sorted(r[0] for r in gone.select(self._bucket().alias("b")).distinct().collect())  # at most a row per bucket
        at = dict(self.snapshots.state(number)["buckets"]) if number >= 0 else {}
        if touched:
            old = self.frame(number, touched) if number >= 0 else self.spark.createDataFrame([], self.schema)
            rows = old.join(gone, self.key, "left_anti").select(*names).union(new.select(*names)).withColumn("bucket", self._bucket())
            version = uuid.uuid4().hex
            folder = f"{self.path}/data/v={version}"
            rows.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(folder)
            made = {n.removeprefix("bucket=") for n in self.snapshots.names(folder) if n.startswith("bucket=")}
            at = {b: v for b, v in at.items() if int(b) not in touched} | dict.fromkeys(made, version)
        return self.snapshots.commit((tag or {}) | {"buckets": at}, number)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete what none of the last ``keep`` states refers to; the folders deleted."""
        last = self.snapshots.number()
        used = {(v, b) for n in range(max(0, last - keep + 1), last + 1) for b, v in self.snapshots.state(n)["buckets"].items()}
        lost = []
        for v in self.snapshots.names(f"{self.path}/data"):
            for b in self.snapshots.names(f"{self.path}/data/{v}"):
                if b.startswith("bucket=") and (v.removeprefix("v="), b.removeprefix("bucket=")) not in used:
                    lost.append(f"{self.path}/data/{v}/{b}")
        for folder in lost:
            self.snapshots.delete(folder)
        return lost


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new folder for a table in the shared folder."""
    return f"{shared_dir(spark)}/trailhead/{name}-{uuid.uuid4().hex}"
