"""What the operators of this subpackage share: cutting lineage, checked broadcasts, connected components."""

from __future__ import annotations

import contextlib
import gc
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (long, few longs) up to which a side is broadcast: at most some 64 MB in memory. Beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


#: Rows and bytes of an Arrow batch that goes to a Python worker while a table is cut: executor and worker both hold a batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a folder under /tmp/checkpoints if all of Spark runs on this machine;
    on a cluster an error, as executors don't see one another's local folders."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (given or "file:///tmp/checkpoints").rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for what is run within; the session's settings come back at the end."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trailhead/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df once as a table in the shared folder and read it back: later plans restart from the files.

    The rows survive lost executors, the plan is short, and readers get column pruning. The path is on the
    returned frame as ``cut_path`` for ``discard``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that came from ``cut`` and that no later plan reads."""
    for df in frames:
        path = getattr(df, "cut_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Have the driver drop what no frame refers to any more: Spark's cleaner then removes finished steps' shuffle files and broadcasts
    from the executors, which else stay until the driver's heap happens to fill."""
    gc.collect()
    spark._jvm.System.gc()


def named(column: str) -> Column:
    """A column by its plain name, whatever characters that has."""
    return F.col(f"`{column.replace('`', '``')}`")


def map_batches(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """df.mapInArrow, also where names hold dots, which that call itself doesn't take; run finds df's columns by place."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough; else as it is, and the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (u long, v long): one row (node, root) per node that has an edge to
    another node; root is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Each round is two aggregations of
    minima with map-side combine and two equi-joins that AQE may split where a hub has many edges; no neighbourhood
    is ever gathered. Self-loops and edges with nulls are ignored; no edges give no rows.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = cut(e, "cc")
    state = _state(cur)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        near = star.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = cut(near.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = _state(nxt)
        discard(cur)
        cur, done = nxt, now == state
        state = now
        if done:
            break
    else:
        raise RuntimeError(f"components: no fixed point after {most_rounds} rounds")
    sweep(edges.sparkSession)
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def extend(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root), written, after more links (u, v): only links between different roots are worked on."""
    a, b = (comp.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("u", "v"))
    open_ = links.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")).where("u <> v").distinct()
    top = components(open_)
    up = top.select(F.col("node").alias("root"), F.col("root").alias("high"))
    moved = comp.join(up, "root", "left").select("node", F.coalesce("high", "root").alias("root"))
    return cut(moved.union(top.join(comp.select("node"), "node", "left_anti")), "cc-all")


def _state(df: DataFrame) -> tuple:
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]
