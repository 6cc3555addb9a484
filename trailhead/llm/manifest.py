"""Merkle manifest of a dataset: a store of tree nodes in external memory, inclusion proofs and their folding.

* Leaves are hashed in one narrow pass and written; texts are never shuffled.
* Sorted runs: leaves are dealt by ranges of (group, order) and sorted there, so a group with a third of all rows is many runs. A leaf's
  coordinate (group, position) is its place in its run plus the leaves of its group in earlier runs: counts per run and group, no global sort in one task.
* Levels: the store is Parquet partitioned by level. Each level is made from the one before by one scan, in which ``arity`` neighbours
  become a node; a node keeps its children's digests. Groups whose tree is done leave the scan. The groups' subroots are the leaves of one more tree.
* Proofs: from the top down each level is joined with the level above by coordinate (a merge of two tables sorted by it), which
  hands the siblings on the way to the root down to the leaves.

Digests are 32 bytes in the store and lower-case hex text where they are hashed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailhead.llm.common import cut, discard, fresh_path, named, small_side, sweep


def framed(value: Column) -> Column:
    """A value as text that can't be mistaken for a neighbour's: ``-`` for null, else its number of UTF-8 bytes, ``:``, value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest (hex) of a row of values."""
    return F.sha2(F.concat(*map(framed, values)), 256)


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


@dataclass
class Manifest:
    """levels: folders of the groups' trees, leaves first; top: folders of the tree over subroots; root: hex, null for an empty table."""

    spark: SparkSession
    levels: list[str]
    top: list[str]
    root: str | None
    arity: int
    carried: list[str]

    def level(self, i: int) -> DataFrame:
        return self.spark.read.parquet(self.levels[i])

    def top_level(self, i: int) -> DataFrame:
        return self.spark.read.parquet(self.top[i])


def _numbered(rows: DataFrame, group: str | None, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows, written as sorted runs, plus pos (from 0 within the group) and n (rows of the group); and a row (group, n) per group.
    order must tell all rows apart, so that ranges split whatever the keys' frequencies."""
    by = [*([group] if group else []), *order]
    runs = cut(rows.repartitionByRange(*map(named, by)).sortWithinPartitions(*map(named, by)).withColumn("mid", F.monotonically_increasing_id()), name)
    key = named(group) if group else F.lit(0)
    per_run = runs.groupBy(key.alias("key"), F.shiftrightunsigned("mid", 33).alias("run")).agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("c"))
    every = Window.partitionBy("key")
    per_run = per_run.withColumn("before", F.coalesce(F.sum("c").over(every.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("c").over(every))
    per_run = cut(per_run, f"{name}-runs")  # at most a row per run and one per group
    side = small_side(per_run.select("key", "run", "first", "before", "n"), per_run.count())
    joined = runs.join(side, key.eqNullSafe(F.col("key")) & (F.shiftrightunsigned("mid", 33) == F.col("run")))
    out = joined.select(*map(named, rows.columns), (F.col("mid") - F.col("first") + F.col("before")).alias("pos"), "n")
    return out, per_run.groupBy("key").agg(F.max("n").alias("n"))


def _grow(spark: SparkSession, store: str, leaves: DataFrame, arity: int) -> list[str]:
    """Write the levels of the trees over leaves (g, pos, n, digest, ...): folders of the levels, leaves first."""
    paths = [f"{store}/level=0"]
    leaves.write.parquet(paths[0])
    most = spark.read.parquet(paths[0]).agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = spark.read.parquet(paths[-1]).where("n > 1").select("g", "pos", "n", "digest")
        kids = below.groupBy("g", F.expr(f"pos div {arity}").alias("up")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("kids"))
        kids = kids.select("g", F.col("up").alias("pos"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), F.col("kids.digest").alias("kids"))
        made = kids.withColumn("digest", F.unhex(F.sha2(F.array_join(F.transform("kids", _text), ""), 256)))
        paths.append(f"{store}/level={len(paths)}")
        made.sortWithinPartitions("g", "pos").write.parquet(paths[-1])
        most = -(-most // arity)
    return paths


def build(docs: DataFrame, columns: list[str], group: str, order: str, carry: dict[str, Column] | None = None, arity: int = 3) -> Manifest:
    """The manifest of docs: a leaf per row, from the columns in their order; per value of group a tree over its leaves, ascending by order,
    whose every ``arity`` consecutive nodes become one until one is left; over these, by group's value (null first, UTF-8 bytewise), likewise one
    more. carry: expressions of docs that the proofs return beside each leaf.

    Runs eagerly, a job per level. Nulls are values of their own everywhere, and null keys sort first. Rows with one key stand in the
    order of their digests; equal rows are leaves each. Columns that aren't named aren't read, and theirs may be any names; carried ones can't be named like the proofs' own. An empty table has no root.
    """
    spark = docs.sparkSession
    carry = carry or {}
    if taken := {"leaf", "subroot", "g", "pos", "path"} & set(carry):
        raise ValueError(f"proofs have columns of these names: {sorted(taken)}")
    own = F.unhex(leaf(*map(named, columns)))
    rows = docs.select(named(group).alias("grp"), named(order).alias("ord"), own.alias("digest"), F.struct(F.lit(0).alias("-"), *[c.alias(k) for k, c in carry.items()]).alias("carried"))
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()), "mk-leaves")
    placed, groups = _numbered(rows, "grp", ["ord", "digest", "rid"], "mk-runs")
    ranked, _ = _numbered(groups.select(F.col("key").alias("grp")), None, ["grp"], "mk-groups")
    ranked = cut(ranked.select(F.col("grp").alias("grp_"), F.col("pos").alias("g")), "mk-ranks")
    leaves = placed.join(small_side(ranked, ranked.count()), F.col("grp").eqNullSafe(F.col("grp_")))
    store = fresh_path(spark, "mk-store")
    levels = _grow(spark, f"{store}/trees", leaves.select("g", "pos", "n", "digest", "carried"), arity)
    subroots = None
    for p in levels:
        done = spark.read.parquet(p).where("n = 1").select("g", "digest")
        subroots = done if subroots is None else subroots.union(done)
    count = ranked.count()
    tops = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(count).cast("long").alias("n"), "digest")
    top = _grow(spark, f"{store}/top", tops, arity)
    root = spark.read.parquet(top[-1]).select(_text(F.col("digest"))).first()
    discard(rows)
    sweep(spark)
    return Manifest(spark, levels, top, root[0] if root else None, arity, list(carry))


def _down(rows: DataFrame, above: DataFrame | None, arity: int) -> DataFrame:
    """rows (g, pos, n, ...) plus path: the siblings on the way up, from those (g, up, ends, brothers, path) of the level above."""
    at, own = F.expr(f"pos div {arity}"), F.expr(f"cast(pos % {arity} as int)")
    side = above.select(F.col("g").alias("g_"), "up", "ends", "brothers", F.col("path").alias("path_"))
    met = rows.join(side, (F.col("g") == F.col("g_")) & (at == F.col("up")) & ((F.col("n") == 1) == F.col("ends")))
    joined = lambda part: F.unhex(F.array_join(F.transform(part, _text), ""))
    step = F.struct(joined(F.slice("brothers", F.lit(1), own)).alias("left"), joined(F.slice("brothers", own + 2, F.lit(arity))).alias("right"))
    path = F.when(F.col("ends"), F.col("path_")).otherwise(F.concat(F.array(step), F.col("path_")))
    return met.select(*map(named, rows.columns), path.alias("path"))


def _above(rows: DataFrame) -> DataFrame:
    return rows.select("g", F.col("pos").alias("up"), F.lit(False).alias("ends"), F.col("kids").alias("brothers"), "path")


def proofs(m: Manifest) -> DataFrame:
    """One row per leaf: what was carried, leaf and subroot (hex), g and pos (the leaf's coordinate: its group's place, its place in the group)
    and path: an array, from the leaf's siblings to the root's children, of (left, right), the siblings' digests on either side, run together.
    No rows for an empty table."""
    spark = m.spark
    none = F.expr("cast(array() as array<struct<left: binary, right: binary>>)")
    kind = "g long, up long, ends boolean, brothers array<binary>, path array<struct<left: binary, right: binary>>"
    over = spark.createDataFrame([], kind)
    for i in reversed(range(len(m.top))):
        rows = m.top_level(i)
        end = i == len(m.top) - 1
        got = rows.withColumn("path", none) if end else _down(rows, over, m.arity)
        over = _above(got) if i else got
    whole = cut(over.select(F.col("pos").alias("g"), F.lit(0).cast("long").alias("up"), F.lit(True).alias("ends"), F.expr("cast(null as array<binary>)").alias("brothers"), "path", F.col("digest").alias("sub")), "mk-top")
    above = None
    for i in reversed(range(len(m.levels))):
        sides = whole.drop("sub")
        got = _down(m.level(i), sides if above is None else above.unionByName(sides), m.arity)
        above = _above(got) if i else got
    subs = whole.select(F.col("g").alias("g_"), _text(F.col("sub")).alias("subroot"))
    out = above.join(subs, F.col("g") == F.col("g_"))
    return out.select(*[F.col("carried").getField(c).alias(c) for c in m.carried], _text(F.col("digest")).alias("leaf"), "subroot", "g", "pos", "path")


def siblings(path: Column) -> Column:
    """All siblings of a proof as text: level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(_text(s["left"]), _text(s["right"]))), "")


def fold(leaf_: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) and a proof's path give."""
    return F.aggregate(path, leaf_, lambda acc, s: F.sha2(F.concat(_text(s["left"]), acc, _text(s["right"])), 256))
