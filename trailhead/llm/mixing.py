"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

A source's target is a whole number of epochs and a rest. All its rows are taken once per epoch; for the rest, rows are
ordered by exponential keys -ln(u) / weight (u from a hash of the row's key, weight a document quality weight), and the order
is taken until its prefix sum reaches the rest. The order is never built in one task: keys fall into buckets of about
``per_bucket`` rows whose distribution function is near uniform, buckets are summed, and only the bucket in which a source's budget ends
is sorted. The result is a plan of one row per source, which any pass over the rows can apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailhead.llm.common import cut, named, small_side

WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(named(text), F.lit(WORDS)), F.lit(0)).cast("long")


def quality_weight(text: str, size: Column) -> Column:
    """A document quality weight from 1 to 2: a sixth of the mean bytes per word, kept within these bounds, which also
    bound how far bucket sizes stray from their mean."""
    return F.greatest(F.lit(1.0), F.least(F.lit(2.0), F.coalesce(F.octet_length(named(text)) / F.when(size > 0, size) / 6.0, F.lit(1.0))))


def _keyed(df: DataFrame, key: str, text: str, source: str, weight: Column | None, whole: bool = False) -> DataFrame:
    """__key, __source, __s (the source, marked so that a null is a value), __k (key as text), __size, __e (the exponential key), and with
    whole __row, df's row. Nothing else, so no name of df's clashes."""
    size = n_words(text)
    w = weight if weight is not None else quality_weight(text, size)
    row = [F.struct(*map(named, df.columns)).alias("__row")] if whole else []
    df = df.select(named(key).alias("__key"), named(source).alias("__source"), size.alias("__size"), w.alias("__w"), *row)
    k = F.coalesce(F.col("__key").cast("string"), F.lit(""))
    u = (F.conv(F.substring(F.md5(k.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return df.withColumns({"__s": F.coalesce(F.concat(F.lit("s"), F.col("__source")), F.lit("n")), "__k": k, "__e": -F.log(u) / F.col("__w")}).drop("__w")


def _bucket(e: Column, buckets: Column) -> Column:
    return F.least(buckets - 1, F.floor((1 - F.exp(-e)) * buckets)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """sizes (source, n, source_size), a row per source, plus share_weight and target.

    Sources by code point, null last, take the weights in turn. The sum of all sizes is shared by weight; a target stops
    at most * source_size and what is over goes to the others by weight until none is above. In order of size per weight the
    sources that stop come first, so the level of the others is the largest value of (rest of total) / (rest of weights).
    These windows hold a row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = sizes.withColumn("share_weight", w).withColumn("cap", F.col("source_size") * float(most))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("share_weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("share_weight").over(every) - F.coalesce(F.sum("share_weight").over(before), F.lit(0.0))
    t = t.withColumn("level", rest / left)
    return t.withColumn("target", F.least("cap", F.max("level").over(every) * F.col("share_weight"))).drop("level", "cap")


def plan(keyed: DataFrame, per_bucket: int = 4096, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """One row per source: __s, source, source_size, target, epochs, and the last row that the rest takes (bucket, key)."""
    sizes = keyed.groupBy("__s", F.col("__source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("source_size"))
    goal = targets(sizes, weights, most)
    goal = goal.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).cast("long"))
    goal = cut(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("buckets", F.ceil(F.col("n") / per_bucket).cast("long")), "mix-goal")
    n = goal.count()
    dealt = keyed.join(small_side(goal.select("__s", "buckets", "rest"), n), "__s").withColumn("b", _bucket(F.col("__e"), F.col("buckets")))
    sums = dealt.groupBy("__s", "b", "rest").agg(F.sum("__size").alias("words"))
    run = Window.partitionBy("__s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    edge = cut(sums.where("before <= rest and before + words > rest").select("__s", "b", "before"), "mix-edge")
    last = dealt.join(small_side(edge, n), ["__s", "b"]).groupBy("__s", "b", "before", "rest", "__e", "__k").agg(F.sum("__size").alias("size"))
    run = Window.partitionBy("__s").orderBy("__e", "__k").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0))).where("at + size / 2 <= rest")
    last = last.groupBy("__s").agg(F.max(F.struct("__e", "__k")).alias("last"))
    return cut(goal.join(edge.select("__s", F.col("b").alias("edge")), "__s", "left").join(last, "__s", "left"), "mix-plan")


def taken_times(e: Column, k: Column) -> Column:
    """How often a row is taken, beside its source's plan: its epochs, and once more if it is before the plan's last row."""
    b = _bucket(e, F.col("buckets"))
    within = F.col("edge").isNull() | (b < F.col("edge")) | ((b == F.col("edge")) & (F.struct(e.alias("__e"), k.alias("__k")) <= F.col("last")))
    # without words a row adds nothing; a source whose rest is 0 takes whole epochs alone
    return F.col("epochs") + F.when((F.col("rest") > 0) & F.coalesce(within, F.lit(False)), 1).otherwise(0)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """One row per row of df: key, source, size, source_size, target, taken (words the mix takes, repeats counted), times.

    Size counts words between ASCII white space; null and empty texts have 0. A null source is a source of its own. A source's words
    differ from its target by half a document at most. Equal keys share a place in the order, so repeated rows are taken alike.
    An empty table gives no rows; df may have any other columns.
    """
    light = cut(_keyed(df, key, text, source, weight), "mix-rows")
    goal = plan(light, weights=weights, most=most)
    out = light.join(small_side(goal.drop("source"), goal.count()), "__s").withColumn("times", taken_times(F.col("__e"), F.col("__k")))
    return out.select(F.col("__key").alias(key), F.col("__source").alias(source), F.col("__size").alias("size"), "source_size", "target", (F.col("times") * F.col("__size")).alias("taken"), "times")


def apply_mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """df's rows, each as often as the mix takes it (not at all: 0 times); df's columns. The texts are read twice and never shuffled.
    Nulls, empty texts, repeated keys and empty tables are as in ``mix``."""
    rows = _keyed(df, key, text, source, weight, whole=True)
    goal = plan(cut(rows.drop("__row"), "mix-rows"), weights=weights, most=most).drop("source", "source_size", "target", "n")
    times = taken_times(F.col("__e"), F.col("__k"))
    out = rows.join(small_side(goal, goal.count()), "__s")
    return out.withColumn("__n", F.explode(F.sequence(F.lit(1), F.when(times > 0, times.cast("int"))))).select("__row.*")
