"""Response budgeting: the widest content limit that keeps a result set within a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Content limits in characters, widest first, and the characters that a row's other fields take.
LIMITS, FRAME = (512, 256, 128, 64, 32, 0), 24


def fit(results: DataFrame, group: str, order: str, content: str, budget: int) -> DataFrame:
    """Per group: content_limit, the widest limit at which the group's serialised size stays within budget tokens (a quarter of the
    characters); and rows, all of them or, where even empty contents are too much, as many first ones as fit."""
    size = {n: F.ceil((2 + F.sum(F.least(F.length(content), F.lit(n)) + FRAME)) / 4) for n in LIMITS}
    g = results.groupBy(group).agg(F.count(F.lit(1)).alias("all"), *[size[n].alias(f"s{n}") for n in LIMITS])
    best = F.coalesce(*[F.when(F.col(f"s{n}") <= budget, n) for n in LIMITS])
    g = g.select(group, "all", best.alias("best"))
    run = F.ceil((2 + F.sum(F.lit(FRAME)).over(Window.partitionBy(group).orderBy(order))) / 4)
    tail = results.select(group, run.alias("t")).where(F.col("t") <= budget).groupBy(group).agg(F.count(F.lit(1)).alias("first"))
    return g.join(tail, group, "left").select(group, F.coalesce("best", F.lit(0)).alias("content_limit"), F.when(F.col("best").isNull(), F.coalesce("first", F.lit(0))).otherwise(F.col("all")).alias("rows"))
