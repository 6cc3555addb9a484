"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailhead.llm.bpe import encode
from trailhead.llm.common import cut


def histogram(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many whole texts encode to each length. Null texts are empty; an empty table gives no rows."""
    return encode(docs.select(text), path, pattern, text, ids=False).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, step: int = 256) -> DataFrame:
    """Per length n_tokens of a histogram: n_docs, docs_at_least and tokens_at_least (documents that are as long or longer, and their tokens),
    truncated_total (tokens left when all are cut to n_tokens), cumulative_share (of documents up to this length).

    Sums run within ranges of ``step`` lengths in parallel and over the ranges' totals, of which there are max length / step.
    """
    # read twice below: written, so that texts aren't encoded twice
    h = cut(hist, "lengths").withColumn("r", F.floor(F.col("n_tokens") / step)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    ranges = h.groupBy("r").agg(F.sum("n_docs").alias("rd"), F.sum("tokens").alias("rt"))
    after = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0)
    ranges = ranges.select("r", F.coalesce(F.sum("rd").over(after), zero).alias("ad"), F.coalesce(F.sum("rt").over(after), zero).alias("at"), F.sum("rd").over(every).alias("docs"), F.sum("rt").over(every).alias("all"))
    within = Window.partitionBy("r").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.join(ranges, "r").withColumn("docs_at_least", F.col("ad") + F.sum("n_docs").over(within)).withColumn("tokens_at_least", F.col("at") + F.sum("tokens").over(within))
    cut_total = F.col("all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return s.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", cut_total.alias("truncated_total"), ((F.col("docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs")).alias("cumulative_share"))


def totals(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """Per context limit of limits (column context): documents longer than it, and tokens left when all are cut to it.

    Limits and lengths stand in one order, in which the answer to a limit is the next length's: one sort of a row per distinct length
    and limit. Null limits are left out, repeated ones answered once; without documents all answers are 0.
    """
    points = sums.select(F.col("n_tokens").alias("at"), F.lit(1).alias("kind"), "docs_at_least", "tokens_at_least")
    asked = limits.select((F.col("context").cast("long") + 1).alias("at")).where("at is not null").distinct()
    points = points.unionByName(asked.select("at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("docs_at_least"), F.lit(None).cast("long").alias("tokens_at_least")))
    after, every = Window.orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    over = [F.coalesce(F.first(c, ignorenulls=True).over(after), F.lit(0)) for c in ("docs_at_least", "tokens_at_least")]
    found = points.select("at", "kind", over[0].alias("docs_over"), over[1].alias("tokens_over"), F.coalesce(F.max("tokens_at_least").over(every), F.lit(0)).alias("all"))
    context = F.col("at") - 1
    return found.where("kind = 0").select(context.alias("context"), "docs_over", (F.col("all") - F.col("tokens_over") + context * F.col("docs_over")).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(share, n_tokens): per share the smallest length that at least that share of documents doesn't exceed; null without documents."""
    found = sums.agg(*[F.min(F.when(F.col("cumulative_share") >= q - 1e-12, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)])
    return found.select(F.explode(F.array(*[F.struct(F.lit(q).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)])).alias("x")).select("x.*")


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share q of documents doesn't exceed, as one row (n_tokens; null without documents)."""
    return sums.where(F.col("cumulative_share") >= q - 1e-12).agg(F.min("n_tokens").alias("n_tokens"))
