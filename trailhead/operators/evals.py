"""Golden-set evaluation: checks, violations, scores, history, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailhead.functions import text as X
from trailhead.operators import chunking, telemetry
from trailhead.sources.files import structural_entry


def _scoped(rows: DataFrame, scope: DataFrame | None) -> DataFrame:
    if scope is None or scope.isEmpty():
        return rows
    return rows.join(scope.select("file_path").distinct(), "file_path", "left_semi")


def case_violations(checks: DataFrame, chunks: DataFrame, rows: list, scope: DataFrame | None = None, limits: tuple[int, int] = (1, 5), compat: bool = False) -> DataFrame:
    """(case_id, kind, literal, file_path, start_line): a row with file N/A per literal that must occur and doesn't, and up to limits[1] rows
    per literal that must not occur and does, in order of path and line.

    rows holds the checks themselves, a bounded parameter: all literals are tested in one scan of the chunks, as expressions.
    Excluded paths go before the limit; with compat after it. scope (file_path) limits the scan to changed files; an empty one means that
    nothing is known to have changed, and all files are scanned.
    """
    content, path = F.col("content"), F.col("file_path")
    chunks = _scoped(chunks, scope)
    hits = []
    for n, (case, _, kind, literal, include, exclude) in enumerate(rows):
        if kind not in ("must", "must_not"):
            continue
        on = F.instr(content, F.lit(literal)) > 0
        if include:
            on = on & X.sql_glob(path, include)
        keep = ~X.path_glob(path, exclude) if exclude else F.lit(True)
        hits.append(F.when(on if compat else on & keep, F.struct(F.lit(n).alias("n"), F.lit(case).alias("case_id"), F.lit(kind).alias("kind"), F.lit(literal).alias("literal"), keep.alias("keep"))))
    found = chunks.select("file_path", "start_line", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("file_path", "start_line", "h.*")
    order = Window.partitionBy("n").orderBy("file_path", "start_line")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.when(F.col("kind") == "must", limits[0]).otherwise(limits[1])).where("keep")
    bad = found.where("kind = 'must_not'").select("case_id", "kind", "literal", "file_path", "start_line")
    there = found.where("kind = 'must'").select("case_id", "literal").distinct()
    missing = checks.where("kind = 'must'").join(there, ["case_id", "literal"], "left_anti").select("case_id", "kind", "literal", F.lit("N/A").alias("file_path"), F.lit(0).alias("start_line"))
    return missing.union(bad)


def structural_violations(files: DataFrame, rows: list, scope: DataFrame | None = None, limits: tuple[int, int] = (1, 10)) -> DataFrame:
    """Like ``case_violations``, for the checks of rows that are code patterns, language:pattern, over files (file_path, language, content):
    structural_must and structural_must_not. An entry that isn't of this form is a violation of its own, invalid_structural_pattern."""
    spark, path = files.sparkSession, F.col("file_path")
    kinds = "n int, case_id string, kind string, literal string"
    valid, bad = [], []
    for n, (case, _, kind, literal, include, exclude) in enumerate(rows):
        if kind not in ("structural_must", "structural_must_not"):
            continue
        try:
            valid.append((n, case, kind, literal, include, exclude, *structural_entry(literal)))
        except ValueError:
            bad.append((n, case, "invalid_structural_pattern", literal))
    found = spark.createDataFrame([], f"{kinds}, file_path string, start_line int")
    files = _scoped(files, scope)
    for language in sorted({v[6] for v in valid}):
        mine = [v for v in valid if v[6] == language]
        hits = chunking.structural_search(files, sorted({v[7] for v in mine}), language=language)
        on = []
        for n, case, kind, literal, include, exclude, _, pattern in mine:
            fits = F.col("pattern") == pattern
            if include:
                fits = fits & X.path_glob(path, include)
            if exclude:
                fits = fits & ~X.path_glob(path, exclude)
            on.append(F.when(fits, F.struct(F.lit(n).alias("n"), F.lit(case).alias("case_id"), F.lit(kind).alias("kind"), F.lit(literal).alias("literal"))))
        found = found.union(hits.select(F.explode(F.array_compact(F.array(*on))).alias("h"), "file_path", "line").select("h.*", "file_path", F.col("line").alias("start_line")))
    order = Window.partitionBy("n").orderBy("file_path", "start_line")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.when(F.col("kind") == "structural_must", limits[0]).otherwise(limits[1]))
    columns = ["case_id", "kind", "literal", "file_path", "start_line"]
    musts = spark.createDataFrame([v[:4] for v in valid if v[2] == "structural_must"], kinds)
    missing = musts.join(found.select("n"), "n", "left_anti").union(spark.createDataFrame(bad, kinds))
    return missing.withColumns({"file_path": F.lit("N/A"), "start_line": F.lit(0)}).select(*columns).union(found.where("kind = 'structural_must_not'").select(*columns))


def all_violations(checks: DataFrame, chunks: DataFrame, files: DataFrame, rows: list, scope: DataFrame | None = None) -> DataFrame:
    """The violations of literal checks in chunks and of code patterns in files; a case may have both, and its score counts both."""
    return case_violations(checks, chunks, rows, scope).union(structural_violations(files, rows, scope))


def run_and_learn(sets: DataFrame, history: str, events: DataFrame, created_at: int, least: float) -> DataFrame:
    """Persist an evaluation and learn from it. sets (golden_set, overall_score, critical_pass) becomes rows of the run history, a Parquet
    folder that is appended to; the gate is open if every set passes. Returns the next weight snapshot from the events."""
    passed = F.col("critical_pass") & (F.col("overall_score") >= least)
    runs = sets.select(F.concat_ws("-", "golden_set", F.lit(created_at)).alias("id"), "golden_set", "overall_score", passed.alias("passed"), F.lit(created_at).cast("long").alias("created_at"))
    runs.write.mode("append").parquet(history)
    done = sets.sparkSession.read.schema(runs.schema).parquet(history).where(F.col("created_at") == created_at)
    gate = done.agg(F.coalesce(F.bool_and("passed"), F.lit(True))).first()[0]
    return telemetry.learn_weights(telemetry.groundedness_window(events), gate)


def case_scores(checks: DataFrame, violations: DataFrame) -> DataFrame:
    """Per case: checks, violations, files touched, score max(0, 1 - violations / checks), passed, weight."""
    c = checks.groupBy("case_id", "priority").agg(F.count(F.lit(1)).alias("checks"))
    v = violations.groupBy("case_id").agg(F.count(F.lit(1)).alias("violations"), F.countDistinct(F.when(F.col("file_path") != "N/A", F.col("file_path"))).alias("files"))
    s = c.join(v, "case_id", "left").fillna(0, ["violations", "files"])
    weight = F.when(F.col("priority") == "critical", 2.0).when(F.col("priority") == "high", 1.5).when(F.col("priority") == "low", 0.5).otherwise(1.0)
    return s.select("case_id", "priority", "checks", "violations", "files", F.round(F.greatest(F.lit(0.0), 1 - F.col("violations") / F.col("checks")), 6).alias("score"), (F.col("violations") == 0).alias("passed"), weight.alias("weight"))


def golden_score(scores: DataFrame) -> DataFrame:
    """One row: the weighted mean (1 without weight) and whether all critical cases pass."""
    return scores.agg(F.coalesce(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 6), F.lit(1.0)).alias("overall_score"), F.coalesce(F.bool_and(F.when(F.col("priority") == "critical", F.col("passed"))), F.lit(True)).alias("critical_pass"))


def regression(runs: DataFrame, window: int = 5) -> DataFrame:
    """Every run against the mean of the last ``window`` runs of its set, its own included."""
    w = Window.partitionBy("golden_set").orderBy("created_at", "id")
    avg = F.avg("overall_score").over(w.rowsBetween(1 - window, 0))
    delta = F.round(F.col("overall_score") - avg, 6)
    r = runs.withColumn("moving_avg", F.round(avg, 6)).withColumn("delta", delta)
    return r.select("golden_set", "id", "overall_score", "moving_avg", "delta", F.when(F.col("delta") < -0.1, "regression").when(F.col("delta") < -0.05, "warning").otherwise("ok").alias("state"))


def history(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy("golden_set").orderBy("created_at", "id")
    return runs.select("golden_set", "id", "overall_score", F.round(F.col("overall_score") - F.lag("overall_score").over(w), 6).alias("change"))


def latest_runs(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy("golden_set").orderBy(F.desc("created_at"), F.desc("id"))
    return runs.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def ci_decision(runs: DataFrame, least: float = 0.45) -> DataFrame:
    """Per set the latest run's verdict: below the threshold, failed, regression or pass."""
    last = latest_runs(runs).join(regression(runs).select("id", "state"), "id")
    why = F.when(F.col("overall_score") < least, "below_threshold").when(~F.col("passed"), "critical_failed").when(F.col("state") == "regression", "regression").otherwise("pass")
    return last.select("golden_set", "overall_score", why.alias("decision"))
