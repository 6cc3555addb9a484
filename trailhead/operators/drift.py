"""Drift checks: each gives issue rows (checker, file, message, severity); scores and reports over them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailhead.functions import text as X
from trailhead.operators.graph import by_pause, segments

DEDUCTIONS = {"error": 10, "warning": 3, "info": 1}


def staleness(fresh: DataFrame, now: DataFrame, days: int = 30, commits: int = 50) -> DataFrame:
    """Files older than days (warning) or with more commits since than commits (info); now: one row (now)."""
    f = fresh.crossJoin(F.broadcast(now))
    age = F.floor((F.col("now") - F.col("last")) / 86400)
    old = f.where(age > days).select(F.lit("staleness").alias("checker"), "file", F.concat(F.lit("not touched for "), age.cast("string"), F.lit(" days")).alias("message"), F.lit("warning").alias("severity"))
    far = f.where(F.col("commits") > commits).select(F.lit("commits").alias("checker"), "file", F.concat(F.col("commits").cast("string"), F.lit(" commits since")).alias("message"), F.lit("info").alias("severity"))
    return old.union(far)


def missing_required(required: DataFrame, present: DataFrame, checker: str = "completeness", severity: str = "error") -> DataFrame:
    """Files of required (file) that aren't in present (file)."""
    gone = required.join(present.select("file").distinct(), "file", "left_anti")
    return gone.select(F.lit(checker).alias("checker"), "file", F.lit("missing").alias("message"), F.lit(severity).alias("severity"))


def index_sync(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Index entries without a file (error) and files without an index entry (warning)."""
    return missing_required(listed, actual, "index_dangling").union(missing_required(actual, listed, "index_unlisted", "warning"))


def version_conflicts(manifests: DataFrame) -> DataFrame:
    """Dependencies with more than one version: versions and locations counted and listed."""
    g = manifests.groupBy("dep").agg(F.countDistinct("version").alias("versions"), F.count(F.lit(1)).alias("locations"), F.array_sort(F.collect_set("version")).alias("v"))
    return g.where("versions > 1").select("dep", "versions", "locations", F.array_join("v", ",").alias("version_list"))


def undeclared(refs: DataFrame, declared: DataFrame) -> DataFrame:
    return refs.join(declared, "script", "left_anti")


def score(issues: DataFrame) -> DataFrame:
    """One row: 100 less 10, 3 and 1 per error, warning and info, at least 0, and the counts."""
    n = {s: F.count(F.when(F.col("severity") == s, 1)) for s in DEDUCTIONS}
    lost = sum((n[s] * d for s, d in DEDUCTIONS.items()), F.lit(0))
    return issues.agg(F.greatest(F.lit(0), 100 - lost).cast("long").alias("score"), *[n[s].alias(f"{s}s") for s in DEDUCTIONS])


def by_file(issues: DataFrame) -> DataFrame:
    """Issues per file, in order of checker and message."""
    g = issues.groupBy("file").agg(F.count(F.lit(1)).alias("issues"), F.array_sort(F.collect_list(F.concat_ws(": ", "checker", "message"))).alias("m"))
    return g.select("file", "issues", F.array_join("m", "; ").alias("messages"))


def diff(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Per path of either side (file_path, content_hash): new, changed, unchanged or removed."""
    c, i = current.withColumnRenamed("content_hash", "now_hash"), indexed.withColumnRenamed("content_hash", "old_hash")
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("now_hash").isNull(), "removed").when(F.col("old_hash") != F.col("now_hash"), "changed").otherwise("unchanged")
    return c.join(i, "file_path", "full_outer").select("file_path", state.alias("state"))


def latest_in_window(activity: DataFrame, window: int) -> DataFrame:
    """Look-back conflicts: for each event the most recent earlier event (by time, then id) by another agent on the same path, if at most window
    seconds old: id, path, agent, other_agent, age.

    In a path's order that event is the last before the current run of events by one agent: where the agent changes it is the row before, and
    later rows of the run take it over. Segments of the order are scanned in parallel; for the run that a segment begins with, the last event of each of
    the two last agents of every earlier segment is enough, two rows a segment.
    """
    s = segments(activity, "path", "timestamp", "id")

    def before(rows: DataFrame, *group: str) -> DataFrame:
        w = Window.partitionBy(*group).orderBy("timestamp", "id")
        changed = F.lag(F.struct("agent", "timestamp")).over(w)
        rows = rows.withColumn("changed", F.when(changed["agent"] != F.col("agent"), changed))
        return rows.withColumn("other", F.last("changed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("changed")

    local = before(s, "path", "seg")
    last = F.max(F.struct("timestamp", "id", "agent", "other"))
    ends = local.groupBy("path", "seg").agg(last.alias("e"), F.min(F.struct("timestamp", "id", "agent")).alias("f"))
    # the last event, the one by another agent before it, and the first event, which asks
    known = ends.select("path", "seg", F.explode(F.array(
        F.struct(F.lit(True).alias("there"), F.lit(False).alias("asks"), F.col("e.timestamp").alias("timestamp"), F.col("e.id").alias("id"), F.col("e.agent").alias("agent")),
        F.struct(F.col("e.other").isNotNull().alias("there"), F.lit(False).alias("asks"), F.col("e.other.timestamp").alias("timestamp"), F.lit(-(1 << 62)).alias("id"), F.col("e.other.agent").alias("agent")),
        F.struct(F.lit(True).alias("there"), F.lit(True).alias("asks"), F.col("f.timestamp").alias("timestamp"), F.col("f.id").alias("id"), F.col("f.agent").alias("agent")),
    )).alias("x")).select("path", "seg", "x.*").where("there")
    # places by segment: what asks comes first in its own
    w = Window.partitionBy("path").orderBy("seg", F.desc("asks"), "timestamp", "id")
    changed = F.lag(F.struct("agent", "timestamp")).over(w)
    known = known.withColumn("changed", F.when(changed["agent"] != F.col("agent"), changed))
    known = known.withColumn("came", F.last("changed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("asks")
    side = known.select(F.col("path").alias("path_"), F.col("seg").alias("seg_"), "came")
    a = local.join(side, F.col("path").eqNullSafe(F.col("path_")) & (F.col("seg") == F.col("seg_"))).withColumn("other", F.coalesce("other", "came"))
    age = F.col("timestamp") - F.col("other.timestamp")
    return a.where(age <= window).select("id", "path", "agent", F.col("other.agent").alias("other_agent"), age.alias("age"))


def debounce(activity: DataFrame, gap: int) -> DataFrame:
    """Events kept when each event less than gap seconds after the last kept one of its path is dropped. Events are cut into runs where the pause
    is at least gap, as the first event after it is kept in any case; runs are folded in parallel, in batches, with the last kept time as state."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, 0
        for b in batches:
            paths, runs, times, ids = (b.column(i).to_pylist() for i in range(4))
            kept = []
            for n, (path, run, ts) in enumerate(zip(paths, runs, times, strict=True)):
                if (path, run) != at or ts - last >= gap:
                    at, last = (path, run), ts
                    kept.append(n)
            yield pa.RecordBatch.from_arrays([pa.array([paths[n] for n in kept], pa.string()), pa.array([ids[n] for n in kept], pa.int64())], ["path", "id"])

    r = by_pause(activity, "path", "timestamp", "id", gap).select("path", "run", "timestamp", "id")
    return r.repartition("path", "run").sortWithinPartitions("path", "run", "timestamp", "id").mapInArrow(fold, "path string, id long")


def convention_lines(conventions: DataFrame) -> DataFrame:
    """(file, line, key, value, language): the settings of convention files (file, body) that checks look at, with line numbers from 1 and
    the language named last before them."""
    rows = conventions.select("file", F.posexplode(X.lines(F.col("body"))).alias("n", "raw")).withColumn("raw", F.trim("raw"))
    key = F.regexp_extract("raw", "^(scope|language|check_pattern|skill)", 1)
    value = F.regexp_replace(F.regexp_replace(F.trim(F.get(F.split("raw", "="), F.lit(1))), "^[\"']+", ""), "[\"']+$", "")
    rows = rows.select("file", (F.col("n") + 1).alias("line"), key.alias("key"), value.alias("value")).where("key <> '' and value is not null")
    w = Window.partitionBy("file").orderBy("line")  # a window holds one file's settings
    return rows.withColumn("language", F.last(F.when(F.col("key") == "language", F.col("value")), ignorenulls=True).over(w))


def _convention_issue(rows: DataFrame, checker: str, message) -> DataFrame:
    return rows.select(F.lit(checker).alias("checker"), F.concat("file", F.lit(":"), "line").alias("file"), message.alias("message"), F.lit("warning").alias("severity"))


def unmatched_scopes(conventions: DataFrame, files: DataFrame) -> DataFrame:
    """Scope globs of conventions that match no file of files (file_path). Globs meet files by the folder that stands before their first wildcard
    and by their ending, if that is plain text; only those pairs are matched. Files without a path match nothing."""
    scopes = convention_lines(conventions).where("key = 'scope' and value <> ''")
    folder, ending = F.regexp_extract("value", r"^(?:[^*?/]*/)*", 0), F.regexp_extract("value", r"\.[^.*?/]*$", 0)
    globs = scopes.select("value").distinct().select("value", X.path_pattern(F.col("value")).alias("pattern"), folder.alias("folder"), ending.alias("ending"))
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i > 0, F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))).otherwise(""))
    keys = files.where("file_path is not null").select("file_path", F.explode(above).alias("folder"), F.regexp_extract("file_path", r"\.[^./]*$", 0).alias("own"))
    keys = keys.select("file_path", "folder", F.explode(F.array_distinct(F.array("own", F.lit("")))).alias("ending"))
    met = keys.join(globs, ["folder", "ending"]).where(F.rlike("file_path", "pattern")).select("value").distinct()
    return _convention_issue(scopes.join(met, "value", "left_anti"), "convention_paths", F.concat(F.lit("scope glob '"), "value", F.lit("' matches no files")))


#: Languages whose code can be searched by pattern.
KNOWN_LANGUAGES = ("rust", "python", "typescript", "javascript")


def bad_patterns(conventions: DataFrame) -> DataFrame:
    """Check patterns of conventions that are empty or for a language that can't be searched."""
    rows = convention_lines(conventions).where("key = 'check_pattern'")
    odd = ~F.col("language").isin(*KNOWN_LANGUAGES)
    message = F.when(F.col("value") == "", "check_pattern is empty").when(odd, F.concat(F.lit("unsupported language '"), "language", F.lit("' in check_pattern")))
    return _convention_issue(rows.withColumn("m", message).where("m is not null"), "convention_patterns", F.col("m"))


def missing_skills(conventions: DataFrame, skills: DataFrame) -> DataFrame:
    """Skills that conventions refer to and that have no file in skills (file): name.md, .yaml, .yml or .txt."""
    rows = convention_lines(conventions).where("key = 'skill' and value <> ''")
    names = skills.select(F.regexp_extract("file", r"^(.+)\.(?:md|yaml|yml|txt)$", 1).alias("value")).where("value <> ''").distinct()
    return _convention_issue(rows.join(names, "value", "left_anti"), "skills_referenced", F.concat(F.lit("Referenced skill '"), "value", F.lit("' not found")))
