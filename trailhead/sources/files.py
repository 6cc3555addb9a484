"""Readers of project files: source trees, golden sets, configuration, activity logs, worktree listings, manifests, Markdown."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhead.functions import text as X
from trailhead.schemas import schema


def walk(spark: SparkSession, root: str, skip: tuple[str, ...] = (), ignore_files: tuple[str, ...] = (".gitignore", ".ignore")) -> DataFrame:
    """(file_path, content, content_hash, language, length): files of known languages under a folder, without hidden ones, those that match
    patterns of skip, and those that the ignore files in the tree rule out. Spark lists and reads them, in any store."""
    base = re.escape(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/"))
    below = F.regexp_replace("path", f"^[a-z0-9]+:/*{base}/", "")
    rules = [r for x in skip for r in ignore_rules("", x)]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    f = raw.withColumn("file_path", below).withColumn("language", X.detect_language(F.col("path")))
    deep = f.agg(F.max(F.size(F.split("file_path", "/")))).first()[0] or 0
    for folder, text in _small_files(spark, root, ignore_files, deep):
        rules += ignore_rules(folder, text)
    f = f.where(F.col("language").isNotNull() & ~F.col("file_path").rlike(r"(^|/)\.") & ~ruled_out(F.col("file_path"), rules))
    return f.select("file_path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"), "language", "length")


def _small_files(spark: SparkSession, root: str, names: tuple[str, ...], deep: int) -> list[tuple[str, str]]:
    """(folder below root, text) of files of some names, down to a depth. Spark's readers pass over hidden files, so its file system is asked."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs, out = top.getFileSystem(conf), []
    base = fs.makeQualified(top).toString().rstrip("/")
    for name in names:
        for d in range(deep):
            for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{base}{'/*' * d}/{name}")) or ():
                stream = fs.open(status.getPath())
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                out.append((status.getPath().toString()[len(base) :].rpartition("/")[0].lstrip("/"), text))
    return out


def ignore_rules(folder: str, text: str) -> list[tuple[int, str, bool]]:
    """(depth, regular expression over paths, ignored) per rule of an ignore file in a folder: comments and blank lines are left out, ! takes a path
    back in, a slash at the start or within ties a pattern to the folder, one at the end asks for a folder, ** crosses folders."""
    out = []
    for line in text.splitlines():
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        ignored = not rule.startswith("!")
        rule = rule if ignored else rule[1:]
        tied, tail = "/" in rule.rstrip("/"), "/.*" if rule.endswith("/") else "(?:/.*)?"
        body = X.path_regex(rule.strip("/"))[1:-1]
        head = re.escape(folder) + "/" if folder else ""
        out.append((head.count("/"), f"^{head}{'' if tied else '(?:.*/)?'}{body}{tail}$", ignored))
    return out


def ruled_out(path: Column, rules: list[tuple[int, str, bool]]) -> Column:
    """Whether the last rule that fits a path, those of deeper folders after those above them, ignores it."""
    out = F.lit(False)
    for _, pattern, ignored in sorted(rules, key=lambda r: r[0]):
        out = F.when(path.rlike(pattern), F.lit(ignored)).otherwise(out)
    return out


def golden_set_names(folder: str) -> list[str]:
    """The golden sets in a folder, sorted; none where there is no folder."""
    return sorted(f.removesuffix(".toml") for f in os.listdir(folder) if f.endswith(".toml")) if os.path.isdir(folder) else []


def insert(rows: DataFrame, table: str, folder: str) -> None:
    """Append rows to a domain table, a Parquet folder, with the declared columns in their order and types; missing ones are null, others an error."""
    want = schema(table)
    if more := set(rows.columns) - set(want.names):
        raise ValueError(f"{table} has no column {sorted(more)}")
    columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]
    rows.select(*columns).write.mode("append").parquet(f"{folder.rstrip('/')}/{table}")


def table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    return spark.read.schema(schema(name)).parquet(f"{folder.rstrip('/')}/{name}")


def golden_sets(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """(golden_set, case_id, name, priority, kind, literal): one row per check of the TOML files in a folder; an unknown set
    or a field of a wrong type is an error."""
    rows = []
    names = golden_set_names(folder)
    if name is not None and name not in names:
        raise FileNotFoundError(f"no golden set {name!r} in {folder}")
    for n in names if name is None else [name]:
        with open(os.path.join(folder, f"{n}.toml"), "rb") as f:
            data = tomllib.load(f)
        for case in data.get("cases", []):
            checks = case.get("checks", {})
            for kind in ("must_contain", "must_not_contain", "structural_must_contain", "structural_must_not_contain"):
                given = checks.get(kind, [])
                if not isinstance(given, list) or any(not isinstance(x, str) for x in given):
                    raise TypeError(f"{n}: {kind} must be a list of strings")
                rows += [(n, str(case["id"]), str(case.get("name", case["id"])), str(case.get("priority", "medium")), kind, x) for x in given]
    return spark.createDataFrame(rows, "golden_set string, case_id string, name string, priority string, kind string, literal string")


@dataclass
class Config:
    """Settings with their defaults."""

    max_chunk_tokens: int = 512
    vector_dimensions: int = 384
    vector_metric: str = "cosine"
    token_pressure_threshold: int = 1024
    default_lane: str = "mcp"
    stale_timeout_hours: int = 48
    conflict_window_secs: int = 90
    debounce_ms: int = 750
    staleness_days: int = 30
    staleness_commits: int = 50
    ci_threshold: float = 0.8
    fail_on_regression: bool = True
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Config:
        """From a TOML file, tables flattened; a missing file gives the defaults, a wrong type is an error."""
        if not os.path.exists(path):
            return cls()
        with open(path, "rb") as f:
            flat: dict = {}
            for k, v in tomllib.load(f).items():
                flat |= v if isinstance(v, dict) else {k: v}
        out, kinds = cls(), {x.name: type(getattr(cls(), x.name)) for x in fields(cls)}
        for k, v in flat.items():
            if k in kinds and k != "extra":
                if not isinstance(v, (kinds[k], int) if kinds[k] is float else kinds[k]):
                    raise TypeError(f"{k} must be {kinds[k].__name__}")
                setattr(out, k, v)
            else:
                out.extra[k] = v
        return out


def append_activity(events: DataFrame, folder: str) -> None:
    """Append events (timestamp, agent, path, kind) to a JSON Lines log."""
    events.select("timestamp", "agent", "path", "kind").write.mode("append").json(folder)


def read_activity(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(schema("activity")).json(folder)


def worktree_records(listing: DataFrame, body: str) -> DataFrame:
    """listing's other columns and place, path, head, branch, locked, prunable: records of worktree listings, parted by blank lines."""
    keep = [c for c in listing.columns if c != body]
    r = listing.select(*keep, F.posexplode(F.filter(F.split(F.col(body), r"\n\n+"), lambda x: F.trim(x) != "")).alias("p", "r"))

    def one(name: str):
        got = F.regexp_extract("r", rf"(?m)^{name} (.*)$", 1)
        return F.when(got != "", got)

    branch = F.regexp_replace(one("branch"), "^refs/heads/", "")
    return r.select(*keep, (F.col("p") + 1).alias("place"), one("worktree").alias("path"), one("HEAD").alias("head"), branch.alias("branch"), F.col("r").rlike(r"(?m)^locked").alias("locked"), F.col("r").rlike(r"(?m)^prunable").alias("prunable"))


def manifest_dependencies(manifests: DataFrame, content: str = "content", location: str = "file_path") -> DataFrame:
    """(location, section, dep, version) of package manifests in JSON."""
    parts = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    j = manifests.withColumn("j", F.from_json(content, ", ".join(f"{p} map<string,string>" for p in parts)))
    rows = [j.where(F.col(f"j.{p}").isNotNull()).select(F.col(location).alias("location"), F.lit(p).alias("section"), F.explode(f"j.{p}").alias("dep", "version")) for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def titles(docs: DataFrame) -> DataFrame:
    """(name, title): the first level-one heading, or the name."""
    head = F.trim(F.regexp_extract("content", r"(?m)^# (.*)$", 1))
    return docs.select("name", F.coalesce(F.nullif(head, F.lit("")), "name").alias("title"))


def index_links(docs: DataFrame, body: str) -> DataFrame:
    """(file): targets of Markdown links."""
    return docs.select(F.explode(F.regexp_extract_all(F.col(body), F.lit(r"\]\(([^)]+)\)"), F.lit(1))).alias("file")).distinct()


def valid_name(name: str) -> bool:
    """A bare name of letters, digits, _, - and ., that doesn't begin with . or -."""
    return re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.\-]*", name) is not None


def require(tool: str, parameter: str, value: str | None) -> str:
    if value is None or not value.strip():
        raise ValueError(f"{tool}: {parameter} is required")
    return value.strip()


def require_top_k(tool: str, top_k: int | None, default: int) -> int:
    k = default if top_k is None else top_k
    if not 1 <= k <= 1000:
        raise ValueError(f"{tool}: top_k must be from 1 to 1000, not {k}")
    return k


def require_relative(tool: str, path: str) -> str:
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"{tool}: {path!r} must be a relative path inside the project")
    return path


def structural_entry(entry: str) -> tuple[str, str]:
    """language:pattern of a structural check; both must be there."""
    language, colon, pattern = entry.partition(":")
    if not colon or not language.strip() or not pattern.strip() or not language.strip().isalnum():
        raise ValueError(f"structural check {entry!r} isn't language:pattern")
    return language.strip(), pattern.strip()
