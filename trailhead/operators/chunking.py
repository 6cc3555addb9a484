"""Chunking of source files and pattern search in code."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from trailhead.functions import text as X
from trailhead.operators import syntax


def line_chunks(files: DataFrame, content: str, per: int = 50) -> DataFrame:
    """Blocks of per lines: start_line and end_line (from 0, inclusive) and the block's text as content. Files
    without lines have none. Narrow: every block is a slice of its file's array of lines."""
    keep = [c for c in files.columns if c != content]
    f = files.withColumn("__l", X.lines(F.col(content))).where(F.size("__l") > 0)
    f = f.withColumn("__b", F.explode(F.sequence(F.lit(0), F.floor((F.size("__l") - 1) / per).cast("int"))))
    start = F.col("__b") * per
    end = F.least(start + per, F.size("__l")) - 1
    return f.select(*keep, start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), F.array_join(F.slice("__l", start + 1, F.lit(per)), "\n").alias("content"), F.lit("block").alias("symbol_kind"))


PREAMBLE = "_preamble"


def _line_blocks(source: str, per: int = 50) -> list[tuple[int, int, str | None, str, str | None, str]]:
    lines = source.split("\n")
    lines = lines[:-1] if lines and lines[-1] == "" else lines
    return [(a, min(a + per, len(lines)) - 1, None, "block", None, "\n".join(lines[a : a + per])) for a in range(0, len(lines), per)]


def symbol_chunks_of(source: str, language: str | None, most: int = 512) -> list[tuple[int, int, str | None, str, str | None, str]]:
    """(start_line, end_line, symbol, kind, scope, content), lines from 0: a preamble up to the last code or comment that stands outside symbols, then a
    chunk per top-level symbol. One of more than ``most`` words gives way to the symbols in its own braces or block, if it has any, whose scope
    is parent/child. Impl blocks, lexical declarations and decorated definitions have no name. Sources that don't parse, and those in other languages, are cut into
    blocks of lines; an empty one has none."""
    if language not in syntax.LANGUAGES:
        return _line_blocks(source)
    inner: list = []
    if language == "python":
        try:
            found, inner = syntax.python_items(source)
        except (SyntaxError, ValueError, RecursionError):
            return _line_blocks(source)
        ends, others, at = [0], [], 0
        for line in source.split("\n"):
            ends.append(ends[-1] + len(line) + 1)
            at = ends[-2]
            if line.startswith("#") and not any(x.start <= at < x.end for x in found):
                others.append(at)
    else:
        code = syntax.Source(source, language)
        found = syntax.items(code)
        others = [b for a, b in code.comments if not any(x.start <= a < x.end for x in found)]
    line_of = lambda place: source.count("\n", 0, place)
    others += [x.end for x in found if not x.kind]
    out = []
    if others:
        last = line_of(max(others))
        out.append((0, last, PREAMBLE, "preamble", None, "\n".join(source.split("\n")[: last + 1])))

    def chunk(x: syntax.Item, scope: str | None) -> tuple:
        return line_of(x.start), line_of(x.end), x.name, x.kind, scope, source[x.start : x.end]

    for n, x in enumerate(found):
        if not x.kind:
            continue
        parts = []
        if len(source[x.start : x.end].split()) > most:
            parts = inner[n] if language == "python" else syntax.members(code, x)
        out += [chunk(m, f"{x.name}/{m.name}" if x.name and m.name else x.name) for m in parts] or [chunk(x, None)]
    return out or _line_blocks(source)


_CHUNK = "start_line int, end_line int, symbol_name string, symbol_kind string, parent_scope string, content string"


def symbol_chunks(files: DataFrame, path: str = "file_path", language: str = "language", content: str = "content", most: int = 512) -> DataFrame:
    """symbol_chunks_of each file, as rows; null contents have none. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *c) for p, lang, s in zip(*(x.to_pylist() for x in b.columns), strict=True) for c in symbol_chunks_of(s or "", lang, most)]
            yield _batch(rows, kind)

    kind = f"file_path string, {_CHUNK}"
    return files.select(path, language, content).mapInArrow(run, kind)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    columns = [c.split() for c in ddl.split(", ")]
    types = {"string": pa.string(), "int": pa.int32()}
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, types[t]) for v, (_, t) in zip(values, columns, strict=True)], [n for n, _ in columns])


def find_pattern(source: str, pattern: str, language: str = "rust", inside: bool = False) -> list[tuple[int, int]]:
    """(start, end) of all matches of a code pattern, in order; see syntax.Pattern."""
    return syntax.Pattern(pattern, language).find(syntax.Source(source, language), inside=inside)


def structural_search(files: DataFrame, patterns: list[str], path: str = "file_path", content: str = "content", language: str | None = None, top_k: int | None = None, inside: bool = False) -> DataFrame:
    """(file_path, pattern, line, text, context, end_line, start_col, end_col), lines and columns from 0: matches of code patterns with the lines from one before to one
    behind them, in files of a language (files' column language, or a path's extension where that is null) if one is given, else each by
    its own; with top_k only the first ones in order of path, line and pattern. Files without a pattern's longest literal are not looked at in Python; files in
    a language without patterns have no matches. An empty pattern and an unsupported language are errors."""
    known = X.detect_language(F.col(path))
    known = F.coalesce(F.col("language"), known) if "language" in files.columns else known
    files = files.withColumn("__lang", known).where(F.col("__lang").isin(*([language] if language else syntax.LANGUAGES)))
    read = {(lang, p): syntax.Pattern(p, lang) for lang in ([language] if language else syntax.LANGUAGES) for p in patterns}

    def literal(p: str, lang: str) -> str:
        of = read[lang, p].of
        return max((t for t, k in zip(of.text, of.kind, strict=True) if k not in ("meta", "many")), key=len, default="")

    longest = {(lang, p): literal(p, lang) for lang, p in read}
    any_of = F.lit(False)
    for x in longest.values():
        any_of = any_of | (F.instr(content, x) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, lang, s in zip(*(x.to_pylist() for x in b.columns), strict=True):
                here = [p for p in patterns if longest[lang, p] in s]
                if not here:
                    continue
                lines, code = s.split("\n"), syntax.Source(s, lang)
                known = syntax.Expressions(code)
                for p in here:
                    for a, e in read[lang, p].find(code, known, inside):
                        n, m = s.count("\n", 0, a), s.count("\n", 0, e)
                        rows.append((f, p, n, s[a:e], "\n".join(lines[max(0, n - 1) : m + 2]), m, a - s.rfind("\n", 0, a) - 1, e - s.rfind("\n", 0, e) - 1))
            yield _batch(rows, kind)

    kind = "file_path string, pattern string, line int, text string, context string, end_line int, start_col int, end_col int"
    found = files.where(any_of).select(path, "__lang", content).mapInArrow(run, kind)
    return found if top_k is None else found.orderBy("file_path", "line", "pattern").limit(top_k)


def find_callers(files: DataFrame, name: str, path: str = "file_path", content: str = "content", language: str | None = None, top_k: int = 50) -> DataFrame:
    """(file_path, line): where name is called, plain or on a receiver; once per line, the first top_k in order."""
    found = structural_search(files, [f"{name}($$$)", f"$RECV.{name}($$$)"], path, content, language)
    return found.select("file_path", "line").dropDuplicates().orderBy("file_path", "line").limit(top_k)


def _struct(ddl: str) -> StructType:
    """A type of strings and integers; analysis runs where there is no session to parse it."""
    return StructType([StructField(n, StringType() if t == "string" else IntegerType()) for n, t in (c.split() for c in ddl.split(", "))])


class _Chunks:
    """symbol_chunks_of the files of a table argument (file_path, language, content; other columns aren't read), for SQL."""

    @staticmethod
    def analyze(files: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not files.isTable:
            raise ValueError("code_chunks takes a table of files")
        if missing := {"file_path", "language", "content"} - {f.name for f in files.dataType.fields}:
            raise ValueError(f"code_chunks needs the columns {sorted(missing)}")
        return AnalyzeResult(_struct(f"file_path string, {_CHUNK}"))

    def eval(self, files: Row, most: int = 512) -> Iterator[tuple]:
        for c in symbol_chunks_of(files["content"] or "", files["language"], most):
            yield (files["file_path"], *c)


class _Matches:
    """Matches of a code pattern in the files of a table argument, as structural_search gives them, for SQL."""

    @staticmethod
    def analyze(files: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        if not files.isTable or not isinstance(pattern.value, str) or not pattern.value.strip():
            raise ValueError("code_matches takes a table of files and a pattern")
        return AnalyzeResult(_struct("file_path string, line int, end_line int, text string"))

    def eval(self, files: Row, pattern: str) -> Iterator[tuple]:
        s = files["content"]
        if s and files["language"] in syntax.LANGUAGES:
            for a, e in find_pattern(s, pattern, files["language"]):
                yield files["file_path"], s.count("\n", 0, a), s.count("\n", 0, e), s[a:e]


def register_functions(spark: SparkSession) -> None:
    """Make code_chunks(TABLE(files) [, most]) and code_matches(TABLE(files), pattern) callable from SQL; PARTITION BY may follow the table."""
    spark.udtf.register("code_chunks", udtf(_Chunks))
    spark.udtf.register("code_matches", udtf(_Matches))
