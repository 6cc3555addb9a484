"""Text functions: tokens, globs, routing, budgets. All are column expressions inside whole-stage plans."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def token_set(c: Column) -> Column:
    """Distinct tokens of letters, digits and _, A-Z lower-cased, of at least two bytes."""
    return F.array_distinct(F.filter(F.split(ascii_lower(c), r"[^\p{L}\p{N}_]+"), lambda t: F.octet_length(t) >= 2))


def _folds() -> tuple[str, str]:
    """Latin letters that are a base letter and marks above or below it, and their base letters."""
    found = {}
    for n in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(n))
        if marks and all(unicodedata.combining(m) for m in marks) and chr(n).lower() == chr(n):
            found[chr(n)] = base
    return "".join(found), "".join(found.values())


FOLD_FROM, FOLD_TO = _folds()


def index_tokens(c: Column) -> Column:
    """Tokens of letters and digits for the inverted index, lower-cased, marks folded away, in order."""
    return F.filter(F.split(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def groundedness(query_tokens: Column, content_tokens: Column) -> Column:
    """Share of the query's tokens that the content has; 0 without query tokens."""
    n = F.size(query_tokens)
    return F.when(n > 0, F.size(F.array_intersect(query_tokens, content_tokens)) / n).otherwise(0.0)


def words(c: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def token_estimate(c: Column) -> Column:
    return F.size(words(c))


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4).cast("int"))


def lines(c: Column) -> Column:
    """Lines without their ends; an empty last line doesn't count."""
    parts = F.split(F.regexp_replace(c, "\r\n", "\n"), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def tail_lines(c: Column, n: int) -> Column:
    parts = lines(c)
    return F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), F.lit(n))


def encoder_text(c: Column) -> Column:
    """A-Z lower-cased; whatever is no ASCII letter or digit is a blank."""
    return F.regexp_replace(ascii_lower(c), "[^a-z0-9]", " ")


def trigrams(c: Column) -> Column:
    """All runs of three characters of the encoder's text without white space, in one pass over it."""
    return F.regexp_extract_all(F.regexp_replace(encoder_text(c), " ", ""), F.lit("(?=(...))"), F.lit(1))


def neighbour_pairs(tokens: Column) -> Column:
    """Each token and the next one, joined by a blank. Nothing is looked up by place, so the tokens are made once."""
    after = F.slice(tokens, F.lit(2), F.greatest(F.lit(0), F.size(tokens) - 1))
    return F.filter(F.zip_with(tokens, after, lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())


def sql_glob(c: Column, pattern: str) -> Column:
    """GLOB as in SQL: * crosses slashes, ? is one character, case counts, the whole path must fit."""
    body = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern)
    return c.rlike(f"(?s)^{body}$")


def path_glob(c: Column, pattern: str) -> Column:
    """The exclude dialect: ** tests a prefix and a suffix, * only a suffix, else equality."""
    if "**" in pattern:
        head, tail = pattern.split("**", 1)
        head, tail = head.rstrip("/"), tail.lstrip("/")
        tail = tail.lstrip("*") if "*" in tail else tail
        return c.startswith(head) & c.endswith(tail)
    if "*" in pattern:
        return c.endswith(pattern.lstrip("*"))
    return c == pattern


def _identifier(t: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(t, r"^[^\p{L}\p{N}_:]+", ""), r"[^\p{L}\p{N}_:]+$", "")
    mixed = t.rlike(r"\p{Lu}") & t.rlike(r"\p{Ll}")
    return (t != "") & (F.octet_length(t) <= 32) & (t.contains("_") | t.contains("::") | mixed | t.rlike("[0-9]"))


# Openings of conceptual questions and marks of symbol queries.
QUESTION_WORDS = ("how", "why", "what", "when", "where", "which", "who", "explain", "describe", "compare")
SYMBOL_MARKS = ("::", "->", ".", "#")


def route_query(c: Column) -> Column:
    """The retrieval strategy of a query by its shape: deterministic, semantic or hybrid."""
    q = F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")
    t = words(q)
    n = F.size(t)
    marks = q.rlike("|".join(re.escape(m) for m in SYMBOL_MARKS))
    exact = (n <= 3) & F.forall(t, _identifier)
    conceptual = ascii_lower(q).rlike(f"^({'|'.join(QUESTION_WORDS)}) ") | (n >= 5)
    symbol = marks | exact
    return F.when((q == "") | (symbol == conceptual), "hybrid").when(symbol, "deterministic").otherwise("semantic")


def select_lane(tokens: Column, remote: Column, local: Column, pressure: int = 1024, default: str = "mcp") -> Column:
    """Protocol lane: token pressure first, then remote work, then local work."""
    return F.when(tokens >= pressure, "progressive-mcp").when(remote, "mcp").when(local, "cli").otherwise(default)


def parse_strategy(c: Column) -> Column:
    """The map in a label of the form k=v;k=v."""
    return F.str_to_map(c, F.lit(";"), F.lit("="))


def scope(c: Column) -> Column:
    """A worktree id: trimmed, project-root where empty or null."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("project-root"))


# File extensions and their languages.
LANGUAGES = {"rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "toml": "toml", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "markdown": "markdown"}


def detect_language(path: Column) -> Column:
    """Language by file extension; null where unknown."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, ext)


def script_refs(c: Column) -> Column:
    """Scripts that a document tells to run: npm run X, pnpm [run] X, yarn X; sorted, distinct."""
    t = words(c)
    rest = lambda n: F.slice(t, F.lit(n + 1), F.greatest(F.lit(0), F.size(t) - n))
    pairs = F.zip_with(t, rest(1), lambda a, b: F.struct(a.alias("tool"), F.coalesce(b, F.lit("")).alias("one")))
    three = F.zip_with(pairs, rest(2), lambda p, b: F.struct(p["tool"].alias("tool"), p["one"].alias("one"), F.coalesce(b, F.lit("")).alias("two")))

    def ref(x: Column) -> Column:
        tool, one = x["tool"], x["one"]
        name = F.when(tool.isin("npm", "pnpm") & (one == "run"), x["two"]).when(tool.isin("pnpm", "yarn"), one).otherwise("")
        name = F.regexp_replace(F.regexp_replace(name, "^[`\"'()]+", ""), "[`\"'()]+$", "")
        name = F.regexp_replace(F.regexp_replace(name, "^[,.;:]+", ""), "[,.;:]+$", "")
        return F.when(name.startswith("-"), "").otherwise(name)

    return F.array_sort(F.array_distinct(F.filter(F.transform(three, ref), lambda x: x != "")))


def placeholders(c: Column) -> Column:
    """Names in {{ }}, sorted, distinct."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1))))


def render(template: Column, variables: Column) -> Column:
    """template with {{ name }} replaced by variables' (a map) value, in one pass: values aren't looked at again, and unknown names and braces that
    don't close stay as they are."""
    none = F.lit(None).cast("string")
    parts = F.split(template, r"\{\{", -1)

    def fold(acc: Column, part: Column) -> Column:
        body = F.when(acc["open"].isNull(), part).otherwise(F.concat(acc["open"], F.lit("{{"), part))
        end = F.instr(body, F.lit("}}"))
        value = F.try_element_at(variables, F.regexp_replace(F.substring(body, F.lit(1), end - 1), r"^\s+|\s+$", ""))
        done = F.when(value.isNull(), F.concat(F.lit("{{"), body)).otherwise(F.concat(value, F.substring(body, end + 2, F.length(body))))
        return F.when(end == 0, F.struct(acc["text"].alias("text"), body.alias("open"))).otherwise(F.struct(F.concat(acc["text"], done).alias("text"), none.alias("open")))

    start = F.struct(parts[0].alias("text"), none.alias("open"))
    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), start, fold, lambda acc: F.concat(acc["text"], F.when(acc["open"].isNull(), "").otherwise(F.concat(F.lit("{{"), acc["open"]))))


def wrapped_json(c: Column) -> Column:
    """What stands from the first { to the last }."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


# Parts of paths by which a session's context files may need an update.
GROW_MARKS = {
    "architecture": ("mod.rs", "lib.rs", "main.rs", "router", "server", "handler", "service", "middleware", "api"),
    "conventions": ("error", "types", "schema", "model", "config", "util", "helper"),
    "setup": ("docker", "makefile", "justfile", "cargo.toml", "package.json", ".env", "setup", "compose"),
}


def touches(path: Column, category: str) -> Column:
    return F.lower(path).rlike("|".join(re.escape(x) for x in GROW_MARKS[category]))


# Paths that a watcher ignores.
IGNORED_HEADS, IGNORED_TAILS = (".git/", "target/", "node_modules/", ".activity/"), (".swp", ".tmp")


def ignored(rel: Column) -> Column:
    heads, tails = (f"{'|'.join(re.escape(x) for x in xs)}" for xs in (IGNORED_HEADS, IGNORED_TAILS))
    return rel.rlike(f"^({heads})") | rel.rlike(f"({tails})$")


def relative(path: Column, root: str) -> Column:
    """A path below root, relative to it, with slashes; relative paths as they are; null outside."""
    p, base = F.replace(path, F.lit("\\"), F.lit("/")), root.rstrip("/") + "/"
    return F.when(p.startswith(base), F.substr(p, F.lit(len(base) + 1))).when(~p.startswith("/"), p)


def unwatched(path: Column, root: str) -> Column:
    """Whether a watcher ignores a path: by its part below root, or as it is outside."""
    return F.coalesce(ignored(relative(path, root)), F.lit(True))


# The kinds of file events that count.
CORE_EVENTS = ("create", "modify", "remove")


def core_event(kind: Column) -> Column:
    return kind.isin(*CORE_EVENTS)


def bounded(c: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(c, 1, n)


def normal_newlines(c: Column) -> Column:
    """Line ends as line feeds, one at the end."""
    body = F.regexp_replace(c, "\r\n?", "\n")
    return F.when(body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))


# What a generated prompt must mention.
ANCHORS = ("docs generate", "docs/specs/constitution.md", "{{placeholder}}", "search_code", "Provide Result")


def missing_anchors(c: Column, anchors: tuple[str, ...] = ANCHORS) -> Column:
    """The anchors that a text doesn't hold, in their order."""
    return F.array_compact(F.array(*[F.when(F.instr(c, a) == 0, a) for a in anchors]))


def rfc3339(seconds: Column) -> Column:
    """Seconds since 1970 as a time in UTC, whatever the session's time zone."""
    at = F.timestamp_add("SECOND", seconds.cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def path_regex(glob: str) -> str:
    """A glob over paths as a regular expression: * and ? stay within a folder, ** crosses folders."""
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def path_pattern(glob: Column) -> Column:
    """``path_regex`` of a column of globs."""
    out = F.regexp_replace(glob, r"([\\.\[\]{}()+^$|#&~-])", r"\\$1")
    for a, b in (("**/", "\x01"), ("**", "\x02"), ("?", "[^/]"), ("*", "[^/]*"), ("\x01", "(?:.*/)?"), ("\x02", ".*")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit("^"), out, F.lit("$"))
