"""Tokens, brackets, items and expressions of source code in Rust, TypeScript, JavaScript and Python, and patterns over them.

A lexer takes strings, characters and comments out of the way, so that what they hold is never taken for code. Brackets give the nesting.
Items (functions, types, ...) are read off the tokens at one level of it; expressions are the stretches that operator precedence gives. A pattern
is unified with tokens, its variables standing for whole expressions or groups.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import NamedTuple

LANGUAGES = ("rust", "python", "typescript", "javascript")
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_OPERATORS = r"\.\.\.|\.\.=|===|!==|\*\*=|\?\?=|&&=|\|\|=|=>|->|::|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\.\.|:=|//|\*\*|\+\+|--|[-+*/%&|^]="
_RUST_OPERATORS = r"\.\.\.|\.\.=|=>|->|::|==|!=|<=|>=|&&|\|\||\.\.|[-+*/%&|^]="
_NUMBER = r"(?P<number>\d\w*(?:\.\d\w*)?(?:(?<=[eE])[-+]\d+)?)"
_META = r"(?P<many>\$\$\$[A-Z0-9_]*)|(?P<meta>\$[A-Z_][A-Z0-9_]*)"
_LEX = {
    "rust": r'(?P<comment>//[^\n]*)|(?P<nested>/\*)|(?P<string>(?:br|cr|r)(?P<h>#*)".*?"(?P=h)|[bc]?"(?:\\.|[^"\\])*"'
    + r"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^\\'\n])')|(?P<life>'[^\W\d]\w*)|" + _NUMBER + r"|(?P<word>(?:r#)?[^\W\d]\w*)|(?P<op>" + _RUST_OPERATORS + r"|\S)",
    "typescript": r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<tick>`)|" + _NUMBER + r"|(?P<word>#?[^\W\d$]?[\w$]+)|(?P<op>" + _OPERATORS.replace("//|", "") + r"|\S)",
    "python": r"(?P<comment>#[^\n]*)|(?P<string>(?i:[rbuf]{0,2})(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'))|" + _NUMBER + r"|(?P<word>[^\W\d]\w*)|(?P<op>" + _OPERATORS + r"|\S)",
}
_LEX["javascript"] = _LEX["typescript"]
_SCAN = {(k, p): re.compile((_META + "|" if p else "") + v, re.S) for k, v in _LEX.items() for p in (False, True)}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = set("( , = : [ ! & | ? { } ; + - * % ^ ~ < > => && || ?? == === != !== return typeof case in of new delete void throw else".split())


class Source:
    """The tokens of a text, without comments: kind, text, start, end, fresh (first on its line) and partner (of a bracket: its other half, or -1)."""

    def __init__(self, text: str, language: str, pattern: bool = False):
        self.source, self.language = text, language
        self.kind: list[str] = []
        self.text: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.comments: list[tuple[int, int]] = []
        scan, at = _SCAN[language, pattern], 0
        while m := scan.search(text, at):
            kind, lo, hi = m.lastgroup, m.start(), m.end()
            if kind == "h":
                kind = "string"
            if kind == "nested":
                kind, hi = "comment", _nested_end(text, lo)
            elif kind == "tick":
                kind, hi = "string", _template_end(text, lo)
            elif m[0] == "/" and language in ("typescript", "javascript") and (not self.text or self.text[-1] in _BEFORE_REGEX) and (r := _REGEX.match(text, lo)):
                kind, hi = "string", r.end()
            at = hi
            if kind == "comment":
                self.comments.append((lo, hi))
                continue
            self.kind.append(kind)
            self.text.append(text[lo:hi])
            self.start.append(lo)
            self.end.append(hi)
        n = len(self.text)
        self.fresh = [i == 0 or "\n" in text[self.end[i - 1] : self.start[i]] for i in range(n)]
        self.partner, stack = [-1] * n, []
        for i, (k, w) in enumerate(zip(self.kind, self.text, strict=True)):
            if k != "op":
                continue
            if w in _CLOSES:
                stack.append(i)
            elif w in ")]}":
                if stack and _CLOSES[self.text[stack[-1]]] == w:
                    self.partner[i] = stack.pop()
                    self.partner[self.partner[i]] = i

    def __len__(self) -> int:
        return len(self.text)

    def opens(self, i: int) -> bool:
        return self.partner[i] > i

    def after(self, i: int) -> int:
        """The place behind token i, or behind the group that it opens."""
        return self.partner[i] + 1 if self.partner[i] > i else i + 1

    def is_(self, i: int, *words: str) -> bool:
        return i < len(self.text) and self.kind[i] in ("word", "op") and self.text[i] in words


def _nested_end(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _template_end(text: str, at: int) -> int:
    """The end of a template literal, whose ${...} hold code, with strings and templates of their own."""
    i, depth = at + 1, []
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if depth and depth[-1]:
            # in code: braces nest, strings and templates are skipped
            if c in "\"'" and (m := re.compile(rf"{c}(?:\\.|[^{c}\\\n])*{c}").match(text, i)):
                i = m.end()
                continue
            if c == "`":
                depth.append(0)
            elif c in "{}":
                depth[-1] += 1 if c == "{" else -1
                if not depth[-1]:
                    depth.pop()
        elif c == "`":
            if not depth:
                return i + 1
            depth.pop()
        elif text.startswith("${", i):
            depth.append(1)
            i += 1
        i += 1
    return len(text)


class Item(NamedTuple):
    """Code at one level: kind (null for what isn't a symbol), name, and its place in the text."""

    kind: str | None
    name: str | None
    start: int
    end: int
    first: int  # token
    last: int  # token behind it


# What opens an item in Rust, and its kind.
_RUST_ITEMS = {"fn": "function_item", "struct": "struct_item", "impl": "impl_item", "trait": "trait_item", "enum": "enum_item", "mod": "mod_item", "const": "const_item", "static": "static_item", "type": "type_item"}
# What opens a declaration in TypeScript or JavaScript, and its kind.
_SCRIPT_ITEMS = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration"}
_GOES_ON = set("= + - * / % & | ^ ! ~ < > ? : , . => && || ?? == === != !== <= >= += -= *= /= ?. extends implements typeof new in of instanceof else as keyof".split())
_CONTINUES = set(". ?. , ) ] = => ? : && || ?? + - * / % == === != !== < > <= >= & | ^ ( [ else catch finally as satisfies instanceof in extends implements {".split())


def _rust_item(s: Source, i: int, hi: int) -> tuple[str | None, str | None, int]:
    """(kind, name, place behind) of the item at token i."""
    if s.is_(i, "#"):
        j = i + 1 + s.is_(i + 1, "!")
        return None, None, s.after(j) if j < hi else hi
    j = i
    if s.is_(j, "pub"):
        j = s.after(j + 1) if s.is_(j + 1, "(") else j + 1
    while j + 1 < hi:
        if s.is_(j, "async", "unsafe", "default", "auto") and s.kind[j + 1] == "word" or s.is_(j, "const") and s.is_(j + 1, "fn", "unsafe", "async", "extern"):
            j += 1
        elif s.is_(j, "extern") and (s.is_(j + 1, "fn") or s.kind[j + 1] == "string" and s.is_(j + 2, "fn")):
            j += 1 + (s.kind[j + 1] == "string")
        else:
            break
    if s.is_(j, "macro_rules") and s.is_(j + 1, "!") and j + 3 < hi:
        end = s.after(j + 3)
        return "macro_definition", s.text[j + 2], end + (s.is_(end, ";") and not s.is_(j + 3, "{"))
    word = s.text[j] if j < hi and s.kind[j] == "word" else ""
    kind, k = _RUST_ITEMS.get(word), j
    to_end = word in ("const", "static", "type", "use", "let")
    while k < hi and not s.is_(k, ";") and (to_end or not s.is_(k, "{")):
        k = s.after(k)
    ends_open = k < hi and s.is_(k, "{")
    end = min(hi, s.after(k)) if k < hi else hi
    if ends_open and not kind and s.is_(end, ";"):
        end += 1
    if word == "fn" and not ends_open:
        kind = None
    at = j + 1 + s.is_(j + 1, "mut")
    name = s.text[at] if kind and word != "impl" and at < hi else None
    return kind, name, end


def _statement_end(s: Source, i: int, hi: int) -> int:
    """Behind the semicolon, or before the line on which the next statement begins."""
    j = i
    while j < hi:
        if s.is_(j, ";"):
            return j + 1
        if j > i and s.fresh[j] and not (s.kind[j - 1] in ("op", "word") and s.text[j - 1] in _GOES_ON) and not (s.kind[j] in ("op", "word") and s.text[j] in _CONTINUES):
            return j
        j = s.after(j)
    return hi


def _script_item(s: Source, i: int, hi: int) -> tuple[str | None, str | None, int]:
    j = i
    while s.is_(j, "@"):
        j += 2
        while j < hi and (s.is_(j, ".") or s.is_(j, "(") or s.is_(j - 1, ".")):
            j = s.after(j)
    if s.is_(j, "export", "declare") or s.is_(j, "abstract") and s.is_(j + 1, "class"):
        k = j + 1 + s.is_(j + 1, "default")
        if s.is_(k, "{", "*", "=") or k >= hi:
            return None, None, _statement_end(s, j, hi)
        return None, None, _script_item(s, k, hi)[2]
    k = j + (s.is_(j, "async") and s.is_(j + 1, "function"))
    if s.is_(k, "function"):
        star = s.is_(k + 1, "*")
        name, at = s.text[k + 1 + star] if k + 1 + star < hi else None, k + 1
        while at < hi and not s.is_(at, "("):
            at = s.after(at)
        at = s.after(at) if at < hi else hi
        body = _body(s, at, hi)
        if body < hi and s.is_(body, "{"):
            return (None, None, s.after(body)) if star else ("function_declaration", name, s.after(body))
        return None, None, min(hi, body + s.is_(body, ";"))
    k = j + (s.is_(j, "const") and s.is_(j + 1, "enum"))
    if k + 1 < hi and s.kind[k] == "word" and s.text[k] in _SCRIPT_ITEMS and s.kind[k + 1] == "word":
        body = _body(s, k + 1, hi)
        return _SCRIPT_ITEMS[s.text[k]], s.text[k + 1], min(hi, s.after(body)) if body < hi else hi
    if s.is_(j, "type") and j + 2 < hi and s.kind[j + 1] == "word" and s.is_(j + 2, "=", "<"):
        return "type_alias_declaration", s.text[j + 1], _statement_end(s, j, hi)
    if s.is_(j, "const", "let") and j + 1 < hi:
        return "lexical_declaration", None, _statement_end(s, j, hi)
    return None, None, _statement_end(s, j, hi)


def _body(s: Source, i: int, hi: int) -> int:
    """The braces of a declaration's body from token i on, not those of a type; or its semicolon or the next statement."""
    j = i
    while j < hi:
        if s.is_(j, "{") and not (j > 0 and s.is_(j - 1, ":", "|", "&", "=>", "<", ",", "=", "extends")) or s.is_(j, ";"):
            return j
        if j > i and s.fresh[j] and s.kind[j] == "word" and s.text[j] not in _CONTINUES and s.text[j - 1] not in _GOES_ON:
            return j
        j = s.after(j)
    return hi


def items(s: Source, lo: int = 0, hi: int | None = None) -> list[Item]:
    """The items at one level of Rust, TypeScript or JavaScript: those of tokens lo to hi."""
    hi, out, i, read = len(s) if hi is None else hi, [], lo, _rust_item if s.language == "rust" else _script_item
    while i < hi:
        if s.is_(i, ";"):
            i += 1
            continue
        kind, name, end = read(s, i, hi)
        end = max(i + 1, min(end, hi))
        out.append(Item(kind, name, s.start[i], s.end[end - 1], i, end))
        i = end
    return out


def members(s: Source, item: Item) -> list[Item]:
    """The symbols in an item's own braces, one level deep."""
    out = []
    i = item.first
    while i < item.last:
        if s.is_(i, "{") and s.opens(i):
            out += [m for m in items(s, i + 1, s.partner[i]) if m.kind]
        i = s.after(i)
    return out


class _Lines:
    """Places in a text of positions that ast gives: line from 1 and column in UTF-8 bytes."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.begin = [0]
        for x in self.lines:
            self.begin.append(self.begin[-1] + len(x) + 1)

    def at(self, line: int, column: int) -> int:
        return self.begin[line - 1] + len(self.lines[line - 1].encode()[:column].decode())


def python_items(text: str, body: list[ast.stmt] | None = None) -> tuple[list[Item], list[list[Item]]]:
    """The items of a Python text, and of each its members, one level deep. Raises SyntaxError where the text isn't Python."""
    lines, top = _Lines(text), body is None
    out, inner = [], []
    for node in ast.parse(text).body if body is None else body:
        symbol = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
        decorated = symbol and node.decorator_list
        start = lines.at(node.decorator_list[0].lineno, node.decorator_list[0].col_offset) if decorated else lines.at(node.lineno, node.col_offset)
        if decorated:
            start = text.rindex("@", 0, start)
        kind = None if not symbol else "decorated_definition" if decorated else "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
        out.append(Item(kind, node.name if symbol and not decorated else None, start, lines.at(node.end_lineno, node.end_col_offset), 0, 0))
        if decorated and top:
            plain = Item("class_definition" if isinstance(node, ast.ClassDef) else "function_definition", node.name, lines.at(node.lineno, node.col_offset), out[-1].end, 0, 0)
            inner.append([plain])
        else:
            inner.append([m for m in python_items(text, node.body)[0] if m.kind] if symbol and top else [])
    return out, inner


# Words that are no operand in each language.
_KEYWORDS = {
    "rust": set("fn let struct enum impl trait mod const static type use pub if else for while loop match return break continue where in unsafe extern macro_rules union".split()),
    "typescript": set("function class interface enum const let var if else for while do switch case default return break continue throw try catch finally export import extends implements".split()),
    "python": set("def class if elif else for while with try except finally return import from pass break continue raise global nonlocal lambda assert del".split()),
}
_KEYWORDS["javascript"] = _KEYWORDS["typescript"]
_MODIFIERS = set("pub async unsafe const extern export default abstract static declare".split())
_PREFIX = set("- ! * & && ~ not await typeof new void delete ref mut dyn move box yield ... impl".split())
_LEVELS = ["= += -= *= /= %= **= &= |= ^= ??= &&= ||= := =>", "? : .. ..=", "|| or ??", "&& and", "== != === !== < > <= >= in is instanceof", "|", "^", "&", "+ -", "* / % // @", "** as satisfies"]
_SCRIPT_LEVELS = [*_LEVELS[:4], "|", "^", "&", _LEVELS[4], *_LEVELS[8:]]
_BINDS = {lang: {w: n for n, ws in enumerate(levels) for w in ws.split()} for lang, levels in (("rust", _LEVELS), ("python", _LEVELS), ("typescript", _SCRIPT_LEVELS), ("javascript", _SCRIPT_LEVELS))}
for _lang in ("rust", "python"):
    for _w in ("?", ":"):
        del _BINDS[_lang][_w]


class Expressions:
    """ends[i]: where the expressions that begin at token i end, by operator precedence; groups are expressions too."""

    def __init__(self, s: Source):
        self.s, self.binds, self.words = s, _BINDS[s.language], _KEYWORDS[s.language]
        self.ends: list[set[int]] = [set() for _ in range(len(s))]
        levels = [(0, len(s), False)] + [(i + 1, s.partner[i], True) for i in range(len(s)) if s.opens(i)]
        for i in range(len(s)):
            if s.opens(i):
                self.ends[i].add(s.after(i))
        for lo, hi, inside in levels:
            i = lo
            while i < hi:
                i = max(self._expression(i, hi, 0, inside), s.after(i))

    def _angles(self, i: int, hi: int) -> int:
        """Behind the > of type arguments that < at token i opens; 0 if it opens none."""
        s, depth = self.s, 0
        while i < hi:
            if s.is_(i, "<"):
                depth += 1
            elif s.is_(i, ">"):
                depth -= 1
                if not depth:
                    return i + 1
            elif not (s.kind[i] in ("word", "life", "number", "string", "meta", "many") or s.opens(i) or s.is_(i, ",", "::", "&", "=", "|", ".", ":", "->", "=>", "?", "*", "+")):
                return 0
            i = s.after(i)
        return 0

    def _expression(self, i: int, hi: int, least: int, inside: bool) -> int:
        """The end of the longest expression at token i whose operators bind at least so much; i if none begins there."""
        s = self.s
        if i >= hi:
            return i
        mark = self.ends[i].add
        if (s.kind[i] in ("op", "word") and s.text[i] in _PREFIX or s.kind[i] == "life") and not s.opens(i):
            j = self._expression(i + 1, hi, len(_LEVELS), inside)
            if j == i + 1:
                return i
            mark(j)
        elif s.kind[i] in ("number", "string", "meta", "many") or s.kind[i] == "word" and s.text[i] not in self.words and s.text[i] not in self.binds:
            j = i + 1
            mark(j)
        elif s.opens(i):
            j = s.after(i)
        else:
            return i
        while j < hi and not (s.fresh[j] and not inside and s.language == "python"):
            if s.is_(j, ".", "::", "?.") and j + 1 < hi and (s.kind[j + 1] in ("word", "number", "meta") or s.is_(j, "::") and s.is_(j + 1, "<") or s.is_(j, "?.") and s.opens(j + 1)):
                if s.is_(j + 1, "<"):
                    k = self._angles(j + 1, hi)
                    if not k:
                        break
                    j = k
                else:
                    j = s.after(j + 1)
            elif s.is_(j, "(", "[") and s.opens(j):
                j = s.after(j)
            elif s.is_(j, "!") and s.language == "rust" and j + 1 < hi and s.opens(j + 1) and s.end[j] == s.start[j + 1]:
                j = s.after(j + 1)
            elif s.is_(j, "?") and s.language == "rust" or s.is_(j, "++", "--"):
                j += 1
            elif s.is_(j, "<") and s.language != "python" and s.kind[j - 1] in ("word", "meta") and (k := self._angles(j, hi)):
                j = k
            else:
                break
            mark(j)
        while j < hi and s.kind[j] in ("op", "word") and not (s.fresh[j] and not inside and s.language == "python"):
            level = self.binds.get(s.text[j])
            if level is None or level < least:
                break
            at = j + 1 + (s.is_(j, "is") and s.is_(j + 1, "not"))
            k = self._expression(at, hi, level + (level > 1), inside)
            if k == at:
                break
            j = k
            mark(j)
        return j


class Pattern:
    """A code pattern: $X is one expression or group, the same wherever it is named again ($_ and names that begin with _ are any); $$$ or $$$X any
    number of tokens and groups."""

    def __init__(self, pattern: str, language: str):
        if language not in _KEYWORDS:
            raise ValueError(f"unsupported language {language!r}")
        self.of = Source(pattern, language, pattern=True)
        if not len(self.of):
            raise ValueError("a pattern needs a token")
        first = self.of.text[0]
        self.statement = self.of.kind[0] == "word" and first in _KEYWORDS[language] or first in ("#", "@")

    def _ends(self, s: Source, e: Expressions, p: int, i: int, bound: dict) -> Iterator[int]:
        pat, n = self.of, len(s)
        while p < len(pat) and pat.kind[p] not in ("meta", "many"):
            if i >= n or s.text[i] != pat.text[p] or s.kind[i] != pat.kind[p]:
                return
            p, i = p + 1, i + 1
        if p == len(pat):
            yield i
            return
        if i > n:
            return
        name = pat.text[p].lstrip("$")
        free = name.startswith("_") or not name
        known = None if free else bound.get(name)
        if known is not None:
            if s.text[i : i + len(known)] == known:
                yield from self._ends(s, e, p + 1, i + len(known), bound)
            return
        if pat.kind[p] == "meta":
            ends = sorted(e.ends[i]) if i < n else []
        else:
            ends, j = [i], i
            while j < n and not (s.kind[j] == "op" and s.text[j] in ")]}") and (s.text[j] not in _CLOSES or s.kind[j] != "op" or s.opens(j)):
                j = s.after(j)
                ends.append(j)
        for j in ends:
            yield from self._ends(s, e, p + 1, j, bound if free else bound | {name: s.text[i:j]})

    def find(self, s: Source, e: Expressions | None = None, inside: bool = False) -> list[tuple[int, int]]:
        """(start, end) in the text of all matches, in order, the longer first: whole expressions, or statements if the pattern begins with a
        keyword. With inside a match may begin and end anywhere, as at the last name of a call."""
        e = e or Expressions(s)
        out, first, meta = set(), self.of.text[0], self.of.kind[0] in ("meta", "many")
        for i in range(len(s)):
            if not meta and (s.text[i] != first or s.kind[i] != self.of.kind[0]):
                continue
            for j in self._ends(s, e, 0, i, {}):
                if j <= i:
                    continue
                if not inside and self.statement:
                    if i and (s.text[i - 1] in _MODIFIERS or s.is_(i - 1, ")") and s.is_(s.partner[i - 1] - 1, "pub")) or s.is_(j, "else"):
                        continue
                    if not (j == len(s) or s.fresh[j] or s.is_(j, ";", ",", ")", "]", "}") or s.text[j - 1] in ("}", ";")):
                        continue
                    j += s.is_(j, ";")
                elif not inside and j not in e.ends[i]:
                    continue
                out.add((s.start[i], s.end[j - 1]))
        return sorted(out, key=lambda x: (x[0], -x[1]))
