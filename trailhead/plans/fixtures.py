"""Small literal inputs of registered queries."""

#: case_id, priority, kind, literal, include glob, exclude glob
GOLDEN_CHECKS = [
    ("c1", "critical", "must", "License", "src*/en/*", ""),
    ("c1", "critical", "must_not", "BEGIN RSA PRIVATE KEY", "src*", ""),
    ("c2", "high", "must", "Copyright", "", ""),
    ("c2", "high", "must_not", "@", "src1*/de/*", "**/d9*"),
    ("c3", "medium", "must", "|", "src?/en/*", ""),
    ("c3", "medium", "must_not", "!!", "src2/*", ""),
    ("c4", "low", "must", "the", "src*/**", "src0/**"),
    ("c4", "low", "must_not", "Licensed under", "src*", "src1/**/d1.txt"),
    ("c5", "medium", "must", "die", "src*/de/*", ""),
    ("c6", "critical", "must", "no such passage anywhere", "", ""),
]
#: The same for code patterns; the entry without a language is wrong on purpose.
CODE_CHECKS = [
    ("s1", "high", "structural_must_not", "python:print($X)", "", ""),
    ("s1", "high", "structural_must", "python:run($$$)", "src/p1**", ""),
    ("s2", "low", "structural_must", "python:absent($X)", "", ""),
    ("s2", "low", "structural_must", "no language", "", ""),
    ("s3", "medium", "structural_must_not", "python:self.run($X)", "src/p2**", "*2.py"),
]
#: One golden set of both families: two cases have literals and patterns.
ALL_CHECKS = [*GOLDEN_CHECKS, *CODE_CHECKS, ("c1", "critical", "structural_must", "python:run($$$)", "src/p1**", ""), ("c5", "medium", "structural_must_not", "python:print($X)", "", "")]
PREFIXES = ["i1", "i12", "i149", "i1234", "i14999", "zz", "i", "77", "1234", "9"]
#: Sources by language, as parts that stand one below another: (kind, name, scope, text), kind null for what is no symbol. ~ stands for a number. Texts
#: hold braces and calls where they are no code: in strings, characters, templates, regular expressions and comments.
CODE_PARTS = {
    "rust": [
        (None, None, None, "//! notes { on ~\nuse std::{io, fs};\n"),
        ("struct_item", "S~", None, "pub struct S~<T> where T: Fn() -> u8 {\n    x: T,\n}\n"),
        ("function_item", "open~", None, "pub(crate) fn open~<'a>(c: char, s: &'a str) -> bool {\n    let t = \"}}\"; /* { /* nested */ a.unwrap() */\n    let r = r#\"}\"{ b.unwrap()\"#;\n    c == '{' && c == c\n}\n"),
        ("macro_definition", "twice~", None, "macro_rules! twice~ {\n    ($x:expr) => { $x + $x };\n}\n"),
        ("impl_item", None, None, "impl<T> Shape for S~<T> {\n    fn area(&self) -> u32 { self.w.get(~).unwrap() }\n}\n"),
        (None, None, None, "thread_local! { static SEEN: u8 = 1; }\n"),
        ("const_item", "N~", None, "const N~: [u8; 2] = { [1, 2] };"),
    ],
    "typescript": [
        (None, None, None, "import { q } from \"q{\"\n"),
        ("class_declaration", "C~", None, "@Tag({ n: ~ })\nclass C~<T extends { x: 1 }> {\n  m() { return `}${ q(`{${1}`) }`; }\n}\n"),
        ("function_declaration", "f~", None, "async function f~(a: { b: number } = { b: 1 }): Promise<{ c: number }> {\n  const re = /[}/]{2}/;\n  return { c: a.b };\n}\n"),
        ("type_alias_declaration", "U~", None, "type U~ = { a: 1 }\n  | { b: 2 }\n"),
        (None, None, None, "export function ex~(): { a: number } { return { a: 1 } }\n"),
        ("lexical_declaration", None, None, "const g~ = (a) => a.x === a.x"),
    ],
    "python": [
        (None, None, None, "import os\n"),
        ("decorated_definition", None, None, "@cache(\n    size=~)\ndef d~(x):\n    return x == x\n"),
        ("class_definition", "C~", None, "class C~:\n    \"\"\"def no(): { print(1)\"\"\"\n    n = 1  # print(2)\n    def m(self): return self.run(~)\n"),
        (None, None, None, "print(f\"{~}\" + str(~))"),
    ],
}
#: An oversized item gives way to its members.
CODE_BIG = [
    (None, None, None, "mod big~ {"),
    ("function_item", "one~", "big~/one~", "fn one~() {\n" + "    x = 1 ;\n" * 150 + "}"),
    ("struct_item", "Two", "big~/Two", "struct Two;"),
    (None, None, None, "}"),
]
#: language, pattern, and what it matches in the sources above: line, end line and text.
CODE_MATCHES = [
    ("rust", "$X.unwrap()", [(18, 18, "self.w.get(~).unwrap()")]),
    ("rust", "$X == $X", [(10, 10, "c == c")]),
    ("rust", "fn $NAME($$$ARGS) -> $RET $BODY", [(18, 18, "fn area(&self) -> u32 { self.w.get(~).unwrap() }")]),
    ("rust", "struct $NAME $BODY", []),
    ("typescript", "$A.x === $A.x", [(17, 17, "a.x === a.x")]),
    ("typescript", "const $NAME = ($$$) => $BODY", [(17, 17, "const g~ = (a) => a.x === a.x")]),
    ("python", "$X == $X", [(5, 5, "x == x")]),
    ("python", "print($X)", [(12, 12, "print(f\"{~}\" + str(~))")]),
]
