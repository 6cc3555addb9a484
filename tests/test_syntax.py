"""Lexing, items, expressions and patterns of source code."""

import pytest
from pyspark.sql import functions as F

from trailhead.operators import chunking, syntax
from trailhead.sources.adapters import Tables


def hits(source, pattern, language="rust", **k):
    return [source[a:b] for a, b in chunking.find_pattern(source, pattern, language, **k)]


def kinds(source, language):
    return [(c[3], c[2]) for c in chunking.symbol_chunks_of(source, language)]


def test_strings_and_comments_hold_no_code():
    rust = "fn a() { let c = '{'; let d = b'\\''; let s = \"}\"; let r = br##\"}\"# {\"##; /* { /* } */ */ // }\n}\nfn b<'x>(y: &'x str) -> char { '}' }\n"
    assert kinds(rust, "rust") == [("function_item", "a"), ("function_item", "b")]
    ts = "function a() { return `}${ f({ g: `{${'}'}` }) }`; /* } */ }\nfunction b(x) { return /[/}]\\/{/.test(x) || x / 2 / 3; } // {\nfunction c() {}"
    assert kinds(ts, "typescript") == [("preamble", "_preamble"), *(("function_declaration", x) for x in "abc")]
    assert hits("a.unwrap(); // b.unwrap()\nlet s = \"c.unwrap()\"; /* d.unwrap() */", "$X.unwrap()") == ["a.unwrap()"]
    assert hits("print(1) # print(2)\nx = \"\"\"print(3)\"\"\"\ny = f'print({4})'", "print($X)", "python") == ["print(1)"]


def test_kinds_of_items():
    rust = "use a::{b, c};\n#[derive(Debug)]\npub(crate) struct A<const N: usize>(u8);\nunsafe impl Send for A {}\npub unsafe extern \"C\" fn e() {}\nconst fn f() {}\nconst C: [u8; 1] = { [1] };\nstatic mut S: u8 = 1;\nmod m;\nmacro_rules! w ( () => {}; );\ntrait T { fn sig(); }\ntype Y = u8;\nunion U { a: u8 }\n"
    assert kinds(rust, "rust") == [("preamble", "_preamble"), ("struct_item", "A"), ("impl_item", None), ("function_item", "e"), ("function_item", "f"), ("const_item", "C"), ("static_item", "S"), ("mod_item", "m"), ("macro_definition", "w"), ("trait_item", "T"), ("type_item", "Y")]
    ts = "interface I { a: string }\nconst enum E { A }\nlet v = 1, w = (a) =>\n  a + 1\nvar old = 1\nfunction* g() {}\nabstract class AC {}\nexport class X {}\ntype U = { a: 1 }\n  | 2\n@D()\nclass K extends B {}\n"
    assert kinds(ts, "typescript") == [("preamble", "_preamble"), ("interface_declaration", "I"), ("enum_declaration", "E"), ("lexical_declaration", None), ("type_alias_declaration", "U"), ("class_declaration", "K")]
    assert kinds("// only words\n", "rust") == [("preamble", "_preamble")] and kinds("", "rust") == [] and kinds("a\nb", "cobol") == [("block", None)]
    assert kinds("fn broken( {\n", "rust") and kinds("}}}", "typescript") is not None


def test_variables_are_tied():
    assert hits("a == b; a + 1 == a + 1; b - a == a && f(x) == f(x)", "$X == $X") == ["a + 1 == a + 1", "f(x) == f(x)"]
    assert hits("a == b", "$_ == $_") == ["a == b"] and hits("f(1, 2)(1, 2); f(1)(2)", "f($$$A)($$$A)") == ["f(1, 2)(1, 2)"]
    assert hits("a && b == c && d", "$X == $Y") == ["b == c"] and hits("x = y * 2 + z", "$A + $B", "python") == ["y * 2 + z"]


def test_what_a_variable_stands_for():
    source = "fn main() {\n    let x = some_result().unwrap();\n    let y = another().expect(\"msg\");\n    let z = a.b::<u8>().c[1]?.unwrap();\n}\n"
    assert hits(source, "$X.unwrap()") == ["some_result().unwrap()", "a.b::<u8>().c[1]?.unwrap()"]
    assert hits("a.unwrap().unwrap()", "$X.unwrap()") == ["a.unwrap().unwrap()", "a.unwrap()"]
    two = "fn hello() {\n    println!(\"hi\");\n}\n\nfn world(x: i32) -> Result<(), Vec<u8>> {\n    x > 0\n}\npub fn p() {}\n"
    assert [len(hits(two, p)) for p in ("fn $NAME($$$) $BODY", "fn $NAME($$$) -> $RET $BODY", "pub fn $NAME($$$) $BODY", "fn $NAME($$$) { $$$BODY }")] == [1, 1, 1, 1]
    assert hits("struct Point {\n x: f64 }\nstruct Color(u8, u8);", "struct $NAME $BODY") == ["struct Point {\n x: f64 }", "struct Color(u8, u8);"]
    assert hits("if let Err(e) = f(x) { log(e); }\nif let Err(q) = g() { a } else { b }", "if let Err($E) = $EXPR { $$$BODY }") == ["if let Err(e) = f(x) { log(e); }"]
    assert hits("const add = (a: number): number => {\n  return a;\n};\nconst sub = (a, b) => a - b;\n", "const $NAME = ($$$) => $BODY", "typescript") == ["const sub = (a, b) => a - b;"]
    assert hits("self.run(3)\nrun(4)", "run($$$)", "python") == ["run(4)"] and hits("self.run(3)\nrun(4)", "run($$$)", "python", inside=True) == ["run(3)", "run(4)"]
    assert hits("x = 42\ny = \"hello\"\n", "x = 42", "python") == ["x = 42"]
    for bad in (("", "rust"), ("$X", "cobol")):
        with pytest.raises(ValueError):
            syntax.Pattern(*bad)


def test_search_gives_places_and_context(spark):
    files = spark.createDataFrame([("a.rs", "fn f() {\n    a\n        .unwrap();\n}\n", None), ("b.txt", "a.unwrap()", None), ("c.rs", None, "rust")], "file_path string, content string, language string")
    got = [tuple(r) for r in chunking.structural_search(files, ["$X.unwrap()"]).collect()]
    assert got == [("a.rs", "$X.unwrap()", 1, "a\n        .unwrap()", "fn f() {\n    a\n        .unwrap();\n}", 2, 4, 17)]


def test_sql_functions(spark):
    chunking.register_functions(spark)
    spark.createDataFrame([("a.rs", "rust", "fn f() { g(1) }", 7), ("b", None, None, 8)], "file_path string, language string, content string, more int").createOrReplaceTempView("code_of_test")
    rows = spark.sql("SELECT file_path, symbol_name, symbol_kind FROM code_chunks(TABLE(code_of_test) PARTITION BY file_path)").collect()
    assert [tuple(r) for r in rows] == [("a.rs", "f", "function_item")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM code_matches(TABLE(code_of_test), 'g($X)')").collect()] == [("a.rs", 0, 0, "g(1)")]
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM code_chunks(TABLE(SELECT 1 AS x))").collect()


def test_sources_are_dealt_to_all_cores(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    for files in (t.code_files(), t.mixed_code()):
        tasks = files.select(F.spark_partition_id().alias("p")).groupBy("p").count().count()
        assert tasks >= 2 * spark.sparkContext.defaultParallelism
