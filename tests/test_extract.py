from __future__ import annotations

import time

from pyspark.sql import functions as F

from sparkloom.operators import extract

FILES = "repo string, path string, content string"

RUST = """//! Sample module for testing.

/// Units in one whole.
pub const UNITS: u64 = 1_000;

/// Largest size.
pub const MAX_SIZE: usize = 1232;

const HIDDEN: u8 = 1;

/// Runs it.
///
/// Twice.
#[inline]
pub fn run<T>(tx: &T) -> Result<(), Error> {
    if true {
        inner();
    }
    Ok(())
}

fn private() {}

#[derive(Debug, Clone)]
pub struct Account {
    pub owner: u64,
}

pub struct Pair([u8; 32], u8);

pub(crate) enum Kind { A { x: u8 }, B }

impl<T> Show for Account {
    pub fn new(a: u64) -> Self {
        Self { owner: a }
    }
}
"""

C = """#define LIMIT  10 // ten
// the name
#define NAME "x"
/* a
 * block
 */
#define F(x) x
#define EMPTY
#define LAST 1

// adds
// numbers
int add(int a, int b) {
  if (a) { return b; }
  return a;
}

struct point {
  int x;
} ;

typedef struct node { int v; } node_t;
enum color { RED, GREEN };
typedef unsigned long ulong_t;
"""


def files(spark, content, path="a.rs"):
    return spark.createDataFrame([("r", path, content)], "repo string, path string, content string")


def test_rust_items(spark):
    items, constants = extract.rust(files(spark, RUST))
    got = {(r.kind, r.name): r for r in items.collect()}
    assert set(got) == {("function", "run"), ("function", "new"), ("struct", "Account"), ("struct", "Pair"), ("enum", "Kind"), ("impl", "impl Show")}
    run = got["function", "run"]
    assert run.signature == "fn run(tx: &T) -> Result<(), Error>"
    assert run.body.strip().startswith("pub fn run<T>") and run.body.endswith("Ok(())\n}")
    assert run.doc_comment == "Runs it.\n\nTwice." and run.attributes == ["#[inline]"]
    assert got["struct", "Account"].body.endswith("pub owner: u64,\n}") and got["struct", "Account"].attributes == ["#[derive(Debug, Clone)]"]
    assert got["struct", "Pair"].body.strip() == "pub struct Pair([u8; 32], u8);"
    assert got["enum", "Kind"].body.strip() == "pub(crate) enum Kind { A { x: u8 }, B }" and got["enum", "Kind"].visibility == "pub(crate)"
    consts = {r.name: r for r in constants.collect()}
    assert set(consts) == {"UNITS", "MAX_SIZE", "HIDDEN"}
    assert {r.name for r in extract.rust(files(spark, RUST), True)[1].collect()} == {"UNITS", "MAX_SIZE"}
    assert (consts["UNITS"].value, consts["UNITS"].type_annotation) == ("1_000", "u64")
    assert consts["UNITS"].doc_comment == "Sample module for testing.\nUnits in one whole."


def test_rust_compat_struct_overshoots(spark):
    text = "pub struct A {\n    x: u8,\n}\nfn f() { g(); }\npub const B: u8 = 1;\n"
    body = lambda compat: extract.rust(files(spark, text), compat)[0].filter("kind = 'struct'").first().body
    assert body(False) == "pub struct A {\n    x: u8,\n}"
    assert body(True).endswith("pub const B: u8 = 1;")
    assert extract.rust(files(spark, RUST), True)[0].filter("kind = 'impl'").count() == 0


def test_unclosed_and_blank_lines(spark):
    items, _ = extract.rust(files(spark, "\n\n\npub fn open() {\n  {"))
    row = items.first()
    assert row.line_number == 1 and row.body == "\n\n\npub fn open() {\n  {"


def test_c_items(spark):
    items, constants = extract.c(files(spark, C, "a.c"))
    got = {(r.kind, r.name): r for r in items.collect()}
    assert set(got) == {("function", "add"), ("struct", "point"), ("struct", "node"), ("enum", "color"), ("type", "ulong_t"), ("type", "node_t")}
    assert got["function", "add"].signature == "int add(int a, int b)" and got["function", "add"].doc_comment == "adds\nnumbers"
    assert got["struct", "point"].body == "struct point {\n  int x;\n} ;"
    assert got["struct", "node"].body == "typedef struct node { int v; } node_t;"
    consts = {r.name: (r.value, r.doc_comment, r.line_number) for r in constants.collect()}
    assert consts == {"LIMIT": ("10 // ten", None, 1), "NAME": ('"x"', "the name", 3), "LAST": ("1", None, 9)}


def test_empty_tables_and_files(spark):
    none = files(spark, RUST).filter("false")
    for run in (extract.rust, extract.c):
        assert [d.count() for d in run(none)] == [0, 0]
        assert [d.count() for d in run(files(spark, ""))] == [0, 0]


def test_name_index_keeps_the_last(spark):
    two = files(spark, "pub const A: u8 = 1;\npub const A: u8 = 2;\n")
    row = extract.name_index(*extract.rust(two)).first()
    assert (row.category, row.name, row.value, row.line) == ("constants", "A", "2", 2)


def test_anonymous_typedefs(spark):
    text = "typedef struct {\n  int a;\n  struct { int b; } in;\n} pair_t;\n\ntypedef union { int x; } cell_t[4];\ntypedef enum { A, B } letter_t;\n"
    rows = sorted((r.name, r.line_number) for r in extract.c(files(spark, text, "a.h"))[0].filter("kind = 'type'").collect())
    assert rows == [("cell_t", 6), ("letter_t", 7), ("pair_t", 1)]
    assert extract.c(files(spark, text, "a.h"), True)[0].filter("kind = 'type'").count() == 0


def test_block_comments_of_c_items(spark):
    text = "/* one line */\nint a(void) { }\n\n/**\n * first\n * second\n */\n\nint b(void) { }\n/* opened\n   middle\n   closed */\n// after\nstruct c { int x; };\n/*\n */\nint d(void) { }\nint x; /* of x */\nint e(void) { }\n"
    docs = {r.name: r.doc_comment for r in extract.c(files(spark, text, "a.c"))[0].collect()}
    assert docs == {"a": "one line", "b": "first\nsecond", "c": "opened\nmiddle\nclosed\nafter", "d": None, "e": None}
    assert extract.c(files(spark, text, "a.c"), True)[0].filter("name = 'a'").first().doc_comment is None


def test_any_character_may_stand_in_a_file(spark):
    text = "pub const A: u8 = 1; // \ue000\npub fn f() { }\n"
    items, constants = extract.rust(files(spark, text))
    assert [(r.kind, r.name, r.line_number) for r in items.collect()] == [("function", "f", 2)]
    assert constants.first().name == "A"


def test_many_declarations_in_a_file(spark):
    """Places and lines of thousands of matches, which running sums give."""
    text = "".join(f"\n/// Doc {i}\npub const C{i}: u32 = {i};\n" for i in range(3000))
    rows = extract.rust(files(spark, text))[1].orderBy("line_number").collect()
    assert [(r.name, r.line_number, r.doc_comment) for r in rows] == [(f"C{i}", 3 * i + 3, f"Doc {i}") for i in range(3000)]


def test_visibility(spark):
    text = "pub(crate) fn a() { }\npub(super) struct B;\npub fn c() { }\n"
    assert {r.name: r.visibility for r in extract.rust(files(spark, text))[0].collect()} == {"a": "pub(crate)", "B": "pub(super)", "c": "pub"}
    assert {r.name: r.visibility for r in extract.rust(files(spark, text), True)[0].collect()} == {"a": "pub(crate)", "B": "pub(super)", "c": "pub"}


def test_an_unclosed_body_is_searched_once(spark):
    """The search for marks must not start again at every character of a tail without any (F1)."""
    text = "pub fn open() {\n" + "x" * 400_000
    start = time.monotonic()
    row = extract.rust(spark.createDataFrame([("r", "a.rs", text)], FILES))[0].filter("kind = 'function'").first()
    assert row["body"] == text
    assert time.monotonic() - start < 45


def test_matches_carry_no_copy_of_their_file(spark):
    """Rows of matches are as long as the matches and what is before them, not as the file (F2)."""
    text = "".join(f"struct s{i} {{\n  int x;\n}};\n\n" for i in range(500))
    found = extract._found(spark.createDataFrame([("r", "a.c", text)], FILES), extract.C_STRUCT, lambda near, tail: F.length(near))
    assert "content" not in found.columns
    lengths = [sum(len(str(v)) for v in r) for r in found.collect()]
    assert len(lengths) == 500 and max(lengths) < 200


def test_files_keep_their_tasks_and_matches_are_dealt_again(spark):
    """Few bytes of many matches: neither all files in one task nor the comments of a file in its task (F2)."""
    many = spark.range(8).selectExpr("'r' AS repo", "concat(id, '.c') AS path", "'int f( int a ) {\\n}\\n' AS content")
    plan = extract.c(many)[0]._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" in plan
