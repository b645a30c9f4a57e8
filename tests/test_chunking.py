from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import chunking, extract

PROPOSAL = """---
simd: 326
title: Sample text that is long enough to be kept as a first section of its own.
---

# Summary

A first paragraph with more than fifty characters in its body.

# Empty

## Overview

Another paragraph that has well over fifty characters in its body.
"""


def proposals(spark, text=PROPOSAL, path="proposals/0326-alpen-glow.md"):
    return spark.createDataFrame([("docs", path, text)], "repo string, path string, content string")


def test_sections(spark):
    rows = chunking.section_chunks(proposals(spark), "simd").orderBy("line_number").collect()
    assert [r.source_name for r in rows] == ["SIMD-0326 - SIMD-0326: Alpen Glow", "SIMD-0326 - Summary", "SIMD-0326 - Overview"]
    assert [r.line_number for r in rows] == [1, 6, 12]
    assert rows[1].content == "# Summary\n\nA first paragraph with more than fifty characters in its body."
    assert rows[1].metadata == {"simd_number": "SIMD-0326", "section": "Summary", "repo": "docs"}


def test_section_lines_strict_and_compat(spark):
    body = "x" * 60
    text = f"## A\n{body}\n# A\n{body}\n"
    lines = lambda compat: [r.line_number for r in chunking.section_chunks(proposals(spark, text, "d/a.md"), "docs", compat).orderBy("line_number").collect()]
    assert lines(False) == [1, 3] and lines(True) == [1, 1]


def test_header_over_a_line_end_is_one(spark):
    row = spark.createDataFrame([("#\n## X\n" + "y" * 60,)], "content string")
    got = chunking.sections(row, "content", F.lit("# first")).collect()
    assert [(r.header, r.body) for r in got] == [("#\n## X", "y" * 60)]


def test_split(spark):
    text = "\n".join(["a" * 8, "b" * 8, "c" * 4, "d" * 17])
    got = spark.range(1).select(chunking.split_parts(F.lit(text), 4)).first()[0]
    assert got == ["a" * 8 + "\n" + "b" * 8, "c" * 4, "d" * 17]
    assert spark.range(1).select(chunking.split_parts(F.lit("short"), 4)).first()[0] == ["short"]


def test_ids(spark):
    chunks = chunking.chunk_content(proposals=proposals(spark), project="sol").collect()
    parts = [r.chunk_id.split("_") for r in chunks]
    assert all(p[0] == "sol" and p[1] == "simd" and len(p[2]) == 8 and len(p[4]) == 8 for p in parts)
    assert sorted(p[3] for p in parts) == ["0000", "0001", "0002"]
    again = chunking.chunk_content(proposals=proposals(spark), project="sol").collect()
    assert sorted(r.chunk_id for r in chunks) == sorted(r.chunk_id for r in again)


def test_long_index_is_not_cut(spark):
    made = spark.range(1).select(chunking.chunk_id("p", F.lit("docs"), F.lit("f"), F.lit(12345), F.lit("c"))).first()[0]
    assert made.split("_")[3] == "12345"


def test_item_and_constant_chunks(spark):
    text = "/// Doc\npub const A: u8 = 1;\n\npub fn f() { }\n"
    files = spark.createDataFrame([("r", "a.rs", text)], "repo string, path string, content string")
    got = {r.source_name: r for r in chunking.chunk_content(*extract.rust(files), prefix="lib").collect()}
    assert got["A"].content == "/// Doc\nconst A: u8 = 1;" and got["A"].source_file == "lib/a.rs"
    assert got["A"].metadata == {"kind": "constant", "value": "1", "type": "u8", "repo": "r"}
    assert got["f"].metadata["signature"] == "fn f()"


def test_oversize_chunks_get_parts(spark):
    body = "\n".join("line %d %s" % (i, "z" * 40) for i in range(400))
    rows = chunking.chunk_content(docs=proposals(spark, "# Big\n" + body, "d/big.md")).orderBy("chunk_id").collect()
    assert len(rows) > 1
    assert sorted(int(r.metadata["part"]) for r in rows) == list(range(1, len(rows) + 1))
    assert all(r.source_name.endswith(f"(part {r.metadata['part']})") for r in rows)


def test_title(spark):
    assert spark.range(1).select(T.title(F.lit("fd3x-a bC"))).first()[0] == "Fd3X-A Bc"


def test_unknown_file_types_have_no_chunks(spark):
    files = spark.createDataFrame([("r", "a.py", "x = 1", "python")], "repo string, path string, content string, file_type string")
    assert chunking.chunk_files(files).count() == 0


def test_files_without_a_type_are_docs(spark):
    files = spark.createDataFrame([("r", "a.md", "# Title\n\n" + "words " * 20, None)], "repo string, path string, content string, file_type string")
    assert [r.source_type for r in chunking.chunk_files(files).collect()] == ["docs"]


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        got = spark.range(1).select(T.running(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"))).first()[0]
        assert got == [i * (i + 1) // 2 for i in range(n)]


def test_split_keeps_blank_and_long_lines(spark):
    lines = ["", "", "a" * 9, "", "b" * 100, "", "c", ""]
    for most in (1, 2, 3, 30):
        got = spark.range(1).select(chunking.split_parts(F.lit("\n".join(lines)), most)).first()[0]
        assert "\n".join(got) == "\n".join(lines)


def test_split_of_many_parts(spark):
    text = "\n".join(["abcdefgh"] * 1500 + [""] * 3000 + ["ijkl"] * 100)
    got = spark.range(1).select(chunking.split_parts(F.lit(text), 2)).first()[0]
    assert "\n".join(got) == text and len(got) == 1500 + 50


def test_parts_are_numbered_in_their_order(spark):
    """Part 10 comes after part 2, in ids too (F5)."""
    text = "\n".join(f"{i:02d} " + "x" * 400 for i in range(25))
    whole = spark.createDataFrame([("", text, "docs", "a.md", "a", 1, {"k": "v"})], "chunk_id string, content string, source_type string, source_file string, source_name string, line_number int, metadata map<string,string>")
    rows = chunking.assign_ids(chunking.split_large(whole, 100)).orderBy("chunk_id").collect()
    assert [r.content[:2] for r in rows] == [f"{i:02d}" for i in range(25)]


def test_documents_are_dealt_before_they_are_cut(spark):
    """A source of one large row group is cut by many tasks, with one shuffle (F9)."""
    rows = [("r", f"{i}.md", f"# a\n\n{'words ' * 20}\n\n# b\n\n{'more words ' * 20}", None) for i in range(40)]
    files = spark.createDataFrame(rows, "repo string, path string, content string, file_type string").coalesce(1)
    chunks = chunking.chunk_files(files)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("Generate") < plan.index("Exchange hashpartitioning")
    assert chunks.rdd.getNumPartitions() == chunking.TASKS * spark.sparkContext.defaultParallelism
    assert chunks.count() == 80 and {r.chunk_id.split("_")[3] for r in chunks.collect()} == {"0000", "0001"}


def test_texts_without_a_match_are_not_cut(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a # b\nc",), ("# x\ny",)], "t string").select(T.pieces(F.col("t"), chunking.HEADER).alias("p"))
    got = [r.p and [(p.start, p.line, p.before, p.text) for p in r.p] for r in rows.collect()]
    assert got == [None, [(1, 1, "", "")], [(1, 1, "", "a # b\nc")], [(1, 1, "", ""), (1, 1, "", "# x\ny")]]


def test_long_texts_are_measured_and_trimmed_as_short_ones(spark):
    """Bytes tell most texts' lengths, and texts without blanks at their end are not trimmed there (F10)."""
    texts = [None, "", " ", "a", "abcd", "abcde", " \x0b a\tb\r\n\x0c ", "\u00e9" * 4, "\u00e9" * 5, "\U0001f600" * 4, "\U0001f600" * 5, "x" * 17, "\n\nx", "x\u00a0"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.longer(F.col("t"), 4).alias("longer"), T.strip_long(F.col("t")).alias("strip"), T.pieces(F.col("t"), "a.", "a").alias("marked"), T.pieces(F.col("t"), "a.").alias("pieces"))
    for r in rows.collect():
        assert r.longer == (None if r.t is None else len(r.t) > 4) and r.strip == (None if r.t is None else r.t.strip(T.BLANKS)) and r.marked == r.pieces
    docs = spark.createDataFrame([("r", "a.md", "words " * 20)], "repo string, path string, content string")
    plan = chunking.section_chunks(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan and "Contains(content" in plan and "endswith" in plan.lower()


def test_split_asks_for_a_line_once(spark):
    """The walk's step compares one count a line instead of measuring the line for each field (F9)."""
    plan = spark.range(1).select(chunking.split_parts(F.col("id").cast("string"), 2))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("length(lambda ") == 1
