"""Queries over the test tables, one or more for every group of operators, with their SQL.

The tables hold no source code, so extraction reads files synthesised from the star schema and must
give the rows back; markdown is made of the pages' headings; a manifest is made of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import vectors
from sparkloom.operators import ann, chunking, encode, extract, fitted, lookup, manifest, search
from sparkloom.plans import index
from sparkloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Chunking

_PARTS_SQL = """
WITH RECURSIVE lines AS (
    SELECT doc_id, source || '/' || doc_id || '.md' AS path, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), walk AS (
    SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS part, 0::BIGINT AS n, 0::BIGINT AS k FROM lines
    UNION ALL
    SELECT w.doc_id, w.i + 1,
           CASE WHEN w.k > 0 AND w.n + length(l[w.i + 1]) // 4 > 64 THEN w.part + 1 ELSE w.part END,
           CASE WHEN w.k > 0 AND w.n + length(l[w.i + 1]) // 4 > 64 THEN length(l[w.i + 1]) // 4 ELSE w.n + length(l[w.i + 1]) // 4 END,
           CASE WHEN w.k > 0 AND w.n + length(l[w.i + 1]) // 4 > 64 THEN 1 ELSE w.k + 1 END
    FROM walk w JOIN lines USING (doc_id) WHERE w.i < len(l) AND length(text) // 4 > 64
), parts AS (
    SELECT doc_id, part, string_agg(l[i], chr(10) ORDER BY i) AS content FROM walk JOIN lines USING (doc_id) WHERE i > 0 GROUP BY doc_id, part
    UNION ALL
    SELECT doc_id, 0, text FROM lines WHERE length(text) // 4 <= 64
), numbered AS (
    SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM parts JOIN (SELECT doc_id, path FROM lines) USING (doc_id)
)
"""


def _document_chunks(spark: SparkSession, sf_dir: str, max_tokens: int = 64) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    whole = docs.select(F.lit("").alias("chunk_id"), F.col("text").alias("content"), F.lit("docs").alias("source_type"), path.alias("source_file"), F.col("doc_id").cast("string").alias("source_name"), F.lit(1).alias("line_number"), chunking.metadata(repo=F.col("source")).alias("metadata"))
    return chunking.assign_ids(chunking.split_large(whole, max_tokens), "sol", ("part",))


@_query("chunk_split_ids", _PARTS_SQL + """
SELECT 'sol_docs_' || substr(sha256(path), 1, 8) || '_' || printf('%04d', part) || '_' || substr(sha256(content), 1, 8) AS chunk_id,
       path AS source_file, CASE WHEN total > 1 THEN doc_id || ' (part ' || (part + 1) || ')' ELSE doc_id::VARCHAR END AS source_name, sha256(content) AS content_hash
FROM numbered""")
def chunk_split_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_chunks(spark, sf_dir).select("chunk_id", "source_file", "source_name", F.sha2("content", 256).alias("content_hash"))


@_query("chunk_stats", _PARTS_SQL + "SELECT split_part(path, '/', 1) AS source, count(*)::BIGINT AS chunks, sum(length(content) // 4)::BIGINT AS tokens FROM numbered GROUP BY 1")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _document_chunks(spark, sf_dir)
    return chunks.groupBy(F.split("source_file", "/")[0].alias("source")).agg(F.count(F.lit(1)).alias("chunks"), F.sum(T.token_estimate(F.col("content"))).cast("long").alias("tokens"))


@_query("chunk_token_estimate", "SELECT doc_id, (length(text) // 4)::BIGINT AS tokens, length(text) // 4 > 1000 AS oversize FROM documents")
def chunk_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.token_estimate(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("tokens"), (n > 1000).alias("oversize"))


def _markdown(pages: DataFrame) -> DataFrame:
    headed = F.regexp_replace("html", "<h[1-3][^>]*>", "\n### ")
    plain = F.regexp_replace(F.regexp_replace(headed, "</h[1-3]>", "\n"), "<[^>]*>", "\n")
    return pages.select("page_id", plain.alias("content"))


_SECTION_SQL = r"""
WITH md AS (
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<h[1-3][^>]*>', chr(10) || '### ', 'g'), '</h[1-3]>', chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS content FROM pages
), cut AS (
    SELECT page_id, string_split(regexp_replace(content, '(?m)^(#{1,3}\s+.+)$', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM md
), pieces AS (SELECT page_id, i - 1 AS section, p[i] AS piece FROM cut, unnest(range(1, len(p) + 1)) AS u(i)),
parted AS (
    SELECT page_id, section,
           CASE WHEN section = 0 THEN '# page' ELSE trim(split_part(piece, chr(2), 1), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) END AS header,
           trim(CASE WHEN section = 0 THEN piece ELSE split_part(piece, chr(2), 2) END, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS body
    FROM pieces
)
SELECT page_id, section::INT AS section, header, sha256(body) AS body_hash, length(body)::BIGINT AS body_chars FROM parted WHERE length(body) > 50
"""


@_query("section_split", _SECTION_SQL)
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.sections(_markdown(_table(spark, sf_dir, "pages")), "content", F.lit("# page"))
    return cut.select("page_id", "section", "header", F.sha2("body", 256).alias("body_hash"), F.length("body").cast("long").alias("body_chars"))


@_query("section_counts", f"SELECT page_id, count(*)::BIGINT AS sections, max(body_chars)::BIGINT AS longest FROM ({_SECTION_SQL}) GROUP BY page_id")
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_split(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("sections"), F.max("body_chars").alias("longest"))


# Extraction: files made of table rows must give the rows back

def _files(df: DataFrame, path, lines, repo: str, language: str) -> DataFrame:
    """One file for each path, a block of text for each row in the order of ``ord``."""
    joined = df.groupBy(path.alias("path")).agg(F.sort_array(F.collect_list(F.struct(F.col("ord"), lines.alias("t")))).alias("x"))
    return joined.select(F.lit(repo).alias("repo"), "path", F.array_join(F.transform("x", lambda r: r["t"]), "\n").alias("content"), F.lit(language).alias("file_type"))


def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").withColumn("ord", F.col("p_partkey"))
    lines = F.concat(F.lit("/// "), "p_type", F.lit("\npub const PART_"), F.col("p_partkey").cast("string"), F.lit(": i64 = "), F.col("p_size").cast("string"), F.lit(";\n"))
    return _files(part, F.concat(F.lit("src/"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"), F.lit(".rs")), lines, "parts", "rust")


@_query("extract_rust_constants", "SELECT 'src/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || '.rs' AS file_path, 'PART_' || p_partkey AS name, p_size::VARCHAR AS value, 'i64' AS type_annotation, p_type AS doc_comment, (3 * row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS line_number FROM part")
def extract_rust_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.rust(_part_files(spark, sf_dir))[1].select("file_path", "name", "value", "type_annotation", "doc_comment", "line_number")


def _supplier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = _table(spark, sf_dir, "supplier").withColumn("ord", F.col("s_suppkey"))
    key = F.col("s_suppkey").cast("string")
    lines = F.concat(F.lit("/// Nation "), F.col("s_nationkey").cast("string"), F.lit("\n#[derive(Debug)]\npub struct Supplier"), key, F.lit(" {\n    pub a: [u8; 4],\n}\n\nimpl Supplier"), key, F.lit(" {\n    pub fn key_"), key, F.lit("(&self) -> u64 {\n        if true { 1 } else { 2 }\n    }\n}\n\npub enum Kind"), key, F.lit(" {\n    A { x: u8 },\n    B,\n}\n"))
    return _files(supplier, F.concat(F.lit("s"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".rs")), lines, "suppliers", "rust")


@_query("extract_rust_items", """
SELECT 's' || (s_suppkey % 7) || '.rs' AS file_path, x.kind AS kind, x.name || s_suppkey AS name,
       replace(x.signature, '@', s_suppkey::VARCHAR) AS signature, replace(x.body, '@', s_suppkey::VARCHAR) AS body,
       CASE WHEN x.kind = 'struct' THEN 'Nation ' || s_nationkey END AS doc_comment, CASE WHEN x.kind = 'struct' THEN '#[derive(Debug)]' ELSE '' END AS attributes, 'pub' AS visibility,
       (x.line + 17 * (row_number() OVER (PARTITION BY s_suppkey % 7, x.kind ORDER BY s_suppkey) - 1))::INT AS line_number
FROM supplier, (VALUES (3, 'struct', 'Supplier', 'struct Supplier@', 'pub struct Supplier@ {
    pub a: [u8; 4],
}'), (6, 'impl', 'impl Supplier', 'impl Supplier@', 'impl Supplier@ {
    pub fn key_@(&self) -> u64 {
        if true { 1 } else { 2 }
    }
}'), (8, 'function', 'key_', 'fn key_@(&self) -> u64', 'pub fn key_@(&self) -> u64 {
        if true { 1 } else { 2 }
    }'), (12, 'enum', 'Kind', 'enum Kind@', 'pub enum Kind@ {
    A { x: u8 },
    B,
}')) AS x(line, kind, name, signature, body)""")
def extract_rust_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = extract.rust(_supplier_files(spark, sf_dir))[0]
    return items.select("file_path", "kind", "name", "signature", T.strip(F.col("body")).alias("body"), "doc_comment", F.array_join("attributes", " ").alias("attributes"), "visibility", "line_number")


def _customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer").withColumn("ord", F.col("c_custkey"))
    key = F.col("c_custkey").cast("string")
    lines = F.concat(F.lit("// Segment "), "c_mktsegment", F.lit("\nint cust_"), key, F.lit("( int a ) {\n  while (a) { a--; }\n  return a;\n}\n\nstruct cust_s"), key, F.lit(" {\n  int x;\n};\n\ntypedef unsigned long cust_t"), key, F.lit(";\n"))
    return _files(customer, F.concat(F.lit("c"), (F.col("c_custkey") % 11).cast("string"), F.lit(".c")), lines, "customers", "c")


@_query("extract_c_items", """
SELECT 'c' || (c_custkey % 11) || '.c' AS file_path, x.kind AS kind, replace(x.name, '@', c_custkey::VARCHAR) AS name, replace(x.signature, '@', c_custkey::VARCHAR) AS signature,
       sha256(replace(x.body, '@', c_custkey::VARCHAR)) AS body_hash, CASE WHEN x.kind = 'function' THEN 'Segment ' || c_mktsegment END AS doc_comment
FROM customer, (VALUES ('function', 'cust_@', 'int cust_@( int a )', 'int cust_@( int a ) {
  while (a) { a--; }
  return a;
}'), ('struct', 'cust_s@', 'struct cust_s@', 'struct cust_s@ {
  int x;
};'), ('type', 'cust_t@', 'typedef cust_t@', 'typedef unsigned long cust_t@;')) AS x(kind, name, signature, body)""")
def extract_c_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.c(_customer_files(spark, sf_dir))[0].select("file_path", "kind", "name", "signature", F.sha2(T.strip(F.col("body")), 256).alias("body_hash"), "doc_comment")


def _nation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").withColumn("ord", F.col("n_nationkey"))
    lines = F.concat(F.lit("/* block\n * region "), F.col("n_regionkey").cast("string"), F.lit("\n */\n#define NATION_"), F.col("n_nationkey").cast("string"), F.lit("  "), "n_name", F.lit("\n#define F(x) x\n#define EMPTY\n"))
    return _files(nation, F.lit("nation.h"), lines, "nations", "c")


@_query("extract_c_defines", "SELECT 'NATION_' || n_nationkey AS name, trim(n_name) AS value, 'region ' || n_regionkey || chr(10) || '/' AS doc_comment, (4 + 7 * (row_number() OVER (ORDER BY n_nationkey) - 1))::INT AS line_number FROM nation")
def extract_c_defines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.c(_nation_files(spark, sf_dir))[1].select("name", "value", "doc_comment", "line_number")


@_query("extract_stats", """
SELECT 'suppliers' AS repo, least(7, count(*))::BIGINT AS files_processed, (4 * count(*))::BIGINT AS items, count(*)::BIGINT AS functions, count(*)::BIGINT AS structs, count(*)::BIGINT AS enums, count(*)::BIGINT AS impls, 0::BIGINT AS constants FROM supplier
UNION ALL SELECT 'parts', count(DISTINCT p_brand)::BIGINT, 0, 0, 0, 0, 0, count(*)::BIGINT FROM part""")
def extract_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _supplier_files(spark, sf_dir).unionByName(_part_files(spark, sf_dir))
    items, constants = extract.rust(files)
    return extract.statistics(items, constants, files).drop("types")


@_query("name_index", """
SELECT 'constants' AS category, 'PART_' || p_partkey AS name, p_size::VARCHAR AS value, 'src/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || '.rs' AS file, (3 * row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS line FROM part
UNION ALL
SELECT x.category, x.name || s_suppkey, NULL, 's' || (s_suppkey % 7) || '.rs', (x.line + 17 * (row_number() OVER (PARTITION BY s_suppkey % 7, x.category ORDER BY s_suppkey) - 1))::INT
FROM supplier, (VALUES (3, 'structs', 'Supplier'), (6, 'impls', 'impl Supplier'), (8, 'functions', 'key_'), (12, 'enums', 'Kind')) AS x(line, category, name)""")
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, constants = extract.rust(_part_files(spark, sf_dir).unionByName(_supplier_files(spark, sf_dir)))
    return extract.name_index(items, constants).select("category", "name", "value", "file", "line")


@_query("code_chunks", """
SELECT 'lib/src/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || '.rs' AS source_file, 'PART_' || p_partkey AS source_name,
       '/// ' || p_type || chr(10) || 'const PART_' || p_partkey || ': i64 = ' || p_size || ';' AS content, p_size::VARCHAR AS value FROM part""")
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_content(*extract.rust(_part_files(spark, sf_dir)), prefix="lib")
    return chunks.select("source_file", "source_name", "content", F.col("metadata")["value"].alias("value"))


@_query("lookup_constant", "SELECT 'PART_' || p_partkey AS name, p_size::VARCHAR AS value FROM part WHERE p_partkey = 7")
def lookup_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.constant(extract.rust(_part_files(spark, sf_dir))[1], "PART_7").select("name", "value")


@_query("lookup_function", "SELECT 'key_' || s_suppkey AS name, 's' || (s_suppkey % 7) || '.rs' AS file_path FROM supplier WHERE s_suppkey = 5")
def lookup_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.function(extract.rust(_supplier_files(spark, sf_dir))[0], "key_5").select("name", "file_path")


@_query("first_by_name", "SELECT 'Nation ' || s_nationkey AS name, min('s' || (s_suppkey % 7) || '.rs') AS file_path FROM supplier GROUP BY 1")
def first_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = extract.rust(_supplier_files(spark, sf_dir))[0].filter("kind = 'struct'").withColumn("name", F.col("doc_comment"))
    return lookup.first_by_name(items).select("name", "file_path")


@_query("source_urls", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://github.com/anza-xyz/agave/blob/master/runtime/' || doc_id || '.rs#L' || (doc_id + 1)
    WHEN 1 THEN 'https://github.com/firedancer-io/firedancer/blob/main/src/' || doc_id || '.c' WHEN 2 THEN NULL ELSE NULL END AS url FROM documents""")
def source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    ident = F.col("doc_id").cast("string")
    file = F.when(k == 0, F.concat(F.lit("runtime/"), ident, F.lit(".rs"))).when(k == 1, F.concat(F.lit("firedancer/src/"), ident, F.lit(".c"))).when(k == 2, F.concat(F.lit("elsewhere/"), ident)).otherwise("")
    hits = _table(spark, sf_dir, "documents").select("doc_id", file.alias("source_file"), F.when(k == 0, F.col("doc_id") + 1).cast("int").alias("line_number"), F.when(k == 0, "agave").alias("repo"))
    return lookup.source_urls(hits).select("doc_id", "url")


# Manifests

_DIFF_SQL = """
WITH old AS (SELECT doc_id || '.md' AS path, sha256(text || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS sha, doc_id % 3 = 0 AS touched, doc_id FROM documents WHERE doc_id % 10 <> 0),
new AS (SELECT doc_id || '.md' AS path, sha256(text) AS sha, doc_id FROM documents WHERE doc_id % 11 <> 0),
diff AS (SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'add' WHEN new.path IS NULL THEN 'delete' WHEN touched AND old.sha <> new.sha THEN 'modify' END AS change_type,
    CASE WHEN old.path IS NULL THEN 0 ELSE 1 + old.doc_id % 3 END AS n FROM old FULL JOIN new ON old.path = new.path)
"""


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents")
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    ids = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda i: F.concat(F.lit("c_"), F.col("doc_id").cast("string"), F.lit("_"), i.cast("string")))
    old = docs.filter("doc_id % 10 <> 0").select(path.alias("path"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise("")), 256).alias("sha256"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(2).cast("long").alias("mtime_ns"), ids.alias("chunk_ids"))
    new = docs.filter("doc_id % 11 <> 0").select(path.alias("path"), F.sha2("text", 256).alias("sha256"), F.lit(2).cast("long").alias("mtime_ns"))
    return old, new


@_query("manifest_changes", _DIFF_SQL + "SELECT path, change_type, n::BIGINT AS old_chunks FROM diff WHERE change_type IS NOT NULL")
def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.changes(*_manifests(spark, sf_dir)).select("path", "change_type", F.size("old_chunk_ids").cast("long").alias("old_chunks"))


@_query("manifest_dry_run", _DIFF_SQL + """SELECT count(*) FILTER (change_type = 'add') AS files_added, count(*) FILTER (change_type = 'modify') AS files_modified, count(*) FILTER (change_type = 'delete') AS files_deleted,
    coalesce(sum(n) FILTER (change_type <> 'add'), 0)::BIGINT AS chunks_to_delete, 10 * count(*) FILTER (change_type IN ('add', 'modify')) AS chunks_to_add FROM diff""")
def manifest_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.summary(manifest.changes(*_manifests(spark, sf_dir)))


@_query("manifest_violations", "SELECT '../' || doc_id AS path, 'unsafe path' AS problem FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id || '.md', 'bad sha256' FROM documents WHERE doc_id % 5 = 1")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ident, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    files = docs.select(F.when(k == 0, F.concat(F.lit("../"), ident)).otherwise(F.concat(ident, F.lit(".md"))).alias("path"), F.when(k == 1, "short").otherwise(F.sha2("text", 256)).alias("sha256"), F.array(F.concat(F.lit("c_"), ident)).alias("chunk_ids"))
    return manifest.violations(files)


@_query("manifest_file_chunks", _PARTS_SQL + "SELECT path, list('sol_docs_' || substr(sha256(path), 1, 8) || '_' || printf('%04d', part) || '_' || substr(sha256(content), 1, 8) ORDER BY part)::VARCHAR AS chunk_ids FROM numbered GROUP BY path")
def manifest_file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _document_chunks(spark, sf_dir)
    files = chunks.select(F.col("source_file").alias("path"), F.lit("").alias("sha256"), F.lit(0).cast("long").alias("mtime_ns")).distinct()
    ids = F.concat(F.lit("["), F.array_join("chunk_ids", ", "), F.lit("]"))
    return manifest.with_chunks(files, chunks).select("path", ids.alias("chunk_ids"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files, before and after: some added, some changed, some gone."""
    docs = _table(spark, sf_dir, "documents").filter("text IS NOT NULL")

    def files(rows: DataFrame, text, time: int) -> DataFrame:
        path = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
        return rows.select(F.lit("r").alias("repo"), path.alias("path"), text.alias("content"), F.sha2(text, 256).alias("sha256"), F.when(F.col("doc_id") % 7 == 0, time).otherwise(1).cast("long").alias("mtime_ns"), F.lit(None).cast("string").alias("file_type"))

    before = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("An older start. "), "text")).otherwise(F.col("text"))
    return files(docs.filter("doc_id % 10 <> 0"), before, 1), files(docs.filter("doc_id % 11 <> 0"), F.col("text"), 2)


_INDEX_SQL = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, doc_id || '.md' AS path, '# ' || doc_id || chr(10) || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS content
    FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 0 AND length(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) > 50
), lines AS (SELECT *, string_split(content, chr(10)) AS l FROM docs),
walk AS (
    SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS part, 0::BIGINT AS n, 0::BIGINT AS k FROM lines WHERE length(content) // 4 > 1000
    UNION ALL
    SELECT w.doc_id, w.i + 1,
           CASE WHEN w.k > 0 AND w.n + length(l[w.i + 1]) // 4 > 1000 THEN w.part + 1 ELSE w.part END,
           CASE WHEN w.k > 0 AND w.n + length(l[w.i + 1]) // 4 > 1000 THEN length(l[w.i + 1]) // 4 ELSE w.n + length(l[w.i + 1]) // 4 END,
           CASE WHEN w.k > 0 AND w.n + length(l[w.i + 1]) // 4 > 1000 THEN 1 ELSE w.k + 1 END
    FROM walk w JOIN lines USING (doc_id) WHERE w.i < len(l)
), parts AS (
    SELECT doc_id, part, string_agg(l[i], chr(10) ORDER BY i) AS content FROM walk JOIN lines USING (doc_id) WHERE i > 0 GROUP BY doc_id, part
    UNION ALL SELECT doc_id, 0, content FROM docs WHERE length(content) // 4 <= 1000
)
SELECT 'sol_docs_' || substr(sha256(doc_id || '.md'), 1, 8) || '_' || printf('%04d', part) || '_' || substr(sha256(content), 1, 8) AS chunk_id, doc_id || '.md' AS source_file, sha256(content) AS content_hash, 1 AS line_number, true AS has_vector FROM parts"""


@_query("index_update", _INDEX_SQL)
def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the files before, brought to the files after by what changed."""
    built = index.Index(spark, index.scratch(spark), "hashing-64")
    for files in _versions(spark, sf_dir):
        built.update(files)
    return built.chunks().select("chunk_id", "source_file", F.sha2("content", 256).alias("content_hash"), "line_number", (F.size("embedding") == 64).alias("has_vector"))


@_query("index_update_stats", """
SELECT count(*) FILTER (doc_id % 10 = 0 AND doc_id % 11 <> 0)::BIGINT AS files_added, count(*) FILTER (doc_id % 7 = 0 AND doc_id % 10 <> 0 AND doc_id % 11 <> 0)::BIGINT AS files_modified,
       count(*) FILTER (doc_id % 11 = 0 AND doc_id % 10 <> 0)::BIGINT AS files_deleted FROM documents WHERE text IS NOT NULL""")
def index_update_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = index.Index(spark, index.scratch(spark), "hashing-64")
    for files in _versions(spark, sf_dir):
        stats = built.update(files)
    # literals, for rows of the driver's would start a Python worker on every core
    return spark.range(1).select(*[F.lit(getattr(stats, n)).cast("long").alias(n) for n in ("files_added", "files_modified", "files_deleted")])


@_query("index_files", "SELECT doc_id || '.md' AS path, sha256(text) AS sha256, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS mtime_ns FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 0")
def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = index.Index(spark, index.scratch(spark), "hashing-64")
    for files in _versions(spark, sf_dir):
        built.update(files)
    return built.files().select("path", "sha256", "mtime_ns")


@_query("text_functions", r"""
SELECT doc_id, substr(sha256(text), 1, 8) AS short, len(string_split(substr(text, 1, 99), chr(10)))::INT AS line, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS shortened,
       trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS stripped, replace(text, ' ', chr(10)) AS unix, 'Fd' || doc_id || 'X-Ab Cd' AS title FROM documents""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select(
        "doc_id", T.short_hash(text).alias("short"), T.line_at(text, F.lit(100)).alias("line"), T.shortened(text, 200, "...").alias("shortened"), T.strip(text).alias("stripped"),
        T.unix_lines(F.replace(text, F.lit(" "), F.lit("\r\n"))).alias("unix"), T.title(F.concat(F.lit("fd"), F.col("doc_id").cast("string"), F.lit("x-aB cd"))).alias("title"),
    )


# Vectors

_COSINE = "round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2])) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x)))), 6) + 0.0::DOUBLE"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return _table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


@_query("vector_topk", f"SELECT b.vec_id, {_COSINE} AS distance, row_number() OVER (ORDER BY {_COSINE}, b.vec_id)::INT AS rank FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY distance, b.vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.top_k(_table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, key="vec_id")
    return found.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


@_query("vector_topk_filtered", f"SELECT b.vec_id, {_COSINE} AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.label = 5 ORDER BY distance, b.vec_id LIMIT 5")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.top_k(_table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 5, F.col("label") == 5, key="vec_id")
    return found.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


@_query("vector_topk_postfiltered", f"SELECT * FROM (SELECT b.vec_id, {_COSINE} AS distance, b.label FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY distance, b.vec_id LIMIT 40) WHERE label = 3 ORDER BY distance, vec_id LIMIT 20")
def vector_topk_postfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.top_k(_table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20, F.col("label") == 3, key="vec_id", compat=True)
    return found.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"), "label")


@_query("vector_knn_join", f"SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS key, {_COSINE} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE.replace(', 6)', ', 12)')}, b.vec_id)::INT AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 10")
def vector_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    found = search.knn_join(rows.filter("vec_id % 20 = 0"), rows, 10, "vec_id", "vec_id")
    return found.select("query", "key", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


@_query("vector_metrics", "SELECT b.vec_id, round(-list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2])), 6) + 0.0::DOUBLE AS dot, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]) ** 2)), 6) AS l2sq FROM embeddings a, embeddings b WHERE a.vec_id = 0")
def vector_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vectors.literal(_query_vector(spark, sf_dir))
    of = lambda m: (F.round(vectors.distance(F.col("embedding"), q, m), 6) + 0.0).alias(m)
    return _table(spark, sf_dir, "embeddings").select("vec_id", of("dot"), of("l2sq"))


def _ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    quantiser = ann.fit(rows, "vec_id")
    return ann.probe_join(rows.filter("vec_id % 20 = 0"), ann.coded(rows, quantiser), quantiser, 10, "vec_id", "vec_id")


@_query("vector_ann")
def vector_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth row's nearest, approximately."""
    return _ann(spark, sf_dir).select("query", "key", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


@_query("vector_ann_recall", "SELECT count(*)::BIGINT AS asked, true AS nine_of_ten FROM embeddings WHERE vec_id % 20 = 0")
def vector_ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the approximate search finds nine of ten that the exact one finds."""
    exact = vector_knn_join(spark, sf_dir).select("query", "key", F.lit(1).alias("exact"))
    found = _ann(spark, sf_dir).select("query", "key", F.lit(1).alias("found"))
    return exact.join(found, ["query", "key"], "left").agg(F.countDistinct("query").alias("asked"), (F.count("found") >= 0.9 * F.count("exact")).alias("nine_of_ten"))


@_query("encode_hashing", """
WITH words AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark),
counted AS (SELECT item_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM words GROUP BY ALL)
SELECT item_id, bucket::INT AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 5) AS weight FROM counted""")
def encode_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode.embed(_table(spark, sf_dir, "benchmark"), "text", "hashing-64")
    return rows.select("item_id", F.posexplode("embedding").alias("bucket", "w")).filter("w > 0").select("item_id", "bucket", F.round(F.col("w").cast("double"), 5).alias("weight"))


_SEARCH_SQL = _PARTS_SQL.replace(" > 64", " > 1000").replace(" <= 64", " <= 1000").rstrip() + """, texts AS (
    SELECT 'sol_docs_' || substr(sha256(path), 1, 8) || '_' || printf('%04d', part) || '_' || substr(sha256(content), 1, 8) AS id, path, content FROM numbered
    UNION ALL SELECT '', '', text FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)
), words AS (SELECT id, path, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS w FROM texts),
counted AS (SELECT id, path, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM words GROUP BY ALL),
vectors AS (SELECT id, path, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY id, path)))::FLOAT::DOUBLE AS x FROM counted),
scored AS (
    SELECT v.id, v.path, 1 - sum(v.x * coalesce(q.x, 0)) / (sqrt(sum(v.x * v.x)) * (SELECT sqrt(sum(x * x)) FROM vectors WHERE id = '')) AS d
    FROM vectors v LEFT JOIN (FROM vectors WHERE id = '') q USING (bucket) WHERE v.id <> '' GROUP BY ALL
)
SELECT id AS chunk_id, path AS source_file, round(d, 4) + 0.0::DOUBLE AS distance, row_number() OVER (ORDER BY round(d, 10), id)::INT AS rank FROM scored ORDER BY round(d, 10), id LIMIT 10"""


@_query("search_documents", _SEARCH_SQL)
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = encode.embed(_document_chunks(spark, sf_dir, 1000), model="hashing-64")
    text = _table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    return search.top_k(chunks, encode.embed_one(text, "hashing-64"), 10).select("chunk_id", "source_file", (F.round("distance", 4) + 0.0).alias("distance"), "rank")


@_query("search_fitted")
def search_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest documents of every benchmark passage, by an encoder fitted to the documents."""
    path = index.scratch(spark, "counted")
    fitted.counted(_table(spark, sf_dir, "documents").filter("text IS NOT NULL"), "text", ["doc_id"]).write.parquet(path)
    words = spark.read.schema("doc_id bigint, bucket array<int>, times array<int>").parquet(path)
    model = fitted.fit_counted(words)
    asked = fitted.embedded(fitted.counted(_table(spark, sf_dir, "benchmark"), "text", ["item_id"]), model, ["item_id"])
    found = search.knn_join(asked, fitted.embedded(words, model, ["doc_id"]), 10, "item_id", "doc_id")
    return found.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), F.round("distance", 6).alias("distance"), "rank")


# Aggregates, metadata, streams

@_query("index_stats", "SELECT lang AS source_type, count(*)::BIGINT AS chunks FROM documents GROUP BY ROLLUP (lang)")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.statistics(_table(spark, sf_dir, "documents").withColumnRenamed("lang", "source_type"))


@_query("metadata_json", "SELECT event_id, event_type, (props ->> 'k')::BIGINT AS k, '{\"event\":\"' || event_type || '\",\"k\":\"' || (props ->> 'k') || '\"}' AS packed FROM events")
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = search.hits(_table(spark, sf_dir, "events").withColumn("metadata", F.col("props")))
    packed = F.to_json(chunking.metadata(event=F.col("event_type"), k=F.col("metadata")["k"]))
    return parsed.select("event_id", "event_type", F.col("metadata")["k"].cast("long").alias("k"), packed.alias("packed"))


@_query("event_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed(_table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@_query("event_sessions", """
WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM numbered GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(_table(spark, sf_dir, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


# Places, partitions and rendered text

@_query("record_counts", "SELECT 'agave' AS repo, p AS path_prefix, n AS items, 0::BIGINT AS constants FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'runtime' WHEN 1 THEN 'core' ELSE '' END AS p, (4 * count(*))::BIGINT AS n FROM supplier GROUP BY 1)")
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = _table(spark, sf_dir, "supplier")
    folder = F.element_at(F.array(F.lit("runtime"), F.lit("core"), F.lit("elsewhere")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    items = supplier.select(F.lit("agave").alias("repo"), F.concat(folder, F.lit("/a.rs")).alias("file_path"), F.explode(F.sequence(F.lit(1), F.lit(4))))
    return lookup.counts(items, items.filter("false"))


@_query("index_sources", _PARTS_SQL + "SELECT path AS source_file, 'docs' AS source_type, count(*)::BIGINT AS chunks FROM numbered GROUP BY 1")
def index_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.sources(_document_chunks(spark, sf_dir))


@_query("rendered_hits", """
SELECT doc_id, (row_number() OVER (ORDER BY doc_id)) || '. [docs] ' || doc_id || ' (score: ' || (doc_id % 101) || '%)' || chr(10) || '   File: ' || source || '/' || doc_id || '.md:1' || chr(10) || chr(10) || '```' || chr(10)
    || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '... (truncated)' ELSE text END || chr(10) || '```' AS text FROM documents WHERE text IS NOT NULL""")
def rendered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    ident = F.col("doc_id").cast("string")
    hits = lookup.numbered(docs, "doc_id", "rank").select("doc_id", "rank", F.lit("docs").alias("source_type"), ident.alias("source_name"), F.concat("source", F.lit("/"), ident, F.lit(".md")).alias("source_file"), F.lit(1).alias("line_number"), ((F.col("doc_id") % 101) / 100).alias("similarity"), F.lit(None).cast("string").alias("url"), F.col("text").alias("content"))
    return lookup.rendered_hits(hits).select("doc_id", "text")
