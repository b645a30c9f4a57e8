"""Name lookup and links to sources (FLT-03, AGG-09, PRJ-16..PRJ-18, JOI-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import catalog


def constant(constants: DataFrame, name: str) -> DataFrame:
    """The first constant of a name in (repo, path, line) order; the name is a pushed-down filter."""
    return constants.filter(F.col("name") == name).orderBy("repo", "file_path", "line_number").limit(1)


def function(items: DataFrame, name: str) -> DataFrame:
    return items.filter((F.col("name") == name) & (F.col("kind") == "function")).orderBy("repo", "file_path", "line_number").limit(1)


#: Keys of a range that are numbered together.
_RANGE = 4096


def numbered(rows: DataFrame, key: str, to: str) -> DataFrame:
    """``rows`` in the order of an integer key, numbered from 1 in ``to`` without gathering them.

    Ranges of keys are counted, the counts (a row for each range) summed up, and rows numbered inside their
    range.  Keys should be unique: rows of one key share its range.
    """
    place = F.floor(F.col(key) / _RANGE).alias("__range")
    counts = rows.groupBy(place).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = rows.withColumn("__range", place).join(counts.select("__range", before.alias("__before")), "__range")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    return joined.withColumn(to, (F.col("__before") + inside).cast("int")).drop("__range", "__before")


def first_by_name(records: DataFrame) -> DataFrame:
    """The first record of every name (AGG-09); one shuffle, minima combined before it."""
    rest = [c for c in records.columns if c not in ("name", "repo", "file_path", "line_number")]
    order = F.struct("repo", "file_path", "line_number")
    return records.groupBy("name").agg(F.min_by(F.struct("repo", "file_path", "line_number", *rest), order).alias("x")).select("name", "x.*")


def partition_parts(path: Column) -> tuple[Column, Column]:
    """Repository and prefix of a partition's path (PRJ-18)."""
    parts = F.split(path, "/")
    return parts[0], F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def partitioned(records: DataFrame) -> DataFrame:
    """Records with ``path_prefix``, the scanned folder that their file is in (SRC-12); the folders are a handful of rows."""
    folders = [(f"{repo}/{folder}".rstrip("/"),) for repo, (_, subdirs) in catalog.SCANS.items() for folder in subdirs]
    known = records.sparkSession.createDataFrame(folders, "p string")
    repo, prefix = partition_parts(F.col("p"))
    known = known.select(repo.alias("__repo"), prefix.alias("__prefix"))
    inner = F.when(F.startswith("file_path", F.concat("repo", F.lit("/"))), F.expr("substring(file_path, length(repo) + 2)")).otherwise(F.col("file_path"))
    under = (F.col("__prefix") == "") | F.startswith(inner, F.concat("__prefix", F.lit("/")))
    return records.join(F.broadcast(known), (F.col("repo") == F.col("__repo")) & under, "left").withColumn("path_prefix", F.coalesce("__prefix", F.lit(""))).drop("__repo", "__prefix")


def counts(items: DataFrame, constants: DataFrame) -> DataFrame:
    """Items and constants by repository and scanned folder (AGG-10)."""
    each = partitioned(items.select("repo", "file_path", F.lit(1).alias("i"), F.lit(0).alias("c")).unionByName(constants.select("repo", "file_path", F.lit(0).alias("i"), F.lit(1).alias("c"))))
    return each.groupBy("repo", "path_prefix").agg(F.sum("i").alias("items"), F.sum("c").alias("constants"))


def source_urls(hits: DataFrame, file: str = "source_file", line: str = "line_number", repo: str = "repo") -> DataFrame:
    """``hits`` with ``url``: by their repository if it is known, else by the path's first part, else null.

    A path may start with its repository or not.
    The registry is a handful of rows, broadcast twice.
    """
    base = catalog.repos(hits.sparkSession).select(F.col("repo").alias("__r"), F.regexp_replace("url", r"\.git$", "").alias("__u"), F.col("branch").alias("__b"))
    own, head = base.toDF("__r1", "__u1", "__b1"), base.toDF("__r2", "__u2", "__b2")
    part = F.element_at(F.split(F.coalesce(F.col(file), F.lit("")), "/"), 1)
    joined = hits.join(F.broadcast(own), F.col(repo) == F.col("__r1"), "left").join(F.broadcast(head), part == F.col("__r2"), "left")
    anchor = F.when(F.coalesce(F.col(line), F.lit(0)) != 0, F.concat(F.lit("#L"), F.col(line).cast("string"))).otherwise("")
    rest = F.regexp_extract(F.col(file), "^[^/]*/(.*)$", 1)
    inner = F.when(F.startswith(F.col(file), F.concat(F.col(repo), F.lit("/"))), rest).otherwise(F.col(file))
    by_repo = F.concat("__u1", F.lit("/blob/"), "__b1", F.lit("/"), inner, anchor)
    by_path = F.when(F.contains(F.col(file), F.lit("/")), F.concat("__u2", F.lit("/blob/"), "__b2", F.lit("/"), rest, anchor))
    return joined.withColumn("url", F.when(F.coalesce(F.col(file), F.lit("")) != "", F.coalesce(by_repo, by_path))).drop("__r1", "__u1", "__b1", "__r2", "__u2", "__b2")


def rendered_hits(hits: DataFrame, limit: int = 500) -> DataFrame:
    """A text for each hit: rank, type, name, similarity, place, link and shortened content (SNK-10)."""
    place = F.format_string("   File: %s:%d", F.col("source_file"), F.col("line_number"))
    head = F.format_string("%d. [%s] %s (score: %.0f%%)", F.col("rank"), F.col("source_type"), F.col("source_name"), F.col("similarity") * 100)
    link = F.when(F.col("url").isNotNull(), F.concat(F.lit("   Source: "), "url"))
    block = F.concat(F.lit("\n```\n"), T.shortened(F.col("content"), limit, "\n... (truncated)"), F.lit("\n```"))
    return hits.withColumn("text", F.concat_ws("\n", head, place, link, block))


def brief_hits(hits: DataFrame, limit: int = 200, lines: int = 3) -> DataFrame:
    """A short text for each hit: similarity to two digits and the first lines of its content (PRJ-15, PRJ-16)."""
    head = F.format_string("%d. [%s] %s (%.2f%%)", F.col("rank"), F.col("source_type"), F.col("source_name"), F.col("similarity") * 100)
    place = F.format_string("   %s:%d", F.col("source_file"), F.col("line_number"))
    start = F.slice(F.split(T.shortened(F.col("content"), limit, "..."), "\n"), 1, lines)
    return hits.withColumn("text", F.concat_ws("\n", head, place, F.array_join(F.transform(start, lambda x: F.concat(F.lit("   | "), x)), "\n")))


def rendered_constants(found: DataFrame) -> DataFrame:
    kind = F.when(F.coalesce("type_annotation", F.lit("")) != "", F.concat(F.lit(": "), "type_annotation")).otherwise("")
    head = F.concat(F.lit("const "), "name", kind, F.lit(" = "), "value")
    return found.withColumn("text", F.concat_ws("\n", head, *_place(), F.col("doc_comment")))


def rendered_functions(found: DataFrame) -> DataFrame:
    block = F.concat(F.lit("```\n"), T.strip(F.col("body"), "\n"), F.lit("\n```"))
    return found.withColumn("text", F.concat_ws("\n", "signature", *_place(), F.col("doc_comment"), block))


def _place() -> list[Column]:
    return [F.format_string("   File: %s:%d", F.col("file_path"), F.col("line_number")), F.when(F.col("url").isNotNull(), F.concat(F.lit("   Source: "), "url"))]


def rendered_rows(found: DataFrame) -> DataFrame:
    """A text of ``name: value`` lines for each row; nulls and empty lists are left out, lists are points (AGG-12)."""

    def line(name: str, kind: str) -> Column:
        value = F.col(name)
        if kind.startswith("array"):
            points = F.concat(F.lit(f"{name}:\n  - "), F.array_join(value.cast("array<string>"), "\n  - "))
            return F.when(F.size(value) > 0, points)
        return F.concat(F.lit(f"{name}: "), value.cast("string"))

    return found.withColumn("text", F.concat_ws("\n", *[line(c, k) for c, k in found.dtypes if c not in ("ord", "text")]))
