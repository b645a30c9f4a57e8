"""Snapshots of source files as DataFrames (SRC-05..SRC-12, FN-11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.functions import text as T

PATTERNS = {"rust": "*.rs", "c": "*.{c,h}", "markdown": "*.md"}


def relative(path: Column, root: str) -> Column:
    """A file's path under the root of its scan (EXT-25)."""
    plain = root.rstrip("/")
    plain = plain[plain.index(":") + 1 :] if ":" in plain else plain
    full = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    return F.regexp_replace(F.substring(full, F.lit(len("/" + plain.lstrip("/")) + 1), F.length(full)), "^/+", "")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, by Hadoop's file systems."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def snapshot(spark: SparkSession, root: str, pattern: str | Sequence[str], repo: str = "", recursive: bool = True, subdirs: Sequence[str] = ()) -> DataFrame:
    """(repo, path, content, sha256, mtime_ns, length) of the UTF-8 files under ``root`` that match a pattern, or one of several.

    Files that are not UTF-8 have no row.  Line ends become ``\\n``; the hash is of the bytes as they
    are.  A select without content and sha256 reads no file.
    """
    paths = [f"{root.rstrip('/')}/{s}" for s in subdirs] or [root]
    glob = pattern if isinstance(pattern, str) else "{" + ",".join(pattern) + "}"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    raw = reader.load(paths)
    time = F.unix_millis(F.col("modificationTime")) * 1_000_000
    text = T.unix_lines(F.decode(F.col("content"), "UTF-8"))
    return raw.filter(F.call_function("is_valid_utf8", F.col("content").cast("string"))).select(F.lit(repo).alias("repo"), relative(F.col("path"), root).alias("path"), text.alias("content"), F.sha2("content", 256).alias("sha256"), time.alias("mtime_ns"), "length")


def rust_files(spark: SparkSession, root: str, repo: str = "", subdirs: Sequence[str] = (), pattern: str | Sequence[str] = PATTERNS["rust"]) -> DataFrame:
    return snapshot(spark, root, pattern, repo, subdirs=subdirs).withColumn("file_type", F.lit("rust"))


def c_files(spark: SparkSession, root: str, repo: str = "", subdirs: Sequence[str] = (), pattern: str | Sequence[str] = PATTERNS["c"]) -> DataFrame:
    return snapshot(spark, root, pattern, repo, subdirs=subdirs).withColumn("file_type", F.lit("c"))


def proposals(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """``proposals/*.md`` under ``root``, not deeper."""
    found = snapshot(spark, f"{root.rstrip('/')}/proposals", PATTERNS["markdown"], repo, recursive=False)
    return found.withColumn("path", F.concat(F.lit("proposals/"), "path")).withColumn("file_type", F.lit("simd"))


def markdown(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """All markdown under ``docs`` of ``root`` (SRC-10)."""
    return snapshot(spark, root, PATTERNS["markdown"], repo, subdirs=["docs"]).withColumn("file_type", F.lit("docs"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records; a missing file has none (SRC-11)."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.ITEM)


def read_constants(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.CONSTANT)


#: Different names for which a file's bloom filter is made.
NAMES = 100_000


def write_records(df: DataFrame, path: str, as_json: bool = False) -> None:
    """Records by repo: Parquet, or JSON lines for other tools (SNK-01).

    Parquet files are sorted by name and have a bloom filter of their names, so that a lookup of a name reads
    the row groups that may have it, and of a name that isn't there none (SRC-13).
    """
    if as_json:
        return df.write.mode("overwrite").partitionBy("repo").json(path)
    filters = {"parquet.bloom.filter.enabled#name": "true", "parquet.bloom.filter.expected.ndv#name": str(NAMES)}
    return df.sortWithinPartitions("repo", "name").write.mode("overwrite").options(**filters).partitionBy("repo").parquet(path)
