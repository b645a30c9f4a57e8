"""Manifests of indexed files: validation, change detection, rebuild decisions (INC-01..03, SRC-14, SRC-15)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import schemas

VERSION = "1.0.0"
MAX_BYTES = 10 * 1024 * 1024
MAX_CHUNKS = 10_000
#: Chunks that a dry run expects of an added or changed file.
ESTIMATE = 10
_VERSION = re.compile(r"^\d+\.\d+\.\d+$")


class ManifestError(ValueError):
    pass


class CorruptManifest(ManifestError):
    pass


@dataclass
class Header:
    embedding_model: str = ""
    chunk_config: dict[str, int] = field(default_factory=dict)
    repo_versions: dict[str, str] = field(default_factory=dict)
    version: str = VERSION
    updated_at: str = ""


def safe_path(path: Column) -> Column:
    """No parent steps, no absolute or drive paths, no NUL or line controls (FLT-12)."""
    return path.isNotNull() & ~path.contains("..") & ~path.rlike(r"^(/|[A-Za-z]:)") & ~path.rlike("[\\x00\\n\\r\\t]") & (path != "")


def safe_chunk_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z0-9_-]+$") & (F.length(c) <= 200), F.lit(False))


def violations(files: DataFrame) -> DataFrame:
    """(path, problem) of entries that break a rule."""
    problem = (
        F.when(~safe_path(F.col("path")), "unsafe path")
        .when(~F.coalesce(F.col("sha256").rlike("^[a-f0-9]{64}$"), F.lit(False)), "bad sha256")
        .when(F.size("chunk_ids") > MAX_CHUNKS, "too many chunk ids")
        .when(F.exists("chunk_ids", lambda c: ~safe_chunk_id(c)), "bad chunk id")
    )
    return files.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def validated(files: DataFrame) -> DataFrame:
    bad = violations(files).limit(1).collect()
    if bad:
        raise ManifestError(f"{bad[0]['problem']}: {bad[0]['path']!r}")
    return files


#: What a JSON manifest's entries are read as.
_ENTRIES = "map<string, struct<sha256: string, mtime_ns: bigint, chunk_ids: array<string>>>"


def parse(spark: SparkSession, text: str, size: int | None = None) -> tuple[Header, DataFrame]:
    """Header and files of a JSON manifest; what is not JSON is corrupt, what breaks a rule invalid."""
    if (len(text.encode()) if size is None else size) > MAX_BYTES:
        raise ManifestError("manifest too large")
    return _parsed(spark.createDataFrame([(text,)], "value string"))


def _parsed(whole: DataFrame) -> tuple[Header, DataFrame]:
    """The same of a table of one text: Spark parses it and makes a row of each entry."""
    data = whole.select(F.try_parse_json("value").alias("data"))
    get = lambda path, kind: F.try_variant_get("data", path, kind)
    entries = get("$.files", _ENTRIES)
    found = data.select(
        F.col("data").isNull().alias("corrupt"), get("$.version", "string").alias("version"), F.try_variant_get("data", "$.files", "variant").isNotNull().alias("files"), entries.isNotNull().alias("mapping"),
        *[F.coalesce(get(f"$.{n}", "string"), F.lit("")).alias(n) for n in ("embedding_model", "updated_at")], get("$.chunk_config", "map<string,int>").alias("chunk_config"), get("$.repo_versions", "map<string,string>").alias("repo_versions"),
    ).first()
    if found.corrupt:
        raise CorruptManifest("no JSON")
    if found.version is None or not found.files:
        raise ManifestError("version and files are required")
    if not found.mapping:
        raise ManifestError("files must be a mapping of entries")
    if not _VERSION.match(found.version):
        raise ManifestError("bad version")
    entry = F.col("entry")
    rows = data.select(F.explode(entries).alias("path", "entry")).select("path", entry["sha256"].alias("sha256"), F.coalesce(entry["mtime_ns"], F.lit(0)).alias("mtime_ns"), F.coalesce(entry["chunk_ids"], F.array().cast("array<string>")).alias("chunk_ids"))
    return Header(found.embedding_model, found.chunk_config or {}, found.repo_versions or {}, found.version, found.updated_at), validated(rows)


def touched(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change_type, same, old_chunk_ids) of added and deleted files, and those whose time changed.

    ``same``: a file's hash is what it was; such a file is not modified, only its time is new.
    """
    old = manifest.select("path", F.lit(True).alias("__old"), F.col("sha256").alias("__sha"), F.col("mtime_ns").alias("__time"), "chunk_ids")
    new = current.select("path", F.lit(True).alias("__new"), "sha256", "mtime_ns")
    kind = F.when(F.col("__old").isNull(), "add").when(F.col("__new").isNull(), "delete").when(~F.col("mtime_ns").eqNullSafe(F.col("__time")), "modify")
    same = (kind == "modify") & F.col("sha256").eqNullSafe(F.col("__sha"))
    return new.join(old, "path", "full_outer").select("path", kind.alias("change_type"), same.alias("same"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("old_chunk_ids")).filter("change_type IS NOT NULL")


def load(spark: SparkSession, path: str) -> tuple[Header, DataFrame] | None:
    """The manifest of a JSON file anywhere that Spark reads, None without one; what is not JSON is copied beside before it raises (SRC-14)."""
    try:
        size = spark.read.format("binaryFile").load(path).select("length").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if size[0] > MAX_BYTES:
        raise ManifestError("manifest too large")
    try:
        return _parsed(spark.read.text(path, wholetext=True))
    except CorruptManifest as e:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        file, copy = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.corrupted"))
        fs = file.getFileSystem(conf)
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, file, fs, copy, False, conf)
        raise CorruptManifest(f"{e}; kept as {path}.corrupted") from e


def changes(manifest: DataFrame, current: DataFrame, check_hashes: bool = True) -> DataFrame:
    """(path, change_type, old_chunk_ids) of added, modified and deleted files (JOI-01, SET-02).

    A file whose time is unchanged is not looked into; one whose time changed is modified if its hash
    did (or at once, without ``check_hashes``).
    """
    found = touched(manifest, current)
    return (found.filter("NOT same") if check_hashes else found).drop("same")


def rebuild_reason(header: Header | None, model: str, chunk_config: dict[str, int]) -> str:
    """Why everything must be indexed anew; empty if it need not (INC-01)."""
    if header is None:
        return "No manifest exists"
    if header.embedding_model and header.embedding_model != model:
        return f"Embedding model changed: {header.embedding_model} -> {model}"
    if header.chunk_config and header.chunk_config != chunk_config:
        return "Chunk configuration changed"
    return ""


def summary(changed: DataFrame) -> DataFrame:
    """One row: files by change, chunks to delete, and a dry run's estimates (AGG-04, AGG-05)."""
    is_ = lambda k: F.col("change_type") == k
    old = F.size("old_chunk_ids")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return changed.agg(
        F.count_if(is_("add")).alias("files_added"), F.count_if(is_("modify")).alias("files_modified"), F.count_if(is_("delete")).alias("files_deleted"),
        zero(F.sum(F.when(~is_("add"), old))).alias("chunks_to_delete"), (F.count_if(is_("add") | is_("modify")) * ESTIMATE).alias("chunks_to_add"),
    )


def with_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files with the ids of their chunks in order; files without chunks have none (JOI-05, AGG-07)."""
    order = F.split("chunk_id", "_")
    place = F.try_element_at(order, F.lit(-2)).cast("int")
    ids = chunks.groupBy(F.col("source_file").alias("path")).agg(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("i"), F.col("chunk_id").alias("id")))), lambda x: x["id"]).alias("chunk_ids"))
    return files.select("path", "sha256", "mtime_ns").join(ids, "path", "left").select("path", "sha256", "mtime_ns", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
