"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the controls U+0009 to U+000D, nothing else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a small table for which a task of its own is worth while.
TASK_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local-mode session may go without; it gets a temporary folder, removed at exit.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sparkloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


class Workspace:
    """Written tables of one operator call, in the shared folder.

    ``save`` cuts the lineage: what it returns is read from files, so that a lost executor
    costs a re-read and not a recomputation.  ``drop`` removes what is no longer needed.  What a
    result still reads goes when the driver's program ends, or with ``clear``.
    """

    _made: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        if not Workspace._made:
            atexit.register(Workspace.clear)
        Workspace._made.append(self)

    @classmethod
    def clear(cls) -> None:
        """Remove the tables of all calls so far; results that read them can't be read again."""
        for work in cls._made:
            with contextlib.suppress(Exception):  # at the end of a program the session may be gone
                delete(work.spark, work.path)
        cls._made.clear()

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``df``, written; if it has about so many ``rows``, by no more tasks (and into no more files) than they need."""
        path = self.folder(name)
        (df if rows is None else df.coalesce(max(1, -(-rows // TASK_ROWS)))).write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved.workspace_path = path
        return saved

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t.workspace_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def local_path(uri: str) -> str:
    """A file: URI without its scheme, for pyarrow's file systems; other URIs stay."""
    return "/" + uri[len("file:") :].lstrip("/") if uri.startswith("file:") else uri
