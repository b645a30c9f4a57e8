"""The engine: a data directory, its extracted records and its index behind one object (§2.16)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.operators import catalog, encode, extract, lookup, search
from sparkloom.plans import validate
from sparkloom.plans.index import DryRun, Index, Stats
from sparkloom.sources import files as S
from sparkloom.sources import repos


class Engine:
    def __init__(self, spark: SparkSession, data_dir: str, model: str = "hashing") -> None:
        self.spark, self.data_dir, self.model = spark, data_dir.rstrip("/"), model
        self.index = Index(spark, f"{self.data_dir}/index", model)

    def _exists(self, path: str) -> bool:
        return S.exists(self.spark, path)

    def present(self) -> list[str]:
        return [r[0] for r in catalog.REPOS if self._exists(f"{self.data_dir}/{r[0]}")]

    def files(self) -> DataFrame:
        """All source files of the repositories that are there; paths start with the repository."""
        parts = []
        for repo in self.present():
            root = f"{self.data_dir}/{repo}"
            if repo in catalog.SCANS:
                language, subdirs = catalog.SCANS[repo]
                there = [s for s in subdirs if self._exists(f"{root}/{s}")]
                if there:
                    scan = S.rust_files if language == "rust" else S.c_files
                    parts.append(scan(self.spark, root, repo, [s for s in there if s]))
            if self._exists(f"{root}/proposals"):
                parts.append(S.proposals(self.spark, root, repo))
            if self._exists(f"{root}/docs"):
                parts.append(S.markdown(self.spark, root, repo))
        if not parts:
            raise FileNotFoundError(f"no known repository under {self.data_dir}")
        found = reduce(DataFrame.unionByName, parts)
        return found.withColumn("path", F.concat("repo", F.lit("/"), "path"))

    def compile(self) -> DataFrame:
        """Extract and write records; statistics by repository."""
        files = self.files().cache()
        try:
            (ri, rc), (ci, cc) = extract.rust(files.filter("file_type = 'rust'")), extract.c(files.filter("file_type = 'c'"))
            S.write_records(ri.unionByName(ci), f"{self.data_dir}/compiled/items")
            S.write_records(rc.unionByName(cc), f"{self.data_dir}/compiled/constants")
            rows = extract.statistics(self.items(), self.constants(), files).collect()
        finally:
            files.unpersist()
        return self.spark.createDataFrame(rows) if rows else self.spark.createDataFrame([], "repo string")

    def compiled(self) -> bool:
        return self._exists(f"{self.data_dir}/compiled/items")

    def items(self) -> DataFrame:
        return self.spark.read.schema(schemas.ITEM).parquet(f"{self.data_dir}/compiled/items")

    def constants(self) -> DataFrame:
        return self.spark.read.schema(schemas.CONSTANT).parquet(f"{self.data_dir}/compiled/constants")

    def update(self, full: bool = False, progress: Callable[[str], None] | None = None) -> Stats:
        """Bring the index to the files that are there; the manifest notes their repositories' commits."""
        return self.index.update(self.files(), full=full, repo_versions=self._commits(), progress=progress)

    def _commits(self) -> dict[str, str]:
        return repos.versions(self.data_dir) if ":" not in self.data_dir.removeprefix("file:") else {}

    def refresh(self, full: bool = False, tell: Callable[[str], None] = print) -> Stats | None:
        """Refresh the checkouts; if any changed, extract and index again (INC-08)."""
        if not repos.refreshed(self.data_dir, tell):
            return None
        self.compile()
        return self.update(full, tell)

    def dry_run(self) -> DryRun:
        return self.index.dry_run(self.files())

    def search(self, query: str, limit: int = 5, source_type: str | None = None, compat: bool = False) -> DataFrame:
        """The nearest chunks with their links.  The query is encoded by the model that the index has."""
        asked = validate.Search(query, limit, source_type)
        header = self.index.header()
        model = header.embedding_model if header else self.model
        where = F.col("source_type") == asked.source_type if asked.source_type else None
        vector = encode.embed_one(asked.query, model)
        found = search.top_k(self.index.chunks(), vector, asked.limit, where, compat=True) if compat else self.index.nearest(vector, asked.limit, where)
        return lookup.source_urls(search.hits(found).withColumn("repo", F.col("metadata")["repo"]))

    def constant(self, name: str) -> DataFrame:
        return lookup.source_urls(lookup.constant(self.constants(), validate.constant_name(name)), file="file_path")

    def function(self, name: str) -> DataFrame:
        return lookup.source_urls(lookup.function(self.items(), validate.function_name(name)), file="file_path")

    def status(self) -> DataFrame:
        return search.statistics(self.index.chunks())

    def counts(self) -> DataFrame:
        """Extracted items and constants by repository and folder."""
        return lookup.counts(self.items(), self.constants())

    def tell(self, tool: str, **arguments) -> str:
        """What ``call`` finds, as text."""
        found = self.call(tool, **arguments)
        ways = {"grep_constant": lookup.rendered_constants, "analyze_function": lookup.rendered_functions}
        way = ways.get(tool, lookup.rendered_hits if tool.startswith("search") else lookup.rendered_rows)
        shown = way(found)
        for order in ("rank", "ord"):
            if order in found.columns:
                shown = shown.orderBy(order)
        texts = [r["text"] for r in shown.select("text").collect()]  # a tool's rows: at most 50 hits, or a catalog
        return "\n\n".join(texts) or "Nothing found"

    def call(self, tool: str, **arguments) -> DataFrame:
        """A tool by name; bad input raises before a plan is built."""
        spark = self.spark
        tools = {
            "search": lambda: self.search(**arguments),
            "search_runtime": lambda: self.search(**{**arguments, "source_type": "rust"}),
            "search_simd": lambda: self.search(**{**arguments, "source_type": "simd"}),
            "grep_constant": lambda: self.constant(**arguments),
            "analyze_function": lambda: self.function(**arguments),
            "expert_guidance": lambda: catalog.find_guidance(catalog.guidance(spark), validate.topic(arguments["topic"])),
            "list_guidance_topics": lambda: catalog.guidance(spark).select("topic"),
            "get_status": self.status,
            "get_current_version": lambda: catalog.current_version(spark),
            "list_versions": lambda: catalog.version_lines(spark),
            "get_consensus_status": lambda: catalog.consensus(spark),
            "list_feature_gates": lambda: catalog.gates(spark, arguments.get("activated_only", False)),
            "list_clients": lambda: catalog.clients(spark, arguments.get("production_only", False)),
            "get_client": lambda: catalog.find_client(spark, validate.client(arguments["name"])),
            "get_client_diversity": lambda: catalog.diversity(spark),
            "get_client_breakdown": lambda: catalog.breakdown(spark),
        }
        if tool not in tools:
            raise validate.InputError(f"Unknown tool: {tool}")
        return tools[tool]()
