"""Command line: checkouts, extraction, the index, search and the catalogs over a data directory."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators import catalog, lookup
from sparkloom.plans.engine import Engine
from sparkloom.sources import repos


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sparkloom")
    parser.add_argument("--data-dir", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("compile", "status", "models", "versions", "clients", "vacuum"):
        commands.add_parser(name)
    commands.add_parser("download").add_argument("repo", nargs="*")
    for name in ("build", "update", "index"):
        commands.add_parser(name).add_argument("--full", action="store_true")
    commands.choices["index"].add_argument("--dry-run", action="store_true")
    commands.add_parser("compact").add_argument("--cells", action="store_true")
    find = commands.add_parser("search")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=5)
    find.add_argument("--type", dest="source_type")
    for name in ("constant", "function"):
        commands.add_parser(name).add_argument("name")
    tool = commands.add_parser("tool")
    tool.add_argument("name")
    tool.add_argument("argument", nargs="*", help="key=value")
    return parser


def _index(engine: Engine, full: bool, dry_run: bool = False) -> str:
    if dry_run:
        planned = engine.dry_run()
        return "\n".join(x for x in (planned.summary(), planned.listing()) if x)
    stats = engine.update(full, logging.getLogger("sparkloom.index").info)
    return "\n".join([stats.summary(), *stats.errors])


def _table(df: DataFrame) -> str:
    return "\n\n".join(r["text"] for r in lookup.rendered_rows(df).select("text").collect())


def run(engine: Engine, asked: argparse.Namespace) -> str:
    """What a command prints."""
    spark, tell = engine.spark, logging.getLogger("sparkloom.repos").info
    if asked.command == "download":
        return "\n".join(f"{name}: {'ok' if ok else 'failed'}" for name, ok in repos.download(engine.data_dir, asked.repo or None, tell).items())
    if asked.command == "build":
        repos.download(engine.data_dir, None, tell)
        engine.compile()
        return _index(engine, asked.full)
    if asked.command == "update":
        stats = engine.refresh(asked.full, tell)
        return stats.summary() if stats else "No updates found"
    if asked.command == "index":
        return _index(engine, asked.full, asked.dry_run)
    if asked.command == "status":
        parts = [repos.status(spark, engine.data_dir), engine.status()]
        if engine.compiled():
            parts.insert(1, engine.counts().orderBy("repo", "path_prefix"))
        return "\n\n".join(_table(p) for p in parts)
    if asked.command == "search":
        found = lookup.brief_hits(engine.search(asked.query, asked.limit, asked.source_type)).orderBy("rank")
        return "\n\n".join(r["text"] for r in found.select("text").collect()) or "Nothing found"
    if asked.command in ("constant", "function"):
        return engine.tell({"constant": "grep_constant", "function": "analyze_function"}[asked.command], name=asked.name)
    if asked.command == "tool":
        return engine.tell(asked.name, **dict(x.split("=", 1) for x in asked.argument))
    if asked.command == "compact":
        engine.index.compact(asked.cells)
        return "Written as one segment"
    if asked.command == "vacuum":
        return f"{len(engine.index.vacuum())} folders deleted"
    return _table({"compile": engine.compile, "models": lambda: catalog.models(spark), "versions": lambda: catalog.version_lines(spark), "clients": lambda: catalog.clients(spark)}[asked.command]())


def main(args: Sequence[str] | None = None) -> int:
    asked = _parser().parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("sparkloom").getOrCreate()
    print(run(Engine(spark, asked.data_dir), asked))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
