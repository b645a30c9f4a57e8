"""What the jobs' command lines share: settings from a TOML file, a session, logs on standard error."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import tomllib
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


def from_file(kind: type, path: str | None) -> Any:
    """A dataclass of settings from a TOML file; what the file leaves out has its default, what it adds is an error."""
    if path is None:
        return kind()
    with open(path, "rb") as f:
        return kind(**tomllib.load(f))


def main(name: str, kind: type, paths: dict[str, str], run: Callable[..., dict[str, int]], argv: list[str] | None = None) -> None:
    """Read the arguments, run the job in a session of its own and print what it counted."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for path, meaning in paths.items():
        parser.add_argument(f"--{path}", required=True, help=meaning)
    parser.add_argument("--config", help="TOML file of: " + ", ".join(f.name for f in dataclasses.fields(kind)))
    asked = vars(parser.parse_args(argv))
    settings = from_file(kind, asked.pop("config"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        print(run(spark, **asked, settings=settings))
    finally:
        spark.stop()
