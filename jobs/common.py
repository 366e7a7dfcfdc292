"""Config files and command lines of the jobs."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from gravelake.session import session

Config = TypeVar("Config")


def read_config(spark: SparkSession, path: str, kind: type[Config], **over) -> Config:
    """A JSON file, read through Spark, so that it may be remote; values that are given win over it. Unknown names are an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first().value) | {k: v for k, v in over.items() if v is not None}
    unknown = set(given) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def main(name: str, kind: type[Config], run: Callable[[SparkSession, Config], object], about: str | None, argv: list[str] | None = None) -> None:
    """The config file, and an option for each of its paths; creates the session and stops it."""
    top = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    top.add_argument("config", help="a JSON file of settings")
    paths = [f.name for f in dataclasses.fields(kind) if f.type == "str"]
    for p in paths:
        top.add_argument(f"--{p}", help="instead of the file's")
    a = top.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session(name)
    try:
        run(spark, read_config(spark, a.config, kind, **{p: getattr(a, p) for p in paths}))
    finally:
        spark.stop()
