"""Line lists, named subsets and YAML query and gold sources."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelake import schemas


def read_list(path: str | Path) -> list[str]:
    """One item a line; a # starts a comment anywhere; blank lines are dropped."""
    kept = (line.partition("#")[0].strip() for line in Path(path).read_text(encoding="utf-8").splitlines())
    return [x for x in kept if x]


def list_table(spark: SparkSession, path: str) -> DataFrame:
    """The same list as a table, for lists that are data."""
    item = F.regexp_replace(F.split("value", "#")[0], r"(?U)^\s+|\s+$", "")
    return spark.read.text(path).select(item.alias("item")).filter("item <> ''")


def query_lines(path: str | Path | None, more: Iterable[str] = ()) -> list[str]:
    """Queries of a file, where only a leading # makes a comment, then those given; none at all is an error."""
    lines = Path(path).read_text(encoding="utf-8").splitlines() if path else []
    found = [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")] + [q for q in more if q]
    if not found:
        raise ValueError("no queries")
    return found


def resolve_subset(argument: str, folder: str | Path) -> Path:
    """An existing path; a name with a suffix must exist; any other name is <folder>/<name>.txt."""
    path = Path(argument)
    if path.exists():
        return path
    if path.suffix:
        raise FileNotFoundError(argument)
    named = Path(folder) / f"{argument}.txt"
    if not named.exists():
        raise FileNotFoundError(str(named))
    return named


def resolve_named_subset(name: str, folder: str | Path) -> dict[str, Path]:
    """Files of a subset by collection, at least one of the two."""
    found = {c: p for c in ("game", "wiki") if (p := Path(folder) / c / f"{name}.txt").exists()}
    if not found:
        raise FileNotFoundError(name)
    return found


def _yaml_rows(path: str | Path, top: str) -> list[dict]:
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    rows = raw.get(top, raw) if isinstance(raw, dict) else raw
    return [{"id": k, **v} for k, v in rows.items()] if isinstance(rows, dict) else list(rows)


def _table(spark: SparkSession, rows: list[dict], schema) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def yaml_queries(spark: SparkSession, path: str | Path, ids: Iterable[str] | None = None, schema=schemas.EVAL_QUERY) -> DataFrame:
    """Queries of a YAML file, those of the ids if any are given."""
    d = _table(spark, _yaml_rows(path, "queries"), schema)
    return d if ids is None else d.join(spark.createDataFrame([(i,) for i in ids], "id string"), "id", "left_semi")


def yaml_gold(spark: SparkSession, path: str | Path, schema=schemas.GOLD_RULE) -> DataFrame:
    return _table(spark, _yaml_rows(path, "gold" if schema is schemas.GOLD_RULE else "rules"), schema)
