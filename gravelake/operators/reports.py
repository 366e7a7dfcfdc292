"""Validator reports: parsing, severity threshold, grouping and rendering."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelake import schemas
from gravelake.functions import text as X

#: Fixed values, lowest first.
SEVERITIES = ("tips", "untidy", "warning", "error", "fatal")


def severity_index(severity: Column) -> Column:
    """From 0; a missing severity is the lowest, an unknown one an error."""
    s = F.lower(F.coalesce(severity, F.lit(SEVERITIES[0])))
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), s) - 1
    return F.when(at >= 0, at).otherwise(F.raise_error(F.concat(F.lit("unknown severity "), s)))


def parse_reports(df: DataFrame, column: str) -> DataFrame:
    """JSON arrays of reports to rows, each with its own JSON as `record`."""
    d = df.select(F.explode(F.from_json(column, "array<string>")).alias("record"))
    return d.select(F.from_json("record", schemas.REPORT).alias("r"), "record").select("r.*", "record")


def at_least(reports: DataFrame, minimum: str = "warning") -> DataFrame:
    """Reports of the severity and above; an unknown minimum is `warning`."""
    low = SEVERITIES.index(minimum.lower()) if minimum.lower() in SEVERITIES else SEVERITIES.index("warning")
    return reports.withColumn("severity_idx", severity_index(F.col("severity"))).filter(F.col("severity_idx") >= low)


def by_severity(reports: DataFrame) -> DataFrame:
    out = reports.groupBy(F.lower(F.coalesce("severity", F.lit(SEVERITIES[0]))).alias("severity"), "severity_idx").agg(F.count(F.lit(1)).alias("n_reports"))
    return out.orderBy(F.desc("severity_idx"))


def report_lines(reports: DataFrame) -> DataFrame:
    """Each report as a line, highest severity first, then by file."""
    place = F.concat(X.text_or_empty("file"), F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""))
    message = X.message_of(F.col("msg"), F.col("message"), F.col("text"), F.col("record"))
    line = F.concat(F.lit("  ["), X.text_or_empty("key"), F.lit("] "), place, F.lit(": "), message)
    return reports.select("severity_idx", F.lower(F.coalesce("severity", F.lit("tips"))).alias("severity"), X.text_or_empty("file").alias("file"), line.alias("report")).orderBy(F.desc("severity_idx"), "file", "report")


def report_text(reports: DataFrame, minimum: str = "warning") -> str:
    """The listing for a reader: one mod's reports, so few."""
    rows = report_lines(at_least(reports, minimum)).collect()
    if not rows:
        return f"No issues at severity >= {minimum}."
    out: list[str] = []
    for s in reversed(SEVERITIES):
        own = [r.report for r in rows if r.severity == s]
        out += [f"{s.upper()} ({len(own)}):", *own, ""] if own else []
    return "\n".join(out).strip()


def run_validator(spark: SparkSession, command: list[str], timeout: int = 120) -> DataFrame | str:
    """Reports of an external validator that prints JSON; its plain output, cut, if it is not JSON."""
    import json

    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=timeout)
    except FileNotFoundError:
        return f"Error: validator not found at {command[0]!r}"
    except subprocess.TimeoutExpired:
        return f"Error: the validator timed out after {timeout}s."
    try:
        json.loads(done.stdout)
    except json.JSONDecodeError:
        return (done.stderr or done.stdout or "No output from the validator.")[:3000]
    return parse_reports(spark.createDataFrame([(done.stdout,)], "j string"), "j")
