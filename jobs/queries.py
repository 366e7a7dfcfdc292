"""The jobs as queries over the given tables, and DuckDB SQL for what they write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gravelake.plans import oracles
from gravelake.session import shared_dir
from jobs import index_documents, sweep


def _twice(job, spark: SparkSession, config) -> DataFrame:
    """The output as it stands after a second run into the same folders."""
    job.run(spark, config)
    job.run(spark, config)
    return job.output(spark, config)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job1_index_documents")
    return _twice(index_documents, spark, index_documents.Config(f"{sf_dir}/documents.parquet", f"{at}/collection", f"{at}/checkpoint"))


def job2_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job2_sweep")
    return _twice(sweep, spark, sweep.Config(*(f"{sf_dir}/{t}.parquet" for t in ("documents", "benchmark", "embeddings")), at))


QUERIES = {"job1_index_documents": job1_index_documents, "job2_sweep": job2_sweep}
ORACLES = {"job1_index_documents": oracles.windows(64, 48), "job2_sweep": oracles.sweep((0.1, 0.5, 0.9), 5)}
