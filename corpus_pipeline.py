"""The corpus pipeline: language identification, toxicity, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which
is written as Parquet and read again as the next stage's documents. The first three drop documents and keep
the columns of `documents`; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gravelake.llm import langid, ngram_join, packing, toxicity
from gravelake.llm.common import staged, table

STAGES = [
    ("language", langid.stage),
    ("toxicity", toxicity.stage),
    ("near_duplicates", ngram_join.stage),
    ("packing", packing.stage),
]

#: SQL can express neither the trained models nor the tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
