"""Compares settings of the search: every passage of a set of questions is searched under every weight of the two sides, with and without
a rerank, and its hits are held against what they should contain.

Documents stand for chunks, their sources for parents. The candidates of both sides do not depend on the weight, so they
are found once and written, with their chunks. Hits, rows by question and summaries are partitioned by setting; a run replaces the
partitions of the settings that it has and leaves others alone, so it may be repeated, and one weight may be added to an earlier sweep.

Documents without an id are left out; of several rows of one id one is taken, always the same. A question without words or without a vector is searched by the side that it has; one without any hit counts as missed.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelake.config import OVERFETCH
from gravelake.operators import evaluate, search
from gravelake.operators.lexical import LexicalIndex, build_index
from gravelake.operators.rerank import lexical_rerank
from gravelake.operators.store import Counted, last_wins
from jobs import common

log = logging.getLogger("jobs.sweep")


@dataclass(frozen=True)
class Config:
    documents: str
    benchmark: str
    embeddings: str
    out: str
    alphas: tuple[float, ...] = (0.1, 0.5, 0.9)
    modes: tuple[str, ...] = ("plain", "rerank")
    top_k: int = 5
    expected_words: int = 4


#: Chunks of candidates that are looked for by a broadcast of their ids.
_BROADCAST = 1_000_000


def _documents(spark: SparkSession, config: Config) -> DataFrame:
    return spark.read.parquet(config.documents).filter("doc_id IS NOT NULL")


def _chunks(docs: DataFrame) -> DataFrame:
    d = last_wins(docs.withColumn("h", F.xxhash64("text", "source", "lang")), "doc_id", "h")
    return d.select(
        F.col("doc_id").alias("child_id"), "text", F.col("source").alias("parent_id"), F.lit("document").alias("source_type"), F.concat_ws("/", F.lit("data"), "source", "lang", F.col("doc_id").cast("string")).alias("file_path"),
        F.col("source").alias("file_category"), F.col("lang").alias("block_name"), F.lit(None).cast("string").alias("section_title"), F.col("doc_id").alias("corpus_ord"),
    )


def _tables(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, vectors of chunks, and questions with their vectors and what a hit must contain."""
    docs = _documents(spark, config)
    e = spark.read.parquet(config.embeddings)
    vectors = e.select(F.col("vec_id").alias("child_id"), "embedding").join(docs.select(F.col("doc_id").alias("child_id")), "child_id", "left_semi")
    words = F.slice(F.filter(F.split("text", " "), lambda w: w != ""), 1, config.expected_words)
    q = spark.read.parquet(config.benchmark).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.array(F.array_join(words, " ")).alias("expected"))
    return _chunks(docs), vectors, q.join(e.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def _written(df: DataFrame, path: str) -> DataFrame:
    """Replaces the folder by these rows, even by none, and reads it again."""
    seen = Counted(df)
    seen.rows.write.mode("overwrite").parquet(path)
    log.info("wrote %d rows to %s", seen.n, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, config: Config) -> dict[str, int]:
    """Writes lexical, candidates, their chunks (hit_chunks), and hits, rows and summaries by setting under `out`; returns how many documents and questions it read."""
    log.info("read %s, %s and %s", config.documents, config.benchmark, config.embeddings)
    chunks, vectors, questions = _tables(spark, config)
    build_index(chunks).save(f"{config.out}/lexical")
    lexical = LexicalIndex.load(spark, f"{config.out}/lexical")
    n = {"documents": lexical.stats.first().n_docs, "questions": questions.count()}
    log.info("read %d documents and %d questions", *n.values())
    index = search.HybridIndex(chunks, lexical, vectors)
    wide = OVERFETCH * config.top_k
    v = _written(index.vector_candidates(questions.filter("embedding IS NOT NULL"), wide), f"{config.out}/candidates/side=vector")
    b = _written(index.lexical_candidates(questions, wide), f"{config.out}/candidates/side=lexical")
    ids = v.select("child_id").unionByName(b.select("child_id")).distinct()
    near = F.broadcast(ids) if ids.count() <= _BROADCAST else ids
    index.chunks = _written(_chunks(_documents(spark, config).join(near, F.col("doc_id") == F.col("child_id"), "left_semi")), f"{config.out}/hit_chunks")  # all that any setting can hit
    asked = questions.select(F.col("query_id").alias("id"), "query", "expected")
    for alpha in map(float, config.alphas):
        for mode in config.modes:
            at, hits = f"alpha={alpha}/mode={mode}", index.hits(search.fused(v, b, alpha), config.top_k)
            if mode == "rerank":
                hits = lexical_rerank(hits, questions).drop("overlap")
            rows = _written(evaluate.hit_rows(_written(hits, f"{config.out}/hits/{at}"), asked), f"{config.out}/rows/{at}")
            told = _written(evaluate.hit_summary(rows, f"{mode}_{alpha}"), f"{config.out}/summaries/{at}").first()
            log.info("%s: hit@1 %.3f, hit@3 %.3f, hit@5 %.3f of %d", at, told.hit1, told.hit3, told.hit5, told.total_queries)
    return n


def output(spark: SparkSession, config: Config) -> DataFrame:
    """alpha, mode, id, hit1, hit3, hit5 and top_score of every question under every setting."""
    d = spark.read.parquet(f"{config.out}/rows")  # settings are partitions
    return d.select(F.col("alpha").cast("double").alias("alpha"), "mode", "id", "hit1", "hit3", "hit5", "top_score")


if __name__ == "__main__":
    common.main("sweep", Config, run, __doc__)
