"""Rerankers. All reorder the hits that the search has cut to its top."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gravelake.functions import text as X

PairScorer = Callable[[list[tuple[str, str]]], list[float]]


def _reranked(hits: DataFrame, *order) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def lexical_rerank(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """By the query's identifiers found in the hit, then by score. Every hit that a filter lets through earns the
    same filter bonus, so the bonuses order nothing. Queries without identifiers stay as they are."""
    terms = queries.select("query_id", X.query_terms("query").alias("__terms"))
    d = hits.join(terms, "query_id").withColumn("overlap", X.overlap(F.col("__terms"), X.haystack()))
    plain = F.size("__terms") == 0
    return _reranked(d, F.when(plain, F.lit(0)).otherwise(-F.col("overlap")), F.desc("score"), F.col("rank")).drop("__terms")


def gold_rerank(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """A diagnostic: by the path rule, then the number of required words, then score."""
    d = hits.join(rules.select(F.col("id").alias("query_id"), "file_path_contains", "must_contain_all"), "query_id", "left")
    path = X.slashed("file_path", lower=True)
    needles = F.transform("file_path_contains", lambda n: F.lower(F.replace(n, F.lit("\\"), F.lit("/"))))
    d = d.withColumn("path_ok", (X.none_given(F.col("file_path_contains")) | X.any_of(needles, path)).cast("int"))
    d = d.withColumn("token_hits", F.coalesce(X.overlap(F.transform("must_contain_all", F.lower), X.haystack()), F.lit(0)))
    return _reranked(d, F.desc("path_ok"), F.desc("token_hits"), F.desc("score"), "rank").drop("file_path_contains", "must_contain_all")


def word_overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """Share of the query's words that the text has: a stand-in for a cross-encoder."""
    out = []
    for q, t in pairs:
        words = set(q.lower().split())
        out.append(len(words & set(t.lower().split())) / len(words) if words else 0.0)
    return out


def pair_rerank(hits: DataFrame, queries: DataFrame, scorer: PairScorer = word_overlap_scorer) -> DataFrame:
    """By an injectable scorer of (query, text) pairs, equal scores in the order they came; adds rerank_score."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            yield pd.Series(scorer(list(zip(q.fillna(""), t.fillna(""), strict=True))), index=q.index, dtype=float)

    d = hits.join(queries.select("query_id", F.col("query").alias("__q")), "query_id").withColumn("rerank_score", scored("__q", "text"))
    return _reranked(d.drop("__q"), F.desc("rerank_score"), F.col("rank"))
