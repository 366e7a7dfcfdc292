"""Hybrid search of a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gravelake.config import DEFAULT_ALPHA, OVERFETCH
from gravelake.functions import text as X
from gravelake.operators.lexical import LexicalIndex, bm25_topk, path_contains
from gravelake.operators.vector import CellIndex, cosine_topk


def normalised(scored: DataFrame, out: str) -> DataFrame:
    """Scores over the largest of the query's list; a largest of 0 counts as 1. No shift: signs stay as a negative largest makes them."""
    top = F.max("score").over(W.partitionBy("query_id"))
    return scored.withColumn(out, F.col("score") / F.when(top == 0, F.lit(1.0)).otherwise(top)).select("query_id", "child_id", out)


def fused(vector: DataFrame, lexical: DataFrame, alpha: float) -> DataFrame:
    """Full outer join of two candidate lists; a missing side counts 0."""
    both = normalised(vector, "v").join(normalised(lexical, "b"), ["query_id", "child_id"], "full")
    score = F.round(F.lit(alpha) * F.coalesce("v", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("b", F.lit(0.0)), 12)
    return both.select("query_id", "child_id", score.alias("score"))


def best_per_parent(scored: DataFrame) -> DataFrame:
    """The best child of each parent; a missing parent is one of its own. Ties go to the smaller child id."""
    w = W.partitionBy("query_id", X.text_or_empty(F.col("parent_id").cast("string"))).orderBy(F.desc("score"), "child_id")
    return scored.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "child_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


@dataclass
class HybridIndex:
    """chunks carry the metadata of hits; embeddings are (child_id, embedding)."""

    chunks: DataFrame
    lexical: LexicalIndex
    embeddings: DataFrame
    parents: DataFrame | None = None
    cells: CellIndex | None = None

    def vector_candidates(self, queries: DataFrame, k: int, category: str | None = None, path: str | None = None) -> DataFrame:
        """The category is looked at before the k nearest are taken, the path after. The index of cells, if there is
        one, serves searches of all chunks; those of a category compare its vectors exactly."""
        vectors = self.embeddings
        if category is not None:
            vectors = vectors.join(self.chunks.filter(F.col("file_category") == category).select("child_id"), "child_id", "left_semi")
        out = self.cells.topk(queries, k) if self.cells is not None and category is None else cosine_topk(vectors, queries, k)
        if path:
            out = out.join(self.chunks.filter(path_contains(F.col("file_path"), path)).select("child_id"), "child_id", "left_semi")
        return out

    def lexical_candidates(self, queries: DataFrame, k: int, category: str | None = None, path: str | None = None) -> DataFrame:
        """Both filters come before the cut; the statistics are the corpus's."""
        keep = None
        if category is not None or path:
            keep = self.chunks
            keep = keep.filter(F.col("file_category") == category) if category is not None else keep
            keep = keep.filter(path_contains(F.col("file_path"), path)) if path else keep
        return bm25_topk(self.lexical, queries, k, keep)

    def search(
        self, queries: DataFrame, top_k: int = 5, alpha: float = DEFAULT_ALPHA, category: str | None = None, path: str | None = None, rerank: bool = False, fetch: int | None = None, dedup: bool = True
    ) -> DataFrame:
        """queries (query_id, query, embedding) -> hits of each, rank from 1. fetch: hits taken before a rerank cuts them to top_k."""
        from gravelake.operators.rerank import lexical_rerank

        n = max(fetch or top_k, top_k)
        both = fused(self.vector_candidates(queries, OVERFETCH * n, category, path), self.lexical_candidates(queries, OVERFETCH * n, category, path), alpha)
        hits = self.hits(both, n, dedup)
        if rerank:
            hits = lexical_rerank(hits, queries)
        return hits.filter(F.col("rank") <= top_k)

    def hits(self, both: DataFrame, n: int, dedup: bool = True) -> DataFrame:
        """The first n of each query's fused candidates, with their chunks. They are ranked by whole scores, which are then rounded."""
        found = both.join(self.chunks.drop("corpus_ord", "parent_ord", "chunk_ord", "content_hash"), "child_id")
        return ranked(best_per_parent(found) if dedup else found, n).withColumn("score", F.round("score", 6))

    def parent(self, ids: DataFrame) -> DataFrame:
        """Parents by id (parent_id); those that are not found stay with null columns."""
        return ids.join(self.parents, "parent_id", "left")
