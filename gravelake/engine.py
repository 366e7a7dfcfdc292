"""The service: search of both collections, sections, reports, index builds and evaluations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelake.config import DEFAULT_ALPHA, EXACT_ALPHA, ExperimentConfig, Settings
from gravelake.functions.script import SubwordCount, token_count
from gravelake.operators import evaluate as E
from gravelake.operators import render, reports, store
from gravelake.operators.chunk import chunk_parents
from gravelake.operators.embed import Embedder, embedded, instructed
from gravelake.operators.parse import script_parents, wiki_parents
from gravelake.operators.rerank import PairScorer, pair_rerank
from gravelake.operators.search import HybridIndex
from gravelake.operators.tables import exists
from gravelake.sources.files import scan_experiment, scan_scripts, scan_wiki


@dataclass
class Engine:
    spark: SparkSession
    path: str
    embedder: Embedder | None = None
    settings: Settings = field(default_factory=Settings.from_env)
    _open: dict[str, HybridIndex] = field(default_factory=dict)

    def build(self, collection: str, parents: DataFrame, strategy: str | None = None, size: int | None = None, overlap: int | None = None) -> dict[str, int]:
        s = self.settings
        count = SubwordCount.load(self.spark, s.vocabulary) if s.vocabulary else token_count
        chunks = chunk_parents(parents, strategy or s.strategy, size or s.chunk_size, s.chunk_overlap if overlap is None else overlap, count)
        self._open.pop(collection, None)
        return store.build_store(parents, chunks, f"{self.path}/{collection}", self.embedder)

    def build_all(self, game: str, wiki: str) -> dict[str, dict[str, int]]:
        return {"game": self.build("game", script_parents(scan_scripts(self.spark, game))), "wiki": self.build("wiki", wiki_parents(scan_wiki(self.spark, wiki)))}

    def build_experiment(self, cfg: ExperimentConfig, game: str, mod: str, wiki: str) -> dict[str, dict[str, int]]:
        how = (cfg.chunking_strategy, cfg.chunk_size, cfg.chunk_overlap)
        return {
            "game": self.build(cfg.collection("game"), script_parents(scan_experiment(self.spark, cfg, game, mod)), *how),
            "wiki": self.build(cfg.collection("wiki"), wiki_parents(scan_wiki(self.spark, wiki, cfg.wiki_files)), *how),
        }

    def index(self, collection: str) -> HybridIndex:
        if collection not in self._open:
            self._open[collection] = store.open_store(self.spark, f"{self.path}/{collection}")
        return self._open[collection]

    def queries(self, texts: list[tuple[str, str]] | DataFrame, collection: str = "game") -> DataFrame:
        """(query_id, query) with embeddings; the instruction, one for each kind of collection, is only seen by the embedder."""
        q = texts if isinstance(texts, DataFrame) else self.spark.createDataFrame(texts, "query_id string, query string")
        q = q.withColumn("__e", instructed(F.col("query"), self.settings.query_instruction_wiki if collection.endswith("wiki") else self.settings.query_instruction_game, self.settings.query_instruction_enabled))
        return embedded(q, "__e", self.embedder).drop("__e")

    def search(self, collection: str, texts, top_k: int = 5, category: str | None = None, path_prefix: str | None = None, exact: bool = False, alpha: float | None = None,
               rerank: bool = False, scorer: PairScorer | None = None, fetch: int | None = None) -> DataFrame:
        q = self.queries(texts, collection)
        a = EXACT_ALPHA if exact else DEFAULT_ALPHA if alpha is None else alpha
        if scorer is None:
            return self.index(collection).search(q, top_k, a, category, path_prefix, rerank, fetch)
        wide = self.index(collection).search(q, max(fetch or top_k, top_k), a, category, path_prefix, rerank)
        return pair_rerank(wide, q, scorer).filter(F.col("rank") <= top_k)

    def search_wiki(self, query: str, top_k: int = 5) -> str:
        return self._answer("wiki", query, top_k)

    def search_game_files(self, query: str, top_k: int = 5, category: str | None = None, path_prefix: str | None = None, exact: bool = False) -> str:
        return self._answer("game", query, top_k, category=category or None, path_prefix=path_prefix or None, exact=exact)

    def _answer(self, collection: str, query: str, top_k: int, **how) -> str:
        asked = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        return render.answers(self.search(collection, asked, top_k, **how), asked).first().answer

    def get_section(self, parent_id: str, collection: str = "auto") -> str:
        if collection == "auto":
            from pathlib import PurePosixPath

            p = parent_id.replace("\\", "/")
            collection = "wiki" if "data/wiki" in p or "wiki" in str(PurePosixPath(parent_id.split("::")[0])) else "game"
        row = self.index(collection).parents.filter(F.col("parent_id") == parent_id).first()
        return f"Not found: {parent_id!r}" if row is None else render.section(row)

    def validate(self, mod: str, game: str | None = None, min_severity: str = "warning") -> str:
        if not exists(self.spark, mod):
            return f"Error: .mod file not found: {mod}"
        exe, game = self.settings.validator, game or self.settings.game_path
        if not exe or not game:
            return "Error: no validator or game directory is configured."
        got = reports.run_validator(self.spark, [exe, "--json", "--game", game, mod])
        return got if isinstance(got, str) else reports.report_text(got, min_severity)

    def _hits(self, queries: DataFrame, cfg: ExperimentConfig, top_k: int, rerank: bool, scorer: PairScorer | None, fetch: int | None) -> DataFrame:
        """Hits of all queries; those of a collection that is not there have none. Categories differ by query, so each has its own search."""
        out = None
        groups = queries.select("collection", "category").distinct().collect()  # a few filters
        for g in groups:
            name = cfg.collection("game" if g.collection == "game" else "wiki")
            if store.version(self.spark, f"{self.path}/{name}") is None:
                continue
            own = queries.filter((F.col("collection") == g.collection) & F.col("category").eqNullSafe(g.category)).select(F.col("id").alias("query_id"), "query")
            plain = Engine(self.spark, self.path, self.embedder, Settings(), self._open)  # evaluation never instructs
            found = plain.search(name, own, top_k, g.category, alpha=cfg.alpha, rerank=rerank, scorer=scorer, fetch=fetch)
            found = found.drop(*[c for c in ("rerank_score", "overlap") if c in found.columns])
            out = found if out is None else out.unionByName(found)
        if out is None:
            raise FileNotFoundError(f"no index of {cfg.name} in {self.path}")
        return out

    def review(self, cfg: ExperimentConfig, queries: DataFrame, subset: str = "all", top_k: int = 5, rerank: bool = False, scorer: PairScorer | None = None) -> str:
        """The hits of every query on a Markdown sheet, for people to judge."""
        there = [c for c in ("game", "wiki") if store.version(self.spark, f"{self.path}/{cfg.collection(c)}") is not None]
        hits = self._hits(queries, cfg, top_k, rerank, scorer, None) if there else None
        return render.review_sheet(hits, queries, cfg.name, subset, top_k, there)

    def latency(self, collection: str, queries: DataFrame, **how) -> DataFrame:
        """id and latency_ms of each query searched by itself; queries (id, query) are a list to be timed one by one."""
        import time

        rows = []
        for q in queries.select("id", "query").collect():
            began = time.perf_counter()
            self.search(collection, [(q.id, q.query)], **how).collect()
            rows.append((q.id, round((time.perf_counter() - began) * 1000, 1)))
        return self.spark.createDataFrame(rows, "id string, latency_ms double")

    def evaluate(self, cfg: ExperimentConfig, queries: DataFrame, top_k: int = 5, rerank: bool = False, scorer: PairScorer | None = None, fetch: int | None = None) -> tuple[DataFrame, DataFrame]:
        rows = E.hit_rows(self._hits(queries, cfg, top_k, rerank, scorer, fetch), queries)
        return E.hit_summary(rows, cfg.name), rows

    def evaluate_gold(self, cfg: ExperimentConfig, queries: DataFrame, rules: DataFrame, top_k: int = 5, **how) -> tuple[DataFrame, DataFrame]:
        how = {"rerank": False, "scorer": None, "fetch": None} | how
        rows = E.gold_rows(self._hits(queries, cfg, top_k, **how), queries, rules)
        return E.gold_summary(rows, cfg.name), rows

    def evaluate_feedback(self, cfg: ExperimentConfig, queries: DataFrame, gold: DataFrame, top_k: int = 5, **how) -> tuple[DataFrame, DataFrame]:
        how = {"rerank": False, "scorer": None, "fetch": None} | how
        rows = E.feedback_rows(self._hits(queries, cfg, top_k, **how), queries, gold)
        return E.feedback_summary(rows, cfg.name), rows
