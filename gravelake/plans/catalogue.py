"""Registered queries of the engine and their DuckDB SQL.

The test tables stand in for an indexed collection: a document is a chunk, its source its parent and category,
`data/<source>/<lang>/<doc_id>` its path and its language its block name. The benchmark items are the queries,
an item's vector is the embedding of the same number, and its leading words are what a right hit must contain.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelake.functions import text as X
from gravelake.operators import chunk, embed, evaluate, order, parse, render, reports, rerank, search, store
from gravelake.operators.lexical import CHUNKS, LexicalIndex, bm25_scores, bm25_topk, build_index, entries, path_contains, write_entries
from gravelake.operators.vector import CellIndex, cosine_topk
from gravelake.plans.oracles import ORACLES
from gravelake.session import shared_dir
from gravelake.sources import files

__all__ = ["ORACLES", "QUERIES"]

CATEGORY, PATH, K = "src0", "/en/", 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    path = F.concat(F.lit("data/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return d.select(
        F.col("doc_id").alias("child_id"), "text", F.col("source").alias("parent_id"), F.lit("game_file").alias("source_type"), path.alias("file_path"),
        F.col("source").alias("file_category"), F.col("lang").alias("block_name"), F.lit(None).cast("string").alias("section_title"), F.col("doc_id").alias("corpus_ord"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of documents; some documents have none."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("child_id"), "embedding")
    return e.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("child_id")), "child_id", "left_semi")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return b.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def fresh_index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    return build_index(chunks(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The stored index of the tables, built by the first query of an application that asks for it."""
    return LexicalIndex.load(spark, _built(spark, sf_dir, "lexical", lambda path: fresh_index(spark, sf_dir).save(path)))


_paths: dict[tuple[str, str, str], str] = {}
_lock = threading.Lock()


def _built(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[str], None]) -> str:
    """Folder of something that this application builds once of the tables; each build has a folder of its own."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    with _lock:
        if key not in _paths:
            path = f"{shared_dir(spark)}/{key[0]}/{kind}-{uuid.uuid4().hex}"
            build(path)
            _paths[key] = path
        return _paths[key]


def hybrid(spark: SparkSession, sf_dir: str) -> search.HybridIndex:
    return search.HybridIndex(chunks(spark, sf_dir), index(spark, sf_dir), vectors(spark, sf_dir))


def hits(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return hybrid(spark, sf_dir).search(asked(spark, sf_dir), **how)


_BRIEF = ("query_id", "rank", "child_id", "score")


def rounded(d: DataFrame) -> DataFrame:
    """For output: ranks come from whole scores."""
    return d.withColumn("score", F.round("score", 6))


def _words(n: int, column: str = "query"):
    return F.slice(F.filter(F.split(column, " "), lambda w: w != ""), 1, n)


def eval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select(F.col("query_id").alias("id"), "query", F.array(F.array_join(_words(4), " ")).alias("expected"))


def gold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("/EN/"), F.lit("\\fr\\"))).otherwise(F.array().cast("array<string>"))
    return asked(spark, sf_dir).select(F.col("query_id").alias("id"), needles.alias("file_path_contains"), _words(2).alias("must_contain_all"))


def feedback_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("query_id")
    return asked(spark, sf_dir).select(
        i.alias("id"), (i % 5 != 4).alias("scorable"), F.lit(None).cast("string").alias("note"),
        F.when(i % 3 == 0, F.array(F.lit("/en/"))).alias("acceptable_path_substrings"), F.when(i % 4 == 1, F.array(F.lit("/DE/"))).alias("top1_path_substrings"),
        F.when(i % 4 == 2, _words(1)).alias("top1_text_must_contain_all"), F.when(i % 4 == 3, _words(2)).alias("top1_text_must_contain_any"),
        F.when(i % 2 == 1, F.slice(_words(2), 2, 1)).alias("top3_text_must_contain_any"), (i % 7 == 3).alias("false_positive_guard"), (i % 6 == 5).alias("skip_noise"),
    )


# Lexical


def corpus_stats(spark, d):
    i = fresh_index(spark, d)
    return i.stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf"))


def lexical_build(spark, d):
    """What the stored index holds; the first query of an application that needs the index builds it."""
    i = index(spark, d)
    word, chunk = F.col("bucket") > CHUNKS, F.col("bucket") == CHUNKS
    own = i.entries.agg(F.count_if(word).alias("n_postings"), F.sum(F.when(word, F.col("tf"))).alias("n_words"), F.count_if(chunk).alias("n_docs"), F.sum(F.when(chunk, F.col("dl"))).alias("sum_dl"))
    return own.join(i.terms.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("sum_df")))  # one row each


def term_df(spark, d):
    return fresh_index(spark, d).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def term_idf(spark, d):
    return fresh_index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_postings(spark, d):
    return fresh_index(spark, d).postings


def bm25_all(spark, d):
    return rounded(bm25_scores(index(spark, d), asked(spark, d)))


def bm25_top(spark, d):
    return rounded(bm25_topk(index(spark, d), asked(spark, d), K))


def bm25_topk_category(spark, d):
    return rounded(bm25_topk(index(spark, d), asked(spark, d), K, chunks(spark, d).filter(F.col("file_category") == CATEGORY)))


def bm25_topk_path(spark, d):
    return rounded(bm25_topk(index(spark, d), asked(spark, d), K, chunks(spark, d).filter(path_contains(F.col("file_path"), PATH))))


def bm25_zero_fill(spark, d):
    """Queries of one unusual word each: most have fewer than k matches."""
    q = asked(spark, d).select("query_id", F.element_at(X.tokens("query"), 1).alias("query")).withColumn("query", F.concat("query", F.lit("~")))
    return rounded(bm25_topk(index(spark, d), q, K))


def bm25_segments(spark, d):
    """The index written in three segments; the last one brings every fourth document of the first two again."""

    def build(path: str) -> None:
        c = chunks(spark, d).select("child_id", "text", "corpus_ord")
        again = F.col("child_id") % 4 == 0
        write_entries(entries(c.filter("child_id % 2 = 0").withColumn("text", F.when(again, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))), path, 0)
        write_entries(entries(c.filter("child_id % 2 = 1")), path, 1)
        write_entries(entries(c.filter(again)), path, 2, c.filter(again))

    return rounded(bm25_topk(LexicalIndex.load(spark, _built(spark, d, "segments", build)), asked(spark, d), K))


# Vector


def _vector(spark, d, **how):
    return rounded(hybrid(spark, d).vector_candidates(asked(spark, d).filter("embedding IS NOT NULL"), K, **how)).select(*_BRIEF)


def cosine_top(spark, d):
    return rounded(cosine_topk(vectors(spark, d), asked(spark, d), K)).select(*_BRIEF)


def cosine_topk_category(spark, d):
    return _vector(spark, d, category=CATEGORY)


def cosine_topk_path_post(spark, d):
    return _vector(spark, d, path=PATH)


def cells(spark, d) -> CellIndex:
    """The stored index of cells, built by the first query of an application that asks for it."""
    return CellIndex.load(spark, _built(spark, d, "cells", lambda path: CellIndex.fit(vectors(spark, d), K).save(path)))


def cosine_cells(spark, d):
    return rounded(cells(spark, d).topk(asked(spark, d).filter("embedding IS NOT NULL"), K)).select(*_BRIEF)


def cosine_cells_recall(spark, d):
    """Whether the index of cells finds nine tenths of the nearest vectors of all vectors with an id divisible by 50."""
    q = vectors(spark, d).filter("child_id % 50 = 0").withColumnRenamed("child_id", "query_id")
    exact, found = cosine_topk(vectors(spark, d), q, K), cells(spark, d).topk(q, K)
    both = exact.join(found.select("query_id", "child_id", F.lit(1).alias("hit")), ["query_id", "child_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_nearest"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


# Search


def hybrid_topk(spark, d):
    return hits(spark, d).select(*_BRIEF, "parent_id", "file_path")


def hybrid_exact(spark, d):
    return hits(spark, d, alpha=0.1).select(*_BRIEF)


def hybrid_filtered(spark, d):
    return hits(spark, d, category=CATEGORY, path=PATH).select(*_BRIEF)


def hybrid_no_dedup(spark, d):
    return hits(spark, d, dedup=False).select(*_BRIEF)


def lexical_rerank(spark, d):
    return hits(spark, d, rerank=True).select(*_BRIEF, "overlap")


def overfetch_rerank(spark, d):
    return hits(spark, d, rerank=True, top_k=3, fetch=8).select(*_BRIEF)


def gold_rerank(spark, d):
    h = hits(spark, d)
    return rerank.gold_rerank(h, gold_rules(spark, d)).select(*_BRIEF, "path_ok", "token_hits")


def pair_rerank(spark, d):
    return rerank.pair_rerank(hits(spark, d), asked(spark, d)).select(*_BRIEF, F.round("rerank_score", 6).alias("rerank_score"))


def query_terms(spark, d):
    return asked(spark, d).select("query_id", F.explode(X.query_terms("query")).alias("term"))


# Evaluation


def eval_hit_at_k(spark, d):
    return evaluate.hit_rows(hits(spark, d), eval_queries(spark, d))


def eval_summary(spark, d):
    return evaluate.hit_summary(eval_hit_at_k(spark, d), "base")


def gold_strict_soft(spark, d):
    return evaluate.gold_rows(hits(spark, d), eval_queries(spark, d), gold_rules(spark, d))


def gold_summary(spark, d):
    return evaluate.gold_summary(gold_strict_soft(spark, d), "base")


def feedback_metrics(spark, d):
    return evaluate.feedback_rows(hits(spark, d), eval_queries(spark, d), feedback_gold(spark, d), guarded="the")


def feedback_summary(spark, d):
    return evaluate.feedback_summary(feedback_metrics(spark, d), "base")


def _exact_rows(spark, d):
    return evaluate.hit_rows(hits(spark, d, alpha=0.1), eval_queries(spark, d))


def grade_compare(spark, d):
    return evaluate.compared_queries(eval_hit_at_k(spark, d), _exact_rows(spark, d)).drop("query")


def compare_lists(spark, d):
    return evaluate.better_lists(evaluate.compared_queries(eval_hit_at_k(spark, d), _exact_rows(spark, d)))


def metric_deltas(spark, d):
    return evaluate.metric_deltas(eval_summary(spark, d), evaluate.hit_summary(_exact_rows(spark, d), "exact"))


def query_id_union(spark, d):
    a, b = eval_queries(spark, d).select("id"), read(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return a.union(b).distinct()


# Parsing and chunking


def _markdown(spark, d):
    """Pages with headings written as Markdown."""
    h = F.regexp_replace(F.regexp_replace("html", "<h([1-6])[^>]*>", "\n## "), "</h[1-6]>", "\n")
    h = F.regexp_replace(F.regexp_replace(h, "</?(p|div|li|article|nav|ul)[^>]*>", "\n"), "<[^>]*>", "")
    return read(spark, d, "pages").select("page_id", F.concat(F.lit("data/wiki/page_"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), h.alias("text"))


def wiki_parents(spark, d):
    files = _markdown(spark, d).select("path", F.col("path").alias("rel_path"), F.encode("text", "UTF-8").alias("content"))
    return parse.wiki_parents(files).select("parent_id", "section_title", "file_path", "ord", F.md5(F.col("content").cast("binary")).alias("digest"))


def script_parents(spark, d):
    files = _scripts(spark, d).select("path", F.col("path").alias("rel_path"), F.encode("text", "UTF-8").alias("content"))
    return parse.script_parents(files).select("parent_id", "block_name", "file_category", "source_type", F.md5(F.col("content").cast("binary")).alias("digest"))


def scan_scripts(spark, d):
    """Documents written as script files in a folder a source, found and decoded again."""

    def write(path: str) -> None:
        read(spark, d, "documents").select("source", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source").text(f"{path}/common")

    found = files.scan_scripts(spark, _built(spark, d, "scripts", write), ("common", "events"))
    text = files.decode_script("content")
    told = found.select(X.category_of("rel_path").alias("category"), F.length(text).cast("long").alias("n"), F.regexp_count(text, F.lit("\n")).cast("long").alias("lines"))
    return told.groupBy("category").agg(F.sum("n").alias("n_chars"), F.sum("lines").alias("n_lines"))


def corpus_order(spark, d):
    """A running index over all documents by source, language and id."""

    def write(path: str) -> None:
        order.placed(read(spark, d, "documents").select("source", "lang", "doc_id"), "source", "lang", "doc_id").write.parquet(f"{path}/documents")

    return order.indexed(spark.read.parquet(f"{_built(spark, d, 'order', write)}/documents"), "corpus_ord").select("doc_id", "corpus_ord")


def section_split(spark, d):
    return parse.split_sections(_markdown(spark, d)).select("page_id", "section_title", F.length("section").alias("n_chars"), F.md5(F.col("section").cast("binary")).alias("digest"))


def dup_name_suffix(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id")
    return parse.numbered_names(e, "user_id", "event_type", "event_id").select("event_id", F.concat("event_type", F.when(F.col("seen") > 0, F.concat(F.lit("#"), F.col("seen").cast("string"))).otherwise("")).alias("name"))


def category_from_path(spark, d):
    p = F.concat(F.when(F.col("child_id") % 3 == 0, F.lit("common\\")).otherwise(""), F.when(F.col("child_id") % 2 == 0, F.concat("parent_id", F.lit("/"))).otherwise(""), F.col("child_id").cast("string"), F.lit(".txt"))
    return chunks(spark, d).select("child_id", p.alias("p")).select("child_id", X.category_of("p").alias("category"))


def word_window_chunks(spark, d):
    c = chunks(spark, d).select("child_id", "text")
    return chunk.word_windows(c, "text", 64, 48).select("child_id", "chunk_ord", F.md5(F.col("chunk").cast("binary")).alias("digest"))


def greedy_pack_lines(spark, d):
    return chunk.greedy_lines(chunks(spark, d).select("child_id", "text"), "text", 40).drop("text")


def sentence_chunks(spark, d):
    p = chunks(spark, d).select(F.col("child_id").cast("string").alias("parent_id"), "block_name", "section_title", F.col("text").alias("content"), "file_path", "file_category", F.lit("wiki").alias("source_type"))
    return chunk.chunk_parents(p, "ast", 128, 16).select("child_id", F.length("text").alias("n_chars"), "content_hash")


def _scripts(spark, d):
    """Script files written from the tables: a block a nation, holding its customers."""
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.format_string("\tcustomer = { key = %d name = \"%s\" }", F.col("c_custkey"), F.col("c_name")).alias("line"))
    body = c.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("body"))
    n = read(spark, d, "nation").join(body, F.col("k") == F.col("n_nationkey"), "left")
    text = F.concat(F.lit("# made\nnamespace = x\nnation "), "n_name", F.lit(" = {\n"), F.coalesce("body", F.lit("")), F.lit("\n}\nlost =\n{ }\n"))
    return n.select(F.concat(F.lit("common/nations/"), "n_name", F.lit(".txt")).alias("path"), text.alias("text"))


def script_blocks(spark, d):
    return parse.script_blocks(_scripts(spark, d)).select("path", "ord", "name", F.md5(F.col("block").cast("binary")).alias("digest"))


def script_chunks(spark, d):
    b = parse.script_blocks(_scripts(spark, d))
    p = b.select(F.concat("path", F.lit("::"), "name").alias("parent_id"), F.col("name").alias("block_name"), F.lit(None).cast("string").alias("section_title"), F.col("block").alias("content"),
                 F.col("path").alias("file_path"), F.lit("nations").alias("file_category"), F.lit("game_file").alias("source_type"))
    return chunk.chunk_parents(p, "ast", 64).select("child_id", "text")


def embed_hash(spark, d):
    return embed.embedded(chunks(spark, d).select("child_id", "text"), "text").select("child_id", "embedding")


def instruct_queries(spark, d):
    return asked(spark, d).select("query_id", F.md5(embed.instructed(F.col("query"), " Find passages. ").cast("binary")).alias("digest"))


# Store


def pending_anti_join(spark, d):
    return store.pending(chunks(spark, d).select("child_id"), vectors(spark, d).select("child_id"))


def parent_last_wins(spark, d):
    return store.last_wins(chunks(spark, d).select("parent_id", "child_id", "file_path"), "parent_id", "child_id")


def keyed_upsert(spark, d):
    new = read(spark, d, "embeddings").select(F.col("vec_id").alias("child_id"), F.lit("new").alias("file_path"))
    return store.upsert(chunks(spark, d).select("child_id", "file_path"), new, "child_id")


# Reports and rendering


def _reports(spark, d):
    """Events as reports: their type as severity, the user as file."""
    sev = F.create_map(*[F.lit(x) for x in ("click", "tips", "view", "untidy", "signup", "Warning", "purchase", "error", "error", "FATAL")])
    return read(spark, d, "events").select(
        sev[F.col("event_type")].alias("severity"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), (F.col("event_id") % 4).alias("line"), F.col("event_type").alias("key"),
        F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("m"), F.col("event_id").cast("string"))).alias("msg"), F.when(F.col("event_id") % 2 == 0, F.lit("second")).alias("message"),
        F.lit(None).cast("string").alias("text"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("record"),
    )


def severity_report(spark, d):
    return reports.by_severity(reports.at_least(_reports(spark, d)))


def severity_lines(spark, d):
    return reports.report_lines(reports.at_least(_reports(spark, d), "error"))


def json_props(spark, d):
    e = read(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", F.explode("m").alias("key", "value"))


def render_answers(spark, d):
    return render.answers(hits(spark, d), asked(spark, d)).select("query_id", F.md5(F.col("answer").cast("binary")).alias("digest"))


def render_cli(spark, d):
    return hits(spark, d).select("query_id", "rank", render.cli_line().alias("line"))


def review_blocks(spark, d):
    return render.review_blocks(hits(spark, d)).select("query_id", "rank", F.md5(F.col("block").cast("binary")).alias("digest"))


def snippets(spark, d):
    return chunks(spark, d).select("child_id", X.snippet("text").alias("snippet"))


def feedback_matrix(spark, d):
    s = feedback_summary(spark, d).drop("experiment")
    modes = spark.range(8).select(F.format_string("profile_%d", F.col("id")).alias("config")).join(spark.range(3).select(F.format_string("mode_%d", F.col("id")).alias("mode")))  # a few rows by a few
    return render.matrix_rows(modes.join(F.broadcast(s)))


def actionable_hits(spark, d):
    return hits(spark, d).select("query_id", "rank", evaluate.actionable().alias("actionable"))


def collection_of_id(spark, d):
    p = F.concat(F.when(F.col("child_id") % 2 == 0, F.lit("data\\wiki\\")).otherwise("game/"), F.when(F.col("child_id") % 5 == 0, F.lit("wiki_")).otherwise(""), F.col("child_id").cast("string"), F.lit("::wiki"))
    return chunks(spark, d).select("child_id", F.when(X.is_wiki(p), "wiki").otherwise("game").alias("collection"))


QUERIES = {
    f.__name__: f
    for f in (
        lexical_build, corpus_stats, term_df, term_idf, bm25_postings, bm25_all, bm25_topk_category, bm25_topk_path, bm25_zero_fill, bm25_segments, cosine_topk_category, cosine_topk_path_post, cosine_cells, cosine_cells_recall, hybrid_topk, hybrid_exact,
        hybrid_filtered, hybrid_no_dedup, lexical_rerank, overfetch_rerank, gold_rerank, pair_rerank, query_terms, eval_hit_at_k, eval_summary, gold_strict_soft, gold_summary, feedback_metrics,
        feedback_summary, grade_compare, compare_lists, metric_deltas, query_id_union, section_split, wiki_parents, script_parents, scan_scripts, corpus_order, dup_name_suffix, category_from_path, word_window_chunks, greedy_pack_lines, sentence_chunks,
        script_blocks, script_chunks, embed_hash, instruct_queries, pending_anti_join, parent_last_wins, keyed_upsert, severity_report, severity_lines, json_props, render_answers, render_cli,
        review_blocks, snippets, feedback_matrix, actionable_hits, collection_of_id,
    )
} | {"bm25_topk": bm25_top, "cosine_topk": cosine_top}
