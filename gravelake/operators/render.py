"""Text for readers: tool answers, command line, review and matrix sheets."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravelake.functions import text as X

#: What readers are told.
NOTHING = "No results found."
TRUNCATED = "\n... [truncated; use --content-limit 0 for full parent text]"
MATRIX_HEAD = ("# Feedback Suite Matrix (A/B)", "", "| Config | Mode | Top1 | Top3 | Noise@5 | Actionability |", "|---|---:|---:|---:|---:|---:|")


def hit_text() -> Column:
    e = X.text_or_empty
    head = F.format_string("[%d] score=%.2f  ", F.col("rank"), F.col("score"))
    wiki = F.concat(F.lit("Wiki · "), e("file_path"), F.lit(" · "), e("section_title"))
    game = F.concat(F.lit("Game · "), e("file_category"), F.lit(" · "), e("block_name"), F.lit("  ("), e("file_path"), F.lit(")"))
    body = F.when(F.col("source_type") == "wiki", wiki).otherwise(game)
    return F.concat(head, body, F.lit("\nparent_id: "), e(F.col("parent_id").cast("string")), F.lit("\n"), e("text"), F.lit("\n"))


def section(row) -> str:
    """A parent under the line that says where it is from; absent parts are empty."""
    told = {k: row[k] or "" for k in ("file_path", "section_title", "file_category", "block_name", "content")}
    head = "Wiki · {file_path} · {section_title}" if row["source_type"] == "wiki" else "Game · {file_category} · {block_name}  ({file_path})"
    return f"{head.format(**told)}\n\n{told['content']}"


def cli_line() -> Column:
    e = X.text_or_empty
    head = F.format_string("  [%d] score=%.4f  ", F.col("rank"), F.col("score"))
    wiki = F.concat(e("file_path"), F.lit("  ::  "), e("section_title"))
    game = F.concat(e("file_category"), F.lit("/"), e("block_name"), F.lit("  ("), e("file_path"), F.lit(")"))
    return F.concat(head, F.when(F.col("source_type") == "wiki", wiki).otherwise(game))


def preview(x: Column | str, limit: int) -> Column:
    """A parent's text, cut with a notice if limit is not 0, every line indented."""
    body = X.text_or_empty(x)
    if limit > 0:
        body = F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit(TRUNCATED))).otherwise(body)
    return F.regexp_replace(body, "(?m)^", "      ")


def answers(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One text a query: its hits in order. A query's hits are at most its top k."""
    own = hits.select("query_id", F.struct("rank", hit_text().alias("t")).alias("h")).groupBy("query_id").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    text = F.rtrim(F.array_join(F.transform("hs", lambda h: h["t"]), "\n"))
    return queries.select("query_id").join(own, "query_id", "left").select("query_id", F.coalesce(F.regexp_replace(text, r"\n+$", ""), F.lit(NOTHING)).alias("answer"))


def review_blocks(hits: DataFrame) -> DataFrame:
    """A Markdown section a hit."""
    title = F.coalesce(F.nullif("block_name", F.lit("")), F.nullif("section_title", F.lit("")), F.lit("-"))
    block = F.concat(
        F.format_string("### Rank %d\n\n- score: `%.4f`\n- file: `", F.col("rank"), F.col("score")), F.coalesce("file_path", F.lit("-")), F.lit("`\n- title: `"), title,
        F.lit("`\n- parent_id: `"), F.coalesce(F.col("parent_id").cast("string"), F.lit("-")), F.lit("`\n\n```text\n"), X.snippet("text"), F.lit("\n```\n"),
    )
    return hits.select("query_id", "rank", block.alias("block"))


def review_sheet(hits: DataFrame | None, queries: DataFrame, name: str, subset: str, top_k: int, there: Collection[str] = ("game", "wiki")) -> str:
    """The whole sheet, for people to read; queries (id, query, collection, category, expected). there: collections that have an index."""
    own: dict = {}
    for r in review_blocks(hits).orderBy("query_id", "rank").collect() if hits is not None else ():
        own.setdefault(r.query_id, []).append(r.block)
    out = [f"# Manual Review - {name}", "", f"- query_subset: `{subset}`", f"- top_k: `{top_k}`", ""]
    for q in queries.orderBy("id").collect():
        out += [f"## {q.id} - {q.query}", "", f"- collection: `{q.collection}`", f"- category: `{q.category or '-'}`", f"- expected: `{', '.join(q.expected or [])}`", ""]
        out += own.get(q.id, ["_No results._", ""]) if q.collection in there else ["_Index not found for this collection._", ""]
    return "\n".join(out)


def percent(c: Column) -> Column:
    return F.format_string("%.0f%%", F.bround(c * 100, 0))


def matrix_rows(summaries: DataFrame) -> DataFrame:
    """summaries (config, mode, top1, top3, noise_top5_mean, actionability) -> Markdown rows; no noise shows as a dash."""
    noise = F.coalesce(percent(F.col("noise_top5_mean")), F.lit("-"))
    cells = [F.col("config"), F.col("mode"), percent(F.col("top1")), percent(F.col("top3")), noise, percent(F.col("actionability"))]
    return summaries.select("config", "mode", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
