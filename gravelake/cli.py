"""Command line: index, search, section; experiments: run, evaluate, gold, feedback, compare, review, matrix, rows."""

from __future__ import annotations

import argparse
import dataclasses
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelake import schemas
from gravelake.config import DEFAULT_ALPHA, ExperimentConfig
from gravelake.engine import Engine
from gravelake.operators import evaluate, render, store
from gravelake.session import session
from gravelake.sources.lists import query_lines, read_list, resolve_named_subset, resolve_subset, yaml_gold, yaml_queries


#: Evaluations and whether they need a file of rules.
_EVALUATIONS = {"evaluate": False, "gold": True, "feedback": True}


def printed(df: DataFrame) -> None:
    """All rows, one after the other, a line a column."""
    for r in df.toLocalIterator():
        print("\n".join(f"{k}: {v}" for k, v in r.asDict().items()), end="\n\n")


def sheet(spark: SparkSession, text: str, path: str) -> None:
    """A text for people, as a folder with one file."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    print(f"written to {path}")


def asked_ids(a: argparse.Namespace) -> list[str] | None:
    return read_list(resolve_subset(a.ids, f"{a.subsets}/queries")) if a.ids else None


def narrowed(cfg: ExperimentConfig, a: argparse.Namespace) -> ExperimentConfig:
    """The experiment with the files of a named subset, and of subsets of either collection, which win."""
    chosen = resolve_named_subset(a.subset, a.subsets) if a.subset else {}
    for kind, given in (("game", a.game_subset), ("wiki", a.wiki_subset)):
        if given:
            chosen[kind] = resolve_subset(given, f"{a.subsets}/{kind}")
    return dataclasses.replace(cfg, **{f"{kind}_files": tuple(read_list(path)) for kind, path in chosen.items()})


def evaluated(engine: Engine, a: argparse.Namespace) -> None:
    """One evaluation of one experiment, from YAML files to stored results."""
    spark, cfg = engine.spark, ExperimentConfig.from_yaml(a.config)
    ids = asked_ids(a)
    how = {"top_k": a.top_k, "rerank": a.rerank, "fetch": a.fetch}
    if a.command == "evaluate":
        summary, rows = engine.evaluate(cfg, yaml_queries(spark, a.queries, ids), **how)
    elif a.command == "gold":
        summary, rows = engine.evaluate_gold(cfg, yaml_queries(spark, a.queries, ids), yaml_gold(spark, a.rules), **how)
    else:
        queries = yaml_queries(spark, a.queries, ids, schemas.FEEDBACK_QUERY)
        summary, rows = engine.evaluate_feedback(cfg, queries, yaml_gold(spark, a.rules, schemas.FEEDBACK_GOLD), **how)
    out = f"{a.results}/{a.command}/{cfg.name}{'_' if a.suffix else ''}{a.suffix}"
    store.write_results(summary, rows, out)
    printed(summary)
    print(f"results in {out}")


def matrix(spark: SparkSession, a: argparse.Namespace) -> str:
    """Rows in the order of the command line."""
    modes = [m.split("=", 1) if "=" in m else (m, m) for m in a.mode]
    lines = []
    for name in a.experiments:
        for suffix, label in modes:
            summary = store.read_results(spark, f"{a.results}/feedback/{name}_{suffix}")[0]
            columns = [F.col(c).cast("double").alias(c) if c in summary.columns else F.lit(None).cast("double").alias(c) for c in ("top1", "top3", "noise_top5_mean", "actionability")]
            lines += [r.line for r in render.matrix_rows(summary.select(F.lit(name).alias("config"), F.lit(label).alias("mode"), *columns)).collect()]
    return "\n".join([*render.MATRIX_HEAD, *lines])


# Names, places and defaults of the options.
def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="gravelake")
    top.add_argument("--store", default="store")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index")
    p.add_argument("game")
    p.add_argument("wiki")
    p = sub.add_parser("search")
    p.add_argument("text", nargs="*")
    p.add_argument("--queries")
    p.add_argument("--index", choices=("game", "wiki", "both"), default="both")
    p.add_argument("--top-k", type=int, default=3)
    p.add_argument("--alpha", type=float, default=DEFAULT_ALPHA)
    p.add_argument("--category")
    p.add_argument("--instruct", action="store_true")
    p.add_argument("--compare", action="store_true", help="search without and with the query instruction")
    p.add_argument("--show-content", action="store_true")
    p.add_argument("--content-limit", type=int, default=1200)
    p = sub.add_parser("section")
    p.add_argument("parent_id")
    top.add_argument("--subsets", default="subsets", help="folder of the lists game/<name>.txt, wiki/<name>.txt and queries/<name>.txt")
    p = sub.add_parser("run", help="index what an experiment file names")
    p.add_argument("config")
    p.add_argument("--subset", help="a name that is in game or wiki, or in both")
    p.add_argument("--game-subset", help="a name or a file")
    p.add_argument("--wiki-subset", help="a name or a file")
    for folder in ("game", "mod", "wiki"):
        p.add_argument(folder)
    for name, gold in _EVALUATIONS.items():
        p = sub.add_parser(name, help=f"evaluate an experiment: rows and summary go to <results>/{name}")
        p.add_argument("config")
        p.add_argument("queries")
        if gold:
            p.add_argument("rules")
        p.add_argument("--ids", help="a subset of queries, or a file of their ids, one a line")
        p.add_argument("--suffix", default="", help="added to the name of the results")
        p.add_argument("--results", default="results")
        p.add_argument("--top-k", type=int, default=5)
        p.add_argument("--rerank", action="store_true")
        p.add_argument("--fetch", type=int)
    p = sub.add_parser("rows", help="the rows of an evaluation, one after the other")
    p.add_argument("results")
    p = sub.add_parser("review", help="the hits of queries on a sheet for people")
    p.add_argument("config")
    p.add_argument("queries")
    p.add_argument("--ids", help="a subset of queries, or a file of their ids, one a line")
    p.add_argument("--results", default="results")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--rerank", action="store_true")
    p = sub.add_parser("matrix", help="the feedback results of several experiments and modes on one sheet")
    p.add_argument("experiments", nargs="+")
    p.add_argument("--mode", action="append", required=True, metavar="SUFFIX=LABEL", help="a suffix of results and its name on the sheet; once for each mode")
    p.add_argument("--results", default="results")
    p = sub.add_parser("compare")
    p.add_argument("a")
    p.add_argument("b")
    a = top.parse_args(argv)
    spark = session()
    engine = Engine(spark, a.store)
    if a.command == "index":
        print(engine.build_all(a.game, a.wiki))
    elif a.command == "section":
        print(engine.get_section(a.parent_id))
    elif a.command == "run":
        print(engine.build_experiment(narrowed(ExperimentConfig.from_yaml(a.config), a), a.game, a.mod, a.wiki))
    elif a.command in _EVALUATIONS:
        evaluated(engine, a)
    elif a.command == "rows":
        printed(store.read_results(spark, a.results)[1].orderBy("id"))
    elif a.command == "review":
        cfg, subset = ExperimentConfig.from_yaml(a.config), a.ids or "all"
        text = engine.review(cfg, yaml_queries(spark, a.queries, asked_ids(a)), subset, a.top_k, a.rerank)
        sheet(spark, text, f"{a.results}/review/{cfg.name}/manual_review_{PurePath(subset).stem}")
    elif a.command == "matrix":
        sheet(spark, matrix(spark, a), f"{a.results}/feedback_suite_matrix")
    elif a.command == "compare":
        (sa, qa), (sb, qb) = store.read_results(spark, a.a), store.read_results(spark, a.b)
        printed(evaluate.metric_deltas(sa, sb).orderBy("metric"))
        both = evaluate.compared_queries(qa, qb)
        printed(both.orderBy("id"))
        printed(evaluate.better_lists(both))
    else:
        queries = [(f"q{i:04d}", q) for i, q in enumerate(query_lines(a.queries, a.text))]
        for on in (False, True) if a.compare else (a.instruct,):
            engine.settings = dataclasses.replace(engine.settings, query_instruction_enabled=on)
            for collection in ("game", "wiki") if a.index == "both" else (a.index,):
                hits = engine.search(collection, queries, a.top_k, a.category if collection == "game" else None, alpha=a.alpha)
                if a.show_content:
                    hits = hits.join(engine.index(collection).parents.select("parent_id", "content"), "parent_id", "left")
                lines = hits.select("query_id", "rank", render.cli_line().alias("line"), *([render.preview("content", a.content_limit).alias("body")] if a.show_content else []))
                print(f"== {collection}, instruction {'on' if on else 'off'}")
                for r in lines.orderBy("query_id", "rank").collect():
                    print(f"{dict(queries)[r.query_id]}\n{r.line}" if r["rank"] == 1 else r.line)
                    if a.show_content:
                        print(r.body)


if __name__ == "__main__":
    main()
