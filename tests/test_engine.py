import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gravelake import config, schemas
from gravelake.engine import Engine
from gravelake.functions import text as X
from gravelake.operators import chunk, embed, evaluate, parse, render, rerank, reports, search, store
from gravelake.operators.chunk import chunk_parents
from gravelake.operators.lexical import build_index, bm25_topk
from gravelake.operators.vector import cells_topk, cosine_topk, fit_cells
from gravelake.sources import files, lists


def test_python_white_space(spark):
    every = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    text = " a " + "b".join(every) + " c"
    assert spark.createDataFrame([(text,)], "t string").select(X.tokens("t")).first()[0] == text.lower().split()
    got = spark.createDataFrame([(c + "x" + c,) for c in every], "t string").select(X.stripped("t")).distinct().collect()
    assert [r[0] for r in got] == ["x"]


def test_snippet_and_terms(spark):
    d = spark.createDataFrame([("\n a \n\n b\nc\nd", "Foo_1 ab foo_1 9xyz")], "t string, q string")
    assert d.select(X.snippet("t"), X.query_terms("q")).first() == ("a\nb\nc", ["foo_1", "xyz"])
    assert len(d.select(X.snippet(F.lit("x" * 400))).first()[0]) == 280


@pytest.fixture()
def tree(tmp_path):
    def put(name, data):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())

    put("game/common/traits/a.txt", b"\xef\xbb\xbfbrave = { x = 1 }\r\nbrave = { y = \xff }\r\n")
    put("game/common/b.info", "docs here\n")
    put("game/common/blank.info", " \n")
    put("game/events/e.txt", "namespace = e\ne.1 = { title = \"hunt the fox\" }\n")
    put("game/gui/w/f.gui", "types W { a = { } }\n")
    put("game/events/skip.yml", "x = { }")
    put("wiki/War_guide.md", "intro\n## Title\nbody one\n### Title\nsame\n## \n```\n## in fence\n```\n")
    put("wiki/bom.md", b"\xef\xbb\xbf## First\nx\n## Second\ny")
    put("wiki/sub/no.md", "## Never\n")
    return tmp_path


def test_sources_and_parents(spark, tree):
    g = {r.parent_id: r for r in parse.script_parents(files.scan_scripts(spark, tree / "game")).collect()}
    assert set(g) == {"common/traits/a.txt::brave", "common/traits/a.txt::brave#1", "common/b.info::__file__", "events/e.txt::e.1", "gui/w/f.gui::types W"}
    assert g["common/traits/a.txt::brave#1"].content == "brave = { y = � }" and g["common/traits/a.txt::brave"].file_category == "traits"
    assert g["common/b.info::__file__"].source_type == "game_docs" and g["common/b.info::__file__"].file_category == "common"
    w = {r.parent_id: r for r in parse.wiki_parents(files.scan_wiki(spark, tree / "wiki")).collect()}
    assert "War_guide.md::War guide (intro)" in w and "War_guide.md::Title" in w and "War_guide.md::Title_2" in w and "War_guide.md::in fence" in w
    assert "bom.md::First" not in w and "bom.md::Second" in w and not any("Never" in k for k in w)
    assert files.scan_wiki(spark, tree / "none").count() == 0 and files.scan_scripts(spark, tree / "none").count() == 0


def test_block_table_function(spark):
    parse.register(spark)
    got = spark.sql("SELECT b.* FROM VALUES ('a = { } b = { }') t(x), LATERAL script_blocks(x) b ORDER BY ord").collect()
    assert [(r.ord, r.name) for r in got] == [(0, "a"), (1, "b")]


def test_experiment_paths_and_yaml(spark, tree):
    (tree / "list.txt").write_text("common/b.info # keep\n\n# no\nmissing.txt\n")
    (tree / "x.yaml").write_text("name: x\ndata:\n  game_files_txt: list.txt\n  roots: {vanilla: [events]}\nchunking: {strategy: ast, chunk_size: 99}\nretrieval: {alpha: 0.2}\n")
    cfg = config.ExperimentConfig.from_yaml(tree / "x.yaml")
    assert cfg.game_files == ("common/b.info", "missing.txt") and cfg.chunk_size == 99 and cfg.chunk_overlap == 50 and cfg.alpha == 0.2 and cfg.collection("game") == "exp_x_game" and cfg.common_categories == config.DEFAULT_CATEGORIES
    ends = lambda c: sorted(r.path.rsplit("/", 1)[1] for r in files.scan_experiment(spark, c, tree / "game", tree / "mod").collect())
    assert ends(cfg) == ["b.info"]
    assert ends(config.ExperimentConfig("y", vanilla_roots=("events", "events/skip.yml", "gone"))) == ["e.txt", "skip.yml"]
    (tree / "mod/events").mkdir(parents=True)
    (tree / "mod/events/m.txt").write_text("m.1 = { }")
    both = files.scan_experiment(spark, config.ExperimentConfig("m", vanilla_roots=("events", "events\\e.txt"), mod_roots=("/events/",)), tree / "game", tree / "mod").collect()
    assert sorted(r.rel_path for r in both) == [f"{tree}/mod/events/m.txt", "events/e.txt"]  # every file once
    assert sorted(ends(config.ExperimentConfig("z", common_categories=("traits",), include_gui=True))) == ["a.txt", "e.txt", "f.gui"]


def test_trees_on_any_file_system(spark, tree):
    """The same scans through file: and through a store that only Spark reads."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tree.link./in", f"file://{tree}")
    plain = lambda d: sorted((r.rel_path, bytes(r.content)) for r in d.collect())
    cfg = config.ExperimentConfig("y", vanilla_roots=("events", "events/skip.yml", "gone"))
    for base in (f"file://{tree}", "viewfs://tree/in"):
        assert plain(files.scan_scripts(spark, f"{base}/game/")) == plain(files.scan_scripts(spark, tree / "game"))
        assert plain(files.scan_wiki(spark, f"{base}/wiki", ["bom.md", "gone.md"])) == plain(files.scan_wiki(spark, tree / "wiki", ["bom.md"]))
        assert plain(files.scan_experiment(spark, cfg, f"{base}/game", f"{base}/mod")) == plain(files.scan_experiment(spark, cfg, tree / "game", tree / "mod"))


def test_lists(tmp_path, spark):
    p = tmp_path / "q.txt"
    p.write_text("# c\none # kept\n\n two\n")
    assert lists.read_list(p) == ["one", "two"] and lists.query_lines(p, ["three"]) == ["one # kept", "two", "three"]
    assert sorted(r.item for r in lists.list_table(spark, str(p)).collect()) == ["one", "two"]
    with pytest.raises(ValueError):
        lists.query_lines(None)
    assert lists.resolve_subset("q", tmp_path) == p
    with pytest.raises(FileNotFoundError):
        lists.resolve_subset("gone.txt", tmp_path)
    (tmp_path / "y.yaml").write_text("queries:\n- {id: a, query: x, collection: wiki, expected: [p]}\n- {id: b, query: y, collection: game}\n")
    assert lists.yaml_queries(spark, tmp_path / "y.yaml", ["a"]).first().expected == ["p"]


def test_instructions_by_collection(spark):
    s = config.Settings.from_env({"EMBEDDING_QUERY_INSTRUCTION_WIKI": " Other. ", "EMBEDDING_QUERY_INSTRUCTION_ENABLED": "1"})
    assert s.query_instruction_game == config.INSTRUCTIONS["game"] and s.query_instruction_wiki == "Other."
    seen = lambda c: Engine(spark, "x", settings=s).queries([("1", "fox")], c).first().embedding
    assert seen("game") != seen("wiki")


class _Failing:
    """Embeds until a text that it can't."""

    def __call__(self, texts):
        if any("poison" in t for t in texts):
            raise ValueError("no embedding")
        return embed.HashingEmbedder(4)(texts)


def test_a_broken_build_goes_on(spark, tmp_path):
    c = spark.createDataFrame([(f"c{i}", f"h{i}", "poison" if i == 50 else f"text {i}") for i in range(100)], "child_id string, content_hash string, text string")
    path = str(tmp_path)
    with pytest.raises(Exception):  # noqa: B017
        store.embed_pending(c, path, _Failing())
    done = store.embeddings(spark, path)
    assert 0 < done.count() < 100
    rest = store.pending(c, done, by_content=True)
    n = rest.count()
    assert 0 < n < 100 and store.embed_pending(rest, path, embed.HashingEmbedder(4)) == n
    every = store.embeddings(spark, path)
    assert every.select("child_id").distinct().count() == every.count() == 100
    assert store.pending(c.withColumn("content_hash", F.lit("new")), every, by_content=True).count() == 100


def test_environment():
    assert config.env_bool("A", env={"A": " Yes "}) and not config.env_bool("A", env={"A": "0"}) and config.env_int("A", 3, {"A": " "}) == 3
    assert config.Settings.from_env({"CHUNK_SIZE": "7"}).chunk_size == 7
    with pytest.raises(ValueError):
        embed.HttpEmbedder("http://localhost", "m")


def _chunks(spark, rows):
    return spark.createDataFrame([(i, t, p, "game_file", f"data/{c}/{i}", c, None, None, i) for i, t, p, c in rows], "child_id long, text string, parent_id string, source_type string, file_path string, file_category string, block_name string, section_title string, corpus_ord long")


def test_bm25_fills_with_zero_scores_and_keeps_corpus_statistics(spark):
    c = _chunks(spark, [(0, "a b", "p", "x"), (1, "a a c", "p", "y"), (2, "d", "q", "y"), (3, "d e f g", "q", "x"), (4, "", "q", "x")])
    q = spark.createDataFrame([("q", "c c zzz"), ("none", "nothing")], "query_id string, query string")
    got = {(r.query_id, r["rank"]): (r.child_id, r.score) for r in bm25_topk(build_index(c), q, 3).collect()}
    assert got["q", 1][0] == 1 and got["q", 1][1] > 0 and [got["q", k] for k in (2, 3)] == [(0, 0.0), (2, 0.0)]
    assert [got["none", k] for k in (1, 2, 3)] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    kept = bm25_topk(build_index(c), q, 3, c.filter("file_category = 'y'"))
    assert {r.child_id for r in kept.collect()} == {1, 2} and kept.filter("query_id = 'q' AND rank = 1").first().score == got["q", 1][1]


def test_fusion(spark):
    v = spark.createDataFrame([("q", 1, 0.5), ("q", 2, -0.5), ("n", 1, -0.2), ("n", 2, -0.4)], "query_id string, child_id int, score double")
    b = spark.createDataFrame([("q", 2, 4.0), ("q", 3, 0.0)], "query_id string, child_id int, score double")
    got = {(r.query_id, r.child_id): r.score for r in search.fused(v, b, 0.5).collect()}
    assert got == {("q", 1): 0.5, ("q", 2): 0.0, ("q", 3): 0.0, ("n", 1): 0.5, ("n", 2): 1.0}  # a negative largest turns the order


def test_search_filters_dedup_and_alpha(spark):
    c = _chunks(spark, [(i, f"word{i} common", f"p{i // 2}", "x" if i % 2 else "y") for i in range(12)])
    e = embed.embedded(c.select("child_id", "text"), "text")
    ix = search.HybridIndex(c, build_index(c), e.select("child_id", "embedding"))
    q = embed.embedded(spark.createDataFrame([("q", "word3 common")], "query_id string, query string"), "query")
    hits = ix.search(q, 20).orderBy("rank").collect()
    assert hits[0].child_id == 3 and len({h.parent_id for h in hits}) == len(hits) == 6
    assert {h.file_category for h in ix.search(q, 5, category="y").collect()} == {"y"}
    assert [h.child_id for h in ix.search(q, 5, path="data\\x\\3").collect()] == [3]
    assert ix.search(q, 3, alpha=1.0).count() == 3 and ix.search(q, 2, rerank=True, fetch=5).count() == 2
    assert cells_topk(e.select("child_id", "embedding"), q, 3).filter("rank = 1").first().child_id == 3
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], "child_id int, embedding array<float>")
    assert [r.child_id for r in cosine_topk(zero, spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<float>"), 5).collect()] == [3]


def test_rerank_orders(spark):
    h = spark.createDataFrame([("q", 1, 1, 0.9, "nothing", None, None, "a/x"), ("q", 2, 2, 0.5, "Alpha beta", None, None, "b/y")], "query_id string, rank int, child_id int, score double, text string, block_name string, section_title string, file_path string")
    q = spark.createDataFrame([("q", "alpha beta")], "query_id string, query string")
    first = lambda d: d.filter("rank = 1").first().child_id
    assert first(rerank.lexical_rerank(h, q)) == 2 and first(rerank.pair_rerank(h, q)) == 2
    assert first(rerank.lexical_rerank(h, q.withColumn("query", F.lit("a ?")))) == 1
    rules = spark.createDataFrame([("q", ["A/"], ["zz"])], schemas.GOLD_RULE)
    assert first(rerank.gold_rerank(h, rules)) == 1


def test_evaluation_without_hits_and_rules(spark):
    h = spark.createDataFrame([("a", 1, 1, 0.5, "the gold", None, None, "data/common/x.txt")], "query_id string, rank int, child_id int, score double, text string, block_name string, section_title string, file_path string")
    q = spark.createDataFrame([("a", "q1", ["GOLD"]), ("b", "q2", ["x"])], "id string, query string, expected array<string>")
    rows = evaluate.hit_rows(h, q)
    assert evaluate.hit_summary(rows, "e").first().hit1 == 0.5 and rows.filter("id = 'b'").first().top_result == ""
    rules = spark.createDataFrame([("a", [], ["gold", "missing"])], schemas.GOLD_RULE)
    g = evaluate.gold_rows(h, q, rules).collect()
    assert len(g) == 1 and g[0].soft_hit1 and not g[0].strict_hit1
    gold = spark.createDataFrame([("a", True, None, None, None, None, None, None, True, None)], schemas.FEEDBACK_GOLD)
    fb = {r.id: r for r in evaluate.feedback_rows(h, q, gold, "the").collect()}
    assert fb["a"].false_positive_pass is False and fb["a"].noise_top5 is None and fb["b"].scorable and fb["b"].noise_top5 == 0.0 and not fb["b"].top1_correct
    assert evaluate.feedback_summary(evaluate.feedback_rows(h, q, gold, "the"), "e").first().noise_top5_mean == 0.0


def test_reports(spark):
    j = json.dumps([{"severity": "Error", "file": "b", "line": 3, "key": "k", "msg": "m"}, {"severity": "fatal", "file": "a", "line": 0, "message": "n"}, {"file": "c", "text": "t"}])
    r = reports.parse_reports(spark.createDataFrame([(j,)], "j string"), "j")
    assert reports.report_text(r, "error") == "FATAL (1):\n  [] a: n\n\nERROR (1):\n  [k] b:3: m"
    assert reports.at_least(r, "tips").count() == 3 and reports.at_least(r, "what").count() == 2
    assert reports.report_text(r.limit(0)) == "No issues at severity >= warning."
    with pytest.raises(Exception, match="unknown severity"):
        reports.at_least(r.withColumn("severity", F.lit("odd"))).collect()
    assert "not found" in reports.run_validator(spark, ["/no/such"])


def test_build_resume_and_serve(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), settings=config.Settings())
    n = e.build_all(str(tree / "game"), str(tree / "wiki"))
    assert n["game"]["pending"] == n["game"]["chunks"] == 5
    assert e.build_all(str(tree / "game"), str(tree / "wiki"))["game"]["pending"] == 0
    assert "e.1" in e.search_game_files("hunt the fox", top_k=1) and e.search_wiki("body one", 1).startswith("[1] score=")
    assert e.get_section("events/e.txt::e.1") == 'Game · events · e.1  (events/e.txt)\n\ne.1 = { title = "hunt the fox" }' and e.get_section("x::y") == "Not found: 'x::y'"
    assert e.get_section("War_guide.md::Title", "wiki") == "Wiki · War_guide.md · Title\n\n## Title\nbody one"
    assert e.validate(str(tmp_path / "no.mod")) == f"Error: .mod file not found: {tmp_path / 'no.mod'}"
    (tmp_path / "a.mod").write_text("name = a")
    assert e.validate(str(tmp_path / "a.mod")).startswith("Error: no validator")
    cfg = config.ExperimentConfig("t", common_categories=("traits",), chunking_strategy="ast")
    e.build_experiment(cfg, str(tree / "game"), str(tree / "mod"), str(tree / "wiki"))
    q = spark.createDataFrame([("1", "fox", "game", None, ["hunt"]), ("2", "title", "wiki", None, ["body"])], schemas.EVAL_QUERY)
    summary, rows = e.evaluate(cfg, q)
    assert summary.first().total_queries == 2 and rows.filter("hit5").count() == 2
    assert e.latency("game", q.limit(1), top_k=1).first().latency_ms > 0
    store.write_results(summary, rows, tmp_path / "r")
    a, b = store.read_results(spark, tmp_path / "r")
    assert b.count() == 2 and evaluate.metric_deltas(a, a).filter("delta <> 0").count() == 0
    with pytest.raises(FileNotFoundError):
        store.read_results(spark, tmp_path / "none")


def test_experiment_commands(spark, tree, tmp_path, capsys, monkeypatch):
    from gravelake import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    at = lambda n: str(tmp_path / n)
    (tmp_path / "x.yaml").write_text("name: x\ndata: {common_categories: [traits]}\nchunking: {strategy: ast}\n")
    (tmp_path / "q.yaml").write_text("queries:\n- {id: a, query: fox, collection: game, expected: [hunt]}\n- {id: b, query: title, collection: wiki, expected: [body]}\n")
    (tmp_path / "g.yaml").write_text("gold:\n  a: {file_path_contains: [events], must_contain_all: [fox]}\n")
    (tmp_path / "f.yaml").write_text("rules:\n- {id: a, scorable: true, acceptable_path_substrings: [events]}\n- {id: b, scorable: false}\n")
    (tmp_path / "ids.txt").write_text("a\n")
    run = lambda *a: cli.main(["--store", at("store"), *a])
    run("run", at("x.yaml"), str(tree / "game"), str(tree / "mod"), str(tree / "wiki"))
    run("evaluate", at("x.yaml"), at("q.yaml"), "--results", at("r"))
    run("gold", at("x.yaml"), at("q.yaml"), at("g.yaml"), "--results", at("r"), "--ids", at("ids.txt"))
    run("feedback", at("x.yaml"), at("q.yaml"), at("f.yaml"), "--results", at("r"))
    run("compare", at("r/evaluate/x"), at("r/evaluate/x"))
    run("rows", at("r/gold/x"))
    said = capsys.readouterr().out
    assert "results in" in said and "delta: 0.0" in said and "id: a" in said
    for suffix, more in (("none", []), ("heuristic", ["--rerank"])):
        run("feedback", at("x.yaml"), at("q.yaml"), at("f.yaml"), "--results", at("r"), "--suffix", suffix, *more)
    run("matrix", "x", "--mode", "none=No rerank", "--mode", "heuristic=Heuristic rerank", "--results", at("r"))
    sheet = "\n".join(r.value for r in spark.read.text(at("r/feedback_suite_matrix"), wholetext=True).collect()).splitlines()
    assert sheet[:4] == list(render.MATRIX_HEAD) and sheet[4:] == ["| x | No rerank | 0% | 100% | 67% | 100% |", "| x | Heuristic rerank | 100% | 100% | 67% | 100% |"]  # the fox stands in quotes: no word of BM25, found by the rerank
    run("--subsets", at("subsets"), "review", at("x.yaml"), at("q.yaml"), "--results", at("r"), "--ids", at("ids.txt"), "--top-k", "3", "--rerank")
    got = spark.read.text(at("r/review/x/manual_review_ids"), wholetext=True).first().value
    assert got.startswith(f"# Manual Review - x\n\n- query_subset: `{at('ids.txt')}`\n- top_k: `3`\n\n## a - fox\n\n- collection: `game`\n- category: `-`\n- expected: `hunt`\n\n### Rank 1\n\n- score: `")
    assert "- file: `events/e.txt`\n- title: `e.1`\n- parent_id: `events/e.txt::e.1`\n\n```text\ne.1 = { title" in got and "title -" not in got
    for name, text in (("game/one", "common/traits/a.txt"), ("queries/only", "b"), ("wiki/one", "bom.md")):
        (tmp_path / "subsets" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "subsets" / f"{name}.txt").write_text(text + "\n")
    run("--subsets", at("subsets"), "run", at("x.yaml"), str(tree / "game"), str(tree / "mod"), str(tree / "wiki"), "--subset", "one")
    assert {r.file_path for r in store.open_store(spark, at("store/exp_x_game")).chunks.collect()} == {"common/traits/a.txt"} and {r.file_path for r in store.open_store(spark, at("store/exp_x_wiki")).chunks.collect()} == {"bom.md"}
    run("--subsets", at("subsets"), "evaluate", at("x.yaml"), at("q.yaml"), "--results", at("r"), "--ids", "only", "--suffix", "sub")
    assert [r.id for r in store.read_results(spark, at("r/evaluate/x_sub"))[1].collect()] == ["b"]
    assert store.read_results(spark, at("r/evaluate/x"))[1].count() == 2 and store.read_results(spark, at("r/gold/x"))[1].count() == 1


def test_queries_in_blocks(spark, monkeypatch):
    from gravelake.operators import vector

    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "child_id long, embedding array<float>")
    q = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(20)], "query_id long, embedding array<float>")
    rows = lambda: sorted(tuple(r) for r in vector.cosine_topk(v, q, 3).collect())
    whole = rows()
    monkeypatch.setattr(vector, "AT_ONCE", 500)
    assert rows() == whole and len(whole) == 60


def test_cells_find_what_the_exact_search_finds(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("child_id"), "embedding")
    q = v.filter("child_id % 50 = 0").select(F.col("child_id").alias("query_id"), "embedding")
    pairs = lambda d: {(r.query_id, r.child_id) for r in d.collect()}
    exact = pairs(cosine_topk(v, q, 10))
    assert len(exact & pairs(cells_topk(v, q, 10))) >= 0.9 * len(exact)
    ragged = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [1.0])], "child_id int, embedding array<float>")
    assert [r.child_id for r in cells_topk(ragged, spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<float>"), 5).collect()] == [3]
    assert cells_topk(v.limit(0), q, 10).count() == 0 == cells_topk(v, q.limit(0), 10).count()


def test_cells_prune_where_vectors_cluster():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(40, 32)), 50, axis=0) + 0.2 * rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres, probes = fit_cells(x, x[::20], 10, 0.95)
    own, near = (x @ centres.T).argmax(1), np.argsort(-(x[::20] @ centres.T), axis=1)[:, :probes]
    read = [np.isin(own, row) for row in near]
    best = np.argsort(-(x[::20] @ x.T), axis=1)[:, :10]
    assert np.mean([r[b].mean() for r, b in zip(read, best, strict=True)]) >= 0.9
    assert np.mean(read) <= 0.1


def test_stream_takes_new_files_once(spark, tree, tmp_path):
    from gravelake.streaming.incremental import index_new_files

    out, ck = str(tmp_path / "out" / "game"), str(tmp_path / "ck")
    index_new_files(spark, str(tree / "game"), out, ck).awaitTermination()
    n = store.open_store(spark, out).chunks.count()
    (tree / "game/events/new.txt").write_text("n.1 = { a = zebra }\nn.2 = { c = d }\n")
    index_new_files(spark, str(tree / "game"), out, ck).awaitTermination()
    now = store.open_store(spark, out)
    assert now.chunks.count() == n + 2 == now.embeddings.count() and store.embeddings(spark, out).count() == n + 2
    engine = Engine(spark, str(tmp_path / "out"), settings=config.Settings())
    first = lambda alpha: engine.search("game", [("q", "a = zebra }")], 1, alpha=alpha).first()
    assert first(0.0).parent_id == first(1.0).parent_id == "events/new.txt::n.1"  # by words, and by vectors
    assert "zebra" in engine.get_section("events/new.txt::n.1", "game")
    later = parse.script_parents(spark.createDataFrame([("/x/events/new.txt", "events/new.txt", bytearray(b"n.1 = { a = badger }"))], schemas.SOURCE_FILE))
    store.add_segment(later, chunk_parents(later), spark.createDataFrame([("events/new.txt",)], "file_path string"), out)  # takes the place of what the file was
    engine = Engine(spark, str(tmp_path / "out"), settings=config.Settings())
    assert engine.index("game").chunks.count() == n + 1 and "badger" in engine.get_section("events/new.txt::n.1", "game")
    assert engine.search("game", [("q", "zebra")], 1, alpha=0.0).first().score == 0 and engine.search("game", [("q", "badger")], 1, alpha=0.0).first().parent_id == "events/new.txt::n.1"
    assert engine.get_section("events/new.txt::n.2", "game").startswith("Not found")


def test_chunk_ids_do_not_move(spark):
    p = spark.createDataFrame([("a", "n", None, "x. " * 10, "f", "c", "wiki", 0), ("b", "n", None, " ", "f", "c", "wiki", 1)], schemas.PARENT)
    got = chunk_parents(p, size=6).orderBy("parent_ord", "chunk_ord").collect()
    assert [r.child_id for r in got] == [f"a::chunk{i}" for i in range(len(got))] and len(got) > 2


def test_chunks_in_sql(spark):
    """The table functions give what the operator gives."""
    chunk.register(spark)
    text = "a = {\n" + "\n".join(f"k{i} = {{ x = {i} y = word }}" for i in range(12)) + "\n}"
    p = spark.createDataFrame([("s", "a", None, text, "f", "c", "game_file", 0), ("w", None, "t", "One here. Two there. " * 9, "g", None, "wiki", 0), ("e", None, None, None, "h", None, "wiki", 0)], schemas.PARENT)
    p.createOrReplaceTempView("parents_of_test")
    for name, strategy, args in (("script_chunks", "ast", (20,)), ("sentence_chunks", "sentence_splitter", (8, 3))):
        got = spark.sql(f"SELECT parent_id, chunk_ord, text FROM {name}(TABLE(parents_of_test), {', '.join(map(str, args))})")
        want = chunk_parents(p, strategy, *args).select("parent_id", "chunk_ord", "text")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
    made = spark.sql("SELECT * FROM script_chunks(TABLE(SELECT 1 AS n, 'x y' AS content, 'wiki' AS source_type), 5)")
    assert made.columns == ["n", "content", "source_type", "chunk_ord", "text"] and made.first().n == 1
    for bad in ("TABLE(SELECT 1 AS n), 5", "TABLE(SELECT 'x' AS content, 'wiki' AS source_type), n", "TABLE(SELECT 'x' AS content, 'wiki' AS source_type, 'y' AS text), 5"):
        with pytest.raises(Exception):  # noqa: B017
            spark.sql(f"SELECT * FROM script_chunks({bad})").collect()
    spark.catalog.dropTempView("parents_of_test")


class _Slow:
    concurrent = 20

    def __init__(self, wait=0.0, failing=0, error=None):
        self.wait, self.failing, self.error, self.calls, self.flying, self.most = wait, failing, error, 0, 0, 0

    def __call__(self, texts):
        import threading
        import time

        with _Slow.lock:
            self.calls += 1
            self.flying += 1
            self.most = max(self.most, self.flying)
            fail = self.calls <= self.failing
        time.sleep(self.wait * (1 + (int(texts[0]) * 7919 % 5) / 10))  # answers come out of order
        with _Slow.lock:
            self.flying -= 1
        if fail:
            raise self.error
        return [[float(t)] for t in texts]


def test_calls_in_flight_keep_their_order():
    import threading
    import time
    import urllib.error

    _Slow.lock = threading.Lock()
    slow, began = _Slow(0.2), time.perf_counter()
    got = list(embed.in_order(slow, ([str(i)] for i in range(20)), 20))
    assert got == [[[float(i)]] for i in range(20)] and time.perf_counter() - began < 1.0 and slow.most == 20
    taken = []
    lazy = embed.in_order(slow, (taken.append(i) or [str(i)] for i in range(100)), 5)
    assert next(lazy) == [[0.0]] and len(taken) <= 6  # no more items are taken than are in flight
    lazy.close()
    flaky = _Slow(failing=2, error=urllib.error.HTTPError("u", 429, "busy", None, None))
    assert embed.retried(flaky, ["3"], wait=0.01) == [[3.0]] and flaky.calls == 3
    for error in (urllib.error.HTTPError("u", 400, "bad", None, None), ValueError("x")):
        wrong = _Slow(failing=9, error=error)
        with pytest.raises(type(error)):
            embed.retried(wrong, ["1"], wait=0.01)
        assert wrong.calls == 1
    down = _Slow(failing=9, error=ConnectionError())
    with pytest.raises(ConnectionError):
        embed.retried(down, ["1"], tries=3, wait=0.01)
    assert down.calls == 3


class _Service:
    """An embeddings service on this machine: answers out of order, the first call of each text is turned away."""

    def __enter__(self):
        import http.server
        import threading

        seen, lock = {}, threading.Lock()

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
                with lock:
                    seen[texts[0]] = seen.get(texts[0], 0) + 1
                    busy = seen[texts[0]] == 1
                body = json.dumps({"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(texts)))]}).encode()
                self.send_response(503 if busy else 200)
                self.end_headers()
                self.wfile.write(b"" if busy else body)

            def log_message(self, *a):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return f"http://127.0.0.1:{self.server.server_port}/v1/embeddings"

    def __exit__(self, *a):
        self.server.shutdown()


def test_embeddings_from_a_service(spark):
    with _Service() as url:
        d = spark.createDataFrame([(i, "x" * i) for i in range(150)], "i int, text string").repartition(2)
        got = embed.embedded(d, "text", embed.HttpEmbedder(url, "m", "key")).collect()
    assert {r.i: r.embedding for r in got} == {i: [float(i)] for i in range(150)}
