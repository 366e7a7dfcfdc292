"""Stored collections: versions, segments, buckets, cells, the order of the corpus."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gravelake import config
from gravelake.engine import Engine
from gravelake.operators import embed, order, store, vector
from gravelake.operators.chunk import chunk_parents
from gravelake.operators.lexical import LexicalIndex, bm25_scores, bm25_topk, build_index, entries, write_entries
from gravelake.operators.vector import CellIndex, cosine_topk

WORDS = "ash birch cedar date elm fir gum hazel iris jute kapok larch maple nut oak pine".split()


def chunk_rows(n, seed, first=0):
    rng = random.Random(seed)
    return [(f"c{first + i}", " ".join(rng.choices(WORDS, weights=range(1, 17), k=rng.randint(0, 12))), first + i) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "child_id string, text string, corpus_ord long")


def asked(spark):
    return spark.createDataFrame([(i, " ".join(WORDS[i : i + 3])) for i in range(12)] + [(99, "nothing of it")], "query_id int, query string")


def scores(index, q):
    return {(r.query_id, r.child_id): r.score for r in bm25_scores(index, q).collect()}


def files_read(d):
    return {r.f for r in d.select(F.input_file_name().alias("f")).distinct().collect()}


# Lexical segments


def test_segments_score_like_a_whole_rebuild(spark, tmp_path):
    path, q = str(tmp_path), asked(spark)
    a, b = chunk_rows(60, 1), chunk_rows(25, 2, 60)
    again = [(k, t + " oak oak", o + 100) for k, t, o in a[10:20]]  # come again with another text
    gone = [a[3][0], a[4][0]]
    write_entries(entries(frame(spark, a)), path, 0)
    write_entries(entries(frame(spark, b)), path, 1)
    ids = spark.createDataFrame([(x,) for x in [*[r[0] for r in again], *gone]], "child_id string")
    write_entries(entries(frame(spark, again)), path, 2, ids)
    now = [r for r in a + b if r[0] not in {x[0] for x in again} | set(gone)] + again
    stored, whole = LexicalIndex.load(spark, path), build_index(frame(spark, now))
    assert stored.stats.first() == whole.stats.first() and stored.stats.first().n_docs == 83
    table = lambda d: sorted(tuple(r) for r in d.collect())
    assert table(stored.terms) == table(whole.terms) and table(stored.postings) == table(whole.postings) and table(stored.lengths) == table(whole.lengths)
    assert scores(stored, q) == scores(whole, q)
    assert table(bm25_topk(stored, q, 7)) == table(bm25_topk(whole, q, 7))
    before = LexicalIndex.load(spark, path, [0, 1])
    assert scores(before, q) == scores(build_index(frame(spark, a + b)), q)
    write_entries(entries(frame(spark, again)), path, 2, ids)  # the same once more
    assert scores(LexicalIndex.load(spark, path), q) == scores(whole, q)


def test_an_unfinished_segment_is_not_there(spark, tmp_path, monkeypatch):
    from gravelake.operators import lexical

    path, q = str(tmp_path), asked(spark)
    a, b = chunk_rows(30, 1), chunk_rows(30, 2, 30)
    write_entries(entries(frame(spark, a)), path, 0)
    want, real = scores(LexicalIndex.load(spark, path), q), lexical.put
    for stop in ("entries", "removed", "changes", "stats"):

        def broken(df, where, segment, *by, stop=stop):
            if where.endswith(stop):
                raise RuntimeError(stop)
            real(df, where, segment, *by)

        monkeypatch.setattr(lexical, "put", broken)
        with pytest.raises(RuntimeError):
            write_entries(entries(frame(spark, b)), path, 1, spark.createDataFrame([("c1",)], "child_id string"))
        assert scores(LexicalIndex.load(spark, path), q) == want
    monkeypatch.setattr(lexical, "put", real)
    write_entries(entries(frame(spark, b)), path, 1, spark.createDataFrame([("c1",)], "child_id string"))
    assert scores(LexicalIndex.load(spark, path), q) == scores(build_index(frame(spark, [r for r in a + b if r[0] != "c1"])), q)


def test_a_query_reads_the_buckets_of_its_words(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("child_id"), "text", F.col("doc_id").alias("corpus_ord"))
    write_entries(entries(d), str(tmp_path), 0)
    index = LexicalIndex.load(spark, str(tmp_path))
    q = spark.createDataFrame([("q", "the of"), ("r", "the and")], "query_id string, query string")
    from gravelake.operators.lexical import bucket_of, query_table

    near = index.pruned(query_table(q).withColumn("bucket", bucket_of("term", index.buckets)))
    every, read = files_read(index.entries), files_read(near.entries)
    assert len({f.split("bucket=")[1].split("/")[0] for f in every}) == index.buckets + 1 and 1 <= len({f.split("bucket=")[1].split("/")[0] for f in read}) <= 3
    scans = lambda d: [x for x in d._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert all("bucket" in x.split("PartitionFilters:")[1].split("PushedFilters")[0] for x in scans(bm25_scores(index, q))) and sum("tf#" in x for x in scans(bm25_scores(index, q))) == 1
    whole = build_index(d)
    assert scores(index, q) == scores(whole, q)
    assert sum("tf#" in x for x in scans(bm25_topk(index, q, 5))) == 1  # nothing is scored twice


def test_equal_texts_tie_and_unequal_ones_do_not(spark):
    rows = [("b", "oak pine oak elm", 0), ("a", "oak elm pine oak", 1), ("c", "oak oak pine elm fir", 2), ("d", "ash", 3), *[(f"z{i}", f"fig{i}", 4 + i) for i in range(9)]]
    got = bm25_topk(build_index(frame(spark, rows)), spark.createDataFrame([("q", "oak pine elm")], "query_id string, query string"), 4).orderBy("rank").collect()
    assert [r.child_id for r in got] == ["b", "a", "c", "d"] and got[0].score == got[1].score > got[2].score


# Versions


def _collection(spark, texts):
    p = spark.createDataFrame([(f"f{i}::p", "b", None, t, f"f{i}", "c", "wiki", 0) for i, t in enumerate(texts)], "parent_id string, block_name string, section_title string, content string, file_path string, file_category string, source_type string, ord int")
    return p, chunk_parents(p, size=8)


def test_a_killed_build_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "game")
    old = _collection(spark, [f"{w} stands. It is a {w}." for w in WORDS])
    store.build_store(*old, path)
    new = _collection(spark, [f"{w} fell. It was a tall {w}." for w in WORDS[:9]])
    engine = lambda: Engine(spark, str(tmp_path), settings=config.Settings())
    asks = lambda: [tuple(r) for r in engine().search("game", [("q", "cedar fell")], 3).select("child_id", "score").orderBy("rank").collect()]
    want, calls = asks(), []
    from gravelake.operators import lexical

    for module in (store, vector, lexical):

        def counted(df, where, *a, real=module.put):
            calls.append(where)
            if len(calls) == counted.stop:
                raise RuntimeError("killed")
            real(df, where, *a)

        monkeypatch.setattr(module, "put", counted)
        counted.stop = 0
    fakes = [m.put for m in (store, vector, lexical)]
    stop = 0
    while True:  # killed before each of its writes in turn
        stop += 1
        calls.clear()
        for f in fakes:
            f.stop = stop
        try:
            store.build_store(*new, path)
            break
        except RuntimeError:
            assert asks() == want
    assert stop > 6 and store.version(spark, path) == 2 and asks() != want
    for f in fakes:
        f.stop = 0
    assert store.build_store(*new, path)["pending"] == 0 and store.version(spark, path) == 3


def test_compaction_changes_nothing_that_is_found(spark, tmp_path):
    path = str(tmp_path / "game")
    parents, chunks = _collection(spark, [f"{w} stands. It is a {w}." for w in WORDS])
    n = store.build_store(parents, chunks, path)
    assert n == {"parents": 16, "chunks": chunks.count(), "pending": n["chunks"]}
    again = _collection(spark, ["willow bends. It is no ash."])
    store.add_segment(*again, spark.createDataFrame([("f0",)], "file_path string"), path)
    q = embed.embedded(spark.createDataFrame([("q", "ash willow")], "query_id string, query string"), "query")
    found = lambda: sorted((r.child_id, r.score) for r in store.open_store(spark, path).search(q, 6).collect())
    before = found()
    assert any(k.startswith("f0::") for k, _ in before)
    assert store.compact(spark, path)["pending"] == 0 and found() == before
    assert store.version(spark, path) == 2 and store.open_store(spark, path).parents.count() == 16


def test_no_chunks_name_no_version(spark, tmp_path):
    parents, chunks = _collection(spark, [" "])
    assert store.build_store(parents, chunks, str(tmp_path)) == {"parents": 1, "chunks": 0, "pending": 0}
    with pytest.raises(FileNotFoundError):
        store.open_store(spark, str(tmp_path))


def test_counted_by_the_write(spark, tmp_path):
    d = spark.range(50).withColumn("k", F.col("id") % 3)
    some = store.Counted(d.filter("k = 1"))
    some.rows.hint("rebalance", "k").write.parquet(f"{tmp_path}/a")
    none = store.Counted(d.join(d.select("id").hint("shuffle_hash"), "id", "left_anti"))  # found to be empty while it runs
    none.rows.hint("rebalance", "k").write.partitionBy("k").parquet(f"{tmp_path}/b")
    assert (some.n, none.n) == (17, 0)


# Order


def test_running_index_over_all_parts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randint(0, 40), i) for i in range(2000)]
    d = spark.createDataFrame(rows, "k string, n int, i int").repartition(7)
    order.placed(d, "k", "n", "i", parts=5).write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    assert stored.select("part").distinct().count() > 1
    got = {r.i: r.at for r in order.indexed(stored, "at").collect()}
    assert got == {i: at for at, (_, _, i) in enumerate(sorted(rows))}


def test_the_corpus_is_in_order(spark, tmp_path):
    parents, chunks = _collection(spark, [f"{w}. " * 9 for w in WORDS])
    store.build_store(parents, chunks, str(tmp_path))
    got = store.open_store(spark, str(tmp_path)).chunks.orderBy("corpus_ord").collect()
    assert [r.corpus_ord for r in got] == list(range(len(got)))
    assert [(r.file_path, r.chunk_ord) for r in got] == sorted((r.file_path, r.chunk_ord) for r in got)


# Cells


def clustered(n=4000, groups=40, d=32, seed=1):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(groups, d)), n // groups, axis=0) + 0.2 * rng.normal(size=(n, d))
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def recall(found, exact):
    rows = lambda d: {(r.query_id, r.child_id) for r in d.collect()}
    want = rows(exact)
    return len(want & rows(found)) / len(want)


def test_stored_cells_prune_and_find(spark, tmp_path):
    v = spark.createDataFrame(clustered(), "child_id long, embedding array<float>")
    q = v.filter("child_id % 50 = 0").select(F.col("child_id").alias("query_id"), "embedding")
    CellIndex.fit(v).save(str(tmp_path))
    index = CellIndex.load(spark, str(tmp_path))
    assert index.probes <= 0.1 * len(index.centres)
    assert recall(index.topk(q, 10), cosine_topk(v, q, 10)) >= 0.9
    one = q.filter("query_id = 100")
    found, wanted = index.candidates(one, 40)
    read = files_read(index.vectors.filter(F.col("cell").isin(wanted)))
    assert len(wanted) == index.probes and len(read) <= 0.15 * len(files_read(index.vectors))
    scan = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert len(scan) == 1 and "cell" in scan[0].split("PartitionFilters:")[1].split("PushedFilters")[0] and "embedding" not in scan[0].split("ReadSchema:")[1]
    exact = {r.child_id: r.score for r in cosine_topk(v, one, 4000).collect()}
    assert all(abs(r.score - exact[r.child_id]) < 0.02 for r in found.collect())  # codes come near
    assert all(r.score == exact[r.child_id] for r in index.topk(one, 10).collect())  # and results are exact
    more = spark.createDataFrame([(90_000 + i, [float(x) for x in np.eye(32)[i]]) for i in range(3)], "child_id long, embedding array<float>")
    index.add(more, str(tmp_path), 1)
    both = CellIndex.load(spark, str(tmp_path), [0, 1])
    hit = both.topk(more.select(F.col("child_id").alias("query_id"), "embedding"), 1).collect()
    assert {(r.query_id, r.child_id) for r in hit} == {(90_000 + i, 90_000 + i) for i in range(3)}
    hidden = CellIndex.load(spark, str(tmp_path), [0, 1], spark.createDataFrame([(100, 1)], "child_id long, segment int"))
    assert hidden.vectors.count() == 4002 and 100 not in {r.child_id for r in hidden.topk(one, 5).collect()}


def test_cells_on_the_given_table(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("child_id"), "embedding")
    q = v.filter("child_id % 50 = 0").select(F.col("child_id").alias("query_id"), "embedding")
    CellIndex.fit(v).save(str(tmp_path))
    assert recall(CellIndex.load(spark, str(tmp_path)).topk(q, 10), cosine_topk(v, q, 10)) >= 0.9


def test_the_engine_searches_cells(spark, tmp_path):
    parents, chunks = _collection(spark, [f"{a} and {b} stand." for a in WORDS for b in WORDS])
    store.build_store(parents, chunks, str(tmp_path))
    index = store.open_store(spark, str(tmp_path))
    q = embed.embedded(spark.createDataFrame([(i, f"{w} and elm") for i, w in enumerate(WORDS)], "query_id int, query string"), "query")
    assert index.cells is not None and index.cells.stored
    assert recall(index.vector_candidates(q, 10), cosine_topk(index.embeddings, q, 10)) >= 0.75  # ties at the tenth place are many
    assert index.vector_candidates(q, 5, category="c").count() == 5 * len(WORDS)
