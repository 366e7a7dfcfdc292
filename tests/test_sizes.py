"""Steps whose cost must not grow faster than what goes in."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from gravelake import schemas
from gravelake.operators import lexical, store
from gravelake.operators.chunk import chunk_parents
from gravelake.operators.vector import cosine_topk


def test_a_large_block_is_cut_without_a_copy_of_it_in_every_chunk(spark):
    body = "x = {\n" + "\ta = { k = 1 }\n" * 30_000 + "}"  # copied into its chunks it would be 3 GB and more
    p = spark.createDataFrame([("p", "x", None, body, "f.txt", "c", "game_file", 0)], schemas.PARENT)
    d = chunk_parents(p, "ast", 20)
    assert d.columns == schemas.CHUNK.names
    found = d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.regexp_count("text", F.lit("k = 1"))).alias("k"), F.max("chunk_ord").alias("last"), F.countDistinct("child_id").alias("ids")).first()
    assert found.k == 30_000 and found.n == found.ids == found.last + 1 and found.n > 7_000


def test_pairs_of_queries_and_vectors_are_no_rows(spark):
    nan, rows = float("nan"), [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)]
    rows += [(50, [nan, 1.0, 1.0]), (51, [1.0, 2.0]), (52, None), (53, [0.0, 0.0, 0.0]), (54, [1.0, None, 1.0])]
    v = spark.createDataFrame(rows, "child_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [2.0, 1.0])], "query_id long, embedding array<double>")
    d = cosine_topk(v, q, 41)
    assert "Join" not in d._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in d._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.rank): (r.child_id, r.score) for r in d.collect()}

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 9)

    want = sorted((-cosine([1, 2, 3], e), i) for i, e in rows[:40])
    assert got[1, 1][0] == 50 and math.isnan(got[1, 1][1])  # as Spark orders it, before all numbers
    assert [(got[1, r][0], round(got[1, r][1], 9)) for r in range(2, 42)] == [(i, -s) for s, i in want] and (2, 1) not in got and (3, 1) not in got
    assert got[4, 1] == (51, 0.8) and [got[4, r] for r in range(2, 41)] == [(i, None) for i in range(39)]


def test_no_row_of_a_pair_is_shuffled_to_be_summed(spark, monkeypatch):
    c = spark.createDataFrame([(i, " ".join(f"w{j % 7}" for j in range(i, i + i % 9)), i) for i in range(60)], "child_id long, text string, corpus_ord long")
    q = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 5} W{i % 3}") for i in range(12)], "query_id long, query string")
    index = lexical.build_index(c)
    scores, best = lexical.bm25_scores(index, q), lexical.bm25_topk(index, q, 50)
    assert "hashpartitioning(query_id#" not in re.sub(r"hashpartitioning\(query_id#\w+, \d+\)|hashpartitioning\(query_id#\w+, term#\w+, \d+\)", "", scores._jdf.queryExecution().executedPlan().toString())
    whole = [sorted(map(tuple, d.collect())) for d in (scores, best)]
    assert len(whole[1]) == 12 * 50 and {r[3] for r in whole[1]} == set(range(1, 51))
    monkeypatch.setattr(lexical, "WORDS", 5)  # in shares
    assert [sorted(map(tuple, d.collect())) for d in (lexical.bm25_scores(index, q), lexical.bm25_topk(index, q, 50))] == whole


def test_a_step_of_embedding_is_spread_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "EMBED_BATCH", 10)
    monkeypatch.setattr(store, "_COMMITS", 1)
    d = spark.range(100).select(F.col("id").cast("string").alias("child_id"), F.col("id").cast("string").alias("content_hash"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    assert store.embed_pending(d, str(tmp_path)) == 100
    assert len(list(tmp_path.glob("embeddings/run=*/step=0/*.parquet"))) == 4
    assert sorted(int(r.child_id) for r in store.embeddings(spark, str(tmp_path)).collect()) == list(range(100))


def test_whole_is_round(spark):
    """Whole units of scores are those of `round`, halves and signs included, without a decimal of each."""
    from gravelake.operators.lexical import whole

    odd = [0.0, -0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 3.7e13 + 0.5, -3.7e13 - 0.5, 1e15 + 0.25]
    d = spark.createDataFrame([(x,) for x in odd], "x double").unionByName(spark.range(20_000).select(((F.rand(1) - 0.3) * F.pow(F.lit(10.0), F.rand(2) * 14)).alias("x")))
    assert d.filter(whole(F.col("x")) != F.round("x").cast("long")).count() == 0
    assert "round" not in str(whole(F.col("x")))
