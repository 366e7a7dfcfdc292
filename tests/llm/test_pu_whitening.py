import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gravelake.llm import pu_quality as P
from gravelake.llm import whitening as Wh
from gravelake.llm.common import merged_in_tasks, table
from tests.llm.util import corpus, frame

# 11: positive-unlabelled quality


def _risk(w, prior, p, u):
    """The non-negative risk of squared loss, row by row."""
    loss = lambda z: (1 - z) ** 2 / 4
    positive = np.mean([loss(x @ w) for x in p])
    return prior * positive + max(0.0, np.mean([loss(-(x @ w)) for x in u]) - prior * np.mean([loss(-(x @ w)) for x in p]))


@pytest.mark.parametrize(("n", "prior", "ridge"), [(400, 0.5, 1e-4), (6, 0.9, 1e-4), (6, 0.95, 1e-2), (3, 0.3, 1e-3)])
def test_least_nonnegative_risk(n, prior, ridge):
    """No other weights have less of the risk, which is computed row by row; few positives and a high prior need the correction."""
    rng = np.random.default_rng(n)
    p = np.c_[np.ones(n), rng.normal(1, 1, (n, 5))]
    u = np.c_[np.ones(300), rng.normal(np.where(rng.random(300) < prior, 1, -1)[:, None], 1, (300, 5))]
    w = P.fit(prior, p.mean(0), p.T @ p / n, u.mean(0), u.T @ u / 300, ridge)
    full = lambda w: _risk(w, prior, p, u) + ridge * (w @ w) / 2
    best = full(w)
    for size in (1e-3, 1e-2, 0.1, 1.0):
        assert all(full(w + size * rng.normal(size=6)) >= best - 1e-9 for _ in range(200))
    x = np.zeros(6)  # plain subgradient descent finds no better ones either
    for t in range(1, 4001):
        step = np.array([(full(x + 1e-6 * e) - full(x - 1e-6 * e)) / 2e-6 for e in np.eye(6)]) if t % 8 == 1 else step
        x = x - 0.3 / (1 + t / 200) * step
    assert best <= full(x) + 1e-6


def test_correction_is_used():
    rng = np.random.default_rng(1)
    p, u = rng.normal(2, 1, (4, 6)), rng.normal(0, 1, (200, 6))
    args = (0.95, p.mean(0), p.T @ p / 4, u.mean(0), u.T @ u / 200)
    plain = np.linalg.solve(args[4] + 2e-4 * np.eye(6), 2 * 0.95 * args[1] - args[3])
    assert _risk(P.fit(*args, 1e-4), 0.95, p, u) < _risk(plain, 0.95, p, u) - 1e-3


def test_class_prior():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.85):
        of = lambda x: np.bincount(np.clip((x * 500).astype(int), 0, 3999), minlength=4000).astype(float)
        good, bad = rng.normal(3, 0.4, 20_000), rng.normal(1, 0.4, 20_000)
        u = np.where(rng.random(20_000) < share, rng.normal(3, 0.4, 20_000), bad)
        assert abs(P.class_prior(of(good), of(u)) - share) < 0.04
    assert 0.01 <= P.class_prior(of(good[:1]), of(u[:1])) <= 0.99


def test_features():
    one = P.features("Good words, in lines.\nAnd 2 more lines.")
    assert one.shape == (P.DIMENSIONS,) and np.isfinite(one).all() and one.dtype == np.float16
    bins = one[1 : 1 + P._SCALARS * P.KNOTS].reshape(P._SCALARS, P.KNOTS).astype(float)
    assert np.allclose(bins.sum(1), 1, atol=1e-2) and (bins >= 0).all()
    assert (P.features(None) == P.features("")).all() and not (P.features("") == one).all()
    for odd in ("\ud800 lone", "日本語" * 10, "\x00\x1c\xa0", "x" * 3_000_000, "é̀ " * 5, " \n\t"):
        assert np.isfinite(P.features(odd)).all()
    long = "Some words, here!! THERE a1b2 日本 \n" * 90_000  # several pieces, cut at white space
    assert len(long) > 2 * P._PIECE and "".join(P._pieces(long)) == long
    short = long[: len(long) // 90]  # whole lines
    assert np.abs(P.features(long)[-P.SHAPES :].astype(float) - P.features(short)[-P.SHAPES :].astype(float)).max() < 1e-3
    kinds = np.bincount(P.classes("aB1 ,é日̀"), minlength=P._CLASSES)
    assert kinds[P._LOWER] == 2 and kinds[P._UPPER] == 1 and kinds[P._LETTER] == 1 and kinds[P._MARK] == 1 and kinds[P._DIGIT] == 1


def test_moments_and_scores_against_rows(spark):
    """The operator equals the method applied to plain arrays of all rows."""
    rows = corpus(120)
    d = frame(spark, rows).repartition(5)
    labels = spark.createDataFrame([(r[0], int(i % 4 != 0)) for i, r in enumerate(rows)] + [(3, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = {r.id: r.score for r in P.quality_scores(d, labels, F.col("id") % 5 != 0).collect()}
    x = np.stack([P.features(r[1]).astype(float) for r in rows])
    good = np.array([i % 4 != 0 and r[0] % 5 != 0 and r[0] != 3 for i, r in enumerate(rows)])
    halves = {r.id: r.h for r in P.feature_table(frame(spark, rows)).select("id", P._half().alias("h")).collect()}
    half = np.array([halves[r[0]] for r in rows])
    p, eye = x[good], np.eye(P.DIMENSIONS)
    gu, gp = x.T @ x / len(x), p.T @ p / len(p)
    ratio = np.zeros(len(x))
    for k in (0, 1):
        ratio[half == k] = x[half == k] @ np.linalg.solve(gu + P.RIDGE * eye, x[good & (half != k)].mean(0))
    bins = lambda r: np.bincount(np.clip((r / P._BIN).astype(int), 0, P._BINS - 1), minlength=P._BINS).astype(float)
    prior = P.class_prior(bins(ratio[good]), bins(ratio))
    z = x @ P.fit(prior, p.mean(0), gp, x.mean(0), gu)
    assert max(abs(got[r[0]] - 1 / (1 + np.exp(-4 * v))) for r, v in zip(rows, z, strict=True)) < 1e-6


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = P.op11_quality_classifier(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")] and got.count() == 1000
    rows = got.join(table(spark, sf, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    own = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in own]) > 0.95
    assert np.mean([a.score > b.score for a in own for b in own if a.quality > b.quality]) > 0.99


def test_held_out_labels_do_not_count(spark):
    d, labels = frame(spark, corpus(60)), spark.createDataFrame([(i * 3, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(P.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    own = lambda x: sorted((r.id, round(r.score, 9)) for r in P.quality_scores(d, x, ~P.held_out(F.col("id"))).collect())
    assert own(labels) == own(turned)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    every = F.lit(True)
    assert P.quality_scores(frame(spark, []), labels, every).count() == 0
    odd = [(1, None, None, None, None), (1, "", None, None, None), (None, "no id", None, None, None), (None, "no id", None, None, None), (2, "same", None, None, None), (2, "same", None, None, None), (0, "w " * 300_000, None, None, None)]
    d = frame(spark, odd).withColumn("f", F.lit(1)).withColumn("score", F.lit(9.0)).withColumn("id", F.lit("x")).withColumn("y", F.lit(2))
    got = P.quality_scores(d, labels, every).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.id == 2}) == 1 and len({r.score for r in got if r.id == 1}) == 1
    none = P.quality_scores(d, labels.limit(0), every).collect()
    assert {r.score for r in none} == {0.5} and len(none) == 7
    assert frame(spark, odd).select(P.held_out(F.col("doc_id")).alias("h")).filter("h IS NULL").count() == 0


# 12: whitening


def _plain(vectors, k=8):
    """n, deviations, covariance, by whole numbers and a library's solver."""
    xs = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, s = len(xs), [sum(c) for c in zip(*xs, strict=True)]
    dev = [sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)) for x in xs]
    apart = np.array([[n * c - t for c, t in zip(x, s, strict=True)] for x in xs], object)
    v = np.array(apart.T.dot(apart) / n, float) / n / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    return n, dev, e, np.array(apart, float) / n @ q[:, :k] / np.sqrt(e[:k])


def test_whitening_against_whole_numbers(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(700, 12)) * np.linspace(3, 0.2, 12) + 40).astype(np.float32)
    d = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(7)
    rows = Wh.whiten(d).collect()
    n, dev, e, white = _plain(vectors)
    assert len(rows) == 700 * 8 and {r.n for r in rows} == {700} and all(r.deviation == dev[r.vec_id] for r in rows)
    got = np.zeros((700, 8))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
    signs = np.sign((got * white).sum(0))
    assert np.abs(got * signs - white).max() < 1e-9
    assert np.allclose([next(r.explained for r in rows if r.component == k + 1) for k in range(8)], e[:8] / e.sum(), rtol=1e-10)
    errors = {r.identity_error for r in rows}
    want = np.abs(np.cov(got.T, bias=True) - np.eye(8)).max()
    assert len(errors) == 1 and max(errors) < 1e-9 and want < 1e-9


def test_symmetric_qr():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 8, 64, 130):
        for a in (rng.normal(size=(d, d)), np.eye(d), np.zeros((d, d)), np.diag(np.arange(d, dtype=float)), np.outer(np.ones(d), np.ones(d))):
            s = a + a.T
            e, q = Wh.symmetric_qr(s)
            size = max(np.abs(s).max(), 1)
            assert np.abs(e - np.linalg.eigvalsh(s)[::-1]).max() < 1e-11 * size * d
            assert np.abs(q.T @ q - np.eye(d)).max() < 1e-12 * d and np.abs(s @ q - q * e).max() < 1e-11 * size * d


def test_moments_merge_in_any_shape(spark):
    rng = np.random.default_rng(6)
    x = np.floor(1024 * rng.normal(size=(90, 4))) + 1e5
    whole = Wh.Moments(4)
    whole.add(x)
    assert np.allclose(whole.mean, x.mean(0), rtol=1e-14) and np.allclose(whole.about / 90, np.cov(x.T, bias=True), rtol=1e-12)
    parts = []
    for piece in (x[:1], x[1:1], x[1:50], x[50:]):
        m = Wh.Moments(4)
        m.add(piece)
        parts.append(m.packed())
    got = Wh.Moments.unpacked(Wh.merged(iter(parts)))
    assert got.n == 90 and np.allclose(got.mean, whole.mean, rtol=1e-14) and np.allclose(got.about, whole.about, rtol=1e-12)
    states = spark.createDataFrame([(p,) for p in parts * 30], "state binary").repartition(50)
    assert Wh.Moments.unpacked(merged_in_tasks(states, Wh.merged)).n == 90 * 30
    assert merged_in_tasks(states.limit(0), Wh.merged) is None


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>, component int, n string, state binary"
    make = lambda rows: spark.createDataFrame([(*r, 5, "x", None) for r in rows], schema)
    assert Wh.whiten(make([])).count() == 0 and Wh.whiten(make([(1, None), (2, [float("nan")]), (3, [])])).count() == 0
    good = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("inf"), 2.0]), (93, [float("nan"), 0.0, 0.0]), (94, []), (95, [1.0, 2.0]), (96, [1.0] * 5)]
    rows = Wh.whiten(make(good + bad + good[:3] + [(None, [9.0, 9.0, 1.0])])).collect()
    n, dev, e, white = _plain([v for _, v in good + good[:3]] + [[9.0, 9.0, 1.0]], 2)
    assert len(rows) == 34 * 3 and {r.n for r in rows} == {34} and {r.vec_id for r in rows} == {*range(30), None}
    assert sorted(r.deviation for r in rows if r.component == 1) == sorted(dev)
    last = [r for r in rows if r.component == 3]  # one dimension is constant
    assert all(r.whitened is None and r.explained == 0 for r in last)
    assert max(r.identity_error for r in rows) < 1e-9 and np.allclose(sorted(abs(r.whitened) for r in rows if r.component == 1), sorted(np.abs(white[:, 0])))
    same = Wh.whiten(make([(i, [2.0, 2.0]) for i in range(9)])).collect()
    assert len(same) == 18 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in same)
    far = Wh.whiten(make([(i, [3e38 * (-1) ** i, 1.0]) for i in range(4)])).collect()
    assert all(r.deviation is None for r in far) and max(r.identity_error for r in far) < 1e-9


def test_whitening_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    got = Wh.op12_whitening(spark, sf)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    vectors = {r.vec_id: r.embedding for r in table(spark, sf, "embeddings").collect()}
    ids = sorted(vectors)
    n, dev, e, white = _plain([vectors[i] for i in ids])
    rows = got.collect()
    values = np.zeros((n, 8))
    for r in rows:
        values[ids.index(r.vec_id), r.component - 1] = r.whitened
        assert r.deviation == dev[ids.index(r.vec_id)] and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10
    assert len(rows) == 8 * n and np.abs(values * np.sign((values * white).sum(0)) - white).max() < 1e-8
