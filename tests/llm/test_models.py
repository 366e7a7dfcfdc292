import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gravelake.llm import langid, lm, toxicity
from gravelake.llm.common import table
from tests.llm.util import corpus, frame

# 2: toxicity


def test_chain_uses_earlier_categories(spark):
    rows, labels = [], []
    for i in range(400):
        insult, threat = i % 4 == 0, i % 8 == 0
        t = f"plain words number {i % 23} here " + ("idiotic fool " if insult else "") + ("hurtyou " if threat and i % 16 else "")
        rows.append((i, t, "en", "s", 0))
        labels.append((i, int(insult), int(threat)))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (900, None, 1)], "doc_id long, insult int, threat int")
    d = frame(spark, rows)
    chain = toxicity.train(d, lab, {"insult": F.col("insult") == 1, "threat": F.col("threat") == 1, "never": F.col("insult") == 7})
    assert chain.categories == ["insult", "threat", "never"] and chain.weights[2] is None
    assert chain.weights[1][len(chain.vocabulary)] > 0  # the probability of the first counts for the second
    got = {r.doc_id: r for r in toxicity.predict(d, chain).collect()}
    assert all((got[i].p_insult > 0.5) == bool(y) for i, y, _ in labels) and all(r.p_never == 0 for r in got.values())
    threat = [(got[i].p_threat > 0.5) == bool(z) for i, _, z in labels if i % 16]
    assert np.mean(threat) > 0.99
    edge = toxicity.predict(frame(spark, [(1, None, None, None, None), (2, "", None, None, None), (3, "idiotic fool " * 20000, None, None, None)]), chain).orderBy("doc_id").collect()
    assert edge[0].p_insult == edge[1].p_insult < 0.5 < edge[2].p_insult
    none = toxicity.train(d, lab.limit(0), {"insult": F.col("insult") == 1})
    assert toxicity.predict(d, none).filter("p_insult > 0").count() == 0 and toxicity.predict(frame(spark, []), chain).count() == 0


def test_toxic_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op2_toxicity(spark, sf).join(table(spark, sf, "labels").withColumnRenamed("toxic", "y"), "doc_id").collect()
    found = [r for r in got if r.toxic]
    assert np.mean([r.y for r in found]) > 0.95 and len([r for r in found if r.y]) >= 0.65 * sum(r.y for r in got)  # 51 toxic documents to learn from


def test_toxic_stage_keeps_columns(spark):
    sf = "/root/testdata/sf0.01"
    d = table(spark, sf, "documents")
    kept = toxicity.stage(spark, d, sf)
    assert kept.columns == d.columns and 0.8 * d.count() < kept.count() < d.count()


def test_toxic_edges(spark):
    sf = "/root/testdata/sf0.001"
    odd = [(1, None, None, None, None), (1, "", None, None, None), (None, "no id", None, None, None), (2, "a repeated row", None, None, None), (2, "a repeated row", None, None, None)]
    d = frame(spark, odd).withColumn("p_toxic", F.lit(0.9)).withColumn("__p_toxic", F.lit(1.0))
    kept = toxicity.stage(spark, d, sf)
    assert kept.columns == d.columns and kept.count() == 5 and kept.filter("p_toxic = 0.9").count() == 5
    assert toxicity.stage(spark, d.limit(0), sf).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 1), (2, None)], "doc_id long, bad int")
    docs = frame(spark, [(i % 40, "vile " * (i % 2) + f"w{i % 5}", None, None, None) for i in range(4000)])  # ids come again and again
    chain = toxicity.train(docs, labels, {"bad": F.col("bad") == 1})
    got = {r.doc_id: r.p_bad for r in toxicity.predict(docs.limit(40), chain).collect()}
    assert all((got[i] > 0.5) == (i % 2 == 1) for i in range(1, 40))


def test_features_are_chosen_in_the_fold(spark):
    """A word that tells the category in one fold only is no feature of the model that predicts this fold."""
    of = lambda i: zlib.crc32(str(i).encode()) % toxicity.FOLDS
    rows = [(i, "plain words " + ("foul " if i % 2 else "") + ("only " if i % 2 and of(i) == 1 else ""), None, None, None) for i in range(400)]
    d = frame(spark, rows).withColumn("k", F.crc32(F.col("doc_id").cast("string").cast("binary")) % toxicity.FOLDS)
    words_ = d.select("k", (F.col("doc_id") % 2).alias("y"), F.explode(F.array_distinct(F.split("text", " "))).alias("f")).groupBy("f", "k").agg(F.sum("y").alias("n0"), F.count(F.lit(1)).alias("n"))
    sizes = d.groupBy("k").agg(F.sum(F.col("doc_id") % 2).alias("n0"), F.count(F.lit(1)).alias("n"))
    chosen = toxicity._standing_out(words_, sizes, 1)
    assert [("foul" in c, "only" in c) for c in chosen] == [(True, True), (True, False), (True, True), (True, True), (True, True)]


def test_chain_against_plain_fits():
    """Out-of-fold probabilities and the chain's weights equal those of plain fits, fold by fold."""
    rng = np.random.default_rng(5)
    rows = [(i % 4, sorted({int(x) for x in rng.integers(0, 6, 3)}), [float(i % 3 == 0), float(i % 2)]) for i in range(80)]
    chosen = [{0, 1, 2, 3, 4}, {1, 2, 3, 4, 5}, {0, 2, 4}, {0, 1, 5}, {0, 1, 2, 3}]
    got = toxicity.fit(rows, ["a", "b"], {f"f{i}": i for i in range(6)}, [0.4, 0.5], chosen)

    def plain(own, use, earlier, c, prior):
        at = np.array([j for j, i in enumerate(own) for f in rows[i][1] if f in use], np.int64)
        of = np.array([f for i in own for f in rows[i][1] if f in use], np.int64)
        return toxicity._fit(at, of, 6, earlier[own], np.array([rows[i][2][c] for i in own]), prior)

    earlier = np.zeros((80, 0))
    for c, prior in enumerate((0.4, 0.5)):
        assert np.allclose(got.weights[c], plain(list(range(80)), chosen[4], earlier, c, prior))
        out = np.zeros(80)
        for k in range(4):
            w = plain([i for i in range(80) if rows[i][0] != k], chosen[k], earlier, c, prior)
            for i in range(80):
                if rows[i][0] == k:
                    out[i] = 1 / (1 + math.exp(-(sum(w[f] for f in rows[i][1] if f in chosen[k]) + earlier[i] @ w[6:-1] + w[-1])))
        earlier = np.column_stack([earlier, out])


# 4: language


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    k, lengths = 3, np.array([4, 3, 1])
    e, move = rng.normal(size=(8, k)), rng.normal(size=(k, k))
    p, pairs = langid.forward_backward(e, lengths, move)
    want_p, want_pairs, at = np.zeros_like(e), np.zeros((k, k)), 0
    for n in lengths:
        own, moves, z = np.zeros((n, k)), np.zeros((k, k)), 0.0
        for path in itertools.product(range(k), repeat=int(n)):
            w = math.exp(sum(e[at + i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
            z += w
            for i, y in enumerate(path):
                own[i, y] += w
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += w
        want_p[at : at + n] = own / z
        want_pairs += moves / z
        at += n
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs)


def test_features():
    f = langid.word_features(["abc", "abd", "abc", "x", "y" * 100])
    assert (f[0] == f[2]).all() and set(f[0]) & set(f[1]) - {0} and (f < langid.BUCKETS).all()


def test_code_switching():
    docs = [("xx", "zorg blag krunt " * 30), ("yy", "aiou ouei iaea " * 30)] * 5
    m = langid.fit(docs, sequences=200, epochs=3)
    ws = ["zorg", "blag", "krunt", "aiou", "ouei", "iaea", "zorg"]
    p, _ = langid.forward_backward(m.emissions(ws), np.array([len(ws)]), m.move)
    assert [m.languages[i] for i in p.argmax(1)] == ["xx"] * 3 + ["yy"] * 3 + ["xx"]


def test_long_runs_are_read_whole():
    docs = [("xx", "zorg blag krunt " * 30), ("yy", "aiou ouei iaea " * 30), ("xx", "zorgblagkrunt" * 20), ("yy", "aioououeiiaea" * 20)] * 5
    m = langid.fit(docs, sequences=200, epochs=3)
    assert langid.words("ab" * 12) == ["ab" * 12] and len(langid.words("ab" * 13)) == 2
    ws = langid.words("zorgblagkrunt" * 20 + "aioououeiiaea" * 20 + "zorgblagkrunt" * 20)
    p, _ = langid.forward_backward(m.emissions(ws), np.array([len(ws)]), m.move)
    said = "".join(m.languages[i][0] for i in p.argmax(1))
    assert len(said) == 33 and said.replace("xx", "x").strip("x").strip("y") == "" and said[0] == said[-1] == "x" and 9 <= said.count("y") <= 13
    run = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(100))
    parts = langid.words(run)
    assert "".join(s[2:-1] for s in parts) == run and max(map(len, parts)) <= 27
    for k in (1, 30, 50, 98):  # every letter counts
        other = run[:k] + "ß" + run[k + 1 :]
        assert (langid.word_features(parts) != langid.word_features(langid.words(other))).any()
    whole = [x for x in langid.word_features(parts).ravel() if x]
    assert len(whole) == 101 + 100 + len(parts) + 6  # bigrams, trigrams, slices, affixes of the run's own ends


def test_spans_come_from_the_whole_text():
    text = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000]}" for i in range(9000))
    ws = langid.words(text)
    at = {w: i for i, w in enumerate(ws)}
    got = [at[s[0]] for seed in range(40) for s in langid.spans(text, seed)]
    assert len(got) == 40 * langid.SPANS and min(got) < 100 and max(got) > 8800
    assert all(s == ws[at[s[0]] : at[s[0]] + langid.SPAN] for s in langid.spans(text, 1))
    assert langid.spans("a b", 1) == [["a", "b"]] and langid.spans("12", 1) == langid.spans(None, 1) == []


def test_late_words_train(spark):
    """What only the ends of long texts hold is learned."""
    junk = " ".join(f"q{'abcdefghij'[i % 10]}" for i in range(1500))
    d = frame(spark, [(i, junk + (" zorg blag krunt" if i % 2 else " aiou ouei iaea") * 400, "xx" if i % 2 else "yy", None, None) for i in range(40)])
    m = langid.train(d)
    odd = frame(spark, [(1, "zorg krunt blag", None, None, None), (2, "iaea aiou", None, None, None)])
    assert [r.lang_pred for r in langid.predict(odd, m).orderBy("doc_id").collect()] == ["xx", "yy"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op4_language(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and {r.held_out for r in got} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) > 0.97


def test_language_edges(spark):
    d = frame(spark, [(i, t, y, None, None) for i, (t, y) in enumerate([("the and of this that", "en"), ("der die das und ist", "de")] * 20)])
    m = langid.train(d)
    odd = frame(spark, [(1, None, None, None, None), (2, "", None, None, None), (3, "12 ² !!", None, None, None), (4, "der und " * 20000, None, None, None), (4, "the that", None, None, None)])
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(odd, m).orderBy("doc_id", "lang_pred").collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "en")]
    none = langid.train(d.filter("lang IS NULL"))
    assert {r.lang_pred for r in langid.predict(d, none).collect()} == {"und"} and langid.predict(d.limit(0), m).count() == 0
    kept = langid.stage(spark, d.withColumn("score", F.lit(7)), "")
    assert kept.columns == [*d.columns, "score"] and kept.count() == 40


# 7: language model


def test_lookup():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) if n != 7 else np.arange(7, dtype=np.uint64)
        look = lm.Lookup(keys)
        assert (look(keys) == np.arange(len(keys))).all() and (look(rng.integers(1 << 20, 1 << 63, 1000).astype(np.uint64)) == -1).all()


def test_planes():
    for a in (np.arange(1000, dtype="<u8") ** 3, np.array([], "<u4"), np.array([1.5, -2.25])):
        assert (lm.unplaned(lm.planes(a), a.dtype.str) == a).all()


def test_what_a_task_holds_of_a_part(monkeypatch):
    """The JVM holds parts compressed; parts of rare words follow their tokens; sums are made before all pieces are at hand."""
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 38, 100_000).astype(np.uint64))
    assert len(lm.planes(keys)) < keys.nbytes / 2 and len(lm.planes(np.ones(100_000, np.int64))) < 10_000
    often = lm.Model(900 * lm._PART_TOKENS, 10, keys[:0], np.array([90.0 * lm._PART_TOKENS]), 10)  # few words, seen again and again
    assert often.parts() == (900, 90) and lm.Model(0, 0, keys[:0], np.zeros(1)).parts() == (8, 8)
    monkeypatch.setattr(lm, "_COUNT_WINDOW", 1000)
    most, plain = 0, np.concatenate

    def told(x, *a, **b):
        nonlocal most
        most = max(most, sum(map(len, x)))
        return plain(x, *a, **b)

    monkeypatch.setattr(np, "concatenate", told)
    k, n = lm.added((np.arange(i % 3, 300, 3).astype(np.uint64), np.full(100, i + 1, np.uint32)) for i in range(600))
    assert most < 2000 and (k == np.arange(300)).all() and (n == [sum(i + 1 for i in range(r, 600, 3)) for r in (0, 1, 2)] * 100).all() and n.dtype == np.int64


@pytest.mark.parametrize(("weight", "discount"), [(2.0, 0.0), (0.3, 0.6), (30.0, 0.5)])
def test_seating(monkeypatch, weight, discount):
    monkeypatch.setattr(lm, "_AT_ONCE", 3000)
    c = np.array([0, 1, 2, 50, 5000] * 400, float)
    t = lm.seated(np.arange(len(c)).astype(np.uint64), c, np.full(len(c), weight), discount, 1)
    assert (t[c == 0] == 0).all() and (t[c == 1] == 1).all() and (t <= c).all()
    rng = np.random.default_rng(0)
    for n in (2, 50, 5000):  # customers one by one
        plain = np.ones(400)
        for i in range(1, n):
            plain += rng.random(400) < weight / (weight + i - discount * plain)
        got = t[c == n]
        assert abs(got.mean() - plain.mean()) < 5 * math.sqrt((got.var() + plain.var()) / 400 + 1e-9)
        assert abs(got.std() - plain.std()) < 0.25 * plain.std() + 0.05
    again = lm.seated(np.arange(len(c)).astype(np.uint64)[::-1], c[::-1], np.full(len(c), weight), discount, 1)[::-1]
    assert (again == t).all()


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def trained(spark, monkeypatch, texts, frequent=40):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "PAIRS", 60)
    monkeypatch.setattr(lm, "_PART_TOKENS", 500)
    monkeypatch.setattr(lm, "_PART_WORDS", 30)
    monkeypatch.setattr(lm, "_COUNT_WINDOW", 3000)
    monkeypatch.setattr(lm, "_SCORE_WINDOW", 2000)
    return lm.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))


def plain_model(model, tables, texts):
    """The model's probability of a word behind a word, from plain counts of the texts."""
    place = {int(h): i for i, h in enumerate(model.symbols)}
    rare = len(place)
    hashed = lambda w: int(lm.token_hashes(w.decode())[0]) if w else int(lm._END)
    symbol = lambda w: place.get(hashed(w), rare)
    pairs, counts = Counter(), Counter()
    for t in texts:
        ws = tokens(t)
        counts.update(ws)
        pairs.update((symbol(u), symbol(w)) for u, w in zip([b"", *ws], ws, strict=False))
    keys = np.array([(u << lm._BITS) | w for u, w in pairs], np.uint64)
    u, w, c = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.array(list(pairs.values()))
    mean = np.array([tables[int(x)] for x in keys]) / lm.SAMPLES
    assert (mean >= 1).all() and (mean <= c).all() and (mean[c == 1] == 1).all()
    seats = dict(zip(pairs, zip(c, mean, strict=True), strict=True))
    of, served = np.bincount(u, mean, minlength=rare + 1), np.bincount(u, c, minlength=rare + 1)
    odd = [x for x in counts if symbol(x) == rare]
    own = np.array([counts[x] for x in odd])
    t = [lm.seated(np.array([hashed(x) for x in odd], np.uint64), own, np.full(len(odd), (1 + model.rare_discount * max(b - 1, 0)) / (len(odd) + 1)), model.rare_discount, lm.BURN_IN + i) for i, b in enumerate(model.rare_tables[:-1])]
    t = np.mean(t, 0)
    left = (1 + model.rare_discount * t.sum()) / (len(odd) + 1)
    among = {x: (own[i] - model.rare_discount * t[i] + left) / (1 + own.sum()) for i, x in enumerate(odd)}

    def chance(u, w):
        a, b = symbol(u), symbol(w)
        n, m = seats.get((a, b), (0, 0))
        p = (n - model.discount * m + (1 + model.discount * of[a]) * model.parent[b]) / (1 + served[a])
        return p * (among.get(w, left / (1 + own.sum())) if b == rare else 1)

    return chance, counts


@pytest.mark.parametrize("frequent", [40, 1 << 18])
def test_scores_against_a_plain_model(spark, monkeypatch, frequent):
    rows = corpus(50)
    model, pairs, words = trained(spark, monkeypatch, [r[1] for r in rows], frequent)
    told = [[lm.unplaned(r[c], "<u8").tolist() for c in ("keys", "counts", "tables")] for r in pairs.collect()]
    chance, counts = plain_model(model, {k: t for ks, _, ts in told for k, t in zip(ks, ts, strict=True)}, [r[1] for r in rows])
    assert model.parent.sum() == pytest.approx(1, abs=1e-9)
    for u in [b"", *list(counts)[:30], b"never seen"]:
        assert sum(chance(u, w) for w in counts) + chance(u, b"another") == pytest.approx(1, abs=1e-9)
    new = [(900, "never seen the words of this text", None, None, None), (None, "an er", None, None, None)]
    d = frame(spark, [*rows, *new]).select("doc_id", F.lit(True).alias("held_out"), "text")
    got = {r.doc_id: r.score for r in lm.score(d, model, pairs, words).collect()}
    for i, t, *_ in [*rows, *new]:
        ws = tokens(t)
        assert got[i] == pytest.approx(sum(math.log10(chance(u, w)) for u, w in zip([b"", *ws], ws, strict=False)), rel=1e-5)
    empty = lm.train(d.select("text").limit(0))
    none = lm.score(d, *empty).collect()
    assert len(none) == len(rows) + 2 and all(r.n_known == 0 and r.score == r.base_score == 0 for r in none) and empty[0].tokens == 0


def test_batches_do_not_matter(spark, monkeypatch):
    d = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", F.lit(False).alias("held_out"), "text")
    sums = []
    for rows, parts in (("7", 5), ("1000", 2)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        got = lm.score(d.repartition(parts), *lm.train(d.repartition(parts).select("text"))).collect()
        sums.append({r.doc_id: r.score for r in got})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sums[0].keys() == sums[1].keys() and all(abs(sums[0][i] - sums[1][i]) < 1e-3 for i in sums[0])


def test_word_order_counts(spark):
    sf = "/root/testdata/sf0.01"
    d = table(spark, sf, "documents").filter("size(split(text, ' ')) > 30")
    model = lm.train(d.filter("doc_id % 7 <> 2").select("text"))
    held = d.filter("doc_id % 7 = 2").select("doc_id", F.lit(True).alias("held_out"), "text")
    mixed = held.withColumn("text", F.array_join(F.transform(F.array_sort(F.transform(F.split("text", r"\s+"), lambda w, i: F.struct(F.xxhash64(w, i).alias("h"), w.alias("w")))), lambda x: x.w), " "))
    plain = {r.doc_id: r.score for r in lm.score(held, *model).collect()}
    other = {r.doc_id: r.score for r in lm.score(mixed, *model).collect()}
    assert np.mean([plain[i] > other[i] for i in plain]) > 0.95


def test_scores_against_plain_counts(spark, tmp_path):
    rows = corpus(60) + [(None, "no id here", None, None, None), (3, "repeated id", None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = lm.op7_lm_scoring(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_better_than_add_one_on_held_out(spark):
    got = lm.op7_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_better_than_words_alone(spark):
    """The contexts tell more about held-out texts than the parent alone."""
    sf = "/root/testdata/sf0.01"
    d = table(spark, sf, "documents").select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).alias("held_out"), "text")
    model, pairs, words = lm.train(d.filter("NOT held_out").select("text"))
    held = d.filter("held_out")
    whole = lm.score(held, model, pairs, words).agg(F.sum("score")).first()[0]
    model.pair_keys, model.pair_logs = model.pair_keys[:0], model.pair_logs[:0]
    model.tables, model.parent = model.counts / model.discount, np.append(model.counts[:-1], max(model.counts[-1], 1)) / max(model.tokens, 1)
    alone = lm.score(held, model, pairs.limit(0), words).agg(F.sum("score")).first()[0]
    assert whole > alone
