import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from gravelake.llm import fingerprints, quality, sharding, url_filters
from tests.llm.util import corpus, frame


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# 1: sharding


def test_table_is_filled_in_turns():
    owners = sharding.fill_table(["a", "b", "c"], 13)
    at, step = {}, {}
    for s in "abc":
        d = hashlib.md5(s.encode()).digest()
        at[s], step[s] = int.from_bytes(d[:8], "big") % 13, int.from_bytes(d[8:], "big") % 12 + 1
    taken = {}
    walks = {s: [(at[s] + k * step[s]) % 13 for k in range(13)] for s in "abc"}
    while len(taken) < 13:
        for i, s in enumerate("abc"):
            slot = next((x for x in walks[s] if x not in taken), None)
            if slot is not None:
                taken[slot] = i
    assert owners == [taken[k] for k in range(13)]


def test_balance_and_little_moves():
    names = [f"n{i}" for i in range(10)]
    full = sharding.fill_table(names, 4099)
    loads = Counter(full)
    assert max(loads.values()) - min(loads.values()) <= 1
    rest = [n for n in names if n != "n3"]
    less = sharding.fill_table(rest, 4099)
    moved = sum(names[a] != "n3" and names[a] != rest[b] for a, b in zip(full, less, strict=True))
    assert moved < 0.15 * 4099
    assert Counter(sharding.fill_table(["a", "b"], 101, [3, 1]))[0] >= 75
    for bad in (([], 13), (["a", "a"], 13), (["a"], 12)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_sharding_edges(spark):
    d = spark.createDataFrame([(1, "x", "y"), (1, "x", "y"), (None, "z", None)], "doc_id long, slot string, shard string")
    got = sharding.assign_shards(d, "doc_id").collect()
    assert len(got) == 3 and got[0].shard in sharding.SHARDS and len({r.slot for r in got if r.doc_id == 1}) == 1 and got[0].asDict().keys() == {"doc_id", "slot", "shard"}
    assert sharding.assign_shards(d.limit(0), "doc_id").count() == 0
    assert sharding.shard_loads(sharding.assign_shards(d, "doc_id")).agg(F.sum("n_rows")).first()[0] == 3


# 5: URL filters


def test_url_filter(spark):
    from datetime import date

    entries = spark.createDataFrame(
        [("l", "bad.com", "add", date(2024, 1, 10)), ("l", "bad.com", "remove", date(2024, 2, 10)), ("l", "bad.com", "add", date(2024, 3, 10)), ("l", "bad.com", "add", date(2024, 1, 10)), ("m", "ok.org/a/b", "add", date(2024, 1, 1)), ("m", "tie.net", "add", date(2024, 1, 1)), ("m", "tie.net", "remove", date(2024, 1, 1))],
        "list string, value string, action string, since date",
    )
    rows = [
        (1, "http://user@WWW.bad.com:80/x", date(2024, 1, 9), False), (2, "http://www.bad.com/x", date(2024, 1, 10), True), (3, "https://bad.com", date(2024, 2, 10), False), (4, "https://bad.com?q", date(2024, 5, 1), True),
        (5, "https://notbad.com/", date(2024, 5, 1), False), (6, "https://ok.org/a/b/c/d", date(2024, 5, 1), True), (7, "https://ok.org/a", date(2024, 5, 1), False), (8, None, date(2024, 5, 1), False),
        (9, "garbage", date(2024, 5, 1), False), (10, "https://bad.com", None, False), (11, "https://tie.net/", date(2024, 5, 1), False), (2, "http://www.bad.com/x", date(2024, 1, 10), True),
    ]
    caps = spark.createDataFrame([r[:3] + ("h",) for r in rows], "page_id long, u string, t date, host string")
    got = url_filters.url_filter(caps, entries, "page_id", "u", "t").collect()
    assert sorted((r.page_id, r.blocked) for r in got) == sorted((r[0], r[3]) for r in rows)
    assert next(r for r in got if r.page_id == 6).entry == "ok.org/a/b" and next(r for r in got if r.page_id == 1).host == "www.bad.com"
    assert url_filters.url_filter(caps.limit(0), entries, "page_id", "u", "t").count() == 0
    assert url_filters.url_filter(caps, entries.limit(0), "page_id", "u", "t").filter("blocked").count() == 0


def test_deep_url_prefixes(spark):
    from datetime import date

    day, deep = date(2024, 1, 1), "/".join(f"s{k}" for k in range(40))
    entries = spark.createDataFrame([("l", "ok.org/a/b/c/d", "add", day), ("m", f"ok.org/{deep}", "add", day)], "list string, value string, action string, since date")
    rows = [(1, "http://ok.org/a/b/c/d/e?x", "ok.org/a/b/c/d"), (2, "http://ok.org/a/b//c/d", "ok.org/a/b/c/d"), (3, "http://ok.org/a/b/c/dd", None), (4, "http://ok.org/a/b/c", None), (5, f"http://ok.org/{deep}/x", f"ok.org/{deep}"), (6, "http://ok.org", None)]
    caps = spark.createDataFrame([(i, u, day) for i, u, _ in rows], "page_id long, u string, t date")
    assert {r.page_id: r.entry for r in url_filters.url_filter(caps, entries, "page_id", "u", "t").collect()} == {i: e for i, _, e in rows}


def test_odd_hosts(spark):
    from datetime import date

    day = date(2024, 1, 1)
    entries = spark.createDataFrame([("l", "xn.com", "add", day), ("l", "[2001:db8::1]", "add", day), ("l", "[::2]/a", "add", day)], "list string, value string, action string, since date")
    rows = [(1, "http://xn.com./a", "xn.com"), (2, "http://u:p@[2001:DB8::1]:8080/x", "[2001:db8::1]"), (3, "http://[::2]/a/b", "[::2]/a"), (4, "http://[::2]/b", None), (5, "http://[", None), (6, "http://.../", None), (7, "http://www.xn.com../" + "s/" * 20000, "xn.com")]
    caps = spark.createDataFrame([(i, u, day) for i, u, _ in rows], "page_id long, u string, t date")
    assert {r.page_id: r.entry for r in url_filters.url_filter(caps, entries, "page_id", "u", "t").collect()} == {i: e for i, _, e in rows}


# 6: quality


def base(text):
    t = text or ""
    w = split(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if split(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_and_verdicts(spark):
    rows = corpus() + [(999, "a#b *c\nsame line here\nsame line here\n\n\n<x> &|$%", "en", "s", 1), (999, "repeated row", None, None, None)]
    rows += [(1000 + i, "good words stand here in a row of plain prose number " + " ".join(f"w{(i + 1) * j % 61}" for j in range(12)), "en", "s", 1) for i in range(30)]
    labels = spark.createDataFrame([(1000 + i, 1, 0) for i in range(20)] + [(None, 1, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_filter(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    want = sorted((r[0], *base(r[1])) for r in rows)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept for r in got if 1000 <= r.doc_id < 1020) and not any(r.kept for r in got if r.base_failed)
    good = [r.score for r in got if r.doc_id >= 1020]
    junk = [r.score for r in got if r.doc_id < 999 and not r.base_failed]
    assert min(good) > max(junk)
    alone = quality.quality_filter(frame(spark, rows), labels.limit(0))
    assert alone.filter("kept = base_failed").count() == 0
    assert quality.quality_filter(frame(spark, []), labels).count() == 0


def plain_quality(rows, trusted, buckets, quantile):
    """Score and verdict of every text, by plain counts."""

    def grams(w):
        one = [xx(x) % buckets for x in w]
        return one + [xx(x, y) % buckets for x, y in zip(w, w[1:], strict=False)]

    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(split(t)))
        if i in trusted:
            good.update(grams(split(t)))
    n, m = sum(raw.values()) + buckets, sum(good.values()) + buckets
    score = {t: sum(math.log((good[g] + 1) / m) - math.log((raw[g] + 1) / n) for g in grams(split(t))) / max(1, 2 * len(split(t)) - 1) for _, t in rows}
    own = sorted(score[t] for i, t in rows if i in trusted and split(t))
    low = own[max(1, math.ceil(quantile * len(own))) - 1]
    return {t: (s, not base(t)[-1] and s > low - 1e-12) for t, s in score.items()}


def xx(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize(("buckets", "quantile"), [(97, 0.005), (1000, 0.3), (1000, 0.9)])
def test_quality_against_plain_counts(spark, buckets, quantile):
    rows = [(r[0], r[1]) for r in corpus(150, seed=5)]
    trusted = {i for i, _ in rows if i % 2}
    labels = spark.createDataFrame([(i, 1) for i in trusted] + [(i, 1) for i in trusted if i % 5 == 0] + [(2, 0)], "doc_id long, quality int")
    got = quality.quality_filter(spark.createDataFrame(rows, "doc_id long, text string"), labels, buckets=buckets, quantile=quantile).collect()
    text, want = dict(rows), plain_quality(rows, trusted, buckets, quantile)
    assert len(got) == len(rows)
    assert all(r.score == pytest.approx(want[text[r.doc_id]][0], abs=1e-12) and r.kept == want[text[r.doc_id]][1] for r in got)
    assert quantile != 0.3 or {r.kept for r in got if not r.base_failed} == {True, False}


@pytest.mark.parametrize("bins", [2, 3, 64])
def test_exact_quantile(spark, bins):
    rng = random.Random(bins)
    for values in ([], [None], [2.5], [-1.0] * 5, [1.0, math.nextafter(1.0, 2)], [5e-324, 0.0, -5e-324, 1e308], [rng.choice([rng.gauss(0, 1), 0.25, 1e-9 * rng.random()]) for _ in range(300)]):
        own = sorted(v for v in values if v is not None)
        for q in (0.0, 0.005, 0.5, 0.77, 1.0):
            want = own[max(1, math.ceil(q * len(own))) - 1] if own else None
            assert quality.exact_quantile(spark.createDataFrame([(v,) for v in values], "v double"), q, bins) == want


def test_log_ratio(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c c")], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,)], "__good long")
    r = quality.bucket_ratios(docs, trusted, buckets=8)
    of = lambda *w: spark.range(1).select(F.pmod(F.xxhash64(*map(F.lit, w)), F.lit(8))).first()[0]
    good = Counter([of("a"), of("b"), of("a", "b")])
    raw = good + Counter([of("a"), of("c"), of("c"), of("a", "c"), of("c", "c")])
    for b in range(8):
        assert r[b] == pytest.approx(math.log((good[b] + 1) / (3 + 8)) - math.log((raw[b] + 1) / (8 + 8)))
    s = quality.with_score(docs.select("doc_id", F.split("text", " ").alias("__w")), r).orderBy("doc_id").collect()
    assert s[0].score == pytest.approx((r[of("a")] + r[of("b")] + r[of("a", "b")]) / 3)


def test_every_trusted_document_counts(spark):
    n = 20_500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")).unionByName(spark.createDataFrame([(n, "b")], "doc_id long, text string"))
    trusted = quality.trusted_ids(docs.select("doc_id", F.lit(1).alias("quality")).filter(f"doc_id < {n}"))
    assert trusted.count() == n
    r = quality.bucket_ratios(docs, trusted, buckets=8)
    of = {w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(8))).first()[0] for w in "ab"}
    assert of["a"] != of["b"] and r[of["a"]] == pytest.approx(math.log((n + 1) / (n + 8)) - math.log((n + 1) / (n + 9)))


# 8: fingerprints


def sketch(text):
    w = split(text)
    h = [hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:12] for i in range(max(1, len(w) - 4))] if w else []
    return sorted({x for x in h if x < fingerprints.LIMIT})


def printed(text):
    w = split(text)
    return "".join(sketch(text)) or ("-" + hashlib.md5(" ".join(w).encode()).hexdigest()[:12] if w else "")


def near(a, b):
    x, y = set(sketch(a)), set(sketch(b))
    return len(x & y) / len(x | y) if x | y else float(printed(a) == printed(b))


def test_fingerprints(spark, tmp_path):
    rows = corpus(40)
    rows += [(i * 5000 + 7, t, "en", "s", 0) for i, (_, t, *_) in enumerate(rows[:30])]  # ids with gaps: many blocks
    rows = sorted({r[0]: r for r in rows}.values())
    frame(spark, rows).withColumn("fp", F.lit("own")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op8_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and any(r.fingerprint[:1] == "-" for r in got.values())
    for i, (k, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[k]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), printed(t), printed(edited))
        assert r.near_edited == pytest.approx(near(t, edited)) and r.near_next == pytest.approx(near(t, nxt))


def test_sketches_merge_by_union(spark):
    texts = [r[1] or "" for r in corpus(40)]
    d = frame(spark, [(i % 3, t, None, None, None) for i, t in enumerate(texts)]).select(F.col("doc_id").alias("g"), F.expr(fingerprints.sketch("text")).alias("h"))
    got = {r.g: r.h for r in fingerprints.merged(d, "g", "h").collect()}
    for g in range(3):
        shingles = {hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:12] for w in map(split, texts[g::3]) if w for i in range(max(1, len(w) - 4))}
        assert got[g] == sorted(x for x in shingles if x < fingerprints.LIMIT)


def test_fingerprint_query_edges(spark, tmp_path):
    rows = [(None, "no id", None, None, None), (None, None, None, None, None), (4, "one two three four five six " * 3000, None, None, None), (4, "repeated id", None, None, None), (4, "repeated id", None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = sorted((str(r.doc_id), r.n_chars) for r in fingerprints.op8_fingerprints(spark, f"{tmp_path}/a").collect())
    assert got == sorted((str(i), len(t or "")) for i, t, *_ in rows)
    frame(spark, []).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert fingerprints.op8_fingerprints(spark, f"{tmp_path}/b").count() == 0


def test_fingerprint_edges(spark):
    one = spark.createDataFrame([(None, "x y"), (5, "same"), (5, "same")], "k long, text string")
    got = fingerprints.with_next(one, "k", ["text"]).collect()
    assert sorted((str(r.k), r.next_text) for r in got) == [("5", "same"), ("5", "x y"), ("None", "same")]
    assert fingerprints.with_next(one.limit(0), "k", ["text"]).count() == 0
    assert fingerprints.with_next(one.limit(1), "k", ["text"]).first().next_text == "x y"
    d = spark.createDataFrame([("g", ["a", "b"]), ("g", ["b", "c"])], "g string, h array<string>")
    assert fingerprints.merged(d, "g", "h").first().h == ["a", "b", "c"]
    c = spark.sql(f"SELECT {fingerprints.containment('array(1, 2)', 'array(2, 3, 4)')} AS c").first().c
    assert c == 0.5


@pytest.mark.parametrize("name", ["op1_sharding", "op3_ngram_join", "op5_url_filters", "op8_fingerprints"])
def test_sql(spark, sf, name):
    import glob
    import os

    from gravelake.llm import queries

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want, got = con.sql(queries.oracle_sql()[name]), queries.QUERIES[name](spark, sf)
    order = lambda names, rows: sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in rows)
    assert order(got.columns, got.collect()) == order(want.columns, want.fetchall())


def test_native_plans_have_no_python(spark, sf):
    from gravelake.llm import queries

    for n in ("op1_sharding", "op5_url_filters", "op6_quality", "op8_fingerprints"):
        plan = queries.QUERIES[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), n
