import numpy as np
import pytest

from gravelake.llm import ngram_join as J
from tests.llm.util import corpus, frame


def brute(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    at = {i: i for i in sets}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s = len(sets[a] & sets[b])
            if s and 100 * s >= 75 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                at[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}, links


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [3, 16])
def test_against_brute_force(spark, seed, small, monkeypatch):
    monkeypatch.setattr(J, "_SMALL", small)
    monkeypatch.setattr(J, "_BLOCK_SETS", 20)
    monkeypatch.setattr(J, "_BLOCK_ROWS", 3_000 * seed)
    rows = corpus(120, seed)
    base = " ".join(f"w{k}" for k in range(90)).split()
    for j in range(25):  # a chain and a large group of near copies
        v = list(base)
        for k in range(j):
            v[k] = f"x{k}"
        rows.append((5000 + j, " ".join(v), "en", "s", 0))
        u = list(base)
        u[20 + j] = f"y{j}"
        rows += [(6000 + 40 * j + c, " ".join(u), "en", "s", 0) for c in range(1 + j % 3)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in J.similar_components(frame(spark, rows).repartition(5), parts=3).collect()}
    same, links = brute(rows)
    assert got == {i: (*same[i], links[i]) for i in same}


def test_block_links():
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(10_000, 60, replace=False))
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, 60, rng.integers(0, 12))), rng.integers(0, 10_000, rng.integers(0, 9))])).astype(np.int64) for _ in range(50)]
    sets += [np.arange(k, k + 7) for k in range(20)]
    weights = rng.integers(1, 5, len(sets))
    link = np.array([[100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)) for b in sets] for a in sets])
    np.fill_diagonal(link, False)

    def joined(pairs, m):
        label = list(range(m))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return [[x == y for y in label] for x in label]

    degree, out = J.block_links(sets, None, weights)
    assert (degree == link @ weights).all() and joined(out, 70) == joined(zip(*np.nonzero(link), strict=True), 70) and all(link[p] for p in out)
    cross = link.copy()
    cross[:33, :33] = cross[33:, 33:] = False
    degree, out = J.block_links(sets[:33], sets[33:], weights)
    assert (degree == cross @ weights).all() and joined(out, 70) == joined(zip(*np.nonzero(cross), strict=True), 70) and all(cross[p] for p in out)


def test_large_groups(spark, monkeypatch):
    """Some thousand near copies and exact copies: every link is counted."""
    base = [f"w{k}" for k in range(60)]
    rows = []
    for j in range(2500):
        v = list(base)
        v[j % 60] = f"y{j}"
        rows.append((j, " ".join(v), "en", "s", 0))
    rows += [(10_000 + j, " ".join(base), "en", "s", 0) for j in range(2000)]
    got = {r.doc_id: (r.component_id, r.n_links) for r in J.similar_components(frame(spark, rows).repartition(6)).collect()}
    n, edited = 56, lambda a: {x for x in range(a - 4, a + 1) if 0 <= x < 56}  # the shingles that an edit changes
    own = [len(edited(p)) for p in range(60)]
    per = [2500 // 60 + (p < 2500 % 60) for p in range(60)]
    for p in range(60):
        links = 2000 * (100 * (n - own[p]) >= 75 * (n + own[p])) - 1
        for q in range(60):
            s = n - len(edited(p) | edited(q))
            links += per[q] * (100 * s >= 75 * (2 * n - s))
        assert got[p] == (0, links)
    assert got[10_000] == (0, 1999 + sum(per))


def test_edges(spark):
    d = frame(spark, [(1, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (None, "a b c d e f", None, None, None), (3, "A  B c\nd e F", None, None, None), (4, None, None, None, None), (5, "", None, None, None), (6, "a b", None, None, None), (7, "A b", None, None, None), (7, "another text under this id", None, None, None), (None, "no id at all", None, None, None)])
    got = sorted(map(str, J.similar_components(d).collect()))
    want = [(1, 2, 1, 3), (1, 2, 1, 3), (None, 2, 1, 3), (3, 2, 1, 3), (4, 0, 4, 0), (5, 0, 5, 0), (6, 1, 6, 1), (7, 1, 6, 1), (7, 1, 7, 0), (None, 1, None, 0)]
    assert got == sorted(f"Row(doc_id={a}, n_shingles={b}, component_id={c}, n_links={e})" for a, b, c, e in want)
    assert J.similar_components(frame(spark, [])).count() == 0 and J.stage(spark, frame(spark, []), "").count() == 0
    kept = sorted((str(r.doc_id), r.text or "") for r in J.stage(spark, d, "").collect())
    assert kept == [("1", "a b c d e f"), ("4", ""), ("5", ""), ("6", "a b"), ("7", "another text under this id"), ("None", "no id at all")]


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for n in (1, 5, 40, 300, 3000):
        for m in (n, max(1, n * 3 // 4)):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: m // 2], rng.integers(0, 1 << 63, m - m // 2).astype(np.uint64)]))
            s = J.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
            assert J.distance(*s) <= len(np.setxor1d(a, b)) and J.distance(s[0], s[0]) == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    for trial in range(300):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        cut = int(rng.integers(0, n // 7 + 1))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)]))
        s, u = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * s < 75 * u:
            continue
        frequent = np.sort(rng.choice(a, len(a) // 2, replace=False)) if trial % 3 == 0 else np.zeros(0, np.uint64)
        keys, owner = J.sketch_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), frequent)
        assert set(keys[owner == 0]) & set(keys[owner == 1]), (n, len(b))


def test_components(spark):
    e = spark.createDataFrame([(2, 1), (3, 2), (9, 8), (7, 9), (4, 3), (5, 4)], "a long, b long")
    assert {r.id: r.component for r in J.components(e).collect()} == {2: 1, 3: 1, 4: 1, 5: 1, 8: 7, 9: 7}
