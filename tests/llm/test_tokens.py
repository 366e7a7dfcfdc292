import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gravelake.llm import packing, spm
from gravelake.llm.common import table
from tests.llm.util import corpus, frame

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [" " * k + "a" * (k % 3) for k in range(70)] + ["x" * 5000, "ab" * 2000, "日" * 300, "a▁b", "\x00", "<0x41><s>", "a\r\n\r\nb", "x \n y  z", "it's I'LL 12 345", "a\x1cb \x1c c", "\xa0b　c d﻿e", "<|endoftext|>"]


def test_prefix_table_equals_the_library(spark):
    enc = spm.encoder(MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in [*ODD, *[r[1] or "" for r in corpus(60)]]:
        ids = enc.encode(t)
        assert ids == lib.encode(t), t[:50]
        assert enc.decode(ids) == lib.decode(ids)


@pytest.mark.parametrize("run", ["0123456789" * 1000, "日" * 10_000, "7" * 10_000 + "日" * 10_000 + "the", "☃" * 10_000])
def test_long_runs(run):
    enc = spm.encoder(MODEL)
    for t in (run, f"a {run} b"):
        assert enc.encode(t) == enc.sp.encode(t)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdeinrst THE.,\n▁é日☃\t0'"), max_size=60))
def test_any_text(text):
    enc = spm.encoder(MODEL)
    assert enc.encode(text) == enc.sp.encode(text)


UNTOUCHED = Tokenizer.from_file(BYTES)
PARTS = ["<|endoftext|>", "<|endoftext", "|>", "a", "the ", " The", "N't", "'ll", "'", " ", "  ", "\n", "\r\n", "\t", "12", " 345", "!?", "...", "é", "ÀÖ", "ſ", "ß", "×", "日", "☃", "\u00a0", "\u2028", "\x1c", "²", "_", "x" * 30]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4), st.text(st.sampled_from("abcdeinrst THE.,\n▁é日☃\t0'"), max_size=20)), max_size=30).map("".join))
def test_byte_ids_of_any_text(text):
    t = packing.tokenizer_ids(BYTES)
    assert np.frombuffer(t.of(text), "<u4").tolist() == UNTOUCHED.encode(text, add_special_tokens=False).ids


def test_encoding_query(spark, tmp_path):
    rows = corpus(30)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in spm.op9_sentencepiece(spark, str(tmp_path)).collect()}
    for i, t, *_ in rows:
        ids = lib.encode(t or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    ids = spm.encode_texts(frame(spark, rows), MODEL)
    back = {r.doc_id: r.text for r in spm.decode_ids(ids, MODEL).collect()}
    assert all(back[i] == lib.decode(lib.encode(t or "")) for i, t, *_ in rows)


def test_recent_forgets():
    r = spm.Recent(lambda k: k.upper(), 4)
    assert [r[x] for x in "abcdefab"] == list("ABCDEFAB") and len(r) <= 4 and len(r.old) <= 4


def test_byte_ids_equal_the_library():
    t = packing.tokenizer_ids(BYTES)
    lib = Tokenizer.from_file(BYTES)
    for x in [*ODD, *[r[1] or "" for r in corpus(60)]]:
        assert np.frombuffer(t.of(x), "<u4").tolist() == lib.encode(x, add_special_tokens=False).ids, x[:50]
    assert t.quick is not None


def test_cut():
    assert packing.cut(5, 2) == [(0, 1), (1, 2), (3, 2)] and packing.cut(4, 2) == [(0, 2), (2, 2)] and packing.cut(1, 2) == [(0, 1)]


def bins_of(plan):
    bins = defaultdict(list)
    for n, rank, k, first, each, at in plan:
        for j in range(k):
            bins[first + j // each].append((at + j % each * n, n))
    return bins


def gapless(bins, capacity):
    for b in bins.values():
        end = 0
        for at, n in sorted(b):
            assert at == end
            end += n
        assert end <= capacity


def plain_best_fit(lengths, capacity):
    plain: list[int] = []  # longest first, one by one
    for n in sorted(lengths, reverse=True):
        fit = [i for i, free in enumerate(plain) if free >= n]
        if fit:
            plain[min(fit, key=lambda i: plain[i])] -= n
        else:
            plain.append(capacity - n)
    return len(plain)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.lists(st.integers(1, 30), max_size=40))
def test_sweep(pieces, gaps):
    rows = [(packing.PIECE, n, 10 * i, 1 + i % 3, 0, 0, 0) for i, n in enumerate(pieces)] + [(packing.GAP, n, 10 * i, 1 + i % 4, 5, 0, 0) for i, n in enumerate(gaps)]
    out = packing.sweep(rows)
    n_of = lambda rs, kind: sum(r[3] for r in rs if r[0] == kind)
    assert n_of(out, packing.PIECE) + n_of(out, packing.PAIR) == n_of(rows, packing.PIECE)
    left = [r[1] for r in out if r[0] == packing.PIECE]
    assert all(not left or r[1] < min(left) for r in out if r[0] == packing.GAP)  # no gap is left that a piece fits
    room = {g: 10 * i for i, g in enumerate(gaps)}
    assert all(r[1] * r[5] <= max(gaps) and r[3] % r[5] == 0 for r in out if r[0] == packing.PAIR) and (room or not n_of(out, packing.PAIR))


@pytest.mark.parametrize("case", range(6))
def test_best_fit(spark, case):
    rng = random.Random(case)
    lengths = [[], [64] * 9, [1] * 300, [rng.randint(1, 64) for _ in range(300)], [rng.choice([30, 33, 21, 5, 2]) for _ in range(400)], [rng.randint(1, 9) for _ in range(200)]][case]
    plan = [tuple(r) for r in packing.best_fit(spark, {n: lengths.count(n) for n in set(lengths)}, 64).collect()]
    bins = bins_of(plan)
    assert sorted(n for b in bins.values() for _, n in b) == sorted(lengths)
    gapless(bins, 64)
    assert len(bins) <= 1.01 * plain_best_fit(lengths, 64) + 1


def test_packing_query(spark, tmp_path):
    rows = corpus(60)
    frame(spark, [*rows, rows[0]]).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op10_packing(spark, str(tmp_path)).collect()
    lib = Tokenizer.from_file(BYTES)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, t, *_ in rows[1:]:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids) and all(r.length == 2048 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    assert len(pieces[rows[0][0]]) == 2
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for at, n in sorted(b):
            assert at == end
            end += n
        assert end <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [0, 1000])
def test_ranks_across_salts(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "_SALTED", 7)
    monkeypatch.setattr(packing, "_PLAN_ROWS", rows)
    rng = random.Random(3)
    p = spark.createDataFrame([(i, 0, 0, rng.choice([5, 5, 5, 3, 2]), 1) for i in range(300)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.packed(p, 10).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 300 and all(sum(n for _, n in b) <= 10 and len({at for at, _ in b}) == len(b) for b in bins.values())
    assert len(bins) <= -(-sum(r.length for r in got) // 10) + 1


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    from gravelake.llm.common import staged

    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, sf))
        if name != "packing":
            assert out.columns == docs.columns and 0.7 * docs.count() <= out.count() <= docs.count()
            docs = out
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


CLASHING = ["slot", "score", "Lang_Pred", "_score", "component_id", "length", "__of", "_" * 3 + "of", "__id", "__TH", "__score_in", "__P_toxic", "p_toxic", "a.b", "a`b"]


@pytest.mark.parametrize("number", [False, True])
def test_clashing_columns(spark, number):
    """Columns of any name keep their values through the stages."""
    from gravelake.llm import langid, ngram_join
    from gravelake.llm.common import column

    d = frame(spark, corpus(20))
    for i, name in enumerate(CLASHING):
        d = d.withColumn(name, F.col("doc_id") * 100 + i if number else F.concat(F.lit(f"{i} of "), "doc_id"))
    for stage in (langid.stage, ngram_join.stage):
        out = stage(spark, d, "")
        assert out.columns == d.columns and out.dtypes == d.dtypes
        rows = out.select("doc_id", "text", *[column(c).alias(f"c{i}") for i, c in enumerate(CLASHING)]).collect()
        texts = {r[0]: r[1] for r in corpus(20)}
        assert rows and all(texts[r.doc_id] == r.text for r in rows)
        assert all(r[f"c{i}"] == (r.doc_id * 100 + i if number else f"{i} of {r.doc_id}") for r in rows for i in range(len(CLASHING)))
    assert packing.pack(d).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_pipeline_edges(spark, sf):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names through all stages."""
    import corpus_pipeline
    from gravelake.llm.common import staged

    docs = table(spark, sf, "documents")
    plain = docs.filter("lang = 'en' AND length(text) > 200").orderBy("doc_id").limit(1).first().text
    rng, w = random.Random(2), plain.split()
    copied, long = (" ".join(rng.choice(w) for _ in range(n)) for n in (60, 60_000))
    none = dict.fromkeys(docs.columns)
    odd = [none, none | {"doc_id": 1_000_001}, none | {"doc_id": 1_000_002, "text": ""}, none | {"doc_id": 1_000_003, "text": " 12 !"}]
    odd += [none | {"doc_id": 1_000_004, "text": copied, "lang": "en"}] * 3  # repeated rows
    odd += [none | {"doc_id": 1_000_005, "text": copied, "lang": "en"}, none | {"text": copied}]  # an equal text, and one without id
    odd += [none | {"doc_id": 1_000_006, "text": long, "lang": "en"}]
    d = docs.unionByName(spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in odd], docs.schema))
    for name in CLASHING:
        d = d.withColumn(name, F.xxhash64("doc_id", "text"))
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, staged(stage(spark, d, sf))
        if name != "packing":
            assert d.columns == before.columns and d.dtypes == before.dtypes
            assert d.exceptAll(before).isEmpty()
            assert d.filter(" OR ".join(f"NOT `{c.replace('`', '``')}` <=> xxhash64(doc_id, text)" for c in CLASHING)).isEmpty()
            ids = [r.doc_id for r in d.select("doc_id").collect()]
            assert not {1_000_001, 1_000_002, 1_000_003} & set(ids)
        if name == "language":
            assert ids.count(1_000_004) == 3 and ids.count(None) == 1 and {1_000_005, 1_000_006} <= set(ids)
        if name == "near_duplicates":  # the first row of the group, once
            assert ids.count(1_000_004) == 1 and {1_000_005, None}.isdisjoint(ids) and 1_000_006 in ids
            kept = set(ids)
    assert {r.doc_id for r in d.select("doc_id").collect()} == kept
    d = table(spark, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, staged(stage(spark, d, sf))
        assert d.isEmpty() and (name == "packing" or d.columns == before.columns)


def test_staged_tables_go(spark, tmp_path):
    import os

    from gravelake.llm.common import shared_dir, staged, unstaged

    d = staged(frame(spark, corpus(3)))
    assert d.count() and os.path.isdir(d.staged_at) and d.staged_at.startswith(shared_dir(spark))
    unstaged(d, None)
    assert not os.path.exists(d.staged_at)
