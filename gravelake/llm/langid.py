"""Language identification by a linear-chain conditional random field over the words of a text.

Every word carries a label, its language. A word's emission scores are the summed weights of its affixes, of
its letter bigrams and trigrams and of the word itself (a hashed lexicon); transition scores between labels
are learned with them by maximum likelihood. Training sequences are spans of labelled documents, some of them
spliced from two or three languages, so that the model learns how rarely a text switches. Forward-backward
gives each word's label probabilities, whichever language its neighbours speak; a document's probabilities
are their means over its words, and its language is the most probable one.

The model is fitted on a bounded sample: `DOCS` documents of each language, by hash, and `SPANS` spans of up to `SPAN` words
at drawn places anywhere in the whole text of each; of these the field sees `SEQUENCES` sequences. Predictions read
every letter of every text. A run of more than 24 letters is cut into slices of 12 to 24, each labelled as a word is:
neighbours overlap so that every bigram and trigram of the run counts once, and only the run's own ends have affixes.

Results at the edges: a null text or one without letters is `und` with score 0; with no labelled document
everything is `und`; ties go to the first language in order; repeated rows get equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gravelake.llm.common import bounded_batches, column, free_name, numbered, table

UNKNOWN = "und"
DOCS = 250
SPANS = 24
SPAN = 40
SEQUENCES = 3_000
BUCKETS = 1 << 16
_WIDTH = 24
_SLICE, _START, _STOP = "\0\1\2"
_WORD = re.compile(r"[^\W\d_]+")
_STEP_WORDS = 200_000
_CACHED = 150_000


def words(text: str | None) -> list[str]:
    found = _WORD.findall((text or "").lower())
    if not any(any(map(str.isalpha, w)) for w in found):
        return []
    return [s for w in found for s in slices(w)] if any(len(w) > _WIDTH for w in found) else found


def slices(word: str) -> list[str]:
    """A word of up to 24 letters as it is; a longer run in near equal slices, each a mark and the letters with one neighbour or boundary on either side."""
    if len(word) <= _WIDTH or word[0] == _SLICE:
        return [word]
    padded, k = f"{_START}{word}{_STOP}", -(-len(word) // _WIDTH)
    cuts = [len(word) * j // k for j in range(k + 1)]
    return [_SLICE + padded[a : z + 2] for a, z in zip(cuts, cuts[1:], strict=False)]


def word_features(batch: Sequence[str]) -> np.ndarray:
    """Bucket numbers of the features of each word or slice, one row each; bucket 0 stands for none."""
    short = [w[1:] if w[:1] == _SLICE else f"{_START}{w}{_STOP}" for x in batch for w in slices(x)]
    n = np.array([len(w) - 2 for w in short], np.int64)
    chars = np.array(short, f"<U{_WIDTH + 2}").view(np.uint32).reshape(len(short), _WIDTH + 2).astype(np.uint64)
    rows = np.arange(len(short))
    opens, closes = chars[:, 0] == ord(_START), chars[rows, n + 1] == ord(_STOP)
    columns: list[np.ndarray] = []

    def put(h: np.ndarray, kind: int, there: np.ndarray) -> None:
        h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        columns.append(np.where(there, (h >> np.uint64(40)) % np.uint64(BUCKETS - 1) + np.uint64(1), np.uint64(0)).astype(np.int64))

    a, b, p = np.uint64(1_000_003), np.uint64(998_244_353), np.uint64(0x100000001B3)
    for i in range(_WIDTH + 1):
        two = chars[:, i] * a + chars[:, i + 1]
        put(two, 1, (n >= i) if i else opens)  # a slice within a run leaves its first bigram to the one before
        if i < _WIDTH:
            put(two * b + chars[:, i + 2], 2, n > i)
    whole = np.zeros(len(short), np.uint64)
    for i in range(1, _WIDTH + 1):
        whole = np.where(n >= i, whole * p + chars[:, i], whole)
        if i in (2, 3, 4):
            put(whole, 10 + i, opens & (n >= i))  # beginnings
    put(whole, 3, n > 0)  # the word itself
    end = np.zeros(len(short), np.uint64)
    for i in range(1, 5):
        end = end * p + chars[rows, np.maximum(n + 1 - i, 0)]
        if i > 1:
            put(end, 20 + i, closes & (n >= i))  # endings
    return np.stack(columns, 1)


@dataclass
class Field:
    languages: list[str]
    emit: np.ndarray  # buckets by languages
    move: np.ndarray  # languages by languages

    def emissions(self, batch: Sequence[str]) -> np.ndarray:
        out = np.empty((len(batch), len(self.languages)), np.float32)
        for i in range(0, len(batch), 8192):
            f = word_features(batch[i : i + 8192])
            total = np.zeros((len(f), len(self.languages)), np.float32)
            for column in f.T:
                total += self.emit[column]
            out[i : i + 8192] = total
        return out


def forward_backward(emission: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and expected transitions, of sequences laid end to end.

    Sequences must come longest first: at each step those that still have words are the first ones.
    """
    k = emission.shape[1]
    e = np.exp(emission - emission.max(1, keepdims=True))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    m = np.exp(move).astype(e.dtype)
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # sequences of at least t words
    alpha, out = np.empty_like(e), np.empty_like(e)
    pairs = np.zeros((k, k))
    prev = None
    for t in range(steps):
        at = starts[: active[t]] + t
        a = e[at] if prev is None else (prev[: active[t]] @ m) * e[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = prev = a
    beta = np.ones((len(lengths), k), e.dtype)
    for t in range(steps - 1, -1, -1):
        at = starts[: active[t]] + t
        n = active[t + 1] if t + 1 < steps else 0
        if n:
            ahead = e[starts[:n] + t + 1] * beta[:n]
            back = ahead @ m.T
            joint = alpha[at[:n]]
            scale = 1 / np.maximum((joint * back).sum(1, keepdims=True), 1e-30)
            pairs += m * ((joint * scale).T @ ahead)
            beta[:n] = back / back.sum(1, keepdims=True)
        p = alpha[at] * beta[: active[t]]
        out[at] = p / np.maximum(p.sum(1, keepdims=True), 1e-30)
    return out, pairs


def _sequences(docs: list[tuple[int, list[str]]], rng: np.random.Generator, n: int) -> list[tuple[list[str], list[int]]]:
    """Spans of one language, and a third spliced from up to three."""
    docs = [d for d in docs if d[1]]
    by: dict[int, list[list[str]]] = {}
    for y, ws in docs:
        by.setdefault(y, []).append(ws)
    labels, out = sorted(by), []
    for i in range(n):
        ws_all, ys = [], []
        y = labels[i % len(labels)]
        for part in range(int(rng.integers(2, 4)) if i % 3 == 0 else 1):
            if part:
                y = labels[int(rng.integers(len(labels)))]
            ws = by[y][int(rng.integers(len(by[y])))]
            size = int(rng.integers(5, 40))
            at = int(rng.integers(max(1, len(ws) - size + 1)))
            ws_all += ws[at : at + size]
            ys += [y] * len(ws[at : at + size])
        out.append((ws_all, ys))
    return out


def spans(text: str | None, seed: int) -> list[list[str]]:
    """The words of drawn spans of a text: all of it, or `SPANS` spans of `SPAN` words that may start anywhere."""
    ws = words(text)
    if len(ws) <= SPAN:
        return [ws] if ws else []
    starts = np.random.default_rng(seed).integers(0, len(ws) - SPAN + 1, SPANS)
    return [ws[a : a + SPAN] for a in starts.tolist()]


def fit(docs: list[tuple[str, str]], sequences: int = SEQUENCES, batch: int = 100, epochs: int = 4, seed: int = 7) -> Field:
    """docs: language and text."""
    return fit_spans([(lang, words(text)) for lang, text in docs], sequences, batch, epochs, seed)


def fit_spans(docs: list[tuple[str, list[str]]], sequences: int = SEQUENCES, batch: int = 100, epochs: int = 4, seed: int = 7) -> Field:
    """docs: language and words."""
    languages = sorted({lang for lang, _ in docs})
    k = len(languages)
    field = Field(languages, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)))
    rng = np.random.default_rng(seed)
    seqs = _sequences([(languages.index(lang), ws) for lang, ws in docs], rng, sequences) if any(ws for _, ws in docs) else []
    if k < 2 or not seqs:
        return field
    vocabulary = sorted({w for ws, _ in seqs for w in ws})
    number = {w: i for i, w in enumerate(vocabulary)}
    f = np.concatenate([word_features(vocabulary[i : i + 8192]) for i in range(0, len(vocabulary), 8192)])
    coded = [(np.array([number[w] for w in ws]), np.array(ys)) for ws, ys in seqs]
    seen, seen_moves = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    emit = np.zeros((BUCKETS, k))
    for _ in range(epochs):
        order = rng.permutation(len(coded))
        for at in range(0, len(order), batch):
            part = sorted((coded[i] for i in order[at : at + batch]), key=lambda s: -len(s[0]))
            ids, ys = np.concatenate([s[0] for s in part]), np.concatenate([s[1] for s in part])
            lengths = np.array([len(s[0]) for s in part])
            unique, back = np.unique(ids, return_inverse=True)
            p, pairs = forward_backward(emit[f[unique]].sum(1)[back], lengths, field.move)
            p[np.arange(len(ys)), ys] -= 1
            per_word = np.zeros((len(unique), k))
            np.add.at(per_word, back, p / len(part))
            flat = f[unique].ravel()
            g = np.stack([np.bincount(flat, np.repeat(per_word[:, c], f.shape[1]), minlength=BUCKETS) for c in range(k)], 1)
            g[0] = 0
            seen += g * g
            emit -= 0.1 * g / np.sqrt(seen)
            first = np.cumsum(lengths)[:-1]
            inner = np.ones(len(ys), bool)
            inner[0] = False
            inner[first] = False
            told = np.zeros((k, k))
            np.add.at(told, (ys[np.flatnonzero(inner) - 1], ys[inner]), 1)
            gm = (pairs - told) / len(part)
            seen_moves += gm * gm
            field.move -= 0.1 * gm / np.sqrt(seen_moves)
    field.emit = emit.astype(np.float32)
    return field


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCS) -> Field:
    """A model from documents with a language: a hashed sample of each, and spans of each document."""
    d = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("y"), F.col(text).alias("t"))
    d = d.withColumn("h", F.xxhash64("k"))
    ids = d.select("k", "y", "h").distinct().withColumn("r", F.row_number().over(W.partitionBy("y").orderBy("h", "k"))).filter(F.col("r") <= per_language)
    rows = d.join(F.broadcast(ids.select("k", "y")), ["k", "y"]).groupBy("k", "y", "h").agg(F.min_by("t", F.xxhash64("t")).alias("t"))  # one text an id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(y, h, spans(t, h & 0xFFFFFFFF)) for y, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            flat = [(y, h, i, ws) for y, h, s in found for i, ws in enumerate(s)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())))], ["y", "h", "i", "w"])

    drawn = rows.select("y", "h", "t").mapInArrow(run, "y string, h bigint, i int, w array<string>").collect()  # per_language times SPANS rows a language
    known = {r.y for r in ids.select("y").distinct().collect()}
    empty = [(y, []) for y in sorted(known - {r.y for r in drawn})]
    return fit_spans(empty + [(r.y, r.w) for r in sorted(drawn, key=lambda r: (r.y, r.h, r.i))])


def predict(df: DataFrame, model: Field, keep: Sequence[str] = ("doc_id",), text: str = "text", names: Sequence[str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns, the language and its score, named as told."""
    at = len(keep)
    read = list(keep).index(text) if text in keep else at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        scores = np.zeros((0, len(model.languages)), np.float32)
        for b in batches:
            coded: list[np.ndarray] = []
            for t in b.column(read):
                ws = words(t.as_py())
                missing = [w for w in set(ws) if w not in number]
                if missing:
                    number.update(zip(missing, range(len(number), len(number) + len(missing)), strict=True))
                coded.append(np.fromiter(map(number.__getitem__, ws), np.int32, len(ws)))
            if len(number) > len(scores):
                new = list(number)[len(scores) :]
                scores = np.concatenate([scores, model.emissions(new)])
            order = sorted(range(len(coded)), key=lambda i: -len(coded[i]))
            langs, certain = np.full(len(coded), -1), np.zeros(len(coded))
            i = 0
            while i < len(order) and len(coded[order[i]]) and len(model.languages):
                j, n = i, 0
                while j < len(order) and len(coded[order[j]]) and (j == i or n + len(coded[order[j]]) <= _STEP_WORDS):
                    n += len(coded[order[j]])
                    j += 1
                lengths = np.array([len(coded[x]) for x in order[i:j]])
                p, _ = forward_backward(scores[np.concatenate([coded[x] for x in order[i:j]])], lengths, model.move)
                mean = np.add.reduceat(p.astype(np.float64), np.concatenate([[0], np.cumsum(lengths)[:-1]])) / lengths[:, None]
                langs[order[i:j]], certain[order[i:j]] = mean.argmax(1), np.clip(mean.max(1), 0, 1)
                i = j
            told = [model.languages[x] if x >= 0 else UNKNOWN for x in langs]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(told, pa.string()), pa.array(certain)], [*keep, *names])
            if len(number) > _CACHED:
                number, scores = {}, scores[:0]

    bounded_batches(df.sparkSession)
    schema = StructType([*[StructField(c, df.schema[c].dataType) for c in keep], StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return numbered(df, [*keep, *([] if text in keep else [text])]).mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    d = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return predict(d, model, keep=("doc_id", "held_out"))


LEAST_SCORE = 0.35


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows and is sure of."""
    model = train(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    lang, score = (free_name(c, docs.columns) for c in ("lang_pred", "score"))
    scored = predict(docs, model, keep=docs.columns, names=(lang, score))
    return scored.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*map(column, docs.columns))
