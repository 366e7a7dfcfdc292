"""Quality classifier by positive-unlabelled learning.

Trusted texts are positive, every text of the corpus is unlabelled, and no label says "bad". The model is linear
in a fixed set of features of a text's form (shares of characters, shapes and repetition of words and lines,
each spread over soft bins). With squared loss l(z) = (1 - z)^2 / 4 and class prior c, the non-negative risk is

    c * E_P[l(z)] + max(0, E_U[l(-z)] - c * E_P[l(-z)]),

the larger of two convex quadratics. Both depend on the data through first and second moments of the features only, so one
pass over all unlabelled texts and one over all trusted ones is all that fitting reads, and the minimum is exact:
weights for a mixture of the two quadratics are a linear solve, and the mixture at which the second
term is neither negative nor, inside the interval, positive is found by bisection.

The prior is estimated: the same moments give the density ratio of trusted to unlabelled texts by least squares; over the sets of
texts with a ratio above a threshold, the share of unlabelled over the share of trusted texts bounds the prior from above, and its
least value is taken, at the threshold where the bound with sampling errors is least. All texts are counted for it, by bins of the ratio,
which is fitted on the trusted texts of one half and applied to the texts of the other.

Features are written once; a task holds one matrix of the size of the features squared, and so do the tasks that
merge them. No text is sampled, cut or moved; ids of trusted texts meet the features in a semi join. The features of held-out
rows are part of the unlabelled corpus, their labels of nothing.

Results at the edges: null and empty texts have features of their own and are scored; without trusted or without any texts
every score is 0.5; an id is trusted if it has a label and all of its labels say 1; null labels and ids are ignored in the labels;
a null id is not held out; repeated rows count as often as they stand and get equal scores; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelake.llm.common import bounded_batches, merged_in_tasks, staged, table, unstaged

RIDGE = 1e-3
KNOTS, SHAPES = 8, 64
#: Characters with a class of their own; letters, digits, marks and the rest have one each by their kind.
_OWN = " \n.,!?;:'\"-()#*$%&|<>/@_=+"
_LOWER, _UPPER, _LETTER, _DIGIT, _MARK, _SPACE, _OTHER = range(len(_OWN), len(_OWN) + 7)
_CLASSES = len(_OWN) + 7
_SCALARS = _CLASSES + 12
DIMENSIONS = 1 + _SCALARS * KNOTS + SHAPES
#: A long text is read in pieces of about so many characters, cut at white space.
_PIECE = 1 << 20
_BINS, _BIN = 4_000, 0.001


def _class_of(c: str) -> int:
    kind = unicodedata.category(c)
    if c in _OWN:
        return _OWN.index(c)
    return _SPACE if c.isspace() else _LOWER if kind == "Ll" else _UPPER if kind in ("Lu", "Lt") else _LETTER if kind[0] == "L" else _DIGIT if kind[0] == "N" else _MARK if kind[0] == "M" else _OTHER


_TABLE = np.array([_class_of(chr(i)) for i in range(0x3000)], np.uint8)


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[np.minimum(codes, len(_TABLE) - 1)]
    far = codes >= len(_TABLE)
    if far.any():
        kinds, at = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([_class_of(chr(c)) for c in kinds], np.uint8)[at]
    return out


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > _PIECE:
        end = max(text.rfind(" ", at, at + _PIECE), text.rfind("\n", at, at + _PIECE)) + 1
        end = end if end > at else at + _PIECE
        yield text[at:end]
        at = end
    yield text[at:]


def features(text: str | None) -> np.ndarray:
    text = text or ""
    kinds, shapes, sizes = np.zeros(_CLASSES), np.zeros(SHAPES), np.zeros(3)
    marked = upper = capital = 0
    for piece in _pieces(text):
        c = classes(piece)
        kinds += np.bincount(c, minlength=_CLASSES)
        gap = (c == 0) | (c == 1) | (c == _SPACE)
        own = np.append(c[~gap], 255)
        if len(own) == 1:
            continue
        after = np.append(True, gap[:-1])[~gap]  # first character of a word
        first = np.flatnonzero(after)
        sizes += [len(first), len(own) - 1, (np.diff(np.append(first, len(own) - 1)).astype(float) ** 2).sum()]
        run = np.flatnonzero(after | np.append(True, own[1:-1] != own[:-2]))  # runs of one class in a word
        word = np.cumsum(after) - 1
        word_of = word[run]
        place = np.arange(len(run)) - np.searchsorted(run, first)[word_of]
        h = np.bincount(word_of, (own[run] + 1.0) * (1 + 7 * np.minimum(place, 9)) ** 2, minlength=len(first)).astype(np.int64)
        shapes += np.bincount((h * 2654435761 >> 8) % SHAPES, minlength=SHAPES)
        kind = own[:-1]
        letters = np.bincount(word, kind >= _LOWER, minlength=len(first)) - np.bincount(word, kind == _OTHER, minlength=len(first))
        caps = np.bincount(word, kind == _UPPER, minlength=len(first))
        low = np.bincount(word, (kind == _LOWER) | (kind == _LETTER), minlength=len(first))
        marked += int((letters < np.diff(np.append(first, len(kind)))).sum())
        upper += int(((caps >= 2) & (low == 0)).sum())
        capital += int((kind[first] == _UPPER).sum())
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, w = max(kinds.sum(), 1.0), max(sizes[0], 1.0)
    counts = Counter(words)
    mean = sizes[1] / w
    scalars = np.concatenate([np.sqrt(kinds / n), [
        min(math.log1p(len(text)) / 16, 1), min(math.log1p(len(words)) / 12, 1), mean / (mean + 6), math.sqrt(max(sizes[2] / w - mean * mean, 0)) / (mean + 1e-9 + math.sqrt(max(sizes[2] / w - mean * mean, 0))),
        len(counts) / max(len(words), 1), max(counts.values(), default=0) / max(len(words), 1), sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words) - 1, 1),
        marked / w, upper / w, capital / w, 1 - len(set(lines)) / max(len(lines), 1), min(len(lines) / w * 4, 1),
    ]])
    at = np.clip(scalars, 0, 1) * (KNOTS - 1)
    low, part = np.minimum(at.astype(int), KNOTS - 2), None
    part = at - low
    bins = np.zeros((_SCALARS, KNOTS))
    every = np.arange(_SCALARS)
    bins[every, low], bins[every, low + 1] = 1 - part, part
    return np.concatenate([[1.0], bins.ravel(), np.sqrt(shapes / w)]).astype(np.float16)


def feature_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id and f, the features of the whole text as half-precision numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["id", "f"])

    bounded_batches(df.sparkSession)
    return df.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {df.schema[key].dataType.simpleString()}, f binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, DIMENSIONS).astype(float)


def _added(states: Iterator[bytes]) -> bytes | None:
    out = None
    for s in states:
        x = np.frombuffer(s)
        out = x.copy() if out is None else out + x
    return None if out is None else out.tobytes()


def moments(features: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean, and mean of the outer products of all rows."""
    d = DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                x = _matrix(b.column(0).slice(at, 2_000))
                n, first, second = n + len(x), first + x.sum(0), second + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], first, second.ravel()]).tobytes()], pa.binary())], ["state"])

    got = merged_in_tasks(features.select("f").mapInArrow(run, "state binary"), _added)
    if got is None:
        return 0, np.zeros(d), np.zeros((d, d))
    x = np.frombuffer(got)
    return int(x[0]), x[1 : d + 1] / x[0], x[d + 1 :].reshape(d, d) / x[0]


def _half() -> Column:
    """Equal texts are in one half."""
    return F.pmod(F.xxhash64("f"), F.lit(2))


def ratio_counts(features: DataFrame, weights: list[np.ndarray]) -> np.ndarray:
    """How many rows have a ratio in each bin, a row of half k by the weights k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BINS, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                x, half = _matrix(b.column(0).slice(at, 2_000)), b.column(1).slice(at, 2_000).to_numpy(zero_copy_only=False)
                ratio = (x @ np.stack(weights, axis=1))[np.arange(len(x)), half]
                total += np.bincount(np.clip((ratio / _BIN).astype(int), 0, _BINS - 1), minlength=_BINS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["bin", "n"])

    out = np.zeros(_BINS)
    for r in features.select("f", _half().cast("int")).mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most a row a bin
        out[r.bin] = r.n
    return out


def class_prior(trusted: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from counts by bins of a score that is higher for positives."""
    p, u = (x[::-1].cumsum() / x.sum() for x in (trusted, unlabelled))
    ep, eu = (math.sqrt(math.log(20) / (2 * x.sum())) for x in (trusted, unlabelled))
    bound = np.where(p > ep, (u + eu) / np.maximum(p - ep, 1e-12), np.inf)
    best = int(bound.argmin()) if np.isfinite(bound).any() else len(p) - 1
    return float(np.clip(u[best] / max(p[best], 1e-12), 0.01, 0.99))


def fit(prior: float, mp: np.ndarray, gp: np.ndarray, mu: np.ndarray, gu: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The weights of least non-negative risk, by moments of positive and unlabelled rows."""
    eye = np.eye(len(mp)) * 2 * ridge

    def at(share: float) -> np.ndarray:
        return np.linalg.solve(prior * (1 - share) * gp + share * gu + eye, prior * (1 + share) * mp - share * mu)

    def negative(w: np.ndarray) -> float:
        """The risk of negatives: that of unlabelled rows taken as negative without that of their positives."""
        return (1 + 2 * mu @ w + w @ gu @ w - prior * (1 + 2 * mp @ w + w @ gp @ w)) / 4

    w = at(1.0)
    if negative(w) >= 0:  # the unbiased risk is the larger one at its own minimum
        return w
    low, high = 0.0, 1.0
    if negative(at(low)) <= 0:
        return at(low)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if negative(at(mid)) > 0 else (low, mid)
    return at(low)


def scores(features: DataFrame, w: np.ndarray) -> DataFrame:
    """id and score: 0.5 where the model sees either class as likely, towards 1 for positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = np.concatenate([_matrix(b.column(1).slice(at, 2_000)) @ w for at in range(0, b.num_rows, 2_000)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(4 * z, -50, 50))))], ["id", "score"])

    return features.select("id", "f").mapInArrow(run, f"id {features.schema['id'].dataType.simpleString()}, score double")


def quality_scores(df: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", key: str = "doc_id", text: str = "text", ridge: float = RIDGE) -> DataFrame:
    """id and score of every row. learn: a condition on the id of a label under which it may be learned from."""
    d = staged(feature_table(df, key, text))
    ids = labels.select(F.col(key).alias("id"), F.col(label).alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").filter(learn)
    ids = ids.groupBy("id").agg(F.min("y").alias("y")).filter("y = 1").select("id")
    trusted = staged(d.join(ids, "id", "left_semi"))
    (n0, m0, g0), (n1, m1, g1) = (moments(trusted.filter(_half() == k)) for k in (0, 1))
    w = np.zeros(DIMENSIONS)
    if n0 + n1:
        mp, gp = (n0 * m0 + n1 * m1) / (n0 + n1), (n0 * g0 + n1 * g1) / (n0 + n1)
        _, mu, gu = moments(d)
        other = [np.linalg.solve(gu + np.eye(DIMENSIONS) * ridge, m) for m in (m1 if n1 else m0, m0 if n0 else m1)]
        prior = class_prior(ratio_counts(trusted, other), ratio_counts(d, other))
        w = fit(prior, mp, gp, mu, gu, ridge)
    unstaged(trusted)
    return scores(d, w)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(F.col("id")))
    return got.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
