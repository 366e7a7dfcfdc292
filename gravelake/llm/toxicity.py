"""Toxicity by a chain of linear classifiers.

The categories have an order. The model of each is a logistic regression on word features of the text and on
the probabilities of the categories before it. Those probabilities are predicted out of fold for training, so
that a later model sees them as wrong as they are on new texts; for new texts they come from the models fitted
on all folds, the chain running front to back.

Features are the words of a text, and their beginnings of four and five letters, lower-cased and counted once
a text. A feature is used if its shares of a category and of the rest differ by five standard deviations
(`STAND_OUT`) and at least four texts hold it (`SEEN`); of these, the 600 that differ most, for each category (`FEATURES`). The
model of a fold chooses its features without the fold's rows, as it learns without them. Features are counted,
and the models fitted, on a bounded sample of the labelled rows (5,000 of each side, by hash: `ROWS`);
predictions read the whole text of every row.

Results at the edges: a null or empty text has no features and gets the base probabilities; a category
without positive or negative labels is never predicted (probability 0); rows with a null label or id train
nothing; of several labels of one id a category holds if any says so, and of several texts of one id the one of the smallest
hash trains; repeated rows get equal results; an empty table gives an empty result; other columns are ignored, and
kept by the stage whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gravelake.llm.common import bounded_batches, column, numbered, staged, table

ROWS = 5_000
FOLDS = 4
FEATURES = 600
STAND_OUT = 5.0
SEEN = 4
THRESHOLD = 0.5
_WORD = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:5] + "*" for w in words} | {w[:4] + "*" for w in words}


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)  # by category: features, then earlier categories, then the bias

    def probabilities(self, hits: list[list[int]]) -> np.ndarray:
        """Rows by categories, from each row's feature numbers."""
        at = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        of = np.fromiter((i for h in hits for i in h), np.int64)
        out = np.zeros((len(hits), len(self.categories)))
        n = len(self.vocabulary)
        for c, w in enumerate(self.weights):
            if w is not None:
                z = np.bincount(at, w[of], minlength=len(hits)) + out[:, :c] @ w[n : n + c] + w[-1]
                out[:, c] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        return out

    def restricted(self, to: set[str]) -> Chain:
        """The same chain without the features that only the models of folds used."""
        own = sorted(to)
        at = np.array([*[self.vocabulary[f] for f in own], *range(len(self.vocabulary), len(self.vocabulary) + len(self.categories))], np.int64)
        weights = [None if w is None else np.append(w[at[: len(own) + c]], w[-1]) for c, w in enumerate(self.weights)]
        return Chain(self.categories, {f: i for i, f in enumerate(own)}, weights)

    def hits(self, text: str | None) -> list[int]:
        words = set(_WORD.findall((text or "").lower()))
        get = self.vocabulary.get
        found = {get(w) for w in words} | {get(w[:5] + "*") for w in words} | {get(w[:4] + "*") for w in words}
        found.discard(None)
        return sorted(found)


def _fit(at: np.ndarray, of: np.ndarray, n: int, earlier: np.ndarray, y: np.ndarray, prior: float, steps: int = 300, l2: float = 0.002) -> np.ndarray:
    """Logistic regression by Adam over all rows, each class with weight one half; the bias is then moved to the true share."""
    w = np.zeros(n + earlier.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for t in range(1, steps + 1):
        z = np.bincount(at, w[of], minlength=len(y)) + earlier @ w[n:-1] + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * share
        g = np.concatenate([np.bincount(of, d[at], minlength=n), earlier.T @ d, [d.sum()]]) + l2 * np.append(w[:-1], 0) / 100
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.2 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    w[-1] += math.log(prior / (1 - prior))
    return w


def fit(rows: list[tuple[int, list[int], list[float]]], categories: Sequence[str], vocabulary: dict[str, int], priors: Sequence[float], chosen: Sequence[set[int]]) -> Chain:
    """rows: fold, feature numbers, labels in order of the categories. chosen: features of the model without each fold, and of the whole one."""
    chain, n, folds = Chain(list(categories), vocabulary), len(vocabulary), len(chosen) - 1
    used = np.array([[f in c for f in range(n)] for c in chosen], bool).reshape(folds + 1, n)
    fold = np.array([r[0] for r in rows])
    at = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    of = np.fromiter((i for r in rows for i in r[1]), np.int64)
    labels = np.array([r[2] for r in rows], float).reshape(len(rows), len(categories))
    earlier = np.zeros((len(rows), 0))
    for c in range(len(categories)):
        y, prior = labels[:, c], priors[c]
        if not 0 < y.sum() < len(y) or not 0 < prior < 1:
            chain.weights.append(None)
            earlier = np.column_stack([earlier, np.zeros(len(rows))])
            continue
        out = np.zeros(len(rows))
        for k in range(folds):
            own, rest = np.flatnonzero(fold == k), fold != k
            keep, seen = rest[at] & used[k][of], ~rest[at] & used[k][of]
            renumbered = np.cumsum(rest) - 1
            if not len(own) or not 0 < y[rest].sum() < rest.sum():
                continue
            w = _fit(renumbered[at[keep]], of[keep], n, earlier[rest], y[rest], prior)
            z = np.bincount(at[seen], w[of[seen]], minlength=len(rows))[own] + earlier[own] @ w[n:-1] + w[-1]
            out[own] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        keep = used[folds][of]
        chain.weights.append(_fit(at[keep], of[keep], n, earlier, y, prior))
        earlier = np.column_stack([earlier, out])
    return chain


def _picked(ids: DataFrame, rows: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("__id"), "__id").limit(rows)


def _standing_out(counts: DataFrame, sizes: DataFrame, n: int) -> list[set[str]]:
    """Features of the model without each fold, and of the whole one. counts: f, k (fold), n0.., n; sizes: k, n0.., n."""
    every = counts.groupBy("f").agg(*[F.sum(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for k in range(FOLDS) for c in (*[f"n{i}" for i in range(n)], "n")])
    every = every.na.fill(0)
    total = {r.k: r for r in sizes.collect()}  # a row a fold
    found = []
    for without in range(FOLDS + 1):
        folds = [k for k in range(FOLDS) if k != without]
        sums = lambda c: sum((F.col(f"{c}_{k}") for k in folds), F.lit(0))  # noqa: B023, E731
        size = sum(total[k].n for k in folds if k in total)
        for i in range(n):
            yes, share = float(sum(total[k][f"n{i}"] for k in folds if k in total)), sums("n") / max(size, 1)
            spread = F.sqrt(share * (1 - share) * (1 / max(yes, 0.5) + 1 / max(size - yes, 0.5)))
            apart = sums(f"n{i}") / max(yes, 0.5) - (sums("n") - sums(f"n{i}")) / max(size - yes, 0.5)
            found.append(F.struct(F.lit(without).alias("without"), F.lit(i).alias("i"), F.abs(F.coalesce(F.try_divide(apart, spread), F.lit(0.0))).alias("s"), sums("n").alias("seen")))
    rows = every.select("f", F.explode(F.array(*found)).alias("x")).select("f", "x.*").filter((F.col("s") >= STAND_OUT) & (F.col("seen") >= SEEN))
    best = rows.withColumn("r", F.row_number().over(W.partitionBy("without", "i").orderBy(F.desc("s"), "f"))).filter(F.col("r") <= FEATURES)
    chosen: list[set[str]] = [set() for _ in range(FOLDS + 1)]
    for r in best.select("without", "f").collect():  # at most FEATURES a category and model
        chosen[r.without].add(r.f)
    return chosen


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], key: str = "doc_id", text: str = "text", rows: int = ROWS) -> Chain:
    """categories: name and the condition on a row of `labels` under which it holds, in order of the chain."""
    names = list(categories)
    n = len(names)
    lab = labels.filter(labels[key].isNotNull()).select(labels[key].alias("__id"), *[c.cast("int").alias(f"__y{i}") for i, c in enumerate(categories.values())]).dropna()
    lab = lab.groupBy("__id").agg(*[F.max(f"__y{i}").alias(f"__y{i}") for i in range(n)])
    total = lab.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"__y{i}").alias(f"p{i}") for i in range(n)]).first()
    if not total.n:
        return Chain(names, {}, [None] * n)
    some = " + ".join(f"__y{i}" for i in range(n))
    sample = _picked(lab.filter(f"{some} = 0"), rows)
    for i in range(n):
        sample = sample.unionByName(_picked(lab.filter(f"__y{i} = 1"), rows))
    sample = sample.dropDuplicates(["__id"])  # at most `rows` times categories and one
    d = docs.select(F.col(key).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(sample), "__id")
    d = d.groupBy("__id", *[f"__y{i}" for i in range(n)]).agg(F.min_by("__t", F.xxhash64("__t")).alias("__t"))
    d = staged(d.select("__id", "__t", *[f"__y{i}" for i in range(n)], (F.crc32(F.col("__id").cast("string").cast("binary")) % FOLDS).cast("int").alias("k")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [[Counter() for _ in range(n + 1)] for _ in range(FOLDS)]
        for b in batches:
            ys = [b.column(2 + i).to_pylist() for i in range(n)]
            for j, (t, k) in enumerate(zip(b.column(1).to_pylist(), b.column(2 + n).to_pylist(), strict=True)):
                found = features(t)
                seen[k][n].update(found)
                for i in range(n):
                    if ys[i][j]:
                        seen[k][i].update(found)
        for k, s in enumerate(seen):
            keys = list(s[n])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([k] * len(keys), pa.int32()), *[pa.array([c[x] for x in keys], pa.int64()) for c in s]], ["f", "k", *[f"n{i}" for i in range(n)], "n"])

    counts = d.mapInArrow(count, "f string, k int, " + "".join(f"n{i} bigint, " for i in range(n)) + "n bigint")
    sizes = d.groupBy("k").agg(*[F.sum(f"__y{i}").alias(f"n{i}") for i in range(n)], F.count(F.lit(1)).alias("n"))
    chosen = _standing_out(counts, sizes, n)
    vocabulary = {f: i for i, f in enumerate(sorted(set().union(*chosen)))}
    every = Chain(names, vocabulary)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([every.hits(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32())), *b.columns[2:]], ["__id", "h", *[f"y{i}" for i in range(n)], "k"])

    kind = d.schema["__id"].dataType.simpleString()
    got = d.mapInArrow(found, f"__id {kind}, h array<int>, " + ", ".join(f"y{i} int" for i in range(n)) + ", k int")
    data = sorted((r["__id"], r.k, r.h, [r[f"y{i}"] for i in range(n)]) for r in got.collect())  # a row an id of the sample
    if not data:
        return Chain(names, {}, [None] * n)
    chain = fit([x[1:] for x in data], names, vocabulary, [(total[f"p{i}"] or 0) / total.n for i in range(n)], [{vocabulary[f] for f in c} for c in chosen])
    return chain.restricted(chosen[FOLDS])


def predict(df: DataFrame, chain: Chain, keep: Sequence[str] = ("doc_id",), text: str = "text", prefix: str = "p_") -> DataFrame:
    """The kept columns and `p_<category>` for each category."""
    at, names = len(keep), [f"{prefix}{c}" for c in chain.categories]
    read = list(keep).index(text) if text in keep else at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.probabilities([chain.hits(t.as_py()) for t in b.column(read)])
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *[pa.array(p[:, i]) for i in range(len(names))]], [*keep, *names])

    schema = StructType([*[StructField(c, df.schema[c].dataType) for c in keep], *[StructField(c, DoubleType()) for c in names]])
    bounded_batches(df.sparkSession)
    return numbered(df, [*keep, *([] if text in keep else [text])]).mapInArrow(run, schema)


def chain_of(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Chain:
    """The table of labels has two categories; junk comes first, as it tells how far words can be trusted."""
    labels = table(spark, sf_dir, "labels")
    return train(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, chain_of(spark, sf_dir, docs)).withColumn("toxic", F.col("p_toxic") >= THRESHOLD)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    prefix = "__p_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    scored = predict(docs, chain_of(spark, sf_dir, docs), keep=[*docs.columns], prefix=prefix)
    return scored.filter(F.col(f"{prefix}toxic") < THRESHOLD).select(*map(column, docs.columns))
