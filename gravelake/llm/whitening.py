"""Embedding whitening: streamed moments, a symmetric QR eigen-solve, projections.

Every task walks its vectors once and keeps a count, the exact integer sums, a mean and the matrix of centred
products, to which each vector adds one rank-one update (Welford). The tasks' moments meet in a bounded number of
merging tasks by the parallel update formula, and the driver merges what those leave: one matrix each, whatever
the number of vectors. The covariance is then made tridiagonal by reflections and diagonal by shifted QR steps.
A second walk measures the covariance of the whitened values in the same way, a third one writes them.

An entry c becomes x = floor(1024 * c) + 100000; entries beyond 2^52 count as 2^52, with their sign.

Results at the edges: null vectors and those with a null or non-finite entry are dropped; so are vectors that are
not as long as most are (of equally many the longer), as they have no place in the matrix, and vectors without entries;
a component without variance has a null `whitened` and 0 for `explained`, and stays out of `identity_error`, which is null
if there is no other; a `deviation` beyond 64 bits is null; repeated rows and ids give equal rows; a null id stays
null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelake.llm.common import merged_in_tasks, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
_MOST = float(1 << 52)
#: A variance below this share of the largest is none: rounding leaves about so much of it.
_NOTHING = 1e-13


class Moments:
    """Count, exact sums, mean and centred products of rows."""

    def __init__(self, d: int, n: int = 0, total: list[int] | None = None, mean: np.ndarray | None = None, about: np.ndarray | None = None):
        self.n, self.total = n, total or [0] * d
        self.mean = np.zeros(d) if mean is None else mean
        self.about = np.zeros((d, d)) if about is None else about

    def add(self, rows: np.ndarray) -> None:
        for x in rows:
            self.n += 1
            delta = x - self.mean
            self.mean += delta / self.n
            self.about += np.multiply.outer(delta, delta) * ((self.n - 1) / self.n)

    def merge(self, other: Moments) -> Moments:
        if other.n:
            n = self.n + other.n
            delta = other.mean - self.mean
            self.about += other.about + np.multiply.outer(delta, delta) * (self.n * (other.n / n))
            self.mean = other.mean.copy() if not self.n else self.mean + delta * (other.n / n)
            self.n, self.total = n, [a + b for a, b in zip(self.total, other.total, strict=True)]
        return self

    def packed(self) -> bytes:
        return json.dumps([self.n, self.total]).encode() + b"\n" + self.mean.tobytes() + self.about.tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Moments:
        head, _, rest = data.partition(b"\n")
        n, total = json.loads(head)
        d, values = len(total), np.frombuffer(rest)
        return cls(d, n, total, values[:d].copy(), values[d:].reshape(d, d).copy())


def merged(packed: Iterator[bytes]) -> bytes | None:
    out = None
    for x in packed:
        m = Moments.unpacked(x)
        out = m if out is None else out.merge(m)
    return None if out is None else out.packed()


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: Householder tridiagonal form, then QR steps with Wilkinson's shift."""
    a, d = np.array(a, float), len(a)
    q, nothing = np.eye(d), 1e-30 * np.abs(a).max()  # far below rounding
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        length = math.sqrt(v @ v)
        if length <= nothing:
            a[k + 1 :, k] = a[k, k + 1 :] = 0
            continue
        v[0] += math.copysign(length, v[0])
        v /= math.sqrt(v @ v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    diag, off = np.diag(a).copy(), np.diag(a, -1).copy()
    rows, hi = q.T.copy(), d - 1  # eigenvectors as rows, so that a rotation touches two of them
    while hi > 0:
        off[np.abs(off) <= np.finfo(float).eps * (np.abs(diag[:-1]) + np.abs(diag[1:])) + nothing] = 0.0
        if not off[hi - 1]:
            hi -= 1
            continue
        lo = hi - 1
        while lo and off[lo - 1]:
            lo -= 1
        half = (diag[hi - 1] - diag[hi]) / 2
        shift = diag[hi] - off[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, off[hi - 1]), half or 1.0))
        x, z = diag[lo] - shift, off[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                off[k - 1] = r
            p, e, t = diag[k], off[k], diag[k + 1]
            diag[k], diag[k + 1], off[k] = c * c * p + 2 * c * s * e + s * s * t, s * s * p - 2 * c * s * e + c * c * t, c * s * (t - p) + (c * c - s * s) * e
            if k < hi - 1:
                x, z = off[k], s * off[k + 1]
                off[k + 1] *= c
            rows[k], rows[k + 1] = c * rows[k] + s * rows[k + 1], c * rows[k + 1] - s * rows[k]
    order = np.argsort(-diag, kind="stable")
    vectors = rows[order].T
    return diag[order], vectors / np.sqrt((vectors * vectors).sum(0))


def usable(vector: Column, width: int | None = None) -> Column:
    """No null and no non-finite entry, and of the width, if one is given."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    ok = vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))
    return ok if width is None else ok & (F.size(vector) == width)


def integers(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return np.clip(np.floor(SCALE * flat), -_MOST, _MOST).astype(np.int64) + SHIFT


def _sums(x: np.ndarray) -> list[int]:
    small = len(x) * max(int(x.max()), -int(x.min())) < 1 << 62
    return [int(s) for s in (x if small else x.astype(object)).sum(0)]


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, in whole numbers."""
    most = max(n * max(abs(int(x.max())), abs(int(x.min()))), max(map(abs, total)))
    if most < 1 << 61:
        apart = n * x - np.array(total, np.int64)
        if x.shape[1] * int(np.abs(apart).max()) ** 2 < 1 << 63:
            return [int(v) for v in (apart * apart).sum(1)]
    apart = n * x.astype(object) - np.array(total, object)
    return [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(1)]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error of every usable vector and component."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    d = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(usable(F.col("v")))
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    common = d.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    width = common.w
    d = d.filter(F.size("v") == width)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments(width)
        for b in batches:
            if b.num_rows:
                x = integers(b.column(0), width)
                m.add(x.astype(float))
                m.total = [s + t for s, t in zip(m.total, _sums(x), strict=True)]
        if m.n:
            yield pa.RecordBatch.from_arrays([pa.array([m.packed()], pa.binary())], ["state"])

    fit = merged_in_tasks(d.select("v").mapInArrow(moments, "state binary"), merged)
    found, vectors = symmetric_qr(fit.about / fit.n) if (fit := Moments.unpacked(fit)).n else (np.zeros(width), np.eye(width))
    k, trace = min(components, width), float(np.trace(fit.about)) / fit.n
    there = int((found[:k] > _NOTHING * max(found[0], 0.0)).sum()) if found[0] > 0 else 0
    n, total, mean = fit.n, fit.total, np.array([s // fit.n for s in fit.total], float)
    rest = np.array([(s % n) / n for s in total])  # the mean's whole part is taken away without rounding
    onto = vectors[:, :there] / np.sqrt(found[:there])

    def projected(x: np.ndarray) -> np.ndarray:
        return (x.astype(float) - mean - rest) @ onto

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments(there)
        for b in batches:
            if b.num_rows:
                m.add(projected(integers(b.column(0), width)))
        if m.n:
            yield pa.RecordBatch.from_arrays([pa.array([m.packed()], pa.binary())], ["state"])

    error = None
    if there:
        seen = Moments.unpacked(merged_in_tasks(d.select("v").mapInArrow(again, "state binary"), merged))
        error = float(np.abs(seen.about / seen.n - np.eye(there)).max())
    shares = [float(found[i] / trace) if i < there else 0.0 for i in range(k)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = integers(b.column(1), width)
            values = np.full((len(x), k), np.nan)
            values[:, :there] = projected(x)
            at = np.repeat(np.arange(len(x)), k)
            size = len(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, n, np.int64)), pa.array(deviations(x, n, total), pa.int64()).take(pa.array(at)),
                 pa.array(values.ravel(), from_pandas=True), pa.array(shares * len(x), pa.float64()), pa.array([error] * size, pa.float64())],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return d.mapInArrow(rows, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
