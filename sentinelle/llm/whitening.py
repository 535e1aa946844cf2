"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Every task reduces its vectors to a summary: how many they are, their mean, and all singular values and vectors of
what is left of them when the mean is taken away. Two summaries merge without loss: their singular rows stand on one
another, a row for the distance of the means is appended, and the stack is decomposed again. Summaries meet in groups
of `FAN` until one is left. A summary has as many rows as the vectors have dimensions, whatever the number of vectors.

Vectors are counted in 64ths: an entry c becomes the whole number floor(64 * c) + 1000000, so that sums are exact.

Defined cases: a vector that is null or holds a null, NaN or infinite entry has no rows in the result and no part in the
fit; nor have vectors of another length than the most frequent one (of equally frequent ones the longest). Empty tables
give empty results. Repeated rows and ids count as often as they stand there. Components that the vectors do not extend
to (all of them, if all vectors are equal) have no rows. Components of equal variance come in an arbitrary order, the
same for all rows. Further columns have no effect; those named like one of the result's are not read. Very long vectors
of d entries cost d * d numbers a summary. Deviations beyond 64 bits are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinelle.llm import storage

#: What entries are multiplied by and moved by.
SCALE, SHIFT = 64, 1_000_000
#: Summaries that meet in one merge.
FAN = 8
#: Numbers that are stacked, as multiples of a summary's, before they are decomposed.
STACK = 4

_SUMMARY = "node long, n long, total array<long>, rows binary"


class Summary(NamedTuple):
    """n vectors: the exact sum of each dimension (without SHIFT), and singular values times right vectors."""

    n: int
    total: list[int]
    rows: np.ndarray


class Whitening(NamedTuple):
    """What whitening needs: d x k vectors, k variances, and each component's share of all variance."""

    n: int
    total: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def squeezed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors: as many rows as dimensions at most, with the same products."""
    if len(rows) <= 1:
        return rows
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def apart(a: int, sum_a: list[int], b: int, sum_b: list[int]) -> np.ndarray:
    """The row that two means' distance adds to the centred rows of both sides."""
    # sqrt(ab / (a + b)) * (sum_a / a - sum_b / b), from whole numbers as long as they can stay whole.
    return np.array([(x * b - y * a) / a / b for x, y in zip(sum_a, sum_b, strict=True)]) * (a * b / (a + b)) ** 0.5


def merged(parts: Iterator[Summary]) -> Summary | None:
    """All parts as one. Rows wait on a stack and are decomposed together."""
    n, total, rows, waiting = 0, [], [], 0
    for p in parts:
        if n:
            rows.append(apart(n, total, p.n, p.total)[None])
            total = [x + y for x, y in zip(total, p.total, strict=True)]
        else:
            total = p.total
        n += p.n
        rows.append(p.rows)
        waiting += len(p.rows) + 1
        if waiting > STACK * max(1, len(total)):
            rows = [squeezed(np.concatenate(rows))]
            waiting = len(rows[0])
    return Summary(n, total, squeezed(np.concatenate(rows))) if n else None


def block(values: np.ndarray) -> Summary:
    """The summary of some vectors, one a row, not yet decomposed."""
    total = values.sum(0)
    return Summary(len(values), total.tolist(), values - total / len(values))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of whole vectors as rows of numbers, without SHIFT."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - SHIFT


def _batch(node: int, s: Summary) -> pa.RecordBatch:
    rows = np.ascontiguousarray(s.rows, np.float64)
    return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([s.n]), pa.array([s.total], pa.list_(pa.int64())), pa.array([rows.tobytes()], pa.binary())], names=["node", "n", "total", "rows"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Summary]:
    for batch in batches:
        for r in batch.to_pylist():
            yield Summary(r["n"], r["total"], np.frombuffer(r["rows"]).reshape(-1, len(r["total"])))


def summary(vectors: DataFrame, d: int) -> Summary | None:
    """All of `vectors` (whole, d entries each) as one summary, by merging tasks' summaries in groups."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = merged(block(matrix(b.column("vector"), d)) for b in batches if b.num_rows)
        if found:
            yield _batch(TaskContext.get().partitionId(), found)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = []

        def read():
            for b in batches:
                nodes.extend(b.column("node").to_pylist())
                yield b

        found = merged(_read(read()))
        if found:
            yield _batch(nodes[0], found)

    level = storage.mapped(vectors.select("vector"), each, _SUMMARY)
    # Merged in order of their nodes, so that equal input gives equal numbers.
    width = max(1, vectors.rdd.getNumPartitions())
    while width > 1:
        width = -(-width // FAN)
        level = level.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("node").applyInArrow(lambda t: pa.Table.from_batches(meet(iter(t.to_batches())), schema=t.schema), _SUMMARY)
    last = level.toArrow()
    return merged(_read(last.to_batches()))


def whole(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose `vec` is a vector of finite numbers, with it in whole numbers as `vector`."""
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    vector = F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return df.where(F.col(vec).isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("vector", vector)


def fit(vectors: DataFrame, d: int, most: int) -> Whitening | None:
    """The components of `vectors` (column `vector`, d entries each), `most` at most."""
    s = summary(vectors, d) if d else None
    if s is None:
        return None
    _, values, v = np.linalg.svd(s.rows, full_matrices=False)
    e = values**2 / s.n
    # What rounding alone can leave of a dimension that the vectors do not extend to.
    k = min(most, int((values > values[0] * max(s.rows.shape) * np.finfo(float).eps).sum())) if values[0] > 0 else 0
    return Whitening(s.n, s.total, v[:k].T, e[:k], e[:k] / e.sum() if k else e[:0])


def white(values: np.ndarray, w: Whitening) -> np.ndarray:
    return (values - np.array(w.total) / w.n) @ w.vectors / np.sqrt(w.variances)


def deviations(values: np.ndarray, w: Whitening) -> list[int]:
    """sum (n * x - S)^2 of each row, exactly."""
    total = np.array(w.total)
    far = int(np.abs(values).max(initial=0)) * w.n + max(map(abs, w.total))
    if far < 2**31 and far * far * values.shape[1] < 2**63:
        return ((values * w.n - total) ** 2).sum(1).tolist()
    exact = [sum((w.n * x - s) ** 2 for x, s in zip(r, w.total, strict=True)) for r in values.tolist()]
    if max(exact, default=0) >= 2**63:
        raise OverflowError("a vector's deviation does not fit 64 bits")
    return exact


def moments(vectors: DataFrame, w: Whitening) -> np.ndarray:
    """The covariance of all whitened vectors, from the sums of tasks: k x k numbers, whatever the number of vectors."""
    d, k = len(w.total), len(w.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if not b.num_rows:
                continue
            y = white(matrix(b.column("vector"), d), w)
            m, c = len(y), y.mean(0)
            y -= c
            spread += y.T @ y + np.outer(c - mean, c - mean) * (n * m / (n + m))
            mean += (c - mean) * (m / (n + m))
            n += m
        if n:
            i, j = np.triu_indices(k)
            part = np.concatenate(([n], mean * n, (spread + n * np.outer(mean, mean))[i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part))), pa.array(part)], names=["at", "value"])

    parts = storage.mapped(vectors.select("vector"), run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    got = parts.toArrow()
    flat = np.zeros(1 + k + k * (k + 1) // 2)
    flat[got.column("at").to_numpy()] = got.column("value").to_numpy()
    n, mean = flat[0], flat[1 : 1 + k] / flat[0]
    out = np.zeros((k, k))
    i, j = np.triu_indices(k)
    out[i, j] = flat[1 + k :] / n
    return out - np.triu(np.outer(mean, mean))


def whitened(df: DataFrame, key: str = "vec_id", vec: str = "embedding", most: int = 32) -> DataFrame:
    """A row for each vector and component: (`key`, component, n, deviation, whitened, explained, identity_error)."""
    rows = whole(df.select(F.col(key).alias("_key"), F.col(vec).alias("_vec")), "_vec")
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usual = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = usual["d"] if usual else 0
    rows = rows.where(F.size("vector") == d).select("_key", "vector")
    w = fit(rows, d, most)
    if w is None or not len(w.variances):
        return df.sparkSession.createDataFrame([], schema)
    k = len(w.variances)
    error = float(np.abs(moments(rows, w) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vector"), d)
            m = len(x)
            again = np.repeat(np.arange(m), k)
            columns = [
                b.column("_key").take(pa.array(again)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, w.n)),
                pa.array(deviations(x, w), pa.int64()).take(pa.array(again)),
                pa.array(white(x, w).ravel()),
                pa.array(np.tile(w.explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return storage.mapped(rows, run, schema)
