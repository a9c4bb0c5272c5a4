"""Embedding whitening by mixed-precision eigenvectors (operator 13).

Entries become integers x = floor(64 c) + 1000000.  The fit list is every different vector of integers once; its sums and its
centred products are added up by Spark, in levels of about the root of the number of partitions.  The eigenvectors of
the covariance start in float32 and are corrected by the matrix multiplications of Ogita and Aishima in extended precision,
each of which squares the error; eigenvalues nearer to each other than the error are a cluster, whose vectors are found by the
eigenproblem of the cluster alone, after its mean is taken off.  Rows are projected by tasks that get the mean and the components.

Defined cases: vectors that are null, or hold null, NaN or infinite entries, or entries whose 64-fold is 2^61 or more, are left out, as
are those without entries or of another length than the commonest (ties: the longest); repeated rows count once in the fit and
are all returned, null ids too; a component without variance (up to rounding) has a null `whitened` and explains 0, or 0 / 0 = 0;
equal eigenvalues (ties) have any orthogonal vectors of their space, the same for all rows; a deviation beyond a long is null; an empty table
gives no rows; texts don't occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import materialize

SHIFT, UNIT, LIMIT, LONG = 1_000_000, 64, 1 << 61, 1 << 63
WIDE = np.longdouble
CLUSTER = 1e-9  # of the norm: nearer eigenvalues are one cluster, since rounding would turn their vectors more than the correction mends
BLOCK = 8192


# eigenvectors --------------------------------------------------------------------------------------
def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Places of values whose neighbours, in falling order, are no further than `near`."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(values[order][:-1] - values[order][1:] > near) + 1
    return np.split(order, cuts)


def eigenvectors(a: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, to double precision."""
    d = len(a)
    a = np.asarray(a, WIDE)
    a = (a + a.T) / 2
    size = np.abs(a).max(initial=WIDE(0))
    if not size:
        return np.zeros(d), np.eye(d)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    eye, norm = np.eye(d, dtype=WIDE), WIDE(np.linalg.norm(a.astype(np.float64), 2))
    floor = 2.0**-53
    for _ in range(steps):
        r = eye - x.T @ x
        s = x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        near = 2 * (np.linalg.norm(off.astype(np.float64), 2) + float(norm) * np.linalg.norm(r.astype(np.float64), 2))
        groups = _clusters(values, WIDE(max(near, CLUSTER)))
        label = np.empty(d, np.int64)
        for k, at in enumerate(groups):
            label[at] = k
        same = label[:, None] == label[None, :]
        gap = np.where(same, WIDE(1), values[None, :] - values[:, None])
        # within a cluster only the lengths and right angles are mended
        change = np.where(same, r / 2, (s + values[None, :] * r) / gap)
        x = x + x @ change
        for at in groups:
            if len(at) > 1:
                x[:, at] = x[:, at] @ _split(a, x[:, at])
        moved = float(np.abs(change).max())
        if moved < floor:
            break
    x = x + x @ (eye - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return (values[order] * size).astype(np.float64), x[:, order].astype(np.float64)


def _split(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rotation of a cluster's vectors to the eigenvectors of its own problem, the mean eigenvalue taken off first."""
    t = x.T @ a @ x
    t = t - np.eye(len(t), dtype=WIDE) * (np.trace(t) / len(t))
    t = (t + t.T) / 2
    size = np.abs(t).max()
    if not size:
        return np.eye(len(t), dtype=WIDE)
    w = np.linalg.eigh((t / size).astype(np.float64))[1].astype(WIDE)
    return w @ (WIDE(1.5) * np.eye(len(t), dtype=WIDE) - WIDE(0.5) * (w.T @ w))


# sums over all rows --------------------------------------------------------------------------------
def integers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x of the rows that take part."""
    c = F.transform(vector, lambda e: F.floor(e.cast("double") * UNIT))
    fit = lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < LIMIT / UNIT)
    rows = embeddings.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, fit))
    counts = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    d = counts.agg(F.max(F.struct("n", "d"))["d"]).first()[0]
    if d is None:
        return rows.select(F.col("vec_id").cast("long"), F.array().cast("array<long>").alias("x")).limit(0)
    return rows.where(F.size(vector) == d).select(F.col("vec_id").cast("long"), F.transform(c, lambda e: e.cast("long") + SHIFT).alias("x"))


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of x as matrices of at most BLOCK rows: first row, matrix."""
    for at in range(0, batch.num_rows, BLOCK):
        x = batch.column("x").slice(at, BLOCK)
        yield at, x.flatten().to_numpy().reshape(len(x), -1)


def added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], dtype: type) -> np.ndarray | None:
    """Sum of part(matrix) over all rows; levels of tasks add up the sums of about the root of the number of partitions."""

    def sums(batches):
        total = None
        for batch in batches:
            for _, x in blocks(batch):
                p = part(x)
                total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(dtype).tobytes()], pa.binary())], ["s"])

    def join(batches):
        total = None
        for batch in batches:
            for raw in batch.column("s").to_pylist():
                p = np.frombuffer(raw, dtype)
                total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    n = rows.rdd.getNumPartitions()
    level = rows.mapInArrow(sums, "s binary").withColumn("k", F.spark_partition_id())
    groups = int(np.ceil(np.sqrt(n)))
    if groups > 2:
        level = level.repartition(groups, F.pmod("k", F.lit(groups))).select("s").mapInArrow(join, "s binary")
    done = [np.frombuffer(r.s, dtype) for r in level.select("s").collect()]
    return sum(done[1:], done[0]) if done else None


def _counts(x: np.ndarray) -> np.ndarray:
    """n and the sums of each dimension, as two halves of 32 bits, so that nothing overflows."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return np.concatenate(([len(x)], high.sum(axis=0), low.sum(axis=0)))


class Whitener:
    """Mean and components of a fit list."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        # the mean as an integer and the rest below one
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s - n * (s // n) for s in sums], np.int64)
        self.share = np.array([(s - n * (s // n)) / n for s in sums])
        self.vectors, self.values, self.trace = np.zeros((len(sums), 0)), np.zeros(0), 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: the integer part is taken off exactly."""
        return (x - self.base).astype(np.float64) - self.share

    def products(self, x: np.ndarray) -> np.ndarray:
        c = self.centred(x)
        return (c.T @ c).ravel()

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of their variance; zero for a component without variance."""
        root = np.sqrt(np.where(self.alive, self.values, 1.0))
        return np.where(self.alive, self.centred(x) @ self.vectors / root, 0.0)

    def moments(self, x: np.ndarray) -> np.ndarray:
        w = self.whiten(x)
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 of each row, exact; null beyond a long."""
        with np.errstate(over="ignore"):
            y = self.n * (x - self.base) - self.rest
            exact = (y * y).sum(axis=1)  # modulo 2^64
        size = float(self.n) ** 2 * (self.centred(x) ** 2).sum(axis=1)
        out: list[int | None] = exact.tolist()
        for i in np.flatnonzero(size > 2.0**62).tolist():
            full = sum((self.n * (int(v) - int(b)) - int(r)) ** 2 for v, b, r in zip(x[i], self.base, self.rest, strict=True)) if size[i] < 2.0**64 else LONG
            out[i] = full if full < LONG else None
        return out

    def solve(self, covariance: np.ndarray, most: int) -> None:
        values, vectors = eigenvectors(covariance)
        self.trace = float(np.trace(covariance))
        self.values, self.vectors = np.maximum(values[:most], 0.0), vectors[:, :most]

    @property
    def alive(self) -> np.ndarray:
        return self.values > len(self.base) * 1e-13 * max(self.trace, 0.0)


def fit(x: DataFrame, most: int = 16) -> tuple[Whitener | None, float]:
    """The whitener of the fit list x (every vector once) and its identity error."""
    counts = added(x, _counts, np.int64)
    if counts is None:
        return None, 0.0
    d = len(counts) // 2
    n = int(counts[0])
    sums = [(int(h) << 32) + int(low) for h, low in zip(counts[1 : d + 1], counts[d + 1 :], strict=True)]
    w = Whitener(n, sums)
    w.solve(added(x, w.products, np.float64).reshape(d, d) / n, most)
    m = added(x, w.moments, np.float64) / n
    k = len(w.values)
    covariance = m[k:].reshape(k, k) - np.outer(m[:k], m[:k])
    off = np.abs(covariance - np.eye(k))[np.ix_(w.alive, w.alive)]
    return w, float(off.max(initial=0.0))


WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, most: int = 16, vector: str = "embedding") -> DataFrame:
    """One row for each vector that takes part and component: the whitened value and the figures of the fit."""
    rows = integers(embeddings, vector)
    w, error = fit(materialize(rows.select("x").distinct()), most)

    def work(batches):
        for batch in batches:
            for at, x in blocks(batch):
                k = len(w.values)
                white = w.whiten(x)
                out = [
                    batch.column("vec_id").slice(at, len(x)).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, w.n)),
                    pa.array(w.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(white.ravel(), mask=np.tile(~w.alive, len(x))),
                    pa.array(np.tile(w.values / w.trace if w.trace else np.zeros(k), len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in WHITE.split(", ")])

    return rows.mapInArrow(work, WHITE)
