"""Approximate nearest neighbours by cross-polytope hashing (operator 7).

Three rounds of random signs and a fast Hadamard transform rotate a unit vector; the signed axis nearest to it
is its hash.  A table joins the axes of several rotations, the last with as many axes as make about `FILL` rows
a bucket, so buckets grow with the rows and not in size.  A query probes the buckets whose axes are
least behind its largest ones, more of them the more buckets there are (3/8 of their square root, 16 at least).

Rows and probes of a bucket meet in a sorted partition, a bucket of more than `BLOCK` rows or probes in blocks, so
that no task holds an unbounded one.  Scores in single precision choose the best k + 1 of each query and all within
`MARGIN` of them; these are ranked by the cosine in double precision of the vectors as given.  Equal vectors are one
row of the index that names its k + 1 smallest ids, so copies neither fill buckets nor hide one another.

Defined cases: vectors that are null, zero, or that hold null or non-finite components take no part, as query or
candidate, nor do rows without an id; vectors are compared with those of their own dimension; their magnitudes may be of
any size; rows that share an id but not a vector are rows of their own, but not neighbours of one another; repeated rows are one; ties go to the smaller id; a
query for which the tables yield fewer than k neighbours is compared with all rows, in blocks; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache, partial
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._common import U, materialize, mix, n_shuffle, runs_of

BLOCK, FILL, PAIRS, MARGIN = 4096, 2.5, 200_000, 4e-6
ROW = "cls long, unit binary, keys array<long>"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows."""
    rows, n = x.shape
    h = 1
    while h < n:
        x = x.reshape(rows, n // (2 * h), 2, h)
        a, b = x[:, :, 0, :], x[:, :, 1, :]
        x = np.stack((a + b, a - b), 2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


def layout(rows: int, dim: int) -> list[int]:
    """Axes (without sign) of each rotation of a table for so many rows."""
    padded = max(1 << max(dim - 1, 0).bit_length(), 2)
    bits, full = max(1, round(log2(max(rows, 1) / FILL + 1))), 1 + int(log2(padded))
    count = min(ceil(bits / full), 8)
    return [padded] * (count - 1) + [1 << max(min(bits - (count - 1) * full, full) - 1, 0)]


def n_buckets(axes: list[int]) -> int:
    return int(np.prod([2.0 * a for a in axes]))


def n_probes(axes: list[int]) -> int:
    return min(max(16, round(0.375 * n_buckets(axes) ** 0.5)), n_buckets(axes))


@lru_cache(8)
def rotations(dim: int, tables: int, count: int, seed: int = 3) -> np.ndarray:
    """Random signs (tables, rotations, 3, padded dimension)."""
    padded = max(1 << max(dim - 1, 0).bit_length(), 2)
    return np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (tables, count, 3, padded))


def buckets(x: np.ndarray, tables: int, axes: list[int], probes: int) -> np.ndarray:
    """Buckets (rows, tables, probes) of unit vectors: those least behind."""
    signs = rotations(x.shape[1], tables, len(axes))
    x = np.pad(x, ((0, 0), (0, signs.shape[3] - x.shape[1])))
    out = np.empty((len(x), tables, probes), np.uint64)
    for t in range(tables):
        code, behind = np.zeros((len(x), 1), np.uint64), np.zeros((len(x), 1))
        for rounds, own in zip(signs[t], axes, strict=True):
            y = x
            for s in rounds:
                y = hadamard(y * s)
            y = y[:, :own]
            top = min(probes, own)
            axis = np.abs(y).argmax(1)[:, None] if top == 1 else np.argsort(-np.abs(y), 1)[:, :top]
            v = np.take_along_axis(y, axis, 1)
            signed, size = axis * 2 + (v < 0), np.abs(v)
            late = size[:, :1] - size
            if probes > own:
                # the other sign of an axis is as far behind as both magnitudes together
                signed, late = np.concatenate((signed, signed ^ 1), 1), np.concatenate((late, size[:, :1] + size), 1)
            code = (code[:, :, None] * U(2 * own) + signed[:, None, :].astype(np.uint64)).reshape(len(x), -1)
            behind = (behind[:, :, None] + late[:, None, :] ** 2).reshape(len(x), -1)
            if code.shape[1] > probes:
                best = np.argpartition(behind, probes - 1, 1)[:, :probes]
                code, behind = np.take_along_axis(code, best, 1), np.take_along_axis(behind, best, 1)
        out[:, t] = code if code.shape[1] == probes else np.pad(code, ((0, 0), (0, probes - code.shape[1])), mode="edge")
    return out


def _groups(column, kind: str):
    """(rows, matrix) of the usable vectors of a batch, by dimension."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(0).to_numpy()
    values = column.flatten()
    whole = np.ones(len(size), bool)
    owner = np.repeat(np.arange(len(size)), size)
    if values.null_count:
        whole[owner[values.is_null().to_numpy(zero_copy_only=False)]] = False
    flat, begin = values.fill_null(0).to_numpy(zero_copy_only=False).astype(kind) + 0, np.cumsum(size) - size
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero((size == dim) & whole)
        x = flat[begin[rows][:, None] + np.arange(dim)]
        ok = np.isfinite(x).all(1) & x.any(1)
        yield rows[ok], x[ok]


def _packed(batches, kind: str):
    """Usable vectors as bytes."""
    for batch in batches:
        for rows, x in _groups(batch.column("v"), kind):
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), raw, batch.column("q").take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1]))], ["id", "vec", "q", "dim"])


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near 1."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _by_size(raw: list[bytes]):
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    for n in np.unique(size).tolist():
        yield np.flatnonzero(size == n)


def _hash(batches, kind: str, tables: int, axes: dict[int, list[int]], probing: bool):
    for batch in batches:
        raw = batch.column("vec").to_pylist()
        for own in _by_size(raw):
            step = 512 if probing else 2048
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                x = _scaled(np.frombuffer(b"".join([raw[i] for i in rows.tolist()]), kind).reshape(len(rows), -1))
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                form = axes[x.shape[1]]
                found = buckets(x, tables, form, n_probes(form) if probing else 1)
                with np.errstate(over="ignore"):
                    key = mix(found * U(2 * tables + 1) + (U(2) * np.arange(tables, dtype=np.uint64) + U(1))[None, :, None] + U(x.shape[1]) * U(0x9E3779B97F4A7C15))
                key = key.reshape(len(rows), -1).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * key.shape[1]), pa.array(key.ravel()))
                unit = pa.array([v.tobytes() for v in x.astype("<f4")], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("cls").take(pa.array(rows)), unit, keys], ["cls", "unit", "keys"])


def best_of(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (query, candidate, score) the k best of each query and all within MARGIN of them, once each."""
    order = np.lexsort((c, q))
    q, c, s = q[order], c[order], s[order]
    new = np.append(True, (q[1:] != q[:-1]) | (c[1:] != c[:-1]))[: len(q)]
    q, c, s = q[new], c[new], s[new]
    order = np.lexsort((-s, q))
    q, c, s = q[order], c[order], s[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
    size = np.diff(np.append(start, len(q)))
    level = np.where(size >= k, s[np.minimum(start + k, start + size) - 1] - MARGIN, -np.inf)
    keep = s >= np.repeat(level, size)
    return q[keep], c[keep], s[keep]


def _pairs(vec: np.ndarray, cls: np.ndarray, is_query: np.ndarray, key: np.ndarray, k: int):
    """Pairs of the queries and candidates of each run of a key, the queries first in it."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    end = np.append(start[1:], len(key))
    n_q = np.add.reduceat(is_query.astype(np.int64), start)
    n_c = end - start - n_q
    both = (n_q > 0) & (n_c > 0)
    start, n_q, n_c = start[both], n_q[both], n_c[both]
    large = n_q * n_c > PAIRS // 4
    for a, nq, nc in zip(start[large].tolist(), n_q[large].tolist(), n_c[large].tolist(), strict=True):
        rows, others = max(1, PAIRS // nc), vec[a + nq : a + nq + nc]
        for at in range(a, a + nq, rows):
            own = np.arange(at, min(at + rows, a + nq))
            s = vec[own] @ others.T
            yield best_of(np.repeat(cls[own], nc), np.tile(cls[a + nq : a + nq + nc], len(own)), s.ravel(), k)
    start, n_q, n_c = start[~large], n_q[~large], n_c[~large]
    total = np.cumsum(n_q * n_c)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = n_q[at:to] * n_c[at:to]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        per = np.repeat(n_c[at:to], n)
        x, y = np.repeat(start[at:to], n) + nth // per, np.repeat(start[at:to] + n_q[at:to], n) + nth % per
        yield best_of(cls[x], cls[y], np.einsum("ij,ij->i", vec[x], vec[y]), k)
        at = to


FOUND = "query long, cls long, s float"


def _found(part: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in part], ["query", "cls", "s"])


def _meet(batches, k: int):
    """Best pairs of sorted rows (key, is_query, cls, unit): a task sends each query's best of all its buckets."""
    held, size = [], 0
    for table in runs_of(batches, "key"):
        raw = table.column("unit").to_pylist()
        columns = [table.column(n).to_numpy() for n in ("cls", "is_query", "key")]
        for own in _by_size(raw):
            vec = np.frombuffer(b"".join([raw[i] for i in own.tolist()]), "<f4").reshape(len(own), -1)
            for part in _pairs(vec, *(c[own] for c in columns), k):
                held.append(part)
                size += len(part[0])
                if size > 8 * PAIRS:
                    held = [best_of(*(np.concatenate([h[i] for h in held]) for i in range(3)), k)]
                    size = len(held[0][0])
                    if size > 4 * PAIRS:
                        yield _found(held[0])
                        held, size = [], 0
    if held:
        yield _found(best_of(*(np.concatenate([h[i] for h in held]) for i in range(3)), k))


def _best(batches, k: int):
    """Best pairs of each query, of rows sorted by it."""
    for table in runs_of(batches, "query"):
        yield _found(best_of(*(table.column(n).to_numpy() for n in ("query", "cls", "s")), k))


def _candidates(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Pairs (query, cls) that share a key and are among the best k of the query, of rows (cls, unit, keys)."""
    spark = queries.sparkSession
    flat = lambda df: df.select("cls", "unit", F.explode("keys").alias("key"))
    count = lambda df, name: df.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > BLOCK)
    hot = materialize(count(index, "n_c").join(count(queries, "n_q"), "key", "full"))
    c, q = flat(index), flat(queries)
    if hot.take(1):
        blocks = hot.select("key", *[F.greatest(F.ceil(F.coalesce(n, F.lit(1)) / BLOCK), F.lit(1)).cast("int").alias(n) for n in ("n_c", "n_q")])

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            df = df.join(blocks, "key", "left").fillna(1, ["n_c", "n_q"])
            df = df.withColumn("own", F.pmod(F.xxhash64("cls", "key"), F.col(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            return df.select("cls", "unit", F.when((F.col("n_c") > 1) | (F.col("n_q") > 1), F.xxhash64("key", *(("own", "other") if own == "n_c" else ("other", "own")))).otherwise(F.col("key")).alias("key"))

        c, q = dealt(c, "n_c", "n_q"), dealt(q, "n_q", "n_c")
    rows = c.select("key", F.lit(False).alias("is_query"), "cls", "unit").union(q.select("key", F.lit(True), "cls", "unit"))
    met = rows.repartition(n_shuffle(spark), "key").sortWithinPartitions("key", F.desc("is_query")).mapInArrow(partial(_meet, k=k), FOUND)
    return met.repartition(n_shuffle(spark), "query").sortWithinPartitions("query").mapInArrow(partial(_best, k=k), FOUND).select("query", "cls")


def _exact(batches, kind: str):
    """Cosines in double precision."""
    for batch in batches:
        raw_a, raw_b = batch.column("qvec").to_pylist(), batch.column("vec").to_pylist()
        score = np.full(batch.num_rows, np.nan)
        for own in _by_size(raw_a):
            own = own[[len(raw_b[i]) == len(raw_a[i]) for i in own.tolist()]]
            if not len(own):
                continue
            a, b = (_scaled(np.frombuffer(b"".join([raw[i] for i in own.tolist()]), kind).reshape(len(own), -1)) for raw in (raw_a, raw_b))
            dot = lambda x, y: np.array([np.dot(u, v) for u, v in zip(x, y, strict=True)])
            score[own] = dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))
        kept = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("query"), batch.column("ids"), pa.array(score)], ["query_id", "query", "ids", "score"]).filter(pa.array(kept))


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 5, tables: int = 24, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest other rows of every query row by cosine: query_id, rank, vec_id, score."""
    number, kind = ("float", "<f4") if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else ("double", "<f8")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{number}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null")
    packed = rows.mapInArrow(partial(_packed, kind=kind), "id long, vec binary, q boolean, dim long").withColumn("cls", F.xxhash64("vec"))
    packed = materialize(packed)
    # copies beyond the k + 1 smallest ids of a vector leave before the shuffle
    few = F.dense_rank().over(Window.partitionBy("cls", "vec").orderBy("id"))
    classes = packed.select("cls", "vec", "id", few.alias("r")).where(F.col("r") <= k + 1).groupBy("cls", "vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    classes = materialize(classes)
    asked = packed.where("q").select("cls", "vec", F.col("id").alias("query_id"), "dim").distinct()
    total = {r[0]: r[1] for r in packed.groupBy("dim").count().collect()}  # a row a dimension
    sizes = {r[0]: r[1] for r in classes.groupBy((F.length("vec") / np.dtype(kind).itemsize).cast("long")).count().collect()}
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return vectors.sparkSession.createDataFrame([], schema)
    axes = {dim: layout(n, dim) for dim, n in sizes.items()}
    hashed = lambda df, probing: materialize(df.select("cls", "vec").mapInArrow(partial(_hash, kind=kind, tables=tables, axes=axes, probing=probing), ROW))
    index, queries = hashed(classes, False), hashed(asked.dropDuplicates(["cls", "vec"]), True)

    def ranked(pairs: DataFrame) -> DataFrame:
        full = asked.join(pairs.withColumnRenamed("cls", "other"), F.col("cls") == F.col("query")).select("query_id", "query", F.col("vec").alias("qvec"), "other")
        full = full.join(classes.select(F.col("cls").alias("other"), "vec", "ids"), "other").select("query_id", "query", "qvec", "vec", "ids")
        flat = full.mapInArrow(partial(_exact, kind=kind), "query_id long, query long, ids array<long>, score double").select("query_id", "query", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
        return flat.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    first = materialize(ranked(_candidates(queries, index, k + 1)))
    needed = F.create_map(*[F.lit(v) for dim, n in total.items() for v in (dim, min(k, n - 1))])
    have = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    short = asked.join(have, "query_id", "left").where(F.coalesce("have", F.lit(0)) < needed[F.col("dim")]).select("query_id", "cls").distinct()
    short = materialize(short)
    if not short.take(1):
        return first
    every = lambda df: df.withColumn("keys", F.array(F.length("unit").cast("long")))
    slow = ranked(_candidates(every(queries.join(short.select("cls").distinct(), "cls", "left_semi")), every(index), k + 1))
    slow = materialize(slow.join(short.select("query_id").distinct(), "query_id", "left_semi"))
    return first.join(slow.select("query_id").distinct(), "query_id", "left_anti").unionByName(slow)
