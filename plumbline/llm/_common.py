"""Helpers shared by the training-data operators: text batches, hashing, written intermediates."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
HOT, SALTS, STAR = 1000, 64, 16
ROW_KEY = "row_key struct<own:string,id:long>"
U = np.uint64
MASK = (1 << 64) - 1
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).  Only a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
        elif spark.sparkContext.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="plumbline-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, *by: str) -> DataFrame:
    """Write df as a table in the shared folder, in a part for each value of the columns `by`, and read it back, so that its
    lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/plumbline-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key() -> Column:
    """What tells a row of doc_id and text from others, never null: its id; of rows without one, the SHA-256 of
    the text, so that equal texts are one.  Rows with an id sort first."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.struct(F.when(doc_id.isNull(), F.sha2(text, 256)).alias("own"), doc_id.alias("id"))


def drop(df: DataFrame) -> None:
    """Delete the table of a frame that materialize returned and nothing reads any more."""
    jvm, files = df.sparkSession.sparkContext._jvm, df.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage: only then does Spark remove the files of shuffles nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows with about `limit` bytes of text: (rows, bytes, row offsets).

    A null text counts as empty; a longer text is a slice of its own.
    """
    text = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to
    trim()


def trim() -> None:
    """Give memory that Arrow and the C library hold, but nothing uses, back to the system: workers live on."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_INV = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    step, filled = U(base), 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * step
        step, filled = step * step, filled * 2
    return out[:n]


#: Powers of the base and of its inverse: those below WIDE, and each WIDE-th as far as the longest data needed.
WIDE, STEP = 1 << 12, 1 << 18
_POW: dict[str, np.ndarray] = {}


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]], equal for equal bytes wherever they stand.

    The bytes are summed up STEP at a time and a power is a product of two kept ones: workers live on, and a table of
    all powers would stay with them.
    """
    n = len(data) + 1
    with np.errstate(over="ignore"):
        if len(_POW.get("up", ())) * WIDE < n:
            for name, base in (("up", 0x9E3779B97F4A7C15), ("down", _INV)):
                _POW[name], _POW[f"{name} low"] = _powers(pow(base, WIDE, 1 << 64), -(-n // WIDE)), _powers(base, WIDE)
        prefix = np.zeros(n, np.uint64)
        for at in range(0, n - 1, STEP):
            part = _BYTE[data[at : at + STEP]]
            part *= (_POW["up"][at // WIDE : -(-(at + len(part)) // WIDE), None] * _POW["up low"]).ravel()[: len(part)]
            part[0] += prefix[at]
            np.cumsum(part, out=prefix[at + 1 : at + 1 + len(part)])
        h = (prefix[ends] - prefix[starts]) * (_POW["down"][starts // WIDE] * _POW["down low"][starts % WIDE])
        return mix(h + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true bytes within rows: starts, ends and the row of each."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1 : len(inside)]
    last[:-1] &= ~inside[1:] | edge[1 : len(inside)]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def not_blank(data: np.ndarray) -> np.ndarray:
    """Bytes of words [^\\x20\\x09-\\x0D]+."""
    return (data != 32) & ((data < 9) | (data > 13))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingles(data: np.ndarray, off: np.ndarray, size: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of word shingles, row by row, the row bounds within them, and the words of each row.

    Words are runs of true bytes.  A row with fewer words than `size` has its whole sequence as one
    shingle; a row without words has none.
    """
    starts, ends, rows = spans(inside, off)
    n = len(off) - 1
    count = np.bincount(rows, minlength=n)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), count
    word = range_hashes(data, starts, ends)
    base = np.concatenate(([0], np.cumsum(count)))
    kept = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(kept)))
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], kept) + np.repeat(base[:-1], kept)
    length = np.repeat(np.minimum(count, size), kept)
    with np.errstate(over="ignore"):
        out = length.astype(np.uint64) * U(0xA0761D6478BD642F)
        for k in range(size):
            use = k < length
            out[use] = mix(out[use] * U(0xE7037ED1A0B428DB) + word[at[use] + k])
    return out, bounds, count


def numbered(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ..., so that no name of theirs clashes with an operator's."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def frequent(counts: DataFrame) -> DataFrame:
    """Of rows (keys, n), those with more than one part in HOT of the sum of n: fewer than HOT, without n."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") * HOT > F.lit(total)).drop("n")


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame, how: str, by: list[str]) -> DataFrame:
    """rows.join(table, keys, how) where rows of hot keys (fewer than HOT, which are broadcast) and of null ones are
    spread over SALTS tasks by a hash of the columns `by`; the table's hot rows go to each."""
    mark = F.broadcast(hot.select(*keys, F.lit(True).alias("is hot")))
    spread = F.col("is hot")
    for k in keys:
        spread = spread | F.col(k).isNull()
    salt = F.when(spread, F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    rows = rows.join(mark, keys, "left").withColumn("salt of the row", salt).drop("is hot")
    every = F.when(F.col("is hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    table = table.join(mark, keys, "left").withColumn("salt of the row", F.explode(every)).drop("is hot")
    return rows.join(table, [*keys, "salt of the row"], how).drop("salt of the row")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of each vertex of an undirected edge table: columns id, component.

    Alternates large-star and small-star contraction; each round is a written table, which goes when the next is there,
    and the number of rounds follows the logarithm of the longest path.  The edges of a vertex are spread over STAR tasks.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e = materialize(e)
    seen = None

    def lowest(edges: DataFrame, low: DataFrame) -> DataFrame:
        salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(STAR)))
        return salted.join(low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(STAR - 1).cast("long")))), ["a", "salt"])

    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = lowest(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = lowest(large, low).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        before, e = e, materialize(small)
        drop(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == tuple(now):
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct().toDF("id", "component"))
        seen = tuple(now)


def runs_of(batches, key: str) -> Iterator[pa.Table]:
    """Batches of rows sorted by a key of integers, joined and cut anew so that no run of one key is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last or (held and held[-1].column(key)[0].as_py() != keys[0]):
            first = int(np.searchsorted(keys, held[-1].column(key)[-1].as_py(), "right")) if held else 0
            cut = max(first, last)
            done = pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
            if done.num_rows:
                yield done
            batch = batch.slice(cut)
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
