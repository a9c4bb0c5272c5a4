"""Removal of repeated word windows by Rabin-Karp hashes (operator 12).

Every window of `size` consecutive words gets a polynomial hash of its words, rolled along the text.  Spark counts the
hashes twice.  First 32 bits of each hash, once a deal of texts and bucket, tell which windows may occur in more than one
document; then 96 bits of those alone, with the smallest id of the deal, tell the windows that also start in a document with
a smaller id.  The windows to remove are merged into maximal intervals of words.

Texts are dealt once, into deals of about DEAL bytes; all passes read that exchange.  The hashes of a deal are sent
in their own order, so what goes back is one bit a hash.  A frequent window is one hash a deal, however many rows hold it.

Defined cases: words are runs of bytes other than \\x20 and \\x09-\\x0D, compared as they are; a null or empty text has
none; fewer words than `size` make no window; rows that share an id are not compared with each other, each is held against smaller
ids by its own text, so repeated rows keep alike; null ids come before all others; overlapping windows
count; a very long text is read whole, as a slice of its own; an empty table gives no rows; other columns are ignored.  Two
different windows count as one if 96 bits of their hashes agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import U, mix, n_shuffle, not_blank, range_hashes, slices, spans, trim

DEAL, BUCKET, LEAST, SPREAD = 32 << 20, 128 << 20, 2 << 20, 16
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def rolled(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial of `size` word hashes from every word on, modulo 2^64, scrambled."""
    n = max(len(words) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out *= U(base)
            out += words[k : k + n]
        return mix(out)


def windows(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the rows of a slice: row, first word within the row, hash and second hash (32 bits)."""
    starts, ends, rows = spans(not_blank(data), off)
    words = range_hashes(data, starts, ends)
    inside = np.flatnonzero(rows[size - 1 :] == rows[: max(len(rows) - size + 1, 0)]) if len(rows) >= size else np.zeros(0, np.int64)
    first = np.searchsorted(rows, np.arange(len(off)))
    row = rows[inside]
    return row, inside - first[row], rolled(words, size, BASES[0])[inside], (rolled(words, size, BASES[1])[inside] >> U(32)).astype(np.uint32)


def ids_of(column) -> np.ndarray:
    return column.fill_null(-(1 << 63)).to_numpy().astype(np.int64)


class Deal:
    """The windows of all rows of a deal, slice after slice."""

    def __init__(self, docs: pa.Table, size: int):
        h, g, ids, at, base = [], [], [], [], 0
        for batch in docs.combine_chunks().to_batches():
            for rows, data, off in slices(batch, "text"):
                row, place, h1, h2 = windows(data, off, size)
                own = ids_of(rows.column("doc_id"))
                h.append(h1), g.append(h2), ids.append(own[row]), at.append(np.stack((row + base, place)))
                base += rows.num_rows
        join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        self.h, self.g, self.id = join(h, np.uint64), join(g, np.uint32), join(ids, np.int64)
        self.row, self.place = np.concatenate(at, axis=1) if at else np.zeros((2, 0), np.int64)

    def groups(self, at: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """Order of the windows `at` by hash (and second hash), and where the groups of equal ones start in it."""
        order = at[np.lexsort((self.g[at], self.h[at])) if exact else np.argsort(self.h[at], kind="stable")]
        h, g = self.h[order], self.g[order]
        new = np.ones(len(order), bool)
        new[1:] = h[1:] != h[:-1]
        if exact:
            new[1:] |= g[1:] != g[:-1]
        return order, np.flatnonzero(new)


def cut(h: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Sorted hashes by bucket of their upper bits: bucket, from, to."""
    b = ((h >> U(32)) * U(buckets)) >> U(32)
    at = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    yield from zip(b[at].astype(np.int64).tolist(), at.tolist(), [*at[1:].tolist(), len(b)], strict=True)


SENT = "bucket int, deal int, kind int, h binary, g binary, id binary"
BITS = "deal int, kind int, bucket int, bits binary"
KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<struct<first:int,last:int>>": pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))}


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(c, KINDS[k]) for (n, k), c in zip(fields, columns, strict=True)})


def pack(x: np.ndarray) -> bytes:
    """Integers as bytes, by the differences of neighbours."""
    raw = np.diff(x, prepend=x.dtype.type(0)).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(raw: bytes, dtype) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True), dtype), dtype=dtype)


def _prints(docs: pa.Table, size: int, buckets: int) -> pa.Table:
    """32 bits of each hash of a deal, by bucket, and whether several documents of the deal have it."""
    if not docs.num_rows:
        return table_of([], SENT)
    d, deal = Deal(docs, size), docs.column("deal")[0].as_py()
    order, first = d.groups(np.arange(len(d.h)), False)
    ids, h, out = d.id[order], d.h[order][first], []
    if len(first):
        many = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
        out = [(b, deal, 0, h[i:j].astype(np.uint32).tobytes(), np.packbits(many[i:j]).tobytes(), b"") for b, i, j in cut(h, buckets)]
    del d
    trim()
    return table_of(out, SENT)


def _bits(bits: pa.Table, kind: int) -> dict[int, bytes]:
    return {r["bucket"]: r["bits"] for r in bits.to_pylist() if r["kind"] == kind}


def _spread(h: np.ndarray, bits: dict[int, bytes], buckets: int) -> np.ndarray:
    """The bits of all buckets in the order of the hashes."""
    out = np.zeros(len(h), bool)
    for b, i, j in cut(h, buckets):
        if b in bits:
            out[i:j] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=j - i).astype(bool)
    return out


def _nominated(d: Deal, bits: pa.Table, buckets: int) -> np.ndarray:
    """Windows whose 32 bits occur in several documents."""
    order, first = d.groups(np.arange(len(d.h)), False)
    if not len(order):
        return order
    group = np.repeat(_spread(d.h[order][first], _bits(bits, 0), buckets), np.diff(np.append(first, len(order))))
    return order[group]


def _nominees(docs: pa.Table, bits: pa.Table, size: int, buckets: int) -> pa.Table:
    """The nominated windows of a deal with its smallest id, by bucket; the bits that nominated them travel along."""
    if not docs.num_rows:
        return table_of([], SENT)
    d, deal = Deal(docs, size), docs.column("deal")[0].as_py()
    order, first = d.groups(_nominated(d, bits, buckets), True)
    out = [(-1, deal, r["bucket"], r["bits"], b"", b"") for r in bits.to_pylist()]
    if len(first):
        h, g, low = d.h[order][first], d.g[order][first], np.minimum.reduceat(d.id[order], first)
        out += [(b, deal, 1, pack(h[i:j]), g[i:j].tobytes(), pack(low[i:j])) for b, i, j in cut(h, buckets)]
    del d
    trim()
    return table_of(out, SENT)


def _by_bucket(batches) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["bucket"] != held[0]["bucket"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _answer(held: list[dict], kind: int, flags: np.ndarray, sizes: list[int]) -> pa.RecordBatch:
    parts = np.split(flags, np.cumsum(sizes)[:-1])
    rows = [(r["deal"], kind, r["bucket"], np.packbits(p).tobytes()) for r, p in zip(held, parts, strict=True) if p.any()]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table_of(rows, BITS).columns], names=["deal", "kind", "bucket", "bits"])


def _several(batches):
    """Of the 32 bits of a bucket, those of several documents: bits for each deal.  Sorted by bucket."""
    for held in _by_bucket(batches):
        sizes = [len(r["h"]) // 4 for r in held]
        h = np.frombuffer(b"".join(r["h"] for r in held), np.uint32)
        flags = np.concatenate([np.unpackbits(np.frombuffer(r["g"], np.uint8), count=n) for r, n in zip(held, sizes, strict=True)]).astype(bool)
        s = np.sort(np.concatenate((h, h[flags])))
        known = np.unique(s[1:][s[1:] == s[:-1]])
        if len(known):
            flags = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        yield _answer(held, 0, flags, sizes)
        trim()


def _later(batches):
    """Of the nominated hashes of a bucket, those that a smaller id than the deal's has: bits for each deal."""
    for held in _by_bucket(batches):
        if held[0]["bucket"] < 0:
            rows = [(r["deal"], 0, r["kind"], r["h"]) for r in held]
            yield from table_of(rows, BITS).combine_chunks().to_batches()
            continue
        parts = [unpack(r["h"], np.uint64) for r in held]
        sizes, h = [len(p) for p in parts], np.concatenate(parts)
        g = np.concatenate([np.frombuffer(r["g"], np.uint32) for r in held])
        low = np.concatenate([unpack(r["id"], np.int64) for r in held])
        order = np.lexsort((low, g, h))
        h, g = h[order], g[order]
        new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
        least = low[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        flags = np.zeros(len(h), bool)
        flags[order] = low[order] > least
        yield _answer(held, 1, flags, sizes)
        trim()


DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:int,last:int>>"


def _remove(docs: pa.Table, bits: pa.Table, size: int, buckets: int, with_text: bool) -> pa.Table:
    schema = DONE + ", text string" * with_text
    if not docs.num_rows:
        return table_of([], schema)
    d = Deal(docs, size)
    order, first = d.groups(_nominated(d, bits, buckets), True)
    row, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(first):
        n = np.diff(np.append(first, len(order)))
        low = np.repeat(np.minimum.reduceat(d.id[order], first), n)
        elsewhere = np.repeat(_spread(d.h[order][first], _bits(bits, 1), buckets), n)
        gone = order[elsewhere | (d.id[order] > low)]
        gone = gone[np.lexsort((d.place[gone], d.row[gone]))]
        row, place = d.row[gone], d.place[gone]
    del d
    out, ids = [], docs.column("doc_id").to_pylist()
    bounds = np.searchsorted(row, np.arange(docs.num_rows + 1)).tolist()
    for i, text in enumerate(docs.column("text")):
        raw = text.as_buffer()
        words = bytes(raw).split() if raw is not None else []
        merged: list[tuple[int, int]] = []
        if bounds[i + 1] > bounds[i]:
            p = place[bounds[i] : bounds[i + 1]]
            opens = np.append(True, p[1:] > p[:-1] + size)
            merged = list(zip(p[opens].tolist(), (p[np.append(opens[1:], True)] + size).tolist(), strict=True))
        kept, at = [], 0
        for a, b in merged:
            kept += words[at:a]
            at = b
        joined = b" ".join(kept + words[at:] if merged else words)
        removed = sum(b - a for a, b in merged)
        out.append((ids[i], len(words), removed, hashlib.sha256(joined).hexdigest(), [{"first": a, "last": b - 1} for a, b in merged], joined.decode("utf-8"))[: 5 + with_text])
    trim()
    return table_of(out, schema)


def dedup_words(docs: DataFrame, size: int = 13, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (the maximal intervals of removed words, from 0, both ends
    included) and, if asked for, the kept words joined by one space."""
    n = n_shuffle(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.input_file_block_start().alias("block"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # what a group holds follows DEAL and BUCKET; with more partitions than that, they get LEAST each, so that a deal's hashes
    # are not cut into more pieces than they are worth
    deals, buckets = (max(-(-total // most), min(k * n, total // LEAST), 1) for most, k in ((DEAL, 1), (BUCKET, 4)))
    # equal rows of one id are spread by the part of the file they stand in
    deal = F.pmod(F.xxhash64("doc_id", "text", F.pmod(F.xxhash64("block"), F.lit(SPREAD))), F.lit(deals)).cast("int")
    dealt = texts.select("doc_id", deal.alias("deal"), "text").repartition(n, "deal")

    def prints(docs: pa.Table) -> pa.Table:
        return _prints(docs, size, buckets)

    def nominees(docs: pa.Table, bits: pa.Table) -> pa.Table:
        return _nominees(docs, bits, size, buckets)

    def remove(docs: pa.Table, bits: pa.Table) -> pa.Table:
        return _remove(docs, bits, size, buckets, with_text)

    def counted(sent: DataFrame, work) -> DataFrame:
        to = F.when(F.col("bucket") < 0, -1 - F.col("deal")).otherwise(F.col("bucket"))
        return sent.withColumn("to", to).repartition(n, "to").sortWithinPartitions("bucket", "deal").drop("to").mapInArrow(work, BITS)

    several = counted(dealt.groupBy("deal").applyInArrow(prints, SENT), _several)
    later = counted(dealt.groupBy("deal").cogroup(several.groupBy("deal")).applyInArrow(nominees, SENT), _later)
    return dealt.groupBy("deal").cogroup(later.groupBy("deal")).applyInArrow(remove, DONE + ", text string" * with_text)
