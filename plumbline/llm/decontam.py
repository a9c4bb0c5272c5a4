"""Benchmark decontamination (operator 1).

A window of an item's size is laid at every word of every text and has a SimHash of its weighted word shingles
(five words, an item's own number where it has fewer; the weight is how often one occurs); running sums
of the hashes' bits give all windows of a size at once.  The 64 bits are looked up in a multi-index of four
blocks of 16: an item stands under all values within 3 bits of its own, so every item within 15 bits of a window
agrees in a block at least and is nominated; for a stranger one of 24 is.  Of nominated items those within the
radius are held against the window by the exact weighted Jaccard similarity of the shingles.

Items of more than 16 shingles share windows with sizes that differ by 3 % at most, so the work grows with the
logarithm of the largest size; the exact similarity is that of a window of the item's own size.

Equal items are one.  Items are dealt by size into blocks of about `ITEMS` items and `BYTES` bytes, which alone pass
through the driver, one at a time: a size's windows are made for one block, whatever the benchmark's size.  A
text is read once a block, in slices of bounded size; a longer text is a slice of its own, read whole.

Defined cases: words are runs of letters and digits in lower case (every non-ASCII character but common
punctuation counts as a letter); a text of fewer words than an item is one window, of fewer than a
shingle has no hit; null or wordless items match nothing; null or empty texts have no hit; repeated rows give
repeated hits and repeated items a hit each; ids may be null; ties go to the first window; empty tables give no
rows; other columns are ignored by find_leaks and kept by drop_leaks, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import materialize, numbered, shingles, slices

ITEMS, BYTES, RADIUS, STEP = 2000, 8 << 20, 15, 1 << 14
BLOCKS, BLOCK_BITS, NEAR = 4, 16, 3
TEXT = "text of the row"
PUNCTUATION = "[\u00a0-\u00bf\u2000-\u206f\u3000-\u3003]"
_EIGHT = (1 << np.arange(8, dtype=np.uint8))[:, None]
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_FLIPS = np.array([sum(1 << b for b in bits) for r in range(NEAR + 1) for bits in combinations(range(BLOCK_BITS), r)], np.uint16)


def lowered(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    """The batch with its text in lower case and common non-ASCII punctuation blank."""
    text = pc.utf8_lower(pc.fill_null(batch.column(column), ""))
    if pc.any(pc.match_substring_regex(text, PUNCTUATION)).as_py():
        text = pc.replace_substring_regex(text, PUNCTUATION, " ")
    return pa.RecordBatch.from_arrays([text if n == column else batch.column(n) for n in batch.schema.names], batch.schema.names)


def window_size(n: int) -> int:
    """Shingles of the windows for items of n shingles: n itself up to 16, then steps of 6 %."""
    return n if n <= 16 else round(16 * 1.06 ** round(log(n / 16) / log(1.06)))


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1)


def _packed(more: np.ndarray) -> np.ndarray:
    return np.packbits(more.ravel()).view(np.uint16).reshape(-1, BLOCKS)


def simhash(h: np.ndarray) -> np.ndarray:
    """SimHash of a sequence of shingles, each as heavy as it is frequent, as BLOCKS numbers."""
    return _packed(_bits(h).sum(0, dtype=np.int64)[None] > len(h) // 2)[0]


def window_prints(h: np.ndarray, sizes: list[int]):
    """(size, first start, SimHashes) of all windows of each size, in stretches of STEP starts or twice the largest size."""
    step = max(STEP, 2 * max(sizes))
    kind = np.uint8 if max(sizes) < 256 else np.uint32
    for at in range(0, len(h), step):
        part = h[at : at + step + max(sizes) - 1]
        total = np.zeros((len(part) + 1, 64), kind)
        np.cumsum(_bits(part), axis=0, dtype=kind, out=total[1:])
        more, sums = np.empty((step, 64), bool), np.empty((step, 64), kind)
        for m in sizes:
            n = min(step, len(part) - m + 1)
            if n > 0:
                # sums of fewer than 256 bits are right modulo 256
                np.subtract(total[m : m + n], total[:n], out=sums[:n])
                yield m, at, _packed(np.greater(sums[:n], m // 2, out=more[:n]))


class Index:
    """Items (name, words of a shingle, bag of shingles) by window size, eight to a table: what a block's value holds
    are the bits of those items of the table that have a value within NEAR bits."""

    def __init__(self, items: list[tuple[str, int, np.ndarray]]):
        self.names = [name for name, _, _ in items]
        self.bags = [Counter(h.tolist()) for _, _, h in items]
        self.n = [len(h) for _, _, h in items]
        prints = np.array([simhash(h) for _, _, h in items], np.uint16).reshape(-1, BLOCKS)
        self.prints = prints.view(np.uint64).ravel()
        self.tables: dict[tuple[int, int], list[tuple[list[int], np.ndarray]]] = {}
        of: dict[tuple[int, int], list[int]] = {}
        for i, (_, size, h) in enumerate(items):
            of.setdefault((size, window_size(len(h))), []).append(i)
        for key, members in of.items():
            for a in range(0, len(members), 8):
                own, table = members[a : a + 8], np.zeros((BLOCKS, 1 << BLOCK_BITS), np.uint8)
                for bit, i in enumerate(own):
                    for b in range(BLOCKS):
                        table[b, prints[i, b] ^ _FLIPS] |= 1 << bit
                self.tables.setdefault(key, []).append((own, table))
        self.sizes: dict[int, list[int]] = {}
        for size, m in sorted(self.tables):
            self.sizes.setdefault(size, []).append(m)

    def within(self, size: int, m: int, prints: np.ndarray):
        """(windows, item) for the items of this size nominated for them and within the radius."""
        whole, values = prints.view(np.uint64).ravel(), prints.T.astype(np.intp)
        for own, table in self.tables[size, m]:
            named = table[0][values[0]]
            for b in range(1, BLOCKS):
                named |= table[b][values[b]]
            at = np.flatnonzero(named)
            near = np.bitwise_count(whole[at] ^ self.prints[own][:, None]) <= RADIUS
            near &= np.bitwise_and(named[at], _EIGHT[: len(own)]) > 0
            if near.any():
                for bit in np.flatnonzero(near.any(1)).tolist():
                    yield at[near[bit]], own[bit]

    def candidates(self, h: np.ndarray, bounds: np.ndarray, size: int, least: float):
        """(starts of windows, item) within rows of shingles."""
        length = np.diff(bounds)
        left = np.repeat(bounds[1:], length) - np.arange(len(h))
        for dtype in (False, True):
            sizes = [m for m in self.sizes[size] if (m >= 256) == dtype]
            for m, at, prints in window_prints(h, sizes) if sizes else ():
                for k, i in self.within(size, m, prints):
                    yield (at + k)[left[at + k] >= m], i
        # rows too short for a window are one
        short = np.flatnonzero((length > 0) & (length < max(self.sizes[size])))
        if len(short):
            prints = np.array([simhash(h[bounds[r] : bounds[r + 1]]) for r in short.tolist()], np.uint16).reshape(-1, BLOCKS)
            for m in self.sizes[size]:
                fit = np.flatnonzero((length[short] < m) & (length[short] >= ceil(least * m * 0.96)))
                if len(fit):
                    for k, i in self.within(size, m, np.ascontiguousarray(prints[fit])):
                        yield bounds[:-1][short[fit[k]]], i

    def hits(self, h: np.ndarray, bounds: np.ndarray, size: int, least: float) -> list[tuple[int, int, int, int, float]]:
        """(row, item, first word, words, similarity): the best window of each item that is similar enough."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for starts, i in self.candidates(h, bounds, size, least):
            for start, row in zip(starts.tolist(), (np.searchsorted(bounds, starts, "right") - 1).tolist(), strict=True):
                m = min(self.n[i], int(bounds[row + 1]) - start)
                both = sum((Counter(h[start : start + m].tolist()) & self.bags[i]).values())
                score, place = both / (m + self.n[i] - both), start - int(bounds[row])
                if score >= least and ((row, i) not in best or (-score, place) < (-best[row, i][0], best[row, i][1])):
                    best[row, i] = (score, place, m + size - 1)
        return sorted((row, i, place, words, score) for (row, i), (score, place, words) in best.items())


def _described(batches, size: int):
    """Items with words: name, words of a shingle, shingles."""
    for batch in batches:
        table, rows = lowered(batch, "text"), []
        for k in range(size, 0, -1):
            for part, data, off in slices(table, "text"):
                h, bounds, count = shingles(data, off, k, _INSIDE[data])
                chosen = np.flatnonzero(np.minimum(count, size) == k)
                rows += [(part.column("name")[i].as_py(), k, window_size(int(bounds[i + 1] - bounds[i])), h[bounds[i] : bounds[i + 1]].tobytes()) for i in chosen.tolist()]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, ["name", "size", "m", "bag"])


def _found(batch: pa.RecordBatch, index: Index, least: float, column: str = "text"):
    """Hits in a batch: (row of the batch, item, first word, words, similarity)."""
    texts, at = lowered(batch.select([column]), column), 0
    for rows, data, off in slices(texts, column):
        inside = _INSIDE[data]
        for size in index.sizes:
            h, bounds, count = shingles(data, off, size, inside)
            # a row with fewer words than a shingle has none
            if (few := (count < size) & (count > 0)).any():
                h, bounds = h[~np.repeat(few, np.diff(bounds))], np.append(0, np.cumsum(np.where(few, 0, np.diff(bounds))))
            for row, *rest in index.hits(h, bounds, size, least):
                yield (at + row, *rest)
        at += rows.num_rows


def _index(block: list[tuple]) -> Index:
    return Index([(name, size, np.frombuffer(bag, np.uint64)) for name, size, bag in block])


def _hits(batches, block: list[tuple], least: float):
    index = _index(block)
    for batch in batches:
        rows = sorted(_found(batch, index, least))
        of, item, *columns = (pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())))
        names = pa.array([index.names[i] for i in item.to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), names, *columns], ["doc_id", "name", "first_word", "n_words", "similarity"])


def _clean(batches, block: list[tuple], least: float, column: str):
    index = _index(block)
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for row, *_ in _found(batch, index, least, column):
            keep[row] = False
        yield batch.filter(pa.array(keep))


def item_blocks(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """Distinct items (name, words of a shingle, shingles) in blocks of bounded size, each of few sizes."""
    held = items.where("text is not null").groupBy("name").agg(F.first("text").alias("text")).mapInArrow(partial(_described, size=size), "name string, size int, m int, bag binary")
    held = materialize(held)
    blocks: list[list] = []
    room = 0
    # one row a size: a few hundred, whatever the benchmark holds
    for k, m, n, b in held.groupBy("size", "m").agg(F.count(F.lit(1)), F.sum(F.length("bag"))).orderBy("size", "m").collect():
        parts = max(-(-n // ITEMS), -(-b // BYTES))
        for part in range(parts):
            share = max(n / parts / ITEMS, b / parts / BYTES)
            if share > room:
                blocks.append([])
                room = 1.0
            blocks[-1].append((F.col("size") == k) & (F.col("m") == m) & (F.pmod(F.xxhash64("name"), F.lit(parts)) == part))
            room -= share
    for own in blocks:
        chosen = own[0]
        for other in own[1:]:
            chosen = chosen | other
        yield [tuple(r) for r in held.where(chosen).select("name", "size", "bag").collect()]


def _items(benchmark: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).withColumn("name", F.sha2("text", 256))


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """Hits of benchmark items in texts: doc_id, item_id, first_word, n_words, similarity."""
    texts, items = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _items(benchmark)
    schema = "doc_id long, name string, first_word long, n_words long, similarity double"
    out = None
    for block in item_blocks(items, size):
        found = texts.mapInArrow(partial(_hits, block=block, least=least), schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.join(items.where("text is not null").select("name", "item_id"), "name").select("doc_id", "item_id", "first_word", "n_words", "similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """Rows of docs without a hit.  No row leaves its partition."""
    out = numbered(docs)
    text = f"c{docs.columns.index('text')}"
    if docs.schema["text"].dataType.simpleString() != "string":
        out, text = out.withColumn(TEXT, F.col(text).cast("string")), TEXT
    for block in item_blocks(_items(benchmark), size):
        out = out.mapInArrow(partial(_clean, block=block, least=least, column=text), out.schema)
    return out.drop(TEXT).toDF(*docs.columns)
