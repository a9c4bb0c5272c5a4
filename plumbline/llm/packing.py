"""Best-fit packing of tokenized documents by linear grouping (operator 2).

Lengths, not documents, are planned: the histogram of piece lengths has at most `capacity` rows
whatever the corpus holds.  Large lengths are rounded up to the largest of their equal-cardinality
group, a configuration programme over these few sizes gives patterns, actual lengths take the places of
the rounded ones, and best-fit fills the remaining space with what is left.  The plan's rows say which
ranks of a length go to which sequences; every document finds its rank with salted counting, so no
length, however frequent, meets in one task.

Defined cases: a null text is an empty document and holds its end token only; a document longer than
the capacity is cut into pieces of the capacity, the last may be shorter; repeated rows are packed each;
rows without an id are packed like others; pieces of equal length (ties) take places in the order of their salted ranks; a very long
text is tokenized whole; an empty table gives no rows; columns other than the id and text are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._common import materialize, n_shuffle, not_blank, slices, spans

CACHE_PARTS = 250_000
# parts of words in lower case: endings, letters, a digit, signs; ASCII and Latin letters with marks only
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\\sa-zß-öø-ſ0-9]+| ")
OTHER = re.compile("[^ -~À-ſ]|İ|<\\|")
_STATE: dict = {}


def _encoder(path: str) -> dict:
    """The tokenizer and, for parts met before, their places in one array of ids.  Part 0 is a blank, without ids."""
    if _STATE.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        suffix = getattr(t.model, "end_of_word_suffix", None) or "\0"
        ends = np.zeros(max(t.get_vocab().values()) + 1, bool)
        for token, i in t.get_vocab().items():
            ends[i] = token.endswith(suffix)
        _STATE.update(path=path, tokenizer=t, ends=ends)
        _forget(_STATE)
    return _STATE


def _forget(state: dict) -> None:
    state.update(parts={" ": 0}, ids=np.zeros(0, np.uint32), begin=np.zeros(2, np.int64))


def _gather(ids: np.ndarray, begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of parts one after the other, and where each part's begin."""
    length = begin[which + 1] - begin[which]
    bounds = np.append(0, np.cumsum(length))
    return ids[np.repeat(begin[which] - bounds[:-1], length) + np.arange(bounds[-1])], bounds


def _learn(state: dict, parts: list[str], other: list[str]) -> None:
    """Encode new parts, all in one call: each ends with the one end-of-word token it has.  Words of other
    characters are encoded one by one."""
    t, lengths, found = state["tokenizer"], np.zeros(0, np.int64), []
    if parts:
        ids = np.array(t.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(state["ends"][ids]) + 1
        if len(cuts) == len(parts) and cuts[-1] == len(ids):
            lengths, found = np.diff(np.append(0, cuts)), [ids]
        else:
            found = [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(parts, add_special_tokens=False)]
            lengths = np.array([len(f) for f in found])
    if other:
        more = [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(other, add_special_tokens=False)]
        found, lengths = found + more, np.append(lengths, [len(m) for m in more]).astype(np.int64)
    first = len(state["parts"])
    state["parts"].update(zip(chain(parts, ("\0" + w for w in other)), range(first, first + len(lengths)), strict=True))
    state["begin"] = np.append(state["begin"], state["begin"][-1] + np.cumsum(lengths))
    state["ids"] = np.concatenate([state["ids"], *found])


def _words(words: list[bytes], state: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words, one after the other, and where each word's begin."""
    joined = b" ".join(words).decode("utf-8", "replace")
    other: list[str] = []
    at = np.arange(len(words))
    if OTHER.search(joined):
        each = joined.split(" ")
        odd = np.fromiter(map(bool, map(OTHER.search, each)), bool, len(each))
        other = [each[i] for i in np.flatnonzero(odd).tolist()]
        joined = " ".join([each[i] for i in np.flatnonzero(~odd).tolist()])
        at = np.empty(len(words), np.int64)
        at[~odd], at[odd] = np.arange(len(words) - len(other)), np.arange(len(words) - len(other), len(words))
    parts = PARTS.findall(joined.lower())
    new = [p for p in dict.fromkeys(parts) if p not in state["parts"]]
    odd_new = [w for w in dict.fromkeys(other) if "\0" + w not in state["parts"]]
    if len(state["parts"]) + len(new) + len(odd_new) > CACHE_PARTS:
        _forget(state)
        new, odd_new = [p for p in dict.fromkeys(parts) if p != " "], list(dict.fromkeys(other))
    _learn(state, new, odd_new)
    known = state["parts"]
    which = np.fromiter(chain(map(known.__getitem__, parts), (known["\0" + w] for w in other)), np.int64)
    ids, bounds = _gather(state["ids"], state["begin"], which)
    # a word's parts end at a blank, where the joined words end, and after each other word
    ends = np.append(np.flatnonzero(which[: len(parts)] == 0), [len(parts)] if len(other) < len(words) else []).astype(np.int64)
    ends = np.append(ends, np.arange(len(parts) + 1, len(which) + 1))
    begin = np.append(0, bounds[ends])
    return _gather(ids, begin, at)


def encode(data: np.ndarray, off: np.ndarray, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of rows of text, each followed by the end token, and where each row's begin.

    Blanks part words, which the tokenizer drops in any case and never joins over.  Each distinct word is looked
    at once, so the work in Python follows their number; the rest is done on arrays.
    """
    state, n = _encoder(path), len(off) - 1
    starts, _, rows = spans(not_blank(data), off)
    # a word with the blanks after it
    cells = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data))])
    coded = cells.dictionary_encode()
    ids, begin = _words([w.rstrip(b" \t\n\v\f\r") for w in coded.dictionary.to_pylist()], state) if len(starts) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
    # the end token is one more word, after the last of each row
    last = np.cumsum(np.bincount(rows, minlength=n))
    which = np.insert(coded.indices.to_numpy().astype(np.int64), last, len(begin) - 1)
    out, bounds = _gather(np.append(ids, np.uint32(end_id)), np.append(begin, len(ids) + 1), which)
    return out, np.append(0, bounds[last + np.arange(1, n + 1)])


def _pieces(batches, path: str, capacity: int, end_id: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    for batch in batches:
        for rows, data, off in slices(batch, "text"):
            ids, bounds = encode(data, off, path, end_id)
            length = np.diff(bounds)
            count = -(-length // capacity)
            row = np.repeat(np.arange(len(length)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            size = np.minimum(capacity, length[row] - start)
            raw, at = memoryview(ids.astype("<u4").tobytes()), 4 * (bounds[row] + start)
            parts = [raw[a:b] for a, b in zip(at.tolist(), (at + 4 * size).tolist(), strict=True)]
            crc = pa.array([zlib.crc32(p) for p in parts], pa.int64())
            columns = [rows.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), crc]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([bytes(p) for p in parts], pa.binary())] * with_ids], names)


def cut(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of tokenized documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_pieces, path=path, capacity=capacity, end_id=end_id, with_ids=with_ids), schema)


def _knapsack(sizes: np.ndarray, gain: np.ndarray, capacity: int) -> np.ndarray:
    """Most valuable multiset of sizes within the capacity: how many of each."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for w in range(int(sizes.min()), capacity + 1):
        fit = sizes <= w
        v = np.where(fit, best[np.where(fit, w - sizes, 0)] + gain, -1.0)
        k = int(v.argmax())
        best[w], pick[w] = (v[k], k) if v[k] > best[w - 1] + 1e-12 else (best[w - 1], -1)
    out, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            out[pick[w]] += 1
            w -= int(sizes[pick[w]])
    return out


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of the configuration programme by column generation: (pattern, how often)."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    x = need / np.diag(columns)
    for _ in range(rounds):
        price = np.linalg.solve(columns.T, np.ones(m))
        new = _knapsack(sizes, np.maximum(price, 0), capacity)
        if price @ new <= 1 + 1e-9:
            break
        step = np.linalg.solve(columns, new.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * step, 0)
        columns[:, out], x[out] = new, ratio[out]
    return [(columns[:, j].astype(np.int64), float(x[j])) for j in range(m) if x[j] > 1e-9]


def plan(histogram: dict[int, int], capacity: int = 2048) -> np.ndarray:
    """The shortest plan over a few group counts; the first that meets the bound by total length ends the search."""
    bound = -(-sum(s * n for s, n in histogram.items()) // capacity)
    best, fewest = np.zeros((0, 6), np.int64), None
    for groups, large_share in ((48, 3), (96, 3), (48, 2)):
        rows = grouped_plan(histogram, capacity, groups, large_share)
        sequences = int((rows[:, 3] + -(-rows[:, 2] // rows[:, 4])).max()) if len(rows) else 0
        if fewest is None or sequences < fewest:
            best, fewest = rows, sequences
        if fewest == bound:
            break
    return best


def grouped_plan(histogram: dict[int, int], capacity: int = 2048, groups: int = 48, large_share: int = 3) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, copies a sequence, offset) that place every piece.

    The number of rows follows the number of lengths and of patterns, not of pieces.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = dict.fromkeys(histogram, 0)
    left = dict(histogram)
    next_sequence = 0
    free: dict[int, list[list[int]]] = {}

    def place(length: int, copies: int, bins: int, first: int, offset: int) -> None:
        rows.append((length, used[length], bins * copies, first, copies, offset))
        used[length] += bins * copies
        left[length] -= bins * copies

    large = sorted((s for s in histogram if s > capacity // large_share), reverse=True)
    total = sum(histogram[s] for s in large)
    if total:
        # equal-cardinality groups over lengths in falling order; runs[g] lists (length, how many)
        share, runs, room = -(-total // groups), [[]], 0
        room = share
        for s in large:
            n = histogram[s]
            while n:
                if not room:
                    runs.append([])
                    room = share
                take = min(n, room)
                runs[-1].append([s, take])
                n, room = n - take, room - take
        by_size: dict[int, list[list[int]]] = {}
        for g in runs:
            by_size.setdefault(g[0][0], []).extend(g)
        sizes = np.array(sorted(by_size, reverse=True))
        need = np.array([sum(n for _, n in by_size[s]) for s in sizes.tolist()], float)
        for pattern, times in configurations(sizes, need, capacity):
            times = int(times + 1e-9)
            # the smallest slot of a pattern stays open: best-fit finds the document that fits it most closely
            slots = [int(sizes[k]) for k in np.flatnonzero(pattern) for _ in range(int(pattern[k]))][:-1]
            if not slots:
                continue
            while times and all(by_size[s] for s in slots):
                # the longest stretch of sequences that hold the same actual lengths
                heads, wanted = {}, {}
                for s in slots:
                    wanted[s] = wanted.get(s, 0) + 1
                stretch = min([times, *(by_size[s][0][1] // wanted[s] for s in wanted)])
                one = stretch == 0
                stretch = max(stretch, 1)
                if one and any(sum(n for _, n in by_size[s]) < wanted[s] for s in wanted):
                    break
                offset = 0
                for s in wanted:
                    todo = wanted[s]
                    while todo:
                        head = by_size[s][0]
                        copies = todo if not one else min(todo, head[1])
                        place(head[0], copies, stretch, next_sequence, offset)
                        offset += head[0] * copies
                        head[1] -= copies * stretch
                        todo -= copies
                        if not head[1]:
                            by_size[s].pop(0)
                        heads[s] = True
                if capacity - offset:
                    free.setdefault(capacity - offset, []).append([stretch, next_sequence])
                next_sequence += stretch
                times -= stretch
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            room = next((f for f in range(s, capacity + 1) if free.get(f)), 0)
            if not room:
                copies = min(capacity // s, left[s])
                bins = left[s] // copies
                free.setdefault(capacity, []).append([bins, next_sequence])
                next_sequence += bins
                continue
            bins, first = free[room].pop()
            copies = min(room // s, left[s])
            take = min(bins, left[s] // copies)
            place(s, copies, take, first, capacity - room)
            if take < bins:
                free[room].append([bins - take, first + take])
            if room - copies * s:
                free.setdefault(room - copies * s, []).append([take, first])
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _assign(batches, rows: np.ndarray, names: list[str]):
    key = (rows[:, 0] << 44) + rows[:, 1]
    for batch in batches:
        if not batch.num_rows:
            continue
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        at = np.searchsorted(key, (length << 44) + rank, "right") - 1
        j = rank - rows[at, 1]
        sequence, offset = rows[at, 3] + j // rows[at, 4], rows[at, 5] + (j % rows[at, 4]) * length
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give every piece (columns doc_id, piece, length, ...) its sequence_id and offset."""
    spark = pieces.sparkSession
    salts = n_shuffle(spark)
    pieces = materialize(pieces)
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    names = pieces.columns
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    local = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = local.join(before, ["length", "salt"]).select(*names, (F.col("rank") + F.col("before")).cast("long").alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(partial(_assign, rows=plan(histogram, capacity), names=names), schema)
