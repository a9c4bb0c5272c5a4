"""Removal of repeated byte strings by threshold-bounded interval expansion (operator 9).

Every byte of a text that lies in a string of `least` bytes which also starts in a document with a smaller
id is removed.  The smallest hash of the short grams in a window of `least` bytes depends on the window
alone, so equal windows have equal keys.  A first exchange finds the keys that more than one document
has; the stretches of text under them go to buckets by key, equal stretches joined, and each bucket sorts
what differs: breadth-first backward extension over the Burrows-Wheeler transform of its stretches finds
the common prefixes by increasing length and stops at `least`, which leaves the classes of equal windows.
The smallest document of a class keeps its bytes.

Texts are dealt once, by a hash of id and text, into deals of about DEAL bytes, however many partitions there are, and all
passes read that exchange; what goes back to them are keys and spans of their own deal.

Defined cases: a null text is empty; a text shorter than `least` bytes keeps all; rows that share an id are
compared with smaller ids only, each row by its own text, so equal ids (the ties) keep alike; null ids come before all
others; overlapping and nested matches count; a very long text is read whole, as a slice of its own; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import U, mix, n_shuffle, range_hashes, slices

GRAM, PIECE, END, BLOCK, DEAL = 16, 256, 255, 1 << 15, 64 << 20


def _keys_of(data: np.ndarray, least: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x, step, factor = data.astype(np.uint64) + U(1), 1, U(0x9E3779B97F4A7C15)
        while step < GRAM:
            x = x[:-step] * factor + x[step:]
            x ^= x >> U(29)
            step, factor = step * 2, factor * U(0xBF58476D1CE4E5B9)
        x = mix(x)
    width, step = least - GRAM + 1, 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def window_keys(data: np.ndarray, least: int) -> np.ndarray:
    """Smallest gram hash of each window of `least` bytes, in blocks that stay in a processor's cache."""
    n = len(data) - least + 1
    out = np.empty(max(n, 0), np.uint64)
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        out[a:b] = _keys_of(data[a : b + least - 1], least)
    return out


def runs(data: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one key: row, first window, windows (PIECE at most), key."""
    key = window_keys(data, least)
    if not len(key):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    # windows that reach over the end of their row are none
    outside = np.zeros(len(key) + 1, bool)
    stop = np.zeros(len(key) + 1, bool)
    for a, b in zip(np.maximum(off[1:] - least + 1, off[:-1]).tolist(), off[1:].tolist(), strict=True):
        outside[a:b] = True
        if a <= len(key):
            stop[a] = True
    stop[off[off < len(key)]] = True
    stop[1:-1] |= key[1:] != key[:-1]
    stop[-1] = True
    every = np.flatnonzero(stop)
    head, size = every[:-1], np.diff(every)
    if len(every) and every[0]:
        head, size = np.append(0, head), np.append(every[0], size)
    inside = ~outside[head]
    head, size = head[inside], size[inside]
    parts = -(-size // PIECE)
    again = np.repeat(np.arange(len(head)), parts)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = head[again] + nth * PIECE
    return np.searchsorted(off, start, "right") - 1, start, np.minimum(PIECE, head[again] + size[again] - start), key[start]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((mix(key) >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


def _by_bucket(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else []
    for i, j in zip(at, np.append(at[1:], len(order)).tolist() if len(order) else [], strict=True):
        yield int(bucket[order[i]]), order[i:j]


def _keys(batches, least: int, buckets: int):
    """Keys of a slice, once each, marked where several of its documents have them."""
    for batch in batches:
        for rows, data, off in slices(batch, "text", 16 << 20):
            deals = rows.column("deal").to_numpy()
            row, _, _, key = runs(data, off, least)
            for deal in np.unique(deals):
                own = deals[row] == deal
                k, r = key[own], row[own]
                order = np.argsort(k, kind="stable")
                k, r = k[order], r[order]
                new = np.append(True, k[1:] != k[:-1])[: len(k)]
                other = np.append(False, r[1:] != r[:-1])[: len(k)] & ~new
                n = 1 + (np.add.reduceat(other, np.flatnonzero(new)) if len(k) else np.zeros(0, int))
                k = k[new]
                out = [(b, int(deal), k[i].tobytes(), (n[i] > 1).tobytes()) for b, i in _by_bucket(_bucket(k, buckets))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "deal", "keys", "many"])


def _repeated(batches):
    """Keys of a bucket that occur more than once, for each deal that has them.  Sorted by bucket."""
    held: list[tuple[int, bytes, bytes]] = []

    def close():
        key = np.frombuffer(b"".join(h[1] for h in held), np.uint64)
        many = np.frombuffer(b"".join(h[2] for h in held), bool)
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        marked = np.bincount(at, many, minlength=len(n)) > 0
        keep, i = ((n > 1) | marked)[at], 0
        out: dict[int, list[np.ndarray]] = {}
        for deal, raw, _ in held:
            j = i + len(raw) // 8
            if keep[i:j].any():
                out.setdefault(deal, []).append(key[i:j][keep[i:j]])
            i = j
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([np.unique(np.concatenate(v)).tobytes() for v in out.values()], pa.binary())], ["deal", "keys"])

    now = None
    for batch in batches:
        for bucket, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and bucket != now:
                yield close()
            now = bucket
            held.append(tuple(rest))
    if held:
        yield close()


STRETCH = "bucket int, deal int, key binary, doc binary, row binary, start binary, size binary, text binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


def _stretches(docs: pa.Table, keys: pa.Table, least: int, buckets: int) -> pa.Table:
    """Stretches under repeated keys by bucket; of those equal within the deal, the smallest document's.  The
    others are known to be removed and come with bucket -1."""
    if not keys.num_rows or not docs.num_rows:
        return _table([], STRETCH)
    known = np.unique(np.frombuffer(b"".join(keys.column("keys").to_pylist()), np.uint64))
    out = []
    for batch in docs.combine_chunks().to_batches():
        for rows, data, off in slices(batch, "text", 16 << 20):
            ids, names = _ids(rows.column("doc_id")), rows.column("row").to_numpy()
            row, start, size, key = runs(data, off, least)
            hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
            row, start, size, key = row[hit], start[hit], size[hit], key[hit]
            order = np.lexsort((ids[row], key))
            first: dict[tuple[int, bytes], int] = {}
            lead, later = [], []
            for i in order.tolist():
                text = data[start[i] : start[i] + size[i] + least - 1].tobytes()
                known_doc = first.setdefault((int(key[i]), text), int(ids[row[i]]))
                (later if known_doc < ids[row[i]] else lead).append(i)
            for chosen, keep in ((np.array(lead, np.int64), True), (np.array(later, np.int64), False)):
                b = _bucket(key[chosen], buckets) if keep else np.full(len(chosen), -1)
                for bucket, at in _by_bucket(b):
                    i = chosen[at]
                    text = b"".join(data[s : s + n + least - 1].tobytes() for s, n in zip(start[i].tolist(), size[i].tolist(), strict=True)) if keep else b""
                    place = (start[i] - off[row[i]]).astype(np.int64)
                    packed = pa.compress(text, "zstd", asbytes=True) if text else b""
                    out.append((bucket, int(rows.column("deal")[0].as_py()), key[i].tobytes() if keep else b"", ids[row[i]].tobytes(), names[row[i]].tobytes(), place.tobytes(), size[i].astype(np.int16).tobytes(), len(text).to_bytes(4, "little") + packed))
    return _table(out, STRETCH)


def _ids(column) -> np.ndarray:
    return column.fill_null(-(1 << 63)).to_numpy().astype(np.int64)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols at least, by doubling."""
    n = len(text)
    padded = np.concatenate((text, np.full(8, END, np.uint8)))
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << U(8)) | padded[k : n + k].astype(np.uint64)
    order, have = np.argsort(word), 8
    sorted_ = word[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.append(False, sorted_[1:] != sorted_[:-1]))
    while have < depth:
        # only suffixes that still share their rank with another are sorted again
        size = np.bincount(rank, minlength=n)
        shared = size[rank[order]] > 1
        at = np.flatnonzero(shared)
        if not len(at):
            break
        i = order[at]
        follow = np.where(i + have < n, rank[np.minimum(i + have, n - 1)] + 1, 0)
        base = np.cumsum(size) - size
        key = (rank[i].astype(np.uint64) << U(32)) | follow.astype(np.uint64)
        o = np.argsort(key)
        order[at] = i = i[o]
        key = key[o]
        new = np.append(True, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(new, at, 0))
        # ranks become places, so that those already alone keep their order among the others
        full = base[rank]
        full[i] = start
        rank = full
        have *= 2
    return order


def window_classes(text: np.ndarray, least: int) -> np.ndarray:
    """A number for each position, equal for positions whose next `least` symbols are equal.

    Intervals of suffixes with a common prefix are extended backward, breadth first: an interval that ends
    where no shorter prefix ended tells that the prefix common to its last suffix and the next is as long as
    the intervals before it.  After `least` rounds, places without an end lie within a class.
    """
    n = len(text)
    order = suffix_order(text, least)
    before = text[order - 1]
    to = np.empty(n, np.int64)
    to[np.argsort(before, kind="stable")] = np.arange(n)
    ends = np.zeros(n + 1, bool)
    ends[0] = ends[n] = True
    low, high = np.array([0]), np.array([n])
    started = np.flatnonzero(np.bincount(text, minlength=256))
    first = np.cumsum(np.bincount(text, minlength=256))
    # prefixes of one symbol, the end mark included
    low, high = np.append(0, first[started][:-1]), first[started]
    ends[high] = True
    for _ in range(1, least):
        if not len(low):
            break
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]
        keep = before[place] != END
        which, place = which[keep], place[keep]
        target = to[place]
        o = np.argsort(target)
        target, which, symbol = target[o], which[o], before[place[o]]
        new = np.append(True, (target[1:] != target[:-1] + 1) | (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1]))[: len(target)]
        low = target[new]
        high = np.append(target[np.flatnonzero(new)[1:] - 1], target[-1:]) + 1
        open_ = ~ends[high]
        low, high = low[open_], high[open_]
        ends[high] = True
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(ends[:n])
    return out


def _may_share(strings: list[tuple[int, bytes]], which: np.ndarray, least: int) -> np.ndarray:
    """Of the stretches, those with a window whose hash occurs again: the others can't share one."""
    if not len(which):
        return which
    raw = np.frombuffer(b"".join(strings[c][1] for c in which.tolist()), np.uint8)
    length = np.array([len(strings[c][1]) for c in which.tolist()])
    windows = length - least + 1
    owner = np.repeat(np.arange(len(which)), windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(np.cumsum(length) - length, windows)
    h = range_hashes(raw, start, start + least)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    found = np.zeros(len(which), bool)
    found[owner[order[1:][same]]] = True
    found[owner[order[:-1][same]]] = True
    return which[found]


def _resolve(parts: list[dict], least: int) -> list[tuple[int, bytes]]:
    """Spans to remove from the stretches of one bucket: (deal, row, start, end) arrays."""
    get = lambda n, t: np.concatenate([np.frombuffer(p[n], t) for p in parts])
    key, doc, row, start, size = get("key", np.uint64), get("doc", np.int64), get("row", np.int64), get("start", np.int64), get("size", np.int16).astype(np.int64)
    deal = np.repeat([p["deal"] for p in parts], [len(p["key"]) // 8 for p in parts])
    text = b"".join(pa.decompress(p["text"][4:], int.from_bytes(p["text"][:4], "little"), "zstd", asbytes=True) for p in parts)
    cut = np.append(0, np.cumsum(size + least - 1)).tolist()
    content: dict[tuple[int, bytes], int] = {}
    of = np.array([content.setdefault((k, text[a:b]), len(content)) for k, a, b in zip(key.tolist(), cut[:-1], cut[1:], strict=True)])
    m = len(content)
    smallest = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(smallest, of, doc)
    gone = [(deal[i], row[i], start[i], start[i] + size[i] + least - 1) for i in np.flatnonzero(doc > smallest[of])]
    # keys with several contents: windows of these are compared
    content_key = np.array([k for k, _ in content], np.uint64)
    _, at, n = np.unique(content_key, return_inverse=True, return_counts=True)
    differ = np.flatnonzero(n[at] > 1)
    strings = list(content)
    differ = _may_share(strings, differ, least)
    if len(differ):
        raw = np.frombuffer(b"".join(strings[c][1] + b"\xff" for c in differ.tolist()), np.uint8)
        length = np.array([len(strings[c][1]) for c in differ.tolist()])
        begin = np.cumsum(length + 1) - length - 1
        owner = np.repeat(np.arange(len(differ)), length - least + 1)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(length - least + 1) - (length - least + 1), length - least + 1)
        classes = window_classes(raw, least)[begin[owner] + place]
        lowest = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, classes, smallest[differ[owner]])
        hit = lowest[classes] < smallest[differ[owner]]
        # windows in turn make spans of the stretches that hold this content for its smallest document
        opens = hit & ~np.append(False, hit[:-1] & (owner[1:] == owner[:-1]))
        closes = hit & ~np.append(hit[1:] & (owner[1:] == owner[:-1]), False)
        spans: dict[int, list[tuple[int, int]]] = {}
        for o, a, b in zip(owner[opens].tolist(), place[opens].tolist(), place[closes].tolist(), strict=True):
            spans.setdefault(int(differ[o]), []).append((a, b + least))
        if spans:
            for i in np.flatnonzero(np.isin(of, list(spans)) & (doc == smallest[of])):
                gone += [(deal[i], row[i], start[i] + a, start[i] + b) for a, b in spans[int(of[i])]]
    return gone


SPANS = "deal int, spans binary"


def _spans_out(gone: list[tuple]) -> pa.RecordBatch:
    a = np.array(gone, np.int64).reshape(-1, 4)
    out = [(int(d), np.ascontiguousarray(a[a[:, 0] == d][:, 1:]).tobytes()) for d in np.unique(a[:, 0])]
    return _table(out, SPANS).combine_chunks().to_batches()[0] if out else pa.RecordBatch.from_pylist([], _table([], SPANS).schema)


def _compare(batches, least: int):
    """Spans to remove, bucket by bucket.  Sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] < 0:
                row, start, size = np.frombuffer(r["row"], np.int64), np.frombuffer(r["start"], np.int64), np.frombuffer(r["size"], np.int16).astype(np.int64)
                yield _spans_out(list(zip([r["deal"]] * len(row), row, start, start + size + least - 1, strict=True)))
                continue
            if held and held[0]["bucket"] != r["bucket"]:
                yield _spans_out(_resolve(held, least))
                held = []
            held.append(r)
    if held:
        yield _spans_out(_resolve(held, least))


DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(docs: pa.Table, spans: pa.Table, with_text: bool) -> pa.Table:
    schema = DONE + ", text string" * with_text
    if not docs.num_rows:
        return _table([], schema)
    raw = b"".join(spans.column("spans").to_pylist()) if spans.num_rows else b""
    s = np.frombuffer(raw, np.int64).reshape(-1, 3)
    s = s[np.lexsort((s[:, 2], s[:, 1], s[:, 0]))]
    out = []
    for batch in docs.combine_chunks().to_batches():
        for rows, data, off in slices(batch, "text"):
            names = rows.column("row").to_numpy()
            lo, hi = np.searchsorted(s[:, 0], names, "left"), np.searchsorted(s[:, 0], names, "right")
            for i, doc in enumerate(rows.column("doc_id").to_pylist()):
                text = data[off[i] : off[i + 1]]
                removed = spans_n = 0
                if hi[i] > lo[i]:
                    mark = np.zeros(len(text) + 1, np.int32)
                    np.add.at(mark, s[lo[i] : hi[i], 1], 1)
                    np.add.at(mark, s[lo[i] : hi[i], 2], -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    removed, spans_n = int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())
                    text = text[~gone]
                kept = text.tobytes()
                out.append((doc, int(off[i + 1] - off[i]), removed, spans_n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"))[: 5 + with_text])
    return _table(out, schema)


def dedup_bytes(docs: DataFrame, least: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the remaining text (a character
    cut in two becomes a replacement mark there)."""
    spark = docs.sparkSession
    n = n_shuffle(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # what a group holds follows DEAL, not the number of partitions
    deals, buckets = max(n, -(-size // DEAL)), max(4 * n, -(-4 * size // DEAL))
    texts = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    texts = texts.select("doc_id", "row", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(deals)).cast("int").alias("deal"), "text")
    dealt = texts.repartition(n, "deal")
    # all columns go in: with fewer, Spark would deal the texts once more for this pass
    keys = dealt.mapInArrow(partial(_keys, least=least, buckets=buckets), "bucket int, deal int, keys binary, many binary")
    again = keys.repartition(n, "bucket").sortWithinPartitions("bucket", "deal").mapInArrow(_repeated, "deal int, keys binary")

    def stretches(docs: pa.Table, keys: pa.Table) -> pa.Table:
        return _stretches(docs, keys, least, buckets)

    def remove(docs: pa.Table, spans: pa.Table) -> pa.Table:
        return _remove(docs, spans, with_text)

    sent = dealt.groupBy("deal").cogroup(again.groupBy("deal")).applyInArrow(stretches, STRETCH)
    spread = F.when(F.col("bucket") < 0, -1 - F.col("deal")).otherwise(F.col("bucket"))
    spans = sent.withColumn("to", spread).repartition(n, "to").sortWithinPartitions("bucket", "deal").drop("to").mapInArrow(partial(_compare, least=least), SPANS)
    return dealt.groupBy("deal").cogroup(spans.groupBy("deal")).applyInArrow(remove, DONE + ", text string" * with_text)
