"""Cross-entropy difference of word bigram models (operator 4).

A target and a background model of the same order and smoothing share one vocabulary, the distinct words
of both corpora.  p(w | v) = (1 - mix) c(v, w) / c(v) + mix / |vocabulary|; a context never seen gives the
vocabulary's share alone.  A document's score is its mean loss a token under the target model less that
under the background model: the lower, the closer to the target.  The counts of a document itself are left out of the
background it is held against.

All bigrams of both corpora meet in buckets by context, where counts are summed and the losses of the
documents' tokens follow at once, so the corpus is shuffled once and no model is broadcast.  Contexts
with more than one part in `HOT` of all tokens (at most HOT of them) are known beforehand with their
totals; their bigrams are bucketed by both words, so no word's followers meet in one task.  A bigram that a
document repeats is one entry with its count.  Words of a context are told apart by 48 bits of their hashes.

Defined cases: words are runs of non-blank bytes, A-Z lower-cased; the first word's context is a start
mark; null texts and texts without words have no tokens and null losses and score; repeated rows count
and are scored each, against one another too; a very long text is read whole, as a slice of its own; there are no
ties; ids may be null; an empty background gives no rows, with an empty target its model is uniform; other columns
are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import U, lower_ascii, materialize, mix, n_shuffle, not_blank, range_hashes, slices, spans

HOT, START, ENTRIES = 2000, U(0x5851F42D4C957F2D), 400_000


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context hash, word hash and row of every token."""
    data = lower_ascii(data)
    starts, ends, rows = spans(not_blank(data), off)
    w = range_hashes(data, starts, ends)
    v = np.append(START, w[:-1])[: len(w)]
    first = np.append(True, rows[1:] != rows[:-1])[: len(w)]
    v[first] = START
    return v, w, rows


def _vocabulary(batches, target: bool):
    """Words of a slice with how often each is a context."""
    for batch in batches:
        for _, data, off in slices(batch, "text"):
            v, w, _ = _tokens(data, off)
            word, at = np.unique(np.concatenate((v, w)), return_inverse=True)
            n = np.bincount(at[: len(v)], minlength=len(word))
            none = np.zeros(len(word), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(none if target else n), pa.array(n if target else none)], ["w", "bg", "tg"])


def _spread(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rising with h."""
    return ((h >> U(32)) * U(buckets)) >> U(32)


SENT = "bucket int, batch long, kind int, ctx binary, runs binary, word binary, row binary, times binary"


def _distinct(v: np.ndarray, w: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A token of each bigram of each row, and how often it occurs there."""
    with np.errstate(over="ignore"):
        key = mix(v + mix(w + mix(row.astype(np.uint64) + U(1))))
    order = np.argsort(key)
    new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[: len(key)])
    return order[new], np.diff(np.append(new, len(key)))


def _send(batches, hot: np.ndarray, buckets: int, target: bool):
    """Bigrams of a slice by bucket.  kind: 0 contexts in runs, 1 hot contexts (ctx: which; runs: how often it is one in
    the row), 2 the slice's documents."""
    task, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        for rows, data, off in slices(batch, "text"):
            out: list[tuple] = []
            uid = -1 if target else task << 24 | count
            count += 1
            v, w, row = _tokens(data, off)
            if not target:
                n = np.bincount(row, minlength=rows.num_rows).astype(np.int64)
                ids = rows.column("doc_id")
                out.append((uid % buckets, uid, 2, ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), n.tobytes(), b"", b""))
            keep, times = _distinct(v, w, row)
            v, w, row = v[keep], w[keep], row[keep]
            at = np.minimum(np.searchsorted(hot, v), max(len(hot) - 1, 0))
            is_hot = hot[at] == v if len(hot) else np.zeros(len(v), bool)
            with np.errstate(over="ignore"):
                cold, warm = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
                cold = cold[np.argsort(v[cold], kind="stable")]
                both = mix(w[warm] * U(0xE7037ED1A0B428DB) + at[warm].astype(np.uint64))
                order = np.argsort(both)
                warm, both = warm[order], both[order]
            edges = np.arange(buckets + 1)
            cut = np.searchsorted(_spread(v[cold], buckets), edges)
            new = np.append(True, v[cold][1:] != v[cold][:-1])[: len(cold)]
            for b in np.flatnonzero(np.diff(cut)).tolist():
                s = slice(cut[b], cut[b + 1])
                head = np.flatnonzero(new[s])
                run = np.diff(np.append(head, cut[b + 1] - cut[b])).astype(np.uint32)
                i = cold[s]
                out.append((b, uid, 0, v[i[head]].tobytes(), run.tobytes(), _short(w[i]), b"" if target else _narrow(row[i]), _counts(times[i])))
            cut = np.searchsorted(_spread(both, buckets), edges)
            pair, of = np.unique(row[warm] * max(len(hot), 1) + at[warm], return_inverse=True)
            own = np.bincount(of, times[warm], minlength=len(pair)).astype(np.int64)[of]
            for b in np.flatnonzero(np.diff(cut)).tolist():
                i = warm[cut[b] : cut[b + 1]]
                out.append((b, uid, 1, at[i].astype(np.uint16).tobytes(), b"" if target else _narrow(own[cut[b] : cut[b + 1]]), _short(w[i]), b"" if target else _narrow(row[i]), _counts(times[i])))
            types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], [x.split()[0] for x in SENT.split(", ")])


def _narrow(row: np.ndarray) -> bytes:
    """Numbers in one, two or four bytes each, told apart by a leading byte."""
    most = row.max() if len(row) else 0
    size = 1 if most < 256 else 2 if most < 65536 else 4
    return bytes([size]) + row.astype(f"u{size}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _counts(times: np.ndarray) -> bytes:
    """Counts, or nothing where all are 1."""
    return _narrow(times) if len(times) and times.max() > 1 else b""


def _short(w: np.ndarray) -> bytes:
    """The upper 48 bits of each hash."""
    return (w >> U(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(raw: list[bytes]) -> np.ndarray:
    own = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
    return np.pad(own, ((0, 0), (0, 2))).view(np.uint64).ravel()


def _losses(parts: list[dict], hot_totals: np.ndarray, vocabulary: int, share: float):
    """Sums of losses by slice and row for the bigrams of one bucket and kind."""
    word = _long([p["word"] for p in parts])
    size = [len(p["word"]) // 6 for p in parts]
    times = np.concatenate([_wide(p["times"]) if p["times"] else np.ones(n, np.int64) for p, n in zip(parts, size, strict=True)])
    target = np.repeat([p["batch"] < 0 for p in parts], size)
    row = np.concatenate([_wide(p["row"]) if p["row"] else np.zeros(n, np.int64) for p, n in zip(parts, size, strict=True)])
    if parts[0]["kind"] == 0:
        ctx = np.concatenate([np.repeat(np.frombuffer(p["ctx"], np.uint64), np.frombuffer(p["runs"], np.uint32)) for p in parts])
        seen, ctx = np.unique(ctx, return_inverse=True)
        total = np.stack([np.bincount(ctx, times * (target == t), minlength=len(seen)) for t in (False, True)])
        # how often a row itself has the context
        base = np.cumsum([0] + [int(row[a:b].max(initial=0)) + 1 for a, b in zip(np.cumsum([0, *size[:-1]]).tolist(), np.cumsum(size).tolist(), strict=True)])
        at = np.unique((np.repeat(base[:-1], size) + row) * len(seen) + ctx, return_inverse=True)[1]
        own = np.bincount(at, times)[at]
    else:
        ctx = np.concatenate([np.frombuffer(p["ctx"], np.uint16) for p in parts]).astype(np.int64)
        total = hot_totals
        own = np.concatenate([_wide(p["runs"]) if p["runs"] else np.zeros(n, np.int64) for p, n in zip(parts, size, strict=True)])
    order = np.lexsort((word, ctx))
    new = np.append(True, (ctx[order][1:] != ctx[order][:-1]) | (word[order][1:] != word[order][:-1]))[: len(order)]
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    loss = []
    for t, less_pair, less in ((False, times, own), (True, 0, 0)):
        n, c = np.bincount(at, times * (target == t))[at] - less_pair, total[int(t)][ctx] - less
        with np.errstate(invalid="ignore", divide="ignore"):
            loss.append(-times * np.log(np.where(c > 0, (1 - share) * n / np.maximum(c, 1) + share / vocabulary, 1 / vocabulary)))
    begin = 0
    for p, n in zip(parts, size, strict=True):
        if p["batch"] >= 0:
            s = slice(begin, begin + n)
            found, place = np.unique(row[s], return_inverse=True)
            yield p["batch"], found, np.bincount(place, loss[0][s]), np.bincount(place, loss[1][s])
        begin += n


PARTIAL = "batch long, kind int, rows binary, valid binary, bg binary, tg binary"


def _meet(batches, hot_totals: np.ndarray, vocabulary: int, share: float):
    """Batches sorted by bucket and kind; one bucket and kind is held at a time."""
    types, names = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), [x.split()[0] for x in PARTIAL.split(", ")]
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    held: list[dict] = []

    def close():
        rows = [(b, 0, _narrow(r), b"", bg.astype(np.float32).tobytes(), tg.astype(np.float32).tobytes()) for b, r, bg, tg in _losses(held, hot_totals, vocabulary, share)]
        held.clear()
        return [make(rows)] if rows else []

    for batch in batches:
        for r in batch.to_pylist():
            if held and (held[0]["bucket"], held[0]["kind"]) != (r["bucket"], r["kind"]):
                yield from close()
            if r["kind"] == 2:
                yield make([(r["batch"], 2, r["ctx"], r["runs"], r["word"], b"")])
            else:
                held.append(r)
    if held:
        yield from close()


def _finish(group: pa.Table) -> pa.Table:
    """Documents of a slice with their sums."""
    rows = group.to_pylist()
    head = next(r for r in rows if r["kind"] == 2)
    ids, valid, n = np.frombuffer(head["rows"], np.int64), np.frombuffer(head["valid"], bool), np.frombuffer(head["bg"], np.int64)
    sums = np.zeros((2, len(ids)))
    for r in sorted((r for r in rows if r["kind"] == 0), key=lambda r: (len(r["rows"]), r["rows"], r["bg"])):
        at = _wide(r["rows"])
        sums[0, at] += np.frombuffer(r["bg"], np.float32)
        sums[1, at] += np.frombuffer(r["tg"], np.float32)
    none = n == 0
    mean = sums / np.maximum(n, 1)
    return pa.table({"doc_id": pa.array(ids, mask=~valid), "n_tokens": pa.array(n), "loss_target": pa.array(mean[1], mask=none), "loss_background": pa.array(mean[0], mask=none), "score": pa.array(mean[1] - mean[0], mask=none)})


def score(docs: DataFrame, target: DataFrame, share: float = 0.2) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score of every row of docs (the background)."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    wanted = target.select(F.col("text").cast("string"))
    rows = texts.select("text").mapInArrow(partial(_vocabulary, target=False), "w long, bg long, tg long").union(wanted.mapInArrow(partial(_vocabulary, target=True), "w long, bg long, tg long"))
    words = rows.groupBy("w").agg(F.sum("bg").alias("bg"), F.sum("tg").alias("tg"))
    words = materialize(words)
    size, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bg") + F.col("tg")), F.lit(0))).first()
    often = words.where((F.col("bg") + F.col("tg")) * HOT > F.lit(tokens)).collect()  # HOT rows at most
    often = sorted(((r["w"] % (1 << 64), r["bg"], r["tg"]) for r in often))
    hot, totals = np.array([r[0] for r in often], np.uint64), np.array([r[1:] for r in often], np.int64).reshape(-1, 2).T
    buckets = max(n_shuffle(docs.sparkSession), -(-tokens // ENTRIES))
    sent = texts.mapInArrow(partial(_send, hot=hot, buckets=buckets, target=False), SENT).union(wanted.mapInArrow(partial(_send, hot=hot, buckets=buckets, target=True), SENT))
    met = sent.repartition(n_shuffle(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "kind", "batch").mapInArrow(partial(_meet, hot_totals=totals, vocabulary=max(size - 1, 1), share=share), PARTIAL)

    def finish(group: pa.Table) -> pa.Table:
        return _finish(group)

    return met.groupBy("batch").applyInArrow(finish, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
