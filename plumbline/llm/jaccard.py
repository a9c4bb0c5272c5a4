"""N-gram Jaccard join by PartEnum signatures (operator 8).

Sets of word shingles fall in bands of size.  For a band, two sets that are similar enough differ in at
most k elements; the hashed feature domain is cut into first-level partitions so that in at least one of
them the two differ little, each partition into second-level ones of which every subset that may stay
free of differences is enumerated.  The features of a subset are one signature: similar sets share one.

Sets equal in all features are one class.  Signatures that several classes share give candidate pairs
in two steps.  First every class meets its signature's hub, the member that shares most signatures; this
links the bulk of a group.  Then only classes of different components meet, in runs of bounded length.
Of either, only pairs go on that a sketch doesn't rule out: parities of the features of 1024 cells, whose
differing bits are never more than the features in which the sets differ.  Of these pairs, wider sketches rule
out most that are not similar enough, and the rest is compared exactly.
A signature with very many classes left is split again by a second set of partitions.  So no group's pairs
are all written, and yet every link between components is found.

Defined cases: a null text or one without words has no shingle, links with nothing and is its own
component; a text with fewer words than a shingle is one shingle; repeated rows are in one class; equal
ids are one document whose sets are all linked by it; a very long text is read whole, as a slice of its own; sets
and shingles are told apart by 64-bit hashes; an empty table gives no rows; other columns are ignored; a component's
smallest id is null where no row of it has one.
"""

from __future__ import annotations

from functools import lru_cache, partial
from math import ceil, exp, floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import U, components, drop, frequent, lower_ascii, materialize, mix, n_shuffle, not_blank, numbered, release, runs_of, salted_join, shingles, slices

SALT_FROM, SALTS, SMALL, LEVELS = 256, 64, 2000, 3
KEYED = ["key", "cls", "part", "block", "blocks"]
#: Signatures a task holds before it deals them, buckets a partition; rows on their way, and what a bucket's task makes of them.
HELD, BUCKETS = 1 << 20, 4
PARTS = "bucket int, doc_id long, key long, n long, cls long, sketch binary, sigs binary, owners binary, salts binary"
MEMBERS = "kind int, doc_id long, key long, n long, cls long, sketch binary, sig long, salt int"
TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


@lru_cache(4096)
def _band(size: int, percent: int) -> tuple[tuple[int, int], ...]:
    """(band, largest difference) of the bands whose signatures a set of this size has."""
    g = percent / 100
    step = -2 * log(g)
    i = floor(log(size) / step + 1e-9)
    bands = [i, i - 1] if i > 0 and size * g <= np.exp(step * i) + 1e-6 else [i]
    return tuple((b, floor(np.exp(step * (b + 1)) * (1 - g) / g + 1e-9)) for b in bands)


@lru_cache(4096)
def _layout(k: int, size: float) -> tuple[int, int]:
    """First-level partitions, each of two second-level cells, and how many cells a set may leave empty.

    Two sets that differ in k elements agree in all but k cells.  With `spare` cells more than k + 1, a pair
    agrees in a cell that isn't empty unless both sets have more than `spare` empty ones; so only sets
    with more need signatures of empty cells, which else would join strangers.
    """
    if k < 1:
        return 1, 0
    spare = 0
    for _ in range(4):
        cells = k + 1 + spare
        spare = ceil(1.5 * cells * exp(-size / cells)) + 2
    return -(-(k + 1 + spare) // 2), spare


@lru_cache(4096)
def _cells(size: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(band, cells, empty cells without a signature) of the bands of a set of this size."""
    out = []
    for band, k in _band(size, percent) if size else ():
        first, spare = _layout(k, exp(-2 * log(percent / 100) * band))
        out.append((band, 2 * first if k else 1, spare))
    return tuple(out)


def signatures(features: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sorted sets of feature hashes, and the set of each: of every first-level partition, the subsets of one of
    its two second-level cells.  Sets of any sizes are signed together; the features of a cell are neighbours."""
    size = np.diff(bounds)
    kinds, kind = np.unique(size, return_inverse=True)
    plans = [_cells(int(n), percent) for n in kinds]
    out = [np.zeros(0, np.uint64)]
    of = [np.zeros(0, np.int64)]
    for j in range(2):
        rows = np.flatnonzero(np.array([len(p) > j for p in plans], bool)[kind])
        if not len(rows):
            continue
        band, cells, spare = (np.array([p[j][c] if len(p) > j else 0 for p in plans])[kind[rows]] for c in range(3))
        n = size[rows]
        own = features[np.arange(n.sum()) + np.repeat(bounds[rows] - np.cumsum(n) + n, n)] if len(rows) < len(size) else features
        first = np.cumsum(cells) - cells
        count = np.bincount(np.repeat(first, n) + ((own >> U(32)) * np.repeat(cells.astype(np.uint64), n) >> U(32)).astype(np.int64), minlength=cells.sum())
        total = np.append(U(0), np.cumsum(mix(own + U(0x9E3779B97F4A7C15))))
        end = np.cumsum(count)
        tag = (np.arange(len(count)) - np.repeat(first, cells) + 1).astype(np.uint64) * U(0xD1B54A32D192ED03) + np.repeat((band + 1).astype(np.uint64) * U(0xE7037ED1A0B428DB), cells)
        full = count > 0
        kept = full | np.repeat(cells - np.add.reduceat(full, first, dtype=np.int64) > spare, cells)
        out.append(mix(mix(total[end] - total[end - count]) + tag)[kept])
        of.append(np.repeat(rows, cells)[kept])
    return np.concatenate(out), np.concatenate(of)


def _unique(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets, sorted, of the hashes within bounds, and their bounds."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[bounds < len(h)]] = True
    return h[new], np.append(0, np.cumsum(new))[bounds]


def _sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    data = lower_ascii(data)
    h, bounds, _ = shingles(data, off, size, not_blank(data))
    return _unique(h, bounds)


def _some(features: np.ndarray, bounds: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets that are kept, and their bounds."""
    n = np.diff(bounds)
    return features[np.repeat(kept, n)], np.append(0, np.cumsum(n[kept]))


def _classes(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(U(0), np.cumsum(mix(features ^ U(0x2545F4914F6CDD1D))))[bounds]
    return mix(mix(np.diff(total) + np.diff(bounds).astype(np.uint64))).view(np.int64)


def _salted(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, salts, classes.  Where many are of one signature, later ones are spread over salts, each
    with the first of them, through which it stays joined to the others."""
    s = np.sort(sig)
    if not (s[SALT_FROM:] == s[:-SALT_FROM]).any():
        return sig, np.zeros(len(sig), np.uint8), cls
    order = np.argsort(sig, kind="stable")
    s, c = sig[order], cls[order]
    new = np.append(True, s[1:] != s[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    salt = np.where(np.arange(len(s)) - head >= SALT_FROM, 1 + np.abs(c % SALTS), 0).astype(np.uint8)
    hot = np.unique(np.column_stack((s, salt, c[head]))[salt > 0], axis=0)
    return np.append(s, hot[:, 0]), np.append(salt, hot[:, 1].astype(np.uint8)), np.append(c, hot[:, 2])


def _record(fields: str, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of rows with these fields, of which only the given ones are not null."""
    n = len(next(iter(columns.values())))
    schema = [f.split() for f in fields.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, TYPES[t])) for c, t in schema], [c for c, _ in schema])


def _dealt(sig: list[np.ndarray], cls: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Signatures and their classes as one row a bucket: 17 bytes a signature."""
    s, salt, c = _salted(np.concatenate(sig), np.concatenate(cls))
    at = (mix(s.view(np.uint64) + salt * U(0xA0761D6478BD642F)) >> U(32)) * U(buckets) >> U(32)
    order = np.argsort(at.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
    s, salt, c, at = s[order], salt[order], c[order], at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True))
    return _record(PARTS, bucket=pa.array(at[first].astype(np.int32)), **{n: pa.array([x[i:j].tobytes() for i, j in cuts], pa.binary()) for n, x in (("sigs", s), ("owners", c), ("salts", salt))})


def _described(batches, size: int, percent: int, buckets: int):
    """A row of every document, and the signatures of the classes met."""
    seen: set[int] = set()
    sig, cls, held, row = [], [], 0, 0
    for batch in batches:
        for rows, data, off in slices(batch, "text"):
            features, bounds = _sets(data, off, size)
            n, own = np.diff(bounds), _classes(features, bounds)
            sketch = _sketches(features, bounds)
            empty = n == 0
            yield _record(
                PARTS, bucket=pa.array(((row + np.arange(len(n))) % buckets).astype(np.int32)), doc_id=rows.column("doc_id"), key=rows.column("key"), n=pa.array(n.astype(np.int64)),
                cls=pa.array(own, mask=empty), sketch=pa.array([None if e else x.tobytes() for e, x in zip(empty.tolist(), sketch, strict=True)], pa.binary()),
            )
            row += len(n)
            fresh = np.zeros(len(n), bool)
            for i, c in enumerate(own.tolist()):
                if n[i] and c not in seen:
                    seen.add(c)
                    fresh[i] = True
            found, of = signatures(*_some(features, bounds, fresh), percent)
            sig.append(found.view(np.int64))
            cls.append(own[fresh][of])
            held += len(of)
            if held >= HELD:
                yield _dealt(sig, cls, buckets)
                sig, cls, held = [], [], 0
    if held:
        yield _dealt(sig, cls, buckets)


def _resign(batches, percent: int, seed: int, buckets: int):
    """Further signatures of members of large groups."""
    for batch in batches:
        raw = batch.column("features").to_pylist()
        if not raw:
            continue
        features, bounds = np.frombuffer(b"".join(raw), np.uint64), np.append(0, np.cumsum([len(x) // 8 for x in raw]))
        found, of = signatures(*_unique(mix(features * U(2 * seed + 1) + U(seed)), bounds), percent)
        s, c = (batch.column(n).to_numpy() for n in ("sig", "cls"))
        yield _dealt([mix(found + s.view(np.uint64)[of]).view(np.int64)], [c[of]], buckets)


def _several(batches):
    """Signatures of several classes with each of them and their number; rows of documents go on as they are."""
    for table in runs_of(batches, "bucket"):
        blobs = table.filter(pc.is_valid(table.column("sigs")))
        if blobs.num_rows < table.num_rows:
            docs = table.filter(pc.is_null(table.column("sigs"))).combine_chunks().to_batches()[0]
            yield _record(MEMBERS, **{c: docs.column(c) for c in ("doc_id", "key", "n", "cls", "sketch")}, kind=pa.array(np.zeros(docs.num_rows, np.int32)))
        s, c, salt = (np.frombuffer(b"".join(blobs.column(n).to_pylist()), t) for n, t in (("sigs", np.int64), ("owners", np.int64), ("salts", np.uint8)))
        # most signatures are alone
        order = np.argsort(s)
        again = s[order][1:] == s[order][:-1]
        some = order[np.append(again, False) | np.append(False, again)] if len(s) else order
        s, c, salt = s[some], c[some], salt[some]
        order = np.lexsort((c, salt, s))
        s, c, salt = s[order], c[order], salt[order]
        group = np.append(True, (s[1:] != s[:-1]) | (salt[1:] != salt[:-1]))[: len(s)]
        once = group | np.append(True, c[1:] != c[:-1])[: len(s)]
        s, c, salt, group = s[once], c[once], salt[once], group[once]
        n = np.bincount(np.cumsum(group) - 1) if len(s) else np.zeros(0, np.int64)
        n = np.repeat(n, n)
        kept = n > 1
        if kept.any():
            yield _record(MEMBERS, kind=pa.array(np.ones(int(kept.sum()), np.int32)), sig=pa.array(s[kept]), salt=pa.array(salt[kept].astype(np.int32)), cls=pa.array(c[kept]), n=pa.array(n[kept].astype(np.int64)))


def _sketches(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """_sketch of every set."""
    out = [np.zeros((0, 128), np.uint8)]
    for i in range(0, len(bounds) - 1, 1024):
        of = bounds[i : i + 1025]
        at = (mix(features[of[0] : of[-1]] * U(0xD6E8FEB86659FD93)) & U(1023)).astype(np.int64)
        at += np.repeat(np.arange(len(of) - 1) << 10, np.diff(of))
        out.append(np.packbits((np.bincount(at, minlength=(len(of) - 1) << 10) & 1).astype(np.uint8).reshape(-1, 1024), axis=1))
    return np.concatenate(out)


def _sketch(features: np.ndarray, bits: int = 10) -> bytes:
    """Parities of the features of each of 2**bits cells.  Two sets differ in at least as many features as
    their sketches do in bits."""
    with np.errstate(over="ignore"):
        at = (mix(features * U(0xD6E8FEB86659FD93)) & U((1 << bits) - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=1 << bits).astype(np.uint8) & 1).tobytes()


def _wide(features: np.ndarray) -> bytes:
    """A sketch with four to eight cells a feature."""
    return _sketch(features, max(10, int(4 * len(features)).bit_length()))


def _fold(x: np.ndarray, words: int) -> np.ndarray:
    """The sketch of fewer cells: a cell's number is its old one's low bits."""
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def _may(differ: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in so many features are similar enough.

    With D the difference, 100 I >= percent U is D (100 + percent) <= (100 - percent) (na + nb).
    """
    return np.maximum(differ, np.abs(na - nb)) * (100 + percent) <= (100 - percent) * (na + nb)


def _words(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 16)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def _may_pairs(batches, percent: int):
    """Those of pairs (a, b, na, nb, sa, sb) that their sketches don't rule out."""
    for batch in batches:
        kept = _may(_differ(_words(batch.column("sa")), _words(batch.column("sb"))), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
        yield batch.select(["a", "b"]).filter(pa.array(kept))


def _within(batches, percent: int):
    """Pairs of different parts within runs of a key that their sketches don't rule out.

    Rows are sorted by key and a key has a bounded number of rows.  Rows are compared with those `step`
    places further on in their run, for all steps; rows of the same block of a key with two blocks are not.
    """
    for table in runs_of(batches, "key"):
        key, cls, part, n, block, of = (table.column(c).to_numpy() for c in ("key", "cls", "part", "n", "block", "blocks"))
        words = _words(table.column("sketch"))
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        end = np.repeat(np.append(new[1:], len(key)), np.diff(np.append(new, len(key))))
        at, step, out = np.arange(len(key)), 1, []
        while True:
            at = at[at + step < end[at]]
            if not len(at):
                break
            to = at + step
            ok = (part[at] != part[to]) & ((of[at] == 1) | (block[at] != block[to]))
            x, y = at[ok], to[ok]
            ok = _may(0 * x, n[x], n[y], percent)
            x, y = x[ok], y[ok]
            ok = _may(_differ(words[x], words[y]), n[x], n[y], percent)
            out.append(np.column_stack((cls[x[ok]], cls[y[ok]])))
            step += 1
        if out:
            pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _features(batches, size: int, marks: np.ndarray, classes: np.ndarray):
    """Sets of rows (mark, text) whose mark's bit and whose class's bit are set: all that are needed and few others."""
    for batch in batches:
        for rows, data, off in slices(batch.filter(pa.array(_set_in(marks, batch.column("mark").to_numpy()))), "text"):
            features, bounds = _sets(data, off, size)
            own = _classes(features, bounds)
            at = np.flatnonzero(_set_in(classes, own) & (np.diff(bounds) > 0))
            found = [features[bounds[i] : bounds[i + 1]] for i in at.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[at]), pa.array([f.tobytes() for f in found], pa.binary()), pa.array([len(f) for f in found], pa.int64()), pa.array([_wide(f) for f in found], pa.binary())],
                ["cls", "features", "n", "wide"],
            )


def _bits(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """A table of at least 16 bits a row, 4 MB at most, with the bit of every hash in the column set."""
    size = 1 << min(25, max(10, (16 * n - 1).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(size - 1))
    words = rows.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int({column} & 63))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _set_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (bits[hashes >> 6 & len(bits) - 1] >> (hashes & 63) & 1).astype(bool)


def _may_wide(batches, percent: int):
    """Those of pairs (a, b, na, nb, wa, wb) that their wide sketches don't rule out."""
    for batch in batches:
        differ = np.zeros(batch.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(batch.column("wa"), batch.column("wb"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            words = min(len(x), len(y))
            differ[i] = np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum(dtype=np.int64)
        yield batch.select(["a", "b"]).filter(pa.array(_may(differ, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)))


def _similar(batches, percent: int):
    """Those of pairs (a, b, fa, fb) whose sets are similar enough."""
    for batch in batches:
        kept = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("fa"), batch.column("fb"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            short, long_ = (x, y) if len(x) < len(y) else (y, x)
            both = int((long_[np.minimum(np.searchsorted(long_, short), len(long_) - 1)] == short).sum())
            kept[i] = 100 * both >= percent * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(kept))


def _met(parts: DataFrame, n: int) -> DataFrame:
    """Rows MEMBERS: signatures of several classes, and the rows of documents.  A task holds a bucket's signatures at once."""
    return parts.repartitionById(n, F.pmod("bucket", F.lit(n))).sortWithinPartitions("bucket").mapInArrow(_several, MEMBERS)


def _hubs(members: DataFrame) -> DataFrame:
    """Members of signatures with several classes, with the signature's hub: sig, salt, cls, hub."""
    degree = members.groupBy("cls").agg(F.sum(F.col("n") - 1).alias("degree"))
    hubs = members.join(degree, "cls").groupBy("sig", "salt").agg(F.max_by("cls", "degree").alias("hub"))
    return members.join(hubs, ["sig", "salt"]).select("sig", "salt", "cls", "hub")


def links(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, cls) of every row, and (cls, component) of every class that has links.

    A component is named by one of its classes.  The key is the id, or a hash of the text where there is none; it
    only leads to texts, whose class is looked at again.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    n_parts = n_shuffle(docs.sparkSession)
    buckets = n_parts * BUCKETS
    # the texts are read once for both
    both = materialize(_met(texts.mapInArrow(partial(_described, size=size, percent=percent, buckets=buckets), PARTS), n_parts), "kind")
    described = both.where("kind = 0").select("doc_id", "key", "n", "cls", "sketch")
    members = materialize(_hubs(both.where("kind = 1").select("sig", "salt", "cls", "n")))
    release(docs.sparkSession)
    wanted = members.select("cls").distinct().join(described.where("cls is not null").groupBy("cls").agg(F.min("key").alias("key")), "cls")
    sketches = materialize(described.join(wanted, ["key", "cls"]).dropDuplicates(["key", "cls"]))

    def features(pairs: DataFrame) -> DataFrame:
        """Sets of the classes of pairs; of rows that share an id, those of the one that has the class.

        The classes grow with the input, so they are not broadcast at any size; a table of bits of bounded size tells which
        texts may be needed, and only their sets are shuffled.
        """
        needed = materialize(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(sketches.select("cls", "key"), "cls").select("cls", F.xxhash64("key").alias("mark")))
        n = needed.count()
        found = texts.select(F.xxhash64("key").alias("mark"), "text").mapInArrow(partial(_features, size=size, marks=_bits(needed, "mark", n), classes=_bits(needed, "cls", n)), "cls long, features binary, n long, wide binary")
        return materialize(found.join(needed, "cls", "left_semi").dropDuplicates(["cls"]))

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of pairs whose sets are similar enough."""
        pairs = materialize(pairs)
        sets = features(pairs)

        def each(*columns: str) -> DataFrame:
            """Columns of the sets of either class of a pair, their names with an a or b."""
            out = pairs
            for side in "ab":
                out = out.join(sets.select(F.col("cls").alias(side), *[F.col(c).alias(c[0] + side) for c in columns]).hint("merge"), side)
            return out

        pairs = materialize(each("n", "wide").mapInArrow(partial(_may_wide, percent=percent), "a long, b long"))
        release(docs.sparkSession)
        full = each("features")
        found = materialize(full.mapInArrow(partial(_similar, percent=percent), "a long, b long"))
        del full
        drop(sets)
        release(docs.sparkSession)
        return found

    def star(members: DataFrame) -> DataFrame:
        pairs = members.where("hub <> cls").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
        known = sketches.select("cls", "n", "sketch")
        sized = pairs.join(known.toDF("a", "na", "sa"), "a").join(known.toDF("b", "nb", "sb"), "b")
        return linked(sized.mapInArrow(partial(_may_pairs, percent=percent), "a long, b long"))

    def across(rows: DataFrame) -> DataFrame:
        """Pairs of different parts that share a signature; one of m members has its rows in blocks of about
        SMALL, of which any two meet under a key."""
        rows = rows.withColumn("blocks", F.ceil(F.col("m") / SMALL).cast("int")).withColumn("block", F.pmod("cls", "blocks").cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        split = rows.where("blocks > 1").select("*", other).withColumn("key", F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other")))
        split = split.withColumn("blocks", F.when(F.col("block") == F.col("other"), 1).otherwise(2))
        keyed = rows.where("blocks = 1").withColumn("key", F.col("sig")).select(*KEYED).union(split.select(*KEYED))
        keyed = keyed.join(sketches.select("cls", "n", "sketch"), "cls")
        dealt = keyed.repartition(n_shuffle(docs.sparkSession), "key").sortWithinPartitions("key")
        return dealt.mapInArrow(partial(_within, percent=percent), "a long, b long").distinct()

    # sets of one id are linked by it
    several = described.where("cls is not null and doc_id is not null").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b")
    own = described.where("cls is not null").join(several.select("doc_id", "a"), "doc_id").select("a", F.col("cls").alias("b")).where("a <> b").distinct()
    edges, seed = star(members).union(materialize(own)), 0
    while True:
        part = materialize(components(edges)).toDF("cls", "part")
        named = members.join(part, "cls", "left").select("sig", "cls", F.coalesce("part", "cls").alias("part"))
        mixed = named.groupBy("sig").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("m")).where("p <> q").select("sig", "m")
        open_ = materialize(named.join(mixed, "sig"))
        last = seed == LEVELS
        edges = edges.union(linked(across(open_.distinct() if last else open_.where(F.col("m") <= SMALL))))
        many = open_.where(F.col("m") > SMALL).select("sig", "cls").distinct()
        if last or not many.take(1):
            return described, components(edges).toDF("cls", "component")
        seed += 1
        sets = features(many.select(F.col("cls").alias("a"), F.col("cls").alias("b")))
        parts = many.join(sets.select("cls", "features"), "cls").mapInArrow(partial(_resign, percent=percent, seed=seed, buckets=buckets), PARTS)
        members = materialize(_hubs(materialize(_met(parts, n_parts).select("sig", "salt", "cls", "n"))))
        edges = edges.union(star(members))


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows of links() with the smallest id of their component, and the smallest key of its rows without an id.

    Classes are summed up before rows of a component meet, and frequent classes and components are spread over tasks.
    """
    described, linked = links(docs, size, percent)
    sizes = described.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.min(F.when(F.col("doc_id").isNull(), F.col("key"))).alias("low_key"))
    classes = materialize(sizes.join(linked, "cls", "left").withColumn("group", F.coalesce("component", "cls")).drop("component"))
    groups = materialize(classes.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.min("low_key").alias("low_key")))
    named = salted_join(classes.select("cls", "group"), groups.drop("n"), ["group"], frequent(groups.select("group", "n")), "inner", ["cls"])
    return salted_join(described, named.drop("group"), ["cls"], frequent(classes.select("cls", "n")), "left", ["doc_id", "key"])


def join_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the component) of every row."""
    return _grouped(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs whose id is the smallest of its component; all rows of that id stay, as one document.  Of a component
    without any id one row stays; a row without id or words stays.  Columns stay as they are, whatever their names."""
    grouped = _grouped(docs.select("doc_id", "text"), size, percent)
    ids = grouped.where("doc_id = coalesce(low, doc_id)").select(F.col("doc_id").alias("kept")).distinct()
    keys = grouped.where("doc_id is null and low is null and key = low_key").select(F.col("key").alias("kept")).distinct()
    own = numbered(docs)
    doc_id, text = (F.col(f"c{docs.columns.index(c)}").cast(t) for c, t in (("doc_id", "long"), ("text", "string")))
    rest = own.where(doc_id.isNull())
    words = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = rest.where(words).join(keys, F.xxhash64(text) == F.col("kept"), "left_semi").dropDuplicates([f"c{docs.columns.index('text')}"])
    return own.join(ids, doc_id == F.col("kept"), "left_semi").unionByName(once).unionByName(rest.where(~words)).toDF(*docs.columns)
