"""Line dedup by content-defined chunks (operator 3).

A hash rolled over two neighbouring lines' hashes puts each place between lines into one of two boundary families.  From every
place a chunk of its family runs to the next place of the same family by which it has LEAST bytes, its first line and its last
being those at the two places.  So both ends of a chunk, of two lines or more, are chosen by lines within it, whatever stands
beside them, and trivial neighbours (braces, blank lines, short answers) are no chunk by themselves.  Chunks that
occur again anywhere are removed except for their first occurrence (smallest id, then place), after the bytes of all occurrences
have been compared.  A line goes if any chunk over it does; the spans of both families are united.

Defined cases: a null or empty text has no chunk and stays as it is (null becomes empty); a line that stands alone, or a run of fewer
than LEAST bytes, is never removed by itself; repeats that overlap in one text leave one period of it; rows that share an id are
compared by content and place, so repeated rows of one
id keep their first chunks alike; rows without an id come after all others, told apart by their text, and
equal texts among them count as repeated rows of one id; an empty table gives no rows; lines end at \\n only; a group whose bytes
differ under equal hashes is left alone; removed_chunks counts the runs of removed lines; a very long text is
read whole, as a slice of its own; other columns are kept, whatever their names.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import ROW_KEY, U, frequent, materialize, mix, n_shuffle, numbered, range_hashes, release, row_key, salted_join, slices

LEAST = 128


def chunk(data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Lines of rows of text: row, index in its row, byte start and end (without the newline).  Their chunks:
    row, first line (of all, and its index in its row), number of lines, byte start and end, hash."""
    row_start, row_end = off[:-1], off[1:]
    # a line starts at the start of a text and after each newline, also after one that ends the text
    newline = np.flatnonzero(data == 10)
    of = np.searchsorted(off, newline, "right") - 1
    rows = np.concatenate((np.flatnonzero(row_end > row_start), of))
    starts = np.concatenate((row_start[row_end > row_start], newline + 1))
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    first = np.ones(len(starts), bool)
    first[1:] = rows[1:] != rows[:-1]
    last = np.append(first[1:], True)[: len(starts)]
    ends = np.append(starts[1:] - 1, 0)[: len(starts)]
    ends[last] = row_end[rows[last]]
    idx = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    lines = {"row": rows, "idx": idx, "start": starts, "end": ends}
    place = np.flatnonzero(~last)
    with np.errstate(over="ignore"):
        line = range_hashes(data, starts, ends)
        rolled = mix(line[place] * U(3) + line[place + 1]) if len(place) else np.zeros(0, np.uint64)
    family = (rolled & U(1)).astype(bool)
    at, to = [], []
    for f in (False, True):
        own = place[family == f]
        if not len(own):
            continue
        # the first line by whose end a chunk has LEAST bytes, then the first place of the family whose second line is not before it
        enough = np.searchsorted(ends, starts[own] + LEAST)
        k = np.searchsorted(own, np.maximum(own, enough - 1))
        found = k < len(own)
        stop = own[np.minimum(k, len(own) - 1)]
        found &= rows[stop] == rows[own]
        at.append(own[found])
        to.append(stop[found] + 1)
    at, to = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, to))
    order = np.argsort(at)
    at, to = at[order], to[order]
    a, b = starts[at], ends[to]
    return lines, {"row": rows[at], "at": at, "idx": idx[at], "n": to - at + 1, "start": a, "end": b, "h": range_hashes(data, a, b).view(np.int64)}


def _chunks(batches):
    for batch in batches:
        for rows, data, off in slices(batch, "text"):
            _, c = chunk(data, off)
            ids = rows.column("row_key").take(pa.array(c["row"]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(c["idx"].astype(np.int32)), pa.array(c["h"])], ["row_key", "idx", "h"])


def _named(rows: pa.RecordBatch, c: dict[str, np.ndarray]):
    """(row, its chunks that its marks name) of each row with marks."""
    bounds = np.searchsorted(c["row"], np.arange(rows.num_rows + 1))
    for i in np.flatnonzero(rows.column("marks").is_valid().to_numpy(zero_copy_only=False)).tolist():
        marks = {(m["idx"], m["h"]) for m in rows.column("marks")[i].as_py()}
        own = range(bounds[i], bounds[i + 1])
        places = zip(own, c["idx"][own.start : own.stop].tolist(), c["h"][own.start : own.stop].tolist(), strict=True)
        yield i, [k for k, *place in places if tuple(place) in marks]


def _bytes(batches):
    """The text of the chunks that a row's marks name, compressed: equal bytes are compressed alike, and only they."""
    for batch in batches:
        for rows, data, off in slices(batch, "text"):
            _, c = chunk(data, off)
            k = np.array([k for _, named in _named(rows, c) for k in named], np.int64)
            content = [zlib.compress(data[a:b].tobytes(), 1) for a, b in zip(c["start"][k].tolist(), c["end"][k].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c["h"][k]), pa.array(content, pa.binary())], ["h", "content"])


def _apply(batches, names: list[str]):
    for batch in batches:
        for rows, data, off in slices(batch, "text"):
            lines, c = chunk(data, off)
            bounds = np.searchsorted(lines["row"], np.arange(rows.num_rows + 1))
            edge = np.zeros(len(lines["row"]) + 1, np.int64)
            for _, named in _named(rows, c):
                np.add.at(edge, c["at"][named], 1)
                np.add.at(edge, c["at"][named] + c["n"][named], -1)
            gone = np.cumsum(edge[:-1]) > 0
            texts, cut, removed = [], [], []
            for i in range(rows.num_rows):
                lo, hi = bounds[i], bounds[i + 1]
                out = gone[lo:hi]
                if out.any():
                    kept = np.flatnonzero(~out) + lo
                    pieces = [data[a:b].tobytes() for a, b in zip(lines["start"][kept].tolist(), lines["end"][kept].tolist(), strict=True)]
                    texts.append(b"\n".join(pieces).decode("utf-8"))
                    cut.append(int((out & ~np.append(False, out[:-1])).sum()))
                    removed.append(int(out.sum()))
                else:
                    texts.append(data[off[i] : off[i + 1]].tobytes().decode("utf-8"))
                    cut.append(0)
                    removed.append(0)
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(texts, pa.string()), pa.array(cut, pa.int64()), pa.array(removed, pa.int64())], [*names, "text", "removed_chunks", "removed_lines"])


def _deduped(docs: DataFrame) -> DataFrame:
    """Columns c0, c1, ... of docs but the text, then text, removed_chunks and removed_lines.

    The texts are dealt by id once; both passes over them read that exchange.  The occurrences of a frequent chunk
    are spread over tasks.
    """
    own = numbered(docs)
    names = [n for n, c in zip(own.columns, docs.columns, strict=True) if c != "text"]
    doc_id, text = (own[own.columns[docs.columns.index(c)]] for c in ("doc_id", "text"))
    rows = own.select(*names, text.cast("string").alias("text"), doc_id.cast("long").alias("doc_id")).withColumn("row_key", row_key()).drop("doc_id")
    found = rows.select("row_key", "text").mapInArrow(_chunks, f"{ROW_KEY}, idx int, h long")
    again = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_key", "idx")).alias("keep")).where("n > 1"))
    release(docs.sparkSession)
    hot = materialize(frequent(again.select("h", "n")))
    hits = salted_join(found, again.drop("n"), ["h"], hot, "inner", ["row_key", "idx"])
    hits = materialize(hits.select("h", "row_key", "idx", (F.struct("row_key", "idx") != F.col("keep")).alias("later")))
    dealt = rows.repartition(n_shuffle(docs.sparkSession), "row_key")

    def marked(chosen: DataFrame) -> DataFrame:
        marks = chosen.groupBy("row_key").agg(F.collect_set(F.struct("idx", "h")).alias("marks"))
        return dealt.join(marks, "row_key", "left")

    content = marked(hits).select("text", "marks").mapInArrow(_bytes, "h long, content binary")
    differ = content.groupBy("h").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").select("h")
    gone = salted_join(hits.where("later"), differ, ["h"], hot, "left_anti", ["row_key", "idx"])
    schema = ", ".join([*(f"{n} {own.schema[n].dataType.simpleString()}" for n in names), "text string, removed_chunks long, removed_lines long"])
    return marked(gone).select(*names, "text", "marks").mapInArrow(partial(_apply, names=names), schema)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of docs with the text that stays, and removed_chunks, removed_lines, which take the place of columns of
    docs with these names."""
    out, at = _deduped(docs), {c: f"c{k}" for k, c in enumerate(docs.columns)}
    names = [c for c in docs.columns if c not in ("text", "removed_chunks", "removed_lines")]
    return out.select(*[F.col(at[c]).alias(c) for c in names], "text", "removed_chunks", "removed_lines")


def keep_lines(docs: DataFrame) -> DataFrame:
    """The columns of docs as they are, with the text that stays (and its n_chars, if there is such a column).  Rows of
    which nothing stays go."""
    out = _deduped(docs).where(F.length(F.trim("text")) > 0)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)])
