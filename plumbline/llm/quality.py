"""Quality classifier (operator 5).

Document statistics go through random Fourier features, which approximate a Gaussian kernel; partitions
sum their normal equations, ridge regression solves the sum, and isotonic regression over binned scores
turns the fitted values into probabilities.

Defined cases: a null or empty text has the statistics of an empty text and gets a score too; without
labelled rows the score is 0.5; with one class only it is that class; a document with several labels
learns from each; repeated rows are scored each; rows without an id are held out and scored; a very long text is read whole, as a
slice of its own; an empty table gives no rows; columns other than the id and text are ignored, labels are read only for learning.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import materialize
from plumbline.llm.langid import held_out

BINS = 4096
FOLDS = 4
NAMES = (
    "log_bytes log_words log_lines word_length upper lower digit punctuation odd_symbols high_bytes blanks "
    "words_a_line distinct_words distinct_lines capital_words title_words numeric_words symbol_words long_words short_words "
    "top_word entropy bang_words ends_in_stop bar hash_sign repeated_pairs"
).split()


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(raw), 1)
    c = np.bincount(raw, minlength=256).astype(float)
    words, lines = text.split(), text.split("\n")
    m = max(len(words), 1)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    upper, digit = c[65:91].sum(), c[48:58].sum()
    p = c[c > 0] / n
    kinds = [(k, v, any(ch.isalpha() for ch in k)) for k, v in counts.items()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), (n - c[32] - c[10]) / m, upper / n, c[97:123].sum() / n, digit / n,
        (c[44] + c[46] + c[59] + c[58] + c[63]) / n, (c[33] + c[35:39].sum() + c[42] + c[64] + c[94] + c[126]) / n, c[128:].sum() / n, (c[32] + c[10] + c[9]) / n,
        np.log1p(len(words) / max(len(lines), 1)), len(counts) / m, len(set(lines)) / max(len(lines), 1),
        sum(v for k, v, a in kinds if a and k.isupper() and len(k) > 1) / m, sum(v for k, v, a in kinds if a and k[0].isupper()) / m,
        sum(v for k, v, a in kinds if not a and any(ch.isdigit() for ch in k)) / m, sum(v for k, v, a in kinds if not a and not any(ch.isdigit() for ch in k)) / m,
        sum(v for k, v, _ in kinds if len(k) > 14) / m, sum(v for k, v, _ in kinds if len(k) < 3) / m, max(counts.values(), default=0) / m,
        float(-(p * np.log(p)).sum()), sum(v for k, v, _ in kinds if k.endswith("!")) / m, float(text.rstrip()[-1:] in (".", "!", "?")),
        c[124] / n, c[35] / n, 1 - pairs / max(len(words) - 1, 1),
    ]


def _statistics(batches):
    for batch in batches:
        x = np.array([statistics(t.as_py() or "") for t in batch.column(1)], float).reshape(-1, len(NAMES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_statistics, "doc_id long, x array<double>")


def fourier(features: int, width: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(len(NAMES), features)) / width, rng.uniform(0, 2 * np.pi, features)


def expand(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    return np.hstack([np.sqrt(2 / model["w"].shape[1]) * np.cos(z @ model["w"] + model["b"]), z * 0.1, np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(-1, len(NAMES))


def _normal(batches, model: dict):
    """Normal equations of a partition, one block a fold: one row."""
    d = model["w"].shape[1] + len(NAMES) + 1
    a = np.zeros((FOLDS, d, d + 1))
    for batch in batches:
        z, y, fold = expand(_matrix(batch, "x"), model), batch.column("y").to_numpy().astype(float), batch.column("fold").to_numpy()
        for f in np.unique(fold):
            own = z[fold == f]
            a[f] += own.T @ np.column_stack((own, y[fold == f]))
    yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], ["sums"])


def _add(batches):
    total = None
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            part = np.frombuffer(raw)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _score(batches, model: dict, names: list[str]):
    for batch in batches:
        x = expand(_matrix(batch, "x"), model) if batch.num_rows else np.zeros((0, len(model["beta"])))
        # a row that was learned from is placed by the model that left its fold out
        z = x @ model["beta"] if "table" in model else np.einsum("ij,ij->i", x, model["rest"][batch.column("fold").to_numpy()])
        k = np.clip(((z + 0.5) * (BINS / 2)).astype(np.int64), 0, BINS - 1)
        if "table" in model:
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.clip(model["table"][k] + 1e-6 * np.clip(z, 0, 1), 0, 1))], [*names, "score"])
        else:
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(k)], [*names, "bin"])


def isotonic(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Rising probabilities over score bins by pooling adjacent violators; empty bins are interpolated."""
    blocks: list[list[float]] = []
    for k in np.flatnonzero(n):
        blocks.append([positive[k], n[k], k, k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, m, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + m, blocks[-1][2], last]
    at = [e for b in blocks for e in (b[2], b[3])]
    value = [(b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in range(2)]
    return np.maximum.accumulate(np.interp(np.arange(len(n)), at, value))


def fit(rows: DataFrame, features: int = 256, width: float = 6.0, ridge: float = 1e-3) -> dict | None:
    """Fit on rows (x, y, fold).  Every partition sends one matrix a fold of fixed size; eight sums reach the driver.

    The score is fitted on all rows.  Its calibration counts each row where the ridge of the other folds puts it, for
    their normal equations are the total less the row's own fold; where other folds have no rows, the total's does.
    """
    at = range(len(NAMES))
    moments = rows.select(*[F.avg(F.col("x")[k]) for k in at], *[F.stddev_pop(F.col("x")[k]) for k in at], F.count(F.lit(1))).first()
    if not moments[-1]:
        return None
    mean, scale = np.array(moments[: len(NAMES)]), np.array(moments[len(NAMES) : -1])
    w, b = fourier(features, width)
    model = {"mean": mean, "scale": np.where(scale < 1e-9, 1.0, scale), "w": w, "b": b}
    sums = rows.select("x", "y", "fold").mapInArrow(partial(_normal, model=model), "sums binary").repartition(8).mapInArrow(_add, "sums binary").collect()
    d = features + len(NAMES) + 1
    folds = sum(np.frombuffer(r[0]) for r in sums).reshape(FOLDS, d, d + 1)
    total = folds.sum(0)

    def solve(a):
        n = a[d - 1, d - 1]  # the last feature is 1
        return np.linalg.solve(a[:, :d] + ridge * n * np.eye(d) / d, a[:, d])

    model["beta"] = solve(total)
    model["rest"] = np.array([solve(total - a) if total[d - 1, d - 1] - a[d - 1, d - 1] > 0.5 else model["beta"] for a in folds])
    bins = rows.select("x", "y", "fold").mapInArrow(partial(_score, model=model, names=["y"]), "y int, bin long").groupBy("bin").agg(F.count(F.lit(1)), F.sum("y")).collect()  # BINS rows at most
    n, positive = np.zeros(BINS), np.zeros(BINS)
    for k, m, p in bins:
        n[k], positive[k] = m, p
    return model | {"table": isotonic(n, positive)}


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from labels of those not held out."""
    found = materialize(document_statistics(docs))
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long"), (F.col("quality") > 0).cast("int").alias("y"))
    known = known.where(~held_out(F.col("doc_id")))
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 - 1).cast("int")  # held-out rows would be -1
    model = fit(found.join(known, "doc_id").select("x", "y", fold.alias("fold")))
    scored = found.mapInArrow(partial(_score, model=model, names=["doc_id"]), "doc_id long, score double") if model else found.select("doc_id", F.lit(0.5).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
