"""Language identification (operator 10).

Sparse multinomial logistic regression on TF-IDF weighted character n-grams (1 to 3 letters, hashed to a
fixed number of features), trained with follow-the-regularised-leader and elastic-net penalties, then a
temperature that makes the probabilities honest.  Document frequencies count every learning document;
the regression itself is fitted on a bounded sample (`per_language` documents of each language, chosen
by a hash of id and text).  Prediction reads every whole text.

Defined cases: a null text or one without a letter is `und` with score 0; with no learning documents all
are `und`; repeated rows are scored each; rows without an id are held out and predicted; languages that
are equally likely (ties) give the first in order; an empty text is `und`; an empty table gives no rows; very long texts are read whole, one at
a time; columns other than id, text and (for learning) lang are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import numbered

BITS = 15
ORDERS = (1, 2, 3)
_LETTER: list = []


def _letters() -> np.ndarray:
    """Code point to itself where it is a letter, else to a blank."""
    if not _LETTER:
        points = np.arange(0x110000, dtype=np.uint32)
        letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
        _LETTER.append(np.where(letter, points, 32).astype(np.uint32))
    return _LETTER[0]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of the letters of a text and how often each occurs; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _letters()[np.minimum(points, 0x10FFFF)]
    blank = points == 32
    if blank.all():
        return None
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    points = np.concatenate((np.array([32], np.uint32), points[keep], np.array([32], np.uint32)))
    total = np.zeros(1 << BITS, np.int64)
    h = np.zeros(len(points), np.uint32)
    for n in ORDERS:
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint32(0x9E3779B1) + (points[n - 1 :] + np.uint32(n)) * np.uint32(0x85EBCA77)
        m = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
        total += np.bincount(m >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at]


def weigh(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def _frequencies(batches):
    """Documents with each feature: one row a task."""
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            found = ngram_counts(text.as_py() or "")
            if found:
                df[found[0]] += 1
                n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()], pa.binary())], ["n", "df"])


def _sum_frequencies(batches):
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            df += np.frombuffer(raw, np.int64)
            n += k
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()], pa.binary())], ["n", "df"])


def _features(batches):
    for batch in batches:
        rows = [(lang.as_py(), order.as_py(), ngram_counts(text.as_py() or "")) for lang, order, text in zip(*batch.columns, strict=True)]
        rows = [(lang, order, f[0].astype(np.int32).tobytes(), f[1].astype(np.int32).tobytes()) for lang, order, f in rows if f]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "ordering", "at", "count"]
        )


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, features: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights (features, classes) of a softmax regression by follow-the-regularised-leader."""
    z, n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, x, y = examples[i]
            w = weights(at)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    low, high, r = np.log(0.2), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(learning: DataFrame, per_language: int = 500, holdout: float = 0.2) -> dict | None:
    """Fit on rows (doc_id, text, lang).  The driver receives the sample's features (at most per_language
    times the languages, each at most 2**15 features) and one frequency vector."""
    learning = learning.where("lang is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    sizes = {r[0]: r[1] for r in learning.groupBy("lang").count().collect()}
    if not sizes:
        return None
    tree = learning.select("text").mapInArrow(_frequencies, "n long, df binary")
    tree = tree.repartition(8).mapInArrow(_sum_frequencies, "n long, df binary").collect()
    n, df = sum(r[0] for r in tree), sum(np.frombuffer(r[1], np.int64) for r in tree)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    rates = F.create_map(*[F.lit(v) for lang, size in sorted(sizes.items()) for v in (lang, min(1.0, 1.2 * per_language / size))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30))
    sample = learning.withColumn("draw", draw).where(F.col("draw") < rates[F.col("lang")] * F.lit(float(1 << 30)))
    rows = sample.select("lang", "draw", "text").mapInArrow(_features, "lang string, ordering long, at binary, count binary").collect()
    rows = sorted(rows, key=lambda r: (r["ordering"], r["lang"]))
    taken: dict[str, int] = {}
    train, check = [], []
    langs = sorted({r["lang"] for r in rows})
    for r in rows:
        k = taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if k <= per_language:
            at = np.frombuffer(r["at"], np.int32)
            (check if k % round(1 / holdout) == 0 else train).append((at, weigh(at, np.frombuffer(r["count"], np.int32), idf), langs.index(r["lang"])))
    w = ftrl(train, len(langs), 1 << BITS)
    t = temperature(np.array([x @ w[at] for at, x, _ in check]).reshape(-1, len(langs)), np.array([y for *_, y in check], int))
    return {"langs": langs, "idf": idf, "w": w / t}


def _predict(batches, model: dict | None, text: str, names: list[str]):
    for batch in batches:
        langs, scores = [], []
        for value in batch.column(text):
            found = ngram_counts(value.as_py() or "") if model else None
            if not found:
                langs.append("und")
                scores.append(0.0)
                continue
            p = weigh(*found, model["idf"]) @ model["w"][found[0]]
            p = np.exp(p - p.max())
            k = int(p.argmax())
            langs.append(model["langs"][k])
            scores.append(float(p[k] / p.sum()))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])


def predict(docs: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    """Columns `keep` of every row with lang_pred and score.  The model has a fixed number of features."""
    again = "text of the row"
    if "text" in keep and docs.schema["text"].dataType.simpleString() == "string":
        again, rows = "text", docs.select(*[F.col(f"`{c}`") for c in keep])
    else:
        rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(again))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep), "lang_pred string, score double"])
    return rows.mapInArrow(partial(_predict, model=model, text=again, names=keep), schema)


def held_out(doc_id) -> F.Column:
    """The fifth of the documents that nothing is learned from, and those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, per_language: int = 500) -> DataFrame:
    """Learn from the documents that are not held out and predict all."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), per_language)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of docs with a language, all columns as they are: those that are `und` or score less than `least` go."""
    at = docs.columns.index("text")
    own = numbered(docs).withColumnRenamed(f"c{at}", "text")
    out = predict(own, fit(docs), own.columns)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*own.columns).toDF(*docs.columns)
