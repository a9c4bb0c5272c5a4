"""Tree baselines for every condition at once: one tree, forests and boosted trees, chosen on validation rows.

The labeled rows of a condition are few by design (its split size is a parameter, `most`), so a condition is fitted in one task, all of
its candidates sharing what they can: a shallower tree is the top of a deeper one, a shorter series the start of a longer one.
Test rows may be many: they are cut into parts that meet their conditions' models, and send sums of errors.  Models stay in
the executors, as bytes of node tables.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEP = 1 << 20  # no limit
PART_ROWS = 1 << 14


@dataclass
class Trees:
    """Node tables of one or more trees: feature (-1 at a leaf), threshold, left child (the right one follows), mean; first node of each."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    @classmethod
    def join(cls, parts: list[Trees]) -> Trees:
        at = np.cumsum([0] + [len(p.feature) for p in parts[:-1]])
        left = [np.where(p.feature >= 0, p.left + a, 0) for p, a in zip(parts, at, strict=True)]
        cat = lambda n: np.concatenate([getattr(p, n) for p in parts])
        return cls(cat("feature"), cat("threshold"), np.concatenate(left), cat("value"), np.concatenate([p.roots + a for p, a in zip(parts, at, strict=True)]))

    def predict(self, x: np.ndarray, depth: int = DEEP) -> np.ndarray:
        """Values of all trees, cut off at a depth: rows x trees."""
        node = np.tile(self.roots, (len(x), 1))
        for _ in range(depth):
            f = self.feature[node]
            if (f < 0).all():
                break
            right = np.take_along_axis(x, np.maximum(f, 0), axis=1) > self.threshold[node]
            node = np.where(f >= 0, self.left[node] + right, node)
        return self.value[node]


def grow(x: np.ndarray, y: np.ndarray, leaf: int, depth: int = DEEP) -> Trees:
    """A regression tree: the split that lowers the squared error most, halfway between neighbouring values, each side with
    `leaf` rows at least; ties go to the first feature, then the lowest threshold."""
    feature, threshold, left, value = [-1], [0.0], [0], [float(y.mean())]
    todo = [(0, np.arange(len(y)), depth)]
    while todo:
        node, at, deep = todo.pop()
        n = len(at)
        if deep == 0 or n < 2 * leaf or n < 2:
            continue
        own, t = x[at], y[at]
        order = np.argsort(own, axis=0, kind="stable")
        xs = np.take_along_axis(own, order, axis=0)
        below = np.cumsum(t[order], axis=0)[:-1]
        total = t.sum()
        k = np.arange(1, n)[:, None]
        gain = below * below / k + (total - below) ** 2 / (n - k)
        gain[(xs[1:] <= xs[:-1]) | (k < leaf) | (n - k < leaf)] = -np.inf
        most = gain.max()
        # splits as good but for rounding are ties
        f, row = divmod(int(np.argmax(gain.T >= most - 1e-9 * abs(most))), n - 1)
        if not gain[row, f] > total * total / n + 1e-12 * (t @ t):
            continue
        cut = (xs[row, f] + xs[row + 1, f]) / 2
        feature[node], threshold[node], left[node] = f, float(cut), len(feature)
        inside = own[:, f] <= cut
        for side in (at[inside], at[~inside]):
            todo.append((len(feature), side, deep - 1))
            feature.append(-1), threshold.append(0.0), left.append(0), value.append(float(y[side].mean()))
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array([0]))


def draws(tree: int, n: int) -> np.ndarray:
    """Rows of a tree's sample with replacement, by a hash of tree, place and number of rows."""
    return np.array([int(hashlib.md5(f"{tree}|{k}|{n}".encode()).hexdigest()[:8], 16) % n for k in range(n)])


def tree_models(x: np.ndarray, y: np.ndarray, grid: dict[str, list]) -> Iterator[tuple[dict, dict]]:
    """Every candidate of a single tree (depth x leaf) with its model."""
    for leaf in grid["leaf"]:
        trees = grow(x, y, leaf, max(grid["depth"]))
        for depth in grid["depth"]:
            yield {"depth": depth, "leaf": leaf}, {"trees": trees, "depth": depth, "rate": 1.0, "base": 0.0, "mean": True}


def forest_models(x: np.ndarray, y: np.ndarray, grid: dict[str, list]) -> Iterator[tuple[dict, dict]]:
    """Forests (trees x depth x leaf); depths share their samples and trees."""
    samples = [draws(t, len(y)) for t in range(max(grid["trees"]))]
    for leaf in grid["leaf"]:
        grown = [grow(x[s], y[s], leaf, max(grid["depth"])) for s in samples]
        for n in grid["trees"]:
            trees = Trees.join(grown[:n])
            for depth in grid["depth"]:
                yield {"trees": n, "depth": depth, "leaf": leaf}, {"trees": trees, "depth": depth, "rate": 1.0, "base": 0.0, "mean": True}


def boosted_models(x: np.ndarray, y: np.ndarray, grid: dict[str, list]) -> Iterator[tuple[dict, dict]]:
    """Boosted trees on squared error (rate x depth x number); shorter series are the start of the longest."""
    for rate in grid["rate"]:
        for depth in grid["depth"]:
            base, left, grown = float(y.mean()), y - y.mean(), []
            for _ in range(max(grid["trees"])):
                grown.append(grow(x, left, 1, depth))
                left = left - rate * grown[-1].predict(x)[:, 0]
            for n in grid["trees"]:
                yield {"rate": rate, "depth": depth, "trees": n}, {"trees": Trees.join(grown[:n]), "depth": depth, "rate": rate, "base": base, "mean": False}


KINDS = {"tree": tree_models, "forest": forest_models, "boosted": boosted_models}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    v = model["trees"].predict(x, model["depth"])
    return model["base"] + (v.mean(axis=1) if model["mean"] else model["rate"] * v.sum(axis=1))


def fit_trees(rows: DataFrame, condition: list[str], features: list[str], y: str, order: str, kind: str, grid: dict[str, list], most: int) -> DataFrame:
    """Per condition the parameters of least validation error (the first of equals), that error, and the model fitted anew to both roles'
    rows.  rows: condition, role (train, validation), features, y; `order` fixes their order.  A condition of more than
    `most` rows is an error."""
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*condition).schema]
    build = KINDS[kind]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError(f"{len(pdf)} labeled rows in a condition; at most {most} are fitted in a task")
        pdf = pdf.sort_values(order)
        x, t, train = pdf[features].to_numpy(float), pdf[y].to_numpy(float), (pdf["role"] == "train").to_numpy()
        tried = [(float(np.mean((t[~train] - predict(m, x[~train])) ** 2)) if (~train).any() else 0.0, p) for p, m in build(x[train], t[train], grid)]
        loss, best = min(tried, key=lambda v: v[0])
        (_, model), *_ = build(x, t, {k: [v] for k, v in best.items()})
        return pd.DataFrame([[*pdf[condition].iloc[0], loss, {k: float(v) for k, v in best.items()}, pickle.dumps(model)]], columns=[*condition, "validation_mse", "parameters", "model"])

    schema = ", ".join([*kinds, "validation_mse double, parameters map<string,double>, model binary"])
    return rows.select(*condition, "role", order, *features, y).groupBy(*condition).applyInPandas(work, schema)


def test_metrics(rows: DataFrame, models: DataFrame, join_on: list[str], condition: list[str], features: list[str], y: str) -> DataFrame:
    """condition, mse, rmse and mae over rows, whose keys `join_on` are a part of the condition's.  Parts of about PART_ROWS rows
    meet the models of their key."""
    parts = rows.groupBy(*join_on).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("_parts"))
    own = rows.select(*join_on, *features, y).join(parts, join_on).withColumn("_part", F.pmod(F.xxhash64(*features, y), F.col("_parts")).cast("int")).drop("_parts")
    sent = models.select(*condition, "model").join(parts, join_on).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in models.select(*condition).schema]

    def work(data: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        x, t, out = data[features].to_numpy(float), data[y].to_numpy(float), []
        for r in fitted.itertuples(index=False):
            e = t - predict(pickle.loads(r.model), x) if len(t) else t
            out.append([*(getattr(r, c) for c in condition), len(t), float(e @ e), float(np.abs(e).sum())])
        return pd.DataFrame(out, columns=[*condition, "n", "s2", "s1"])

    key = [*join_on, "_part"]
    sums = own.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(work, ", ".join([*kinds, "n long, s2 double, s1 double"]))
    total = sums.groupBy(*condition).agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")).where("n > 0")
    mse = F.col("s2") / F.col("n")
    return total.select(*condition, mse.alias("mse"), F.sqrt(mse).alias("rmse"), (F.col("s1") / F.col("n")).alias("mae"))


test_metrics.__test__ = False  # not a test of its own
