"""Grouped least squares, calibration and weakly supervised fits from distributed Gram matrices.

Raw rows are read a fixed number of times: a Gram row holds one group's cross products, and every
iteration works on such rows, spread over tasks.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 1e-12


# scalers -----------------------------------------------------------------------------------------
def fit_scaler(df: DataFrame, g: list[str], columns: list[str], untouched: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation by group; a deviation below 1e-12 becomes 1."""
    aggs = []
    for c in columns:
        if c in untouched:
            aggs += [F.lit(0.0).alias(f"{c}_mean"), F.lit(1.0).alias(f"{c}_scale")]
        else:
            aggs += [F.avg(c).alias(f"{c}_mean"), F.when(F.stddev_pop(c) < SMALL, 1.0).otherwise(F.stddev_pop(c)).alias(f"{c}_scale")]
    return df.groupBy(*g).agg(*aggs)


def apply_scaler(df: DataFrame, scaler: DataFrame, g: list[str], columns: list[str], inverse: bool = False) -> DataFrame:
    j = df.join(scaler, g) if g else df.crossJoin(F.broadcast(scaler))
    new = {c: (F.col(c) * F.col(f"{c}_scale") + F.col(f"{c}_mean")) if inverse else (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_scale") for c in columns}
    return j.withColumns(new).drop(*[f"{c}_{s}" for c in columns for s in ("mean", "scale")])


# Gram matrices -----------------------------------------------------------------------------------
def gram(df: DataFrame, g: list[str], columns: list[str]) -> DataFrame:
    """n and the upper triangle of cross products, row by row, as one array a group.  Partial sums are made
    before the shuffle, so a large group sends one row a task."""
    pairs = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]
    return df.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.array(*pairs).alias("xtx"))


def full(xtx, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = xtx
    return out + np.triu(out, 1).T


def cross(columns: list[str], a: str, b: str) -> Column:
    """One entry of the triangle as a column."""
    i, j = sorted((columns.index(a), columns.index(b)))
    return F.element_at("xtx", i * len(columns) - i * (i - 1) // 2 + j - i + 1)


def minimum_norm(a: np.ndarray, b: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Solution of least norm after the columns are given unit length; with a ridge, its solution."""
    if ridge:
        return np.linalg.solve(a + ridge * np.eye(len(a)), b)
    d = np.sqrt(np.maximum(np.diag(a), 0))
    d = np.where(d > 0, d, 1.0)
    return np.linalg.pinv(a / np.outer(d, d), rcond=1e-12, hermitian=True) @ (b / d) / d


def _map_rows(df: DataFrame, work, schema: str, keep: list[str]) -> DataFrame:
    """Apply work(row) to Gram rows, one group a row, and keep the named columns."""
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keep]
    names = [s.split()[0] for s in kept + [x.strip() for x in schema.split(";")]]

    def run(parts):
        for pdf in parts:
            rows = [{**{k: getattr(r, k) for k in keep}, **work(r)} for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, ", ".join(kept + [x.strip() for x in schema.split(";")]))


def ols(grams: DataFrame, g: list[str], columns: list[str], x: list[str], y: str, ridge: float = 0.0) -> DataFrame:
    """Least squares of y on x for every Gram row: coefficients by column and the residual mse."""
    at, k = [columns.index(c) for c in x], columns.index(y)

    def work(r):
        m = full(r.xtx, len(columns))
        b = minimum_norm(m[np.ix_(at, at)], m[at, k], ridge)
        sse = m[k, k] - 2 * b @ m[at, k] + b @ m[np.ix_(at, at)] @ b
        return {"n": int(r.n), "coef": b.tolist(), "mse": float(max(sse, 0.0) / r.n)}

    return _map_rows(grams, work, "n long; coef array<double>; mse double", g)


def coverage(grams: DataFrame, g: list[str], columns: list[str], h: list[str], b: list[str], y: str) -> DataFrame:
    """R-squared of H alone, of H and B, and of B on what H leaves (intercept within H)."""
    k = columns.index(y)

    def work(r):
        m = full(r.xtx, len(columns))
        i = columns.index("one")
        total = m[k, k] - m[i, k] ** 2 / m[i, i]

        def left(names):
            at = [columns.index(c) for c in names]
            c = minimum_norm(m[np.ix_(at, at)], m[at, k])
            return max(m[k, k] - 2 * c @ m[at, k] + c @ m[np.ix_(at, at)] @ c, 0.0)

        a, both = left(h), left([*h, *b])
        return {"r2_h": 1 - a / total if total > 0 else None, "r2_hb": 1 - both / total if total > 0 else None, "r2_b": 1 - both / a if a > SMALL else None}

    return _map_rows(grams, work, "r2_h double; r2_hb double; r2_b double", g)


def canonical_correlation(grams: DataFrame, g: list[str], columns: list[str], a: list[str], b: list[str]) -> DataFrame:
    """Largest canonical correlation of two column sets, centred through the column `one`, within [0, 1]."""

    def work(r):
        m = full(r.xtx, len(columns))
        i = columns.index("one")
        m = m - np.outer(m[:, i], m[i]) / m[i, i]
        ia, ib = [columns.index(c) for c in a], [columns.index(c) for c in b]

        def root(s):
            w, v = np.linalg.eigh(s)
            return v @ np.diag(np.where(w > 1e-12 * max(w.max(), SMALL), 1 / np.sqrt(np.maximum(w, SMALL)), 0)) @ v.T

        s = np.linalg.svd(root(m[np.ix_(ia, ia)]) @ m[np.ix_(ia, ib)] @ root(m[np.ix_(ib, ib)]), compute_uv=False)
        return {"correlation": float(np.clip(s[0], 0, 1))}

    return _map_rows(grams, work, "correlation double", g)


def projection(grams: DataFrame, g: list[str], columns: list[str], h: list[str], b: list[str], drop: float = 1e-8) -> DataFrame:
    """Frozen projection of each B column on H: weights by B column, null where nothing of it is left; rows
    no more than the rank of H are skipped with a note."""
    ih = [columns.index(c) for c in h]

    def work(r):
        m = full(r.xtx, len(columns))
        hh = m[np.ix_(ih, ih)]
        d = np.sqrt(np.where(np.diag(hh) > 0, np.diag(hh), 1.0))
        rank = int(np.linalg.matrix_rank(hh / np.outer(d, d), tol=1e-10, hermitian=True))
        if r.n <= rank:
            return {"weights": [[0.0] * len(h) for _ in b], "note": "no more rows than the rank of H"}
        out = []
        for c in b:
            k = columns.index(c)
            w = minimum_norm(hh, m[ih, k])
            left = m[k, k] - 2 * w @ m[ih, k] + w @ hh @ w
            out.append(w.tolist() if left > drop**2 * m[k, k] else None)
        return {"weights": out, "note": None}

    return _map_rows(grams, work, "weights array<array<double>>; note string", g)


def residualize(df: DataFrame, projections: DataFrame, g: list[str], h: list[str], b: list[str]) -> DataFrame:
    """B columns less their projection on H; a dropped column is null."""
    j = df.join(projections.select(*g, "weights"), g)
    w = lambda k, i: F.element_at(F.element_at("weights", k + 1), i + 1)
    return j.withColumns({c: F.col(c) - reduce(lambda s, t: s + t, [w(k, i) * F.col(n) for i, n in enumerate(h)]) for k, c in enumerate(b)}).drop("weights")


# alignment and calibration -----------------------------------------------------------------------
def affine_align(df: DataFrame, g: list[str], y: str, x: str, shift: float = 0.0) -> DataFrame:
    """y = a + b (x - shift) by group."""
    return df.groupBy(*g).agg(F.regr_slope(F.col(y), F.col(x)).alias("b"), (F.regr_intercept(F.col(y), F.col(x)) + F.regr_slope(F.col(y), F.col(x)) * shift).alias("a"))


def ridge_one(df: DataFrame, g: list[str], x: str, residual: Column, ridge: float) -> DataFrame:
    """One-column ridge d = sum(x r) / (sum(x x) + ridge); with ridge 0 and no x at all, 0."""
    xx = F.sum(F.col(x) * F.col(x)) + F.lit(ridge)
    return df.groupBy(*g).agg(F.coalesce(F.try_divide(F.sum(F.col(x) * residual), xx), F.lit(0.0)).alias("d"))


def calibrate(df: DataFrame, g: list[str], y: str, score, low: float, high: float, points: int = 21, rounds: int = 1) -> DataFrame:
    """Theta in a box with the least mean squared error of score(theta), by grids that narrow each round.

    A loss that isn't finite counts as 1e30.  The rows are read once a round; each sends `points` sums.
    """
    bounds, out = None, None
    for _ in range(rounds):
        if bounds is None:
            lo, width = F.lit(low), F.lit((high - low) / (points - 1))
            rows = df
        else:
            rows = df.join(bounds, g)
            lo, width = F.col("_low"), F.col("_width")
        sums = []
        for k in range(points):
            e = F.col(y) - score(lo + width * F.lit(float(k)))
            loss = F.avg(e * e)
            sums.append(F.struct(F.when(F.isnan(loss) | (loss >= float("inf")) | loss.isNull(), 1e30).otherwise(loss).alias("loss"), (F.first(lo) + F.first(width) * F.lit(float(k))).alias("theta")))
        out = rows.groupBy(*g).agg(F.array_min(F.array(*sums)).alias("best"), F.first(width).alias("width"))
        bounds = out.select(*g, F.greatest(F.lit(low), F.col("best.theta") - F.col("width")).alias("_low"), F.least(F.lit(high), F.col("best.theta") + F.col("width")).alias("_high"), F.lit(0).alias("_"))
        bounds = bounds.select(*g, "_low", ((F.col("_high") - F.col("_low")) / (points - 1)).alias("_width"))
    return out.select(*g, F.col("best.theta").alias("theta"), F.col("best.loss").alias("loss"))


def sensitivity(df: DataFrame, g: list[str], score, low: float, high: float, sigma: float) -> DataFrame:
    """Root mean square change of the score across the box, in units of sigma."""
    d = score(F.lit(high)) - score(F.lit(low))
    return df.groupBy(*g).agg((F.sqrt(F.avg(d * d)) / sigma).alias("sensitivity"))


def calibrate_scale(df: DataFrame, g: list[str], base: str, discrepancy: str, y: str, targets: list[float], grid: Column) -> DataFrame:
    """Scale s on a grid for which corr(base + s * discrepancy, y) is nearest each target, with the range of
    correlations that the grid attains.  Rows are read once, for their moments."""
    m = df.groupBy(*g).agg(
        F.var_pop(base).alias("vb"), F.var_pop(discrepancy).alias("vd"), F.covar_pop(base, discrepancy).alias("bd"), F.covar_pop(base, y).alias("by"), F.covar_pop(discrepancy, y).alias("dy"), F.var_pop(y).alias("vy")
    )
    s = F.col("scale")
    r = (F.col("by") + s * F.col("dy")) / F.sqrt((F.col("vb") + 2 * s * F.col("bd") + s * s * F.col("vd")) * F.col("vy"))
    points = m.withColumn("scale", F.explode(grid)).withColumn("correlation", r)
    best = [F.min(F.struct(F.abs(F.col("correlation") - t).alias("gap"), "scale", "correlation")).alias(f"b{i}") for i, t in enumerate(targets)]
    one = points.groupBy(*g).agg(F.min("correlation").alias("lowest"), F.max("correlation").alias("highest"), *best)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"b{i}").alias("b")) for i, t in enumerate(targets)]))
    return one.select(*g, "lowest", "highest", rows.alias("r")).select(*g, "r.target", "r.b.scale", "r.b.correlation", "r.b.gap", "lowest", "highest")


# selection and scoring ----------------------------------------------------------------------------
def one_standard_error(candidates: DataFrame, g: list[str], loss: str, deviation: str, n: str) -> DataFrame:
    """Among candidates within one standard error of the least loss, the largest (weak weight, l1, group
    weight), then the lowest loss."""
    best = candidates.groupBy(*g).agg(F.min_by(F.struct(F.col(loss).alias("l"), (F.col(deviation) / F.sqrt(F.col(n))).alias("se")), loss).alias("b"))
    near = candidates.join(best, g).where(F.col(loss) <= F.col("b.l") + F.col("b.se")).drop("b")
    rest = [c for c in candidates.columns if c not in g]
    return near.groupBy(*g).agg(F.max_by(F.struct(*rest), F.struct("weak_weight", "l1", "group_weight", -F.col(loss))).alias("c")).select(*g, "c.*")


def predict(df: DataFrame, models: DataFrame, g: list[str], shape: list[str], theta_of: list[str], basis: list[str], name: str = "pred") -> DataFrame:
    """H(theta) g + B d with each group's model; the models' other columns come along."""
    more = [c for c in models.columns if c not in (*g, "g", "d", "theta")]
    j = df.join(models.select(*g, *more, F.col("g").alias("_g"), F.col("d").alias("_d"), F.col("theta").alias("_t")), g)
    at = lambda c, i: F.element_at(c, i + 1)
    terms = [at("_g", i) * F.col(c) for i, c in enumerate(shape)]
    terms += [at("_g", len(shape) + i) * F.col("_t") * F.col(c) for i, c in enumerate(theta_of)]
    terms += [at("_d", i) * F.col(c) for i, c in enumerate(basis)]
    return j.withColumn(name, reduce(lambda a, b: a + b, terms)).drop("_g", "_d", "_t")


def active_features(models: DataFrame, g: list[str], names: list[str], vec: str, least: float = 1e-8) -> DataFrame:
    """Names with a coefficient above the threshold, and the others."""
    pick = lambda keep: F.array_join(F.filter(F.transform(F.col(vec), lambda x, i: F.when((F.abs(x) > least) == F.lit(keep), F.element_at(F.array(*[F.lit(n) for n in names]), i + 1))), lambda n: n.isNotNull()), ",")
    return models.select(*g, pick(True).alias("active"), pick(False).alias("dropped"))


def objective_terms(df: DataFrame, g: list[str], residual: Column, labeled: Column, weak_weight: float, l1: float, coefficients: list[float], groups: list[list[int]] = (), group_weight: float = 0.0, basis: list[float] = (), ridge: float = 0.0) -> DataFrame:
    """Labeled term, weak term, penalty and their sum for given coefficients; with groups of places or basis coefficients
    also the group term (sum of the groups' norms) and the ridge term (half the squared norm of the basis)."""
    sse = lambda when: 0.5 * F.sum(F.when(when, residual * residual).otherwise(0.0))
    terms = {"labeled_term": sse(labeled), "weak_term": weak_weight * sse(~labeled), "l1_term": F.lit(float(l1 * sum(abs(c) for c in coefficients)))}
    if groups:
        terms["group_term"] = F.lit(float(group_weight * sum(np.linalg.norm([coefficients[i] for i in at]) for at in groups)))
    if basis:
        terms["ridge_term"] = F.lit(float(0.5 * ridge * sum(c * c for c in basis)))
    out = df.groupBy(*g).agg(*[c.alias(n) for n, c in terms.items()])
    return out.withColumn("objective", reduce(lambda a, b: a + b, [F.col(n) for n in terms]))
