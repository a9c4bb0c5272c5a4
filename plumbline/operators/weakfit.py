"""Weakly supervised fits: frozen scaling, several parameters, checked penalties, labels scored anew.

The model is H(x, theta) g + B(x) d on measured rows and H(x, theta) g on weak ones.  Each part of the rows (labeled,
weak, validation) reaches a fit as centred moments, which Spark merges pairwise, so neither raw rows nor raw cross
products are needed and columns far from zero lose no digits.  A fit alternates over g (sparse groups, solved to an optimality
residual), d (ridge or least norm) and theta (least squares within a box); all candidates of a penalty level move together
as arrays, levels follow each other from the heaviest with warm starts.

References that are not linear in theta are scored over the weak rows before every sweep (`refresh_fits`): the groups that still
move are joined to the weak rows, one aggregation gives the moments of their new labels, and each sweep's states are a
written table, so that the lineage ends there.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.registry import ColumnLibrary
from plumbline.sources.shared import forget, scratch, written

SMALL = 1e-12
MOMENTS = "struct<n:bigint,mean:array<double>,co:array<double>>"


# moments -------------------------------------------------------------------------------------------
def moments(df: DataFrame, g: list[str], columns: list[str], name: str = "moments") -> DataFrame:
    """Per group a struct of n, the means and the upper triangle of centred products.

    Spark's covariance buffers hold means and co-moments and merge pairwise: a task sends one row a group, and a column with a
    mean far beyond its deviation keeps its digits.  Rows with a null in any of the columns are left out."""
    full = df.dropna(subset=columns)
    x = [F.col(c).cast("double") for c in columns]
    n = F.count(F.lit(1))
    co = [F.covar_pop(x[i], x[j]) * n for i in range(len(x)) for j in range(i, len(x))]
    return full.groupBy(*g).agg(F.struct(n.alias("n"), F.array(*[F.avg(c) for c in x]).alias("mean"), F.array(*co).alias("co")).alias(name))


@dataclass
class Part:
    """Moments of a part of the rows over [shape, basis, y]."""

    n: int
    mean: np.ndarray
    co: np.ndarray

    @classmethod
    def of(cls, row: Any, size: int) -> Part:
        """From a moments struct (a row, a dict or None)."""
        if row is None or not row["n"]:
            return cls(0, np.zeros(size), np.zeros((size, size)))
        co = np.zeros((size, size))
        co[np.triu_indices(size)] = np.asarray(row["co"], float)
        return cls(int(row["n"]), np.asarray(row["mean"], float), co + np.triu(co, 1).T)

    def __add__(self, other: Part) -> Part:
        """Moments of both parts together."""
        n = self.n + other.n
        if not self.n or not other.n:
            return other if not self.n else self
        d = other.mean - self.mean
        return Part(n, self.mean + d * (other.n / n), self.co + other.co + np.outer(d, d) * (self.n * other.n / n))

    def raw(self, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Products of (1, (columns - shift) / scale)."""
        d = (self.mean - shift) / scale
        out = np.empty((len(d) + 1, len(d) + 1))
        out[0, 0], out[0, 1:], out[1:, 0] = self.n, self.n * d, self.n * d
        out[1:, 1:] = self.co / np.outer(scale, scale) + self.n * np.outer(d, d)
        return out


# the columns in their scales -----------------------------------------------------------------------
@dataclass
class Setting:
    """What a fit knows of its library: places of columns, penalty groups, the box and what is scaled."""

    shape: list[str]
    alone: list[int]
    parameters: list[list[int]]
    basis: int
    groups: list[list[int]]
    low: np.ndarray
    high: np.ndarray
    scaled: bool = True
    names: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, library: ColumnLibrary, box: dict[str, tuple[float, float]], scaled: bool = True) -> Setting:
        shape = list(library.shape)
        own = library.parameters()
        if set(box) != set(own):
            raise ValueError(f"the box must name {', '.join(own) or 'no parameter'}")
        low, high = (np.array([box[p][k] for p in own], float) for k in (0, 1))
        if (low > high).any():
            raise ValueError("an end of the box lies above the other")
        return cls(shape, [shape.index(n) for n in library.alone()], [[shape.index(n) for n in names] for names in own.values()], len(library.basis), library.group_places(), low, high, scaled, list(own))

    @property
    def columns(self) -> int:
        return len(self.shape) + self.basis + 1

    @property
    def h(self) -> int:
        return len(self.alone) + sum(len(p) for p in self.parameters)


@dataclass
class Frame:
    """Frozen scalers: H(theta) = (1, z) (base + sum of theta_k slope_k), z the shape columns less `shift`."""

    base: np.ndarray
    slopes: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    y_mean: float
    y_scale: float

    @classmethod
    def of(cls, s: Setting, labeled: Part, weak: Part, theta: np.ndarray) -> Frame:
        """Shape columns by the statistics of labeled and weak rows (at the first theta), basis and y by those of the
        labeled rows; a deviation below 1e-12 counts as 1, and a constant shape column stays as it is."""
        p, b = len(s.shape), s.basis
        both = Part(labeled.n, labeled.mean[:p], labeled.co[:p, :p]) + Part(weak.n, weak.mean[:p], weak.co[:p, :p])
        mean = both.mean
        deviation = np.sqrt(np.maximum(np.diag(both.co), 0.0) / max(both.n, 1))
        one = lambda x: np.where(x < SMALL, 1.0, x)
        base, slopes = np.zeros((p + 1, s.h)), np.zeros((len(s.parameters), p + 1, s.h))
        for j, i in enumerate(s.alone):
            plain = not s.scaled or deviation[i] < SMALL
            scale = 1.0 if plain else deviation[i]
            base[i + 1, j] = 1 / scale
            base[0, j] = mean[i] if plain else 0.0
        j = len(s.alone)
        for k, places in enumerate(s.parameters):
            for i in places:
                scale = one(abs(theta[k]) * deviation[i]) if s.scaled else 1.0
                slopes[k, i + 1, j], slopes[k, 0, j] = 1 / scale, mean[i] / scale
                base[0, j] = -theta[k] * mean[i] / scale if s.scaled else 0.0
                j += 1
        shift, scale = np.concatenate((mean, np.zeros(b + 1))), np.ones(p + b + 1)
        own = np.sqrt(np.maximum(np.diag(labeled.co), 0.0) / max(labeled.n, 1))[p:]
        if s.scaled and labeled.n:
            shift[p:], scale[p:] = labeled.mean[p:], one(own)
            still = own[:b] < SMALL
            shift[p : p + b][still] = 0.0  # a constant basis column stays as it is
        return cls(base, slopes, shift, scale, float(shift[-1]), float(scale[-1]))

    def lift(self, theta: np.ndarray) -> np.ndarray:
        """H(theta) over (1, z) for rows of theta: (m, 1 + shape, h)."""
        return self.base + np.tensordot(theta, self.slopes, axes=(1, 0))


# the three blocks ----------------------------------------------------------------------------------
def member(groups: list[list[int]], h: int) -> np.ndarray:
    """One row a group, 1 for its entries."""
    out = np.zeros((len(groups), h))
    for k, at in enumerate(groups):
        out[k, at] = 1.0
    return out


def shrink(v: np.ndarray, l1: np.ndarray, group: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Proximal step of l1 |v| + group * sum of the groups' norms, for rows of v; `of` says which entries a group has."""
    v = np.sign(v) * np.maximum(np.abs(v) - l1[:, None], 0.0)
    if not len(of):
        return v
    norm = np.sqrt((v * v) @ of.T)
    left = np.maximum(1 - group[:, None] / np.where(norm > 0, norm, 1.0), 0.0)
    return v * (left @ of + (1 - of.sum(axis=0)))


def residuals(q: np.ndarray, c: np.ndarray, x: np.ndarray, size: np.ndarray, l1: np.ndarray, group: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How far each x is from the conditions of its optimum: the proximal-gradient step in units of the gradient, over |c|."""
    grad = np.einsum("mij,mj->mi", q, x) - c
    step = shrink(x - grad / size[:, None], l1 / size, group / size, of)
    return np.abs(x - step).max(axis=1) * size / np.maximum(np.abs(c).max(axis=1), SMALL)


def _polish(q: np.ndarray, c: np.ndarray, x: np.ndarray, l1: float, group: float, of: np.ndarray) -> np.ndarray:
    """Newton steps on the entries that are not zero, where signs and norms are smooth.  A step ends where an entry reaches
    zero and leaves; where columns are alike, so that there is no curvature, the step follows the slope; at the end of the
    steps the entry outside that breaks its condition most comes in."""
    x, last = x.copy(), np.inf
    for _ in range(100):
        on = np.flatnonzero(x)
        if not len(on):
            break
        y = x[on]
        force, curve = q[np.ix_(on, on)] @ y - c[on] + l1 * np.sign(y), q[np.ix_(on, on)].copy()
        for at in of[:, on] if group else ():
            own = np.flatnonzero(at)
            norm = np.linalg.norm(y[own])
            if norm > 0:
                unit = y[own] / norm
                force[own] += group * unit
                curve[np.ix_(own, own)] += group / norm * (np.eye(len(own)) - np.outer(unit, unit))
        w, v = np.linalg.eigh(curve)
        flat, f = w <= 1e-12 * max(w[-1], SMALL), v.T @ force
        slope = np.abs(f[flat]).max(initial=0.0) > 1e-11 * np.abs(c).max()
        step = -(v[:, flat] @ f[flat] if slope else v[:, ~flat] @ (f[~flat] / w[~flat]))
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(y * step < 0, -y / step, np.inf)
        first = int(np.argmin(reach))
        if slope and not np.isfinite(reach[first]):
            break
        if slope or reach[first] <= 1:
            y = y + reach[first] * step
            y[first] = 0.0
            x[on] = y
            continue
        x[on] = y + step
        now = np.abs(step).max() / np.abs(y).max()
        if now <= 1e-14 or (now <= 1e-5 and now >= last / 2):  # rounding is all that moves it
            last = np.inf
            grad = q @ x - c
            if group:
                grad[((of @ np.abs(x)) == 0) @ of > 0] = 0.0  # groups that are out come in by a proximal step
            grad[on] = 0.0
            j = int(np.argmax(np.abs(grad)))
            if abs(grad[j]) <= l1 + 1e-10 * np.abs(c).max():
                break
            x[j] = -np.sign(grad[j]) * 1e-9 * np.abs(x).max()
        else:
            last = now
    return x


def sparse_groups(q: np.ndarray, c: np.ndarray, x: np.ndarray, l1: np.ndarray, group: np.ndarray, groups: list[list[int]], tol: float = 1e-9, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of x'qx/2 - c'x + l1 |x| + group * sum of group norms for a batch of problems, and its optimality residual.

    Newton steps on the support come first, where the start has one; then rounds of 25 accelerated proximal steps with
    restarts, each followed by Newton steps, taken where they lower the residual, until it is below tol.  A problem
    whose residual no longer falls keeps what it has."""
    x, of = x.copy(), member(groups, x.shape[1])
    free = (l1 <= 0) & ((group <= 0) | (not groups))
    for k in np.flatnonzero(free):
        x[k] = least_norm(q[k], c[k])
    size = np.maximum(np.linalg.eigvalsh(q)[:, -1], SMALL)
    left = residuals(q, c, x, size, l1, group, of)

    def polish(which: np.ndarray) -> None:
        for k in which:
            at = slice(k, k + 1)
            y = _polish(q[k], c[k], x[k], float(l1[k]), float(group[k]), of)
            own = residuals(q[at], c[at], y[None], size[at], l1[at], group[at], of)[0]
            if own < left[k]:
                x[k], left[k] = y, own

    polish(np.flatnonzero((left > tol) & ~free & x.any(axis=1)))
    todo = np.flatnonzero((left > tol) & ~free)
    best, still = left.copy(), np.zeros(len(left), int)
    for _ in range(rounds):
        if not len(todo):
            break
        qt, ct, lt, gt, st = q[todo], c[todo], l1[todo] / size[todo], group[todo] / size[todo], size[todo][:, None]
        v = z = x[todo]
        t = np.ones(len(todo))
        for _ in range(25):
            new = shrink(z - ((qt @ z[:, :, None])[:, :, 0] - ct) / st, lt, gt, of)
            back = ((z - new) * (new - v)).sum(axis=1) > 0  # the step turned round
            t = np.where(back, 1.0, t)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z = new + np.where(back, 0.0, (t - 1) / t2)[:, None] * (new - v)
            v, t = new, t2
        x[todo] = v
        left[todo] = residuals(qt, ct, v, size[todo], l1[todo], group[todo], of)
        polish(todo[left[todo] > tol])
        fell = left[todo] < 0.5 * best[todo]
        still[todo] = np.where(fell, 0, still[todo] + 1)
        best[todo] = np.minimum(best[todo], left[todo])
        todo = todo[(left[todo] > tol) & (still[todo] < 8)]
    return x, left


def least_norm(a: np.ndarray, b: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Solution of least norm after the columns are given unit length; with a ridge, its solution."""
    if ridge:
        return np.linalg.solve(a + ridge * np.eye(len(a)), b)
    d = np.sqrt(np.maximum(np.diag(a), 0))
    d = np.where(d > 0, d, 1.0)
    return np.linalg.pinv(a / np.outer(d, d), rcond=1e-12, hermitian=True) @ (b / d) / d


def in_box(a: np.ndarray, b: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of x'ax/2 - b'x within a box.  Coordinates move in turn and the free ones are solved together, until
    every gradient points out of the box; a coordinate without curvature stays."""
    x = np.clip(x, low, high)
    curved = np.diag(a) > SMALL * max(float(np.diag(a).max(initial=0.0)), SMALL)
    for _ in range(200):
        before = x.copy()
        for k in np.flatnonzero(curved):
            x[k] = np.clip(x[k] - (a[k] @ x - b[k]) / a[k, k], low[k], high[k])
        free = np.flatnonzero(curved & (x > low) & (x < high))
        if len(free) > 1:
            held = np.setdiff1d(np.arange(len(x)), free)
            y = least_norm(a[np.ix_(free, free)], b[free] - a[np.ix_(free, held)] @ x[held])
            if (y >= low[free]).all() and (y <= high[free]).all():
                x[free] = y
        if np.abs(x - before).max(initial=0.0) <= 1e-14 * max(1.0, np.abs(x).max(initial=0.0)):
            break
    return x


# a condition's fit ---------------------------------------------------------------------------------
@dataclass
class Candidates:
    """Weights of a batch of candidates, one entry each."""

    weak: np.ndarray
    l1: np.ndarray
    group: np.ndarray
    ridge: np.ndarray

    def take(self, at: np.ndarray) -> Candidates:
        return Candidates(self.weak[at], self.l1[at], self.group[at], self.ridge[at])


class Fit:
    """One condition: products in frozen scales, and sweeps over a batch of candidates."""

    def __init__(self, s: Setting, labeled: Part, weak: Part, theta: np.ndarray, phi: tuple[float, float] = (0.0, 1.0)):
        self.s, self.frame, self.phi = s, Frame.of(s, labeled, weak, theta), phi
        self.p = len(s.shape) + 1
        self.labeled = labeled.raw(self.frame.shift, self.frame.scale)
        self.weak_part = weak
        self.weak = self._weak(weak)

    def _weak(self, weak: Part) -> np.ndarray:
        """Products of weak rows with their labels mapped by phi and in the scale of y."""
        f = self.frame
        intercept, slope = self.phi
        n = weak.mean.copy()
        co = weak.co.copy()
        n[-1] = intercept + slope * n[-1]
        co[-1, :-1] *= slope
        co[:-1, -1] *= slope
        co[-1, -1] *= slope * slope
        return Part(weak.n, n, co).raw(f.shift, f.scale)

    def relabel(self, mean: float, co: np.ndarray) -> None:
        """New weak labels by their mean and co-moments with [shape, themselves]."""
        m, c, p = self.weak_part.mean.copy(), self.weak_part.co.copy(), self.p - 1
        m[-1] = mean
        c[-1, :] = c[:, -1] = 0.0
        c[-1, :p] = c[:p, -1] = co[:p]
        c[-1, -1] = co[p]
        self.weak = self._weak(Part(self.weak_part.n, m, c))

    def start(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((m, self.s.h)), np.zeros((m, self.s.basis))

    def sweep(self, w: Candidates, g: np.ndarray, d: np.ndarray, theta: np.ndarray, fixed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """g, then d, then theta of every candidate; their objectives and the optimality residuals of the g block."""
        s, p, gl, gw = self.s, self.p, self.labeled, self.weak
        b, y = slice(p, p + s.basis), p + s.basis
        lift = self.frame.lift(theta)
        mixed = gl[:p, :p] + w.weak[:, None, None] * gw[:p, :p]
        q = np.einsum("mij,mil->mjl", lift, mixed @ lift)
        target = gl[:p, y] - d @ gl[b, :p] + w.weak[:, None] * gw[:p, y]
        c = np.einsum("mij,mi->mj", lift, target)
        g, residual = sparse_groups(q, c, g, w.l1, w.group, s.groups)
        own = np.einsum("mij,mj->mi", lift, g)
        if s.basis:
            right = gl[b, y] - own @ gl[:p, b]
            d = np.stack([least_norm(gl[b, b], right[k], float(w.ridge[k])) for k in range(len(g))])
        if s.parameters and not fixed:
            slopes = np.einsum("kij,mj->mki", self.frame.slopes, g)
            rest = gl[:p, y] - d @ gl[b, :p] + w.weak[:, None] * gw[:p, y] - np.einsum("mij,mj->mi", mixed, (self.frame.base @ g.T).T)
            a = np.einsum("mki,mij,mlj->mkl", slopes, mixed, slopes)
            right = np.einsum("mki,mi->mk", slopes, rest)
            theta = np.stack([in_box(a[k], right[k], theta[k], s.low, s.high) for k in range(len(g))])
        return g, d, theta, self.objective(w, g, d, theta), residual

    def errors(self, products: np.ndarray, g: np.ndarray, d: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Sum of squared errors over rows given by their products."""
        own = np.einsum("mij,mj->mi", self.frame.lift(theta), g)
        v = np.concatenate((own, d, -np.ones((len(g), 1))), axis=1)
        return np.maximum(np.einsum("mi,ij,mj->m", v, products, v), 0.0)

    def objective(self, w: Candidates, g: np.ndarray, d: np.ndarray, theta: np.ndarray) -> np.ndarray:
        norms = sum((np.linalg.norm(g[:, at], axis=1) for at in self.s.groups), np.zeros(len(g)))
        loss = self.errors(self.labeled, g, d, theta) + w.weak * self.errors(self.weak, g, np.zeros_like(d), theta)
        return 0.5 * loss + w.l1 * np.abs(g).sum(axis=1) + w.group * norms + 0.5 * w.ridge * (d * d).sum(axis=1)

    def validation(self, part: Part, g: np.ndarray, d: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Mean squared error over a part, in the units of y."""
        if not part.n:
            return np.full(len(g), np.nan)
        return self.errors(part.raw(self.frame.shift, self.frame.scale), g, d, theta) * self.frame.y_scale**2 / part.n

    def plain(self, g: np.ndarray, d: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Coefficients of [1, shape, basis] in the units of the rows, by which rows are scored."""
        f, p = self.frame, self.p
        own = np.einsum("mij,mj->mi", f.lift(theta), g)
        basis = d / f.scale[p - 1 : -1]
        constant = own[:, 0] - own[:, 1:] @ f.shift[: p - 1] - basis @ f.shift[p - 1 : -1]
        return np.concatenate(((f.y_mean + f.y_scale * constant)[:, None], f.y_scale * own[:, 1:], f.y_scale * basis), axis=1)


@dataclass
class Rule:
    """When sweeps end: both changes below their tolerance and the g block solved."""

    sweeps: int = 60
    objective: float = 1e-6
    change: float = 1e-3
    residual: float = 1e-8

    def met(self, value: np.ndarray, before: np.ndarray, new: np.ndarray, old: np.ndarray, residual: np.ndarray) -> np.ndarray:
        moved = np.linalg.norm(new - old, axis=1) / np.maximum(1.0, np.linalg.norm(old, axis=1))
        return (np.abs(value - before) < self.objective * np.maximum(1.0, np.abs(before))) & (moved < self.change) & (residual < self.residual)


def descend(fit: Fit, w: Candidates, g: np.ndarray, d: np.ndarray, theta: np.ndarray, fixed: bool, rule: Rule) -> dict[str, Any]:
    """Sweeps of a batch of candidates, each until the rule is met."""
    m = len(w.weak)
    value, residual, converged, sweeps = np.full(m, np.inf), np.zeros(m), np.zeros(m, bool), np.zeros(m, int)
    history: list[list[float]] = [[] for _ in range(m)]
    going = np.arange(m)
    for _ in range(rule.sweeps):
        if not len(going):
            break
        old = np.concatenate((g[going], d[going], theta[going]), axis=1)
        g[going], d[going], theta[going], new_value, residual[going] = fit.sweep(w.take(going), g[going], d[going], theta[going], fixed)
        new = np.concatenate((g[going], d[going], theta[going]), axis=1)
        with np.errstate(invalid="ignore"):
            done = rule.met(new_value, value[going], new, old, residual[going])
        value[going], sweeps[going], converged[going] = new_value, sweeps[going] + 1, done
        for k in going:
            history[k].append(float(value[k]))
        going = going[~done & np.isfinite(new_value)]
    return {"g": g, "d": d, "theta": theta, "objective": value, "residual": residual, "converged": converged, "sweeps": sweeps, "history": history}


def random_starts(key: str, n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """n vectors within the box, the same for the same key."""
    rng = np.random.default_rng(zlib.crc32(key.encode()))
    return low + (high - low) * rng.random((n, len(low)))


FIT = (
    "start int, weak_weight double, l1 double, group_weight double, ridge double, theta0 array<double>, g array<double>, d array<double>, theta array<double>, coef array<double>, "
    "objective double, residual double, sweeps int, converged boolean, history array<double>, validation_mse double, status string"
)


def fit_conditions(
    conditions: DataFrame, keep: list[str], library: ColumnLibrary, box: dict[str, tuple[float, float]], weak: list[float], l1: list[float], group: list[float], ridge: float = 1e-3,
    starts: int = 1, fixed: bool = False, scaled: bool = True, relative: bool = False, pooled: bool = False, rule: Rule | None = None,
) -> DataFrame:
    """All candidates weak x l1 x group x starts of every condition; `pooled` (for a refit) fits labeled and validation rows together.

    conditions: the keys `keep` and the moments structs labeled, weak and validation over [shape, basis, y]; optional: theta0
    (array, the calibrated start; without it the middle of the box), phi (array of intercept and slope of the labels' mapping), warm_g and
    warm_d (arrays, where a refit begins), chosen (array of weak, l1 and group weight: this candidate alone).  Start 0 is theta0, the others are drawn within the box by the condition's key.  With
    `relative`, weak weights are times the labeled rows over the weak ones.

    The candidates of a condition and weak weight are one task row: from the heaviest l1 weight down, all group weights and
    starts together, each begun where its heavier neighbour ended (g and d; theta begins at its own start).  `coef` are the
    coefficients of [1, shape, basis] in the rows' units.  A fit that fails has a status instead of raising."""
    s, rule = Setting.of(library, box, scaled), rule or Rule()
    penalties, shares = sorted(l1, reverse=True), list(group)
    have = set(conditions.columns)
    spread = conditions.withColumn("_weak", F.element_at("chosen", 1) if "chosen" in have else F.explode(F.array(*[F.lit(float(x)) for x in weak])))
    parallel = 4 * conditions.sparkSession.sparkContext.defaultParallelism
    spread = spread.select(*keep, "_weak", "labeled", "weak", "validation", *[c for c in ("theta0", "phi", "warm_g", "warm_d", "chosen") if c in have]).repartition(parallel, *keep, "_weak")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in spread.schema if f.name in keep]

    def of_row(r: dict) -> Iterator[dict]:
        key = {k: r[k] for k in keep}
        heavy, group = ([float(r["chosen"][1])], [float(r["chosen"][2])]) if r.get("chosen") is not None else (penalties, shares)
        labeled, far, held = (Part.of(r[c], s.columns) for c in ("labeled", "weak", "validation"))
        if pooled:
            labeled, held = labeled + held, Part.of(None, s.columns)
        given = r.get("theta0")
        first = np.clip(np.asarray(given, float), s.low, s.high) if given is not None else (s.low + s.high) / 2
        share = labeled.n / far.n if relative and far.n else 1.0
        level = [(x, k) for x in group for k in range(starts)]
        m = len(level)
        begin = np.concatenate((first[None], random_starts("|".join(str(key[k]) for k in keep), starts - 1, s.low, s.high)))
        w0 = r["_weak"] * share
        try:
            # each start has its own scales, since theta columns are scaled at the first theta
            fits = [Fit(s, labeled, far, t, tuple(r["phi"]) if r.get("phi") is not None else (0.0, 1.0)) for t in begin]
            state = {k: f.start(len(group)) for k, f in enumerate(fits)}
            if r.get("warm_g") is not None:
                state = {k: (np.tile(np.asarray(r["warm_g"], float), (len(group), 1)), np.tile(np.asarray(r["warm_d"], float), (len(group), 1))) for k in state}
            for x in heavy:
                for k, f in enumerate(fits):
                    n = len(group)
                    w = Candidates(np.full(n, w0), np.full(n, float(x)), np.asarray(group, float), np.full(n, ridge))
                    out = descend(f, w, *(a.copy() for a in state[k]), np.tile(begin[k], (n, 1)), fixed, rule)
                    state[k] = (out["g"], out["d"])
                    loss = f.validation(held, out["g"], out["d"], out["theta"])
                    coef = f.plain(out["g"], out["d"], out["theta"])
                    for i in range(n):
                        good = np.isfinite(out["objective"][i])
                        yield {
                            **key, "start": k, "weak_weight": r["_weak"], "l1": float(x), "group_weight": float(group[i]), "ridge": ridge, "theta0": begin[k].tolist(),
                            "g": out["g"][i].tolist(), "d": out["d"][i].tolist(), "theta": out["theta"][i].tolist(), "coef": coef[i].tolist(), "objective": float(out["objective"][i]),
                            "residual": float(out["residual"][i]), "sweeps": int(out["sweeps"][i]), "converged": bool(out["converged"][i] and good), "history": out["history"][i],
                            "validation_mse": float(loss[i]) if np.isfinite(loss[i]) else None, "status": "ok" if good else "not finite",
                        }
        except np.linalg.LinAlgError as e:
            for x in heavy:
                for v, k in level[:m]:
                    none = dict.fromkeys(["g", "d", "theta", "coef", "objective", "residual", "history", "validation_mse"])
                    yield {**key, "start": k, "weak_weight": r["_weak"], "l1": float(x), "group_weight": float(v), "ridge": ridge, "theta0": begin[k].tolist(), **none, "sweeps": 0, "converged": False, "status": str(e)}

    names = [*[k.split()[0] for k in kinds], *[f.strip().split()[0] for f in FIT.split(", ")]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [x for r in pdf.to_dict("records") for x in of_row(r)]
            yield pd.DataFrame(rows, columns=names)

    return spread.mapInPandas(run, ", ".join([*kinds, FIT]))


# which candidates count ----------------------------------------------------------------------------
def valid(limit: float = float("inf")) -> Column:
    """The one meaning of a valid candidate: solved, converged, with a finite validation error up to the limit."""
    mse = F.abs("validation_mse")
    return F.coalesce((F.col("status") == "ok") & F.col("converged") & (mse < float("inf")) & (mse <= limit), F.lit(False))


def select(fits: DataFrame, g: list[str], limit: float = float("inf")) -> DataFrame:
    """For every condition the valid candidate of least validation error (ties: lighter weights, earlier start), how many
    candidates it had and how many were valid; a condition without a valid one stays, with nulls."""
    order = F.struct("validation_mse", "weak_weight", "l1", "group_weight", "start")
    rest = [c for c in fits.columns if c not in g]
    best = F.min_by(F.when(valid(limit), F.struct(*rest)), F.when(valid(limit), order))
    return fits.groupBy(*g).agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(valid(limit)).alias("n_valid"), best.alias("b")).select(*g, "n_candidates", "n_valid", "b.*")


def score(df: DataFrame, models: DataFrame, g: list[str], library: ColumnLibrary, name: str = "pred") -> DataFrame:
    """Predictions by `coef`; df holds the library's columns by name.  The models' other columns come along."""
    columns = [*library.shape, *library.basis]
    total = F.element_at("coef", 1)
    for k, c in enumerate(columns):
        total = total + F.element_at("coef", k + 2) * F.col(c)
    return df.join(models, g).withColumn(name, total).drop("coef")


# calibration in a box ------------------------------------------------------------------------------
def calibrate_box(df: DataFrame, g: list[str], y: str, score: Callable[[dict[str, Column]], Column], box: dict[str, tuple[float, float]], points: int = 9, rounds: int = 3) -> DataFrame:
    """Parameters in a box with the least mean squared error of score(parameters), by full grids of points^parameters that
    narrow to two steps about the best each round.  The rows are read once a round, each group sends one row of sums a task;
    a loss that isn't finite counts as 1e30, ties go to the first point."""
    names = list(box)
    if points ** len(names) > 1000:
        raise ValueError(f"{points ** len(names)} points a round; use fewer for {len(names)} parameters")
    grid = np.stack(np.meshgrid(*[np.arange(points)] * len(names), indexing="ij"), axis=-1).reshape(-1, len(names))
    bounds: DataFrame | None = None
    out = df
    for _ in range(rounds):
        rows = df if bounds is None else df.join(bounds, g)
        low = {p: F.lit(float(box[p][0])) if bounds is None else F.col(f"_low_{p}") for p in names}
        step = {p: F.lit((box[p][1] - box[p][0]) / (points - 1)) if bounds is None else F.col(f"_step_{p}") for p in names}
        losses = []
        for at in grid.tolist():
            e = F.col(y) - score({p: low[p] + step[p] * F.lit(float(k)) for p, k in zip(names, at, strict=True)})
            losses.append(F.avg(e * e))
        held = [F.first(c).alias(f"{n}{p}") for n, of in (("_l_", low), ("_s_", step)) for p, c in of.items()]
        sums = rows.groupBy(*g).agg(F.array(*losses).alias("_losses"), *held)
        safe = F.transform("_losses", lambda v: F.when(F.isnan(v) | (v >= float("inf")) | v.isNull(), 1e30).otherwise(v))
        sums = sums.withColumn("_losses", safe).withColumn("loss", F.array_min("_losses")).withColumn("_at", F.array_position("_losses", F.col("loss")).cast("int") - 1)
        place = {p: F.floor(F.col("_at") / F.lit(points ** (len(names) - 1 - k))) % points for k, p in enumerate(names)}
        out = sums.select(*g, "loss", *[(F.col(f"_l_{p}") + F.col(f"_s_{p}") * place[p]).alias(p) for p in names], *[F.col(f"_s_{p}") for p in names])
        new = [(F.greatest(F.lit(float(box[p][0])), F.col(p) - F.col(f"_s_{p}")), F.least(F.lit(float(box[p][1])), F.col(p) + F.col(f"_s_{p}"))) for p in names]
        bounds = out.select(*g, *[c for p, (lo, hi) in zip(names, new, strict=True) for c in (lo.alias(f"_low_{p}"), ((hi - lo) / (points - 1)).alias(f"_step_{p}"))])
    return out.select(*g, *names, "loss")


# labels scored anew --------------------------------------------------------------------------------
STATE = "g array<double>, d array<double>, theta array<double>, objective double, residual double, sweeps int, converged boolean, history array<double>, drift array<double>, coef array<double>"


PARTS = 64


def refresh_fits(
    conditions: DataFrame, weak_rows: DataFrame, keep: list[str], join_on: list[str], library: ColumnLibrary, box: dict[str, tuple[float, float]],
    reference: Callable[[dict[str, Column]], Column], weak_weight: float, l1: float = 0.0, group: float = 0.0, ridge: float = 1e-3, scaled: bool = True, rule: Rule | None = None,
) -> DataFrame:
    """One fit for each condition whose weak labels are reference(theta) at the current theta, whatever its form.

    conditions: keys `keep`, moments labeled and weak (with the first weak labels as y), theta0 and optionally phi.
    weak_rows: the keys `join_on` (a part of keep), the library's shape columns by name, what the reference needs, and y.

    A sweep joins the conditions that still move to the weak rows, whose reference is aggregated to its mean and co-moments, and takes
    one step of g, d and theta; conditions that meet the rule stop and are not joined again.  Weak rows are written once, in PARTS
    folders by key, and a sweep reads only the folders of conditions that move.  `drift` is the largest change of a weak
    label (in the scale of y), by sweep."""
    spark = conditions.sparkSession
    s, rule, shape = Setting.of(library, box, scaled), rule or Rule(), list(library.shape)
    p, names = len(shape), list(library.parameters())
    part = F.pmod(F.xxhash64(*join_on), F.lit(PARTS)).cast("int").alias("_part")
    rows_path = scratch(spark, "weak-rows")
    weak_rows.withColumn("_part", part).write.partitionBy("_part").parquet(rows_path)
    rows = spark.read.parquet(rows_path)
    have = set(conditions.columns)
    inputs = [*keep, "labeled", "weak", "theta0", *(["phi"] if "phi" in have else [])]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in conditions.select(*inputs).schema]
    empty = [f.strip().split(" ", 1) for f in STATE.split(", ")]
    first = conditions.select(*inputs, *[F.lit(None).cast(t).alias(n) for n, t in empty if n not in ("theta", "sweeps", "converged")], F.col("theta0").alias("theta"), F.lit(0).alias("sweeps"), F.lit(False).alias("converged"), F.lit(None).cast("array<double>").alias("scored"))
    schema = ", ".join([*kinds, STATE, "scored array<double>"])
    order = [*inputs, *[n for n, _ in empty], "scored"]

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([one(r) for r in pdf.to_dict("records")], columns=order)

    def one(r: dict) -> dict:
        labeled, weak = Part.of(r["labeled"], s.columns), Part.of(r["weak"], s.columns)
        fit = Fit(s, labeled, weak, np.asarray(r["theta0"], float), tuple(r["phi"]) if r.get("phi") is not None else (0.0, 1.0))
        if r["_n"] and r["_n"] > 0:
            fit.relabel(float(r["_mean"]), np.asarray(r["_co"], float))
        w = Candidates(np.array([weak_weight]), np.array([l1]), np.array([group]), np.array([ridge]))
        g0, d0 = fit.start(1) if r["g"] is None else (np.asarray(r["g"], float)[None], np.asarray(r["d"], float)[None])
        theta0 = np.asarray(r["theta"], float)[None]
        g, d, theta, value, residual = fit.sweep(w, g0.copy(), d0.copy(), theta0.copy(), False)
        past = list(r["history"]) if r["history"] is not None else []
        old, new = np.concatenate((g0, d0, theta0), axis=1), np.concatenate((g, d, theta), axis=1)
        with np.errstate(invalid="ignore"):
            done = rule.met(value, np.array([past[-1] if past else np.inf]), new, old, residual)[0]
        moved = (float(r["_drift"]) if r["_n"] and r["_n"] > 0 else 0.0) * abs(fit.phi[1]) / fit.frame.y_scale
        return {
            **{k: r[k] for k in inputs}, "g": g[0].tolist(), "d": d[0].tolist(), "theta": theta[0].tolist(), "objective": float(value[0]), "residual": float(residual[0]), "sweeps": int(r["sweeps"]) + 1,
            "converged": bool(done), "history": [*past, float(value[0])], "drift": [*(list(r["drift"]) if r["drift"] is not None else []), moved], "coef": fit.plain(g, d, theta)[0].tolist(), "scored": theta0[0].tolist(),
        }

    state, path = written(first, "fits")
    value = lambda c: {n: F.element_at(c, k + 1) for k, n in enumerate(names)}
    x = [F.col(c).cast("double") for c in shape]
    for _ in range(rule.sweeps):
        moving = state.where("not converged")
        folders = [r[0] for r in moving.select(part).distinct().collect()]  # at most PARTS numbers
        if not folders:
            break
        own = moving.select(*keep, F.col("theta").alias("_theta"), F.col("scored").alias("_before"))
        now = reference(value("_theta"))
        seen = rows.where(F.col("_part").isin(folders)).join(own, join_on).withColumn("_label", now)
        seen = seen.withColumn("_old", F.when(F.col("_before").isNull(), F.col("y")).otherwise(reference(value("_before"))))
        n = F.count(F.lit(1))
        fresh = seen.groupBy(*keep).agg(
            n.alias("_n"), F.avg("_label").alias("_mean"), F.array(*[F.covar_pop(c, F.col("_label")) * n for c in x], F.var_pop("_label") * n).alias("_co"), F.max(F.abs(F.col("_label") - F.col("_old"))).alias("_drift")
        )
        stepped = moving.join(fresh, keep, "left").mapInPandas(step, schema)
        state, new_path = written(stepped.unionByName(state.where("converged").select(*order)), "fits")
        forget(spark, path)
        path = new_path
    forget(spark, rows_path)
    return state.select(*keep, *[n for n, _ in empty])


# after the search ----------------------------------------------------------------------------------
def choose_refit(trained: DataFrame, refitted: DataFrame, g: list[str]) -> DataFrame:
    """The refit of each condition where it converged or its objective stagnates, else the selected fit on train rows; `source` says
    which, `converged` whether the one taken did.  A condition without a selected fit has nulls, false and source `none`."""
    last5 = F.slice("history", -5, 5)
    spread = (F.array_max(last5) - F.array_min(last5)) / F.greatest(F.lit(1.0), F.abs(F.aggregate(last5, F.lit(0.0), lambda a, x: a + x) / F.size(last5)))
    own = ["g", "d", "theta", "coef", "converged"]
    r = refitted.select(*g, F.struct(*own).alias("refit"), ((F.size("history") >= 5) & (spread < 1e-4)).alias("stagnant"), F.col("status").alias("refit_status"))
    j = trained.select(*g, F.when(F.col("coef").isNotNull(), F.struct(*own)).alias("train")).join(r, g, "left")
    ok, done = F.col("refit_status") == "ok", F.col("refit.converged")
    take = F.col("train").isNotNull() & F.coalesce(ok & (done | F.col("stagnant")), F.lit(False))
    source = F.when(take & done, "refit").when(take, "refit, stagnant").when(F.col("train").isNotNull(), "train only").otherwise("none")
    out = j.select(*g, F.when(take, F.col("refit")).otherwise(F.col("train")).alias("m"), source.alias("source")).select(*g, "m.*", "source")
    return out.withColumn("converged", F.coalesce("converged", F.lit(False)))


def diagnose(fits: DataFrame, keep: list[str], library: ColumnLibrary, box: dict[str, tuple[float, float]]) -> DataFrame:
    """Diagnostics of fits that carry `coef`, `g`, `theta`, `validation_mse` and the moments labeled, weak and test.

    R-squared of the weak labels by the shape part alone and of the labeled rows (null where labels don't vary), norms of both
    parts over the test rows, root mean square of the test residuals, validation less labeled error, norms of g by penalty group, and
    whether a parameter is within 1e-3 of the box's width from an end."""
    s = Setting.of(library, box)
    p, size = len(s.shape), s.columns
    groups = list(library.groups)

    def work(r: dict) -> dict:
        zero, one = np.zeros(size), np.ones(size)
        labeled, weak, test = (Part.of(r[c], size) for c in ("labeled", "weak", "test"))
        coef = np.asarray(r["coef"], float)
        own, rest = coef.copy(), np.zeros_like(coef)
        own[p + 1 :], rest[p + 1 :] = 0.0, coef[p + 1 :]
        error = lambda part, a: float(max(np.append(a, -1.0) @ part.raw(zero, one) @ np.append(a, -1.0), 0.0))
        r2 = lambda part, a: 1 - error(part, a) / part.co[-1, -1] if part.n and part.co[-1, -1] > 0 else None
        norm = lambda a: float(np.sqrt(max(a @ test.raw(zero, one)[:-1, :-1] @ a, 0.0)))
        theta = np.asarray(r["theta"], float)
        edge = np.minimum(theta - s.low, s.high - theta) < 1e-3 * (s.high - s.low)
        g = np.asarray(r["g"], float)
        gap = r["validation_mse"] - error(labeled, coef) / labeled.n if r["validation_mse"] is not None and labeled.n else None
        return {
            "weak_r2": r2(weak, own), "train_r2": r2(labeled, coef), "shape_norm": norm(own), "basis_norm": norm(rest), "residual": float(np.sqrt(error(test, coef) / test.n)) if test.n else None,
            "validation_gap": gap, **{f"g_norm_{n}": float(np.linalg.norm(g[at])) for n, at in zip(groups, s.groups, strict=True)}, "at_bound": bool(edge.any()),
        }

    schema = ["weak_r2 double", "train_r2 double", "shape_norm double", "basis_norm double", "residual double", "validation_gap double", *[f"g_norm_{n} double" for n in groups], "at_bound boolean"]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in fits.schema if f.name in keep]
    names = [k.split()[0] for k in [*kinds, *schema]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([{**{k: r[k] for k in keep}, **work(r)} for r in pdf.to_dict("records")], columns=names)

    return fits.where("coef is not null").select(*keep, "coef", "g", "theta", "validation_mse", "labeled", "weak", "test").mapInPandas(run, ", ".join([*kinds, *schema]))


def selection_audit(candidates: DataFrame, chosen: DataFrame, condition: list[str], weights: list[str], g: list[str], box: tuple[float, float]) -> DataFrame:
    """By group g of conditions: how many have a choice, the mean chosen weights, the rate of first parameters within 1e-3 of the box's
    ends, mean and largest excess of the chosen validation mse over the condition's least, the share of all conditions with
    a choice (those without one count as not converged) and the share of invalid candidates.

    chosen: g and weights; a condition takes the valid candidate with the weights of its group, the best of its starts."""
    least = candidates.groupBy(*condition).agg(F.min(F.when(valid(), F.col("validation_mse"))).alias("least"), F.count(F.lit(1)).alias("tried"), F.count_if(~valid()).alias("invalid"))
    own = candidates.where(valid()).join(chosen.select(*g, *weights), [*g, *weights]).groupBy(*condition).agg(F.min_by(F.struct("validation_mse", F.element_at("theta", 1).alias("theta"), *[F.col(w).alias(f"_{w}") for w in weights]), F.struct("validation_mse", "start")).alias("b"))
    gap, theta = F.col("b.validation_mse") - F.col("least"), F.col("b.theta")
    edge = (F.abs(theta - box[0]) < 1e-3) | (F.abs(theta - box[1]) < 1e-3)
    return least.join(own, condition, "left").groupBy(*g).agg(
        F.count("b").alias("n"), *[F.avg(f"b._{w}").alias(f"mean_{w}") for w in weights], F.avg(edge.cast("double")).alias("boundary_rate"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"),
        F.avg(F.col("b").isNotNull().cast("double")).alias("convergence_rate"), (F.sum("invalid") / F.sum("tried")).alias("invalid_share"),
    )


BLOCK_ROWS = 1 << 17


def row_errors(rows: DataFrame, fits: DataFrame, condition: list[str], candidate: list[str], library: ColumnLibrary) -> DataFrame:
    """condition, candidate, n, mse and deviation (sample) of the squared errors of every candidate over the rows of its condition.

    The rows of a condition are cut into parts of about BLOCK_ROWS; each part meets the condition's candidates as one matrix, and
    sends two sums a candidate.  rows: condition, the library's columns and y; fits: condition, candidate, coef."""
    columns = [*library.shape, *library.basis]
    parts = rows.groupBy(*condition).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_parts"))
    own = rows.select(*condition, *columns, "y").join(parts, condition).withColumn("_part", F.pmod(F.xxhash64(*columns, "y"), F.col("_parts")).cast("int")).drop("_parts")
    tried = fits.where("coef is not null").select(*condition, *candidate, "coef").join(parts, condition).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in fits.select(*condition, *candidate).schema]

    def work(data: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        coef = np.stack(models["coef"].to_list()) if len(models) else np.zeros((0, len(columns) + 1))
        e2 = (data["y"].to_numpy()[:, None] - coef[:, 0] - data[columns].to_numpy(float) @ coef[:, 1:].T) ** 2
        return models[[*condition, *candidate]].assign(n=len(data), s2=e2.sum(axis=0), s4=(e2 * e2).sum(axis=0)) if len(data) else models[[*condition, *candidate]].assign(n=0, s2=0.0, s4=0.0)

    key = [*condition, "_part"]
    sums = own.groupBy(*key).cogroup(tried.groupBy(*key)).applyInPandas(work, ", ".join([*kinds, "n long, s2 double, s4 double"]))
    total = sums.groupBy(*condition, *candidate).agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s4").alias("s4")).where("n > 0")
    mse = F.col("s2") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("s4") - F.col("n") * mse * mse, F.lit(0.0)) / (F.col("n") - 1))
    return total.select(*condition, *candidate, "n", mse.alias("mse"), F.when(F.col("n") > 1, spread).otherwise(0.0).alias("deviation"))


# ridge baseline ------------------------------------------------------------------------------------
def ridge(part: Part, alpha: float) -> np.ndarray:
    """[1, columns] coefficients of y on columns scaled by their own statistics; the intercept isn't penalized."""
    x, y = part.co[:-1, :-1], part.co[:-1, -1]
    scale = np.sqrt(np.diag(x) / max(part.n, 1))
    scale = np.where(scale < SMALL, 1.0, scale)
    z = x / np.outer(scale, scale)
    b = least_norm(z, y / scale, alpha) / scale
    return np.concatenate(([part.mean[-1] - part.mean[:-1] @ b], b))


def ridge_search(conditions: DataFrame, keep: list[str], alphas: list[float]) -> DataFrame:
    """For every condition (moments labeled and validation over [columns, y]) the alpha of least validation error (ties: the first), that error, and the
    coefficients fitted anew to both parts."""
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in conditions.schema if f.name in keep]
    names = [*[k.split()[0] for k in kinds], "alpha", "validation_mse", "coef"]

    def work(r: dict) -> dict:
        size = len(r["labeled"]["mean"])
        labeled, held = (Part.of(r[c], size) for c in ("labeled", "validation"))
        products = held.raw(np.zeros(size), np.ones(size))
        losses = []
        for a in alphas:
            e = np.append(ridge(labeled, a), -1.0)
            losses.append(float(max(e @ products @ e, 0.0)) / held.n if held.n else 0.0)
        best = int(np.argmin(losses))
        return {**{k: r[k] for k in keep}, "alpha": float(alphas[best]), "validation_mse": losses[best] if held.n else None, "coef": ridge(labeled + held, alphas[best]).tolist()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([work(r) for r in pdf.to_dict("records")], columns=names)

    rows = conditions.where("labeled is not null").select(*keep, "labeled", "validation")
    return rows.mapInPandas(run, ", ".join([*kinds, "alpha double, validation_mse double, coef array<double>"]))
