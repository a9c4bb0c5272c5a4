"""Weakly supervised fits against the same steps on rows, subgradient conditions and dense grids."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.registry import ColumnLibrary
from plumbline.operators import weakfit as W
from plumbline.plans.tables import rod_temperature

TWO = ColumnLibrary(
    "two", {"one": lambda: F.lit(1.0), "a": lambda: F.col("a"), "b": lambda: F.col("b")}, {"s": ("a",), "t": ("b", "one")}, {"z": lambda: F.col("z")},
    {"a": ("a", "s_a"), "b": ("b", "t_b", "t_one")},
)
BOX = {"s": (0.5, 2.0), "t": (-1.0, 1.0)}


def part(x):
    m = x.mean(axis=0)
    return W.Part(len(x), m, (x - m).T @ (x - m))


def rows(n, seed, far=0.0, noise=0.1):
    rng = np.random.default_rng(seed)
    a, b, z = rng.normal(far, 1, n), rng.normal(0, 2, n) + 1, rng.normal(size=n)
    y = 3 + 1.3 * a - 0.4 * b + 0.5 * z + noise * rng.normal(size=n)
    return np.column_stack((np.ones(n), a, b, z, y))


class OnRows:
    """The same model on rows, with columns scaled by their own statistics and a slow proximal method."""

    def __init__(self, labeled, weak, theta, scaled=True):
        self.scaled, self.l, self.w = scaled, labeled, weak
        h = self.raw(np.concatenate((labeled, weak)), theta)
        self.hm, self.hs = h.mean(axis=0), h.std(axis=0)
        self.hs[self.hs < 1e-12] = 1.0
        self.hm[0], self.hs[0] = 0.0, 1.0
        self.bm, self.bs = labeled[:, 3].mean(), labeled[:, 3].std()
        self.ym, self.ys = labeled[:, -1].mean(), labeled[:, -1].std()
        if not scaled:
            self.hm, self.hs, self.bm, self.bs, self.ym, self.ys = 0 * self.hm, 0 * self.hs + 1, 0.0, 1.0, 0.0, 1.0

    @staticmethod
    def raw(x, t):
        one, a, b = x[:, 0], x[:, 1], x[:, 2]
        return np.column_stack((one, a, b, t[0] * a, t[1] * b, t[1] * one))

    def h(self, x, t):
        return (self.raw(x, t) - self.hm) / self.hs

    def b(self, x):
        return ((x[:, 3] - self.bm) / self.bs)[:, None]

    def y(self, x):
        return (x[:, -1] - self.ym) / self.ys

    def sweep(self, g, d, t, weak, l1, group, ridge, box, groups):
        hl, hw, b = self.h(self.l, t), self.h(self.w, t), self.b(self.l)
        q, c = hl.T @ hl + weak * hw.T @ hw, hl.T @ (self.y(self.l) - b @ d) + weak * hw.T @ self.y(self.w)
        size = np.linalg.eigvalsh(q)[-1]
        if l1 or group:
            x, z, k = g.copy(), g.copy(), 1.0
            for _ in range(60_000):
                v = z - (q @ z - c) / size
                v = np.sign(v) * np.maximum(abs(v) - l1 / size, 0)
                for at in groups:
                    n = np.linalg.norm(v[at])
                    v[at] *= max(1 - group / size / n, 0) if n else 0
                k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
                if (z - v) @ (v - x) > 0:
                    k2, k = 1.0, 1.0
                z, x, k = v + (k - 1) / k2 * (v - x), v, k2
            g = x
        else:
            g = np.linalg.lstsq(np.concatenate((hl, np.sqrt(weak) * hw)), np.concatenate((self.y(self.l) - b @ d, np.sqrt(weak) * self.y(self.w))), rcond=1e-10)[0]
        d = np.linalg.solve(b.T @ b + ridge * np.eye(1), b.T @ (self.y(self.l) - hl @ g))
        zero = np.zeros(2)
        base_l, base_w = self.h(self.l, zero) @ g, self.h(self.w, zero) @ g
        dl = np.column_stack([self.h(self.l, u) @ g - base_l for u in np.eye(2)])
        dw = np.column_stack([self.h(self.w, u) @ g - base_w for u in np.eye(2)])
        a = dl.T @ dl + weak * dw.T @ dw
        r = dl.T @ (self.y(self.l) - b @ d - base_l) + weak * dw.T @ (self.y(self.w) - base_w)
        for _ in range(20_000):
            for k in range(2):
                if a[k, k] > 1e-12:
                    t = t.copy()
                    t[k] = np.clip(t[k] + (r[k] - a[k] @ t) / a[k, k], *box[k])
        return g, d, t

    def value(self, g, d, t, weak, l1, group, ridge, groups):
        e, f = self.y(self.l) - self.h(self.l, t) @ g - self.b(self.l) @ d, self.y(self.w) - self.h(self.w, t) @ g
        return 0.5 * e @ e + 0.5 * weak * f @ f + l1 * abs(g).sum() + group * sum(np.linalg.norm(g[at]) for at in groups) + 0.5 * ridge * d @ d


GROUPS = [[1, 3], [2, 4, 5]]


def one(weak, l1, group, ridge=0.1):
    return W.Candidates(*(np.array([v], float) for v in (weak, l1, group, ridge)))


@pytest.mark.parametrize(("l1", "group"), [(0.3, 0.0), (0.0, 0.8), (0.5, 1.5), (4.0, 2.0)])
def test_sweeps_equal_those_on_rows(l1, group):
    labeled, weak = rows(40, 1), rows(200, 2)
    weak[:, -1] = 2 + 1.1 * weak[:, 1] - 0.2 * weak[:, 2]
    t = np.array([0.9, 0.3])
    s = W.Setting.of(TWO, BOX)
    assert s.groups == GROUPS
    fit, slow = W.Fit(s, part(labeled), part(weak), t), OnRows(labeled, weak, t)
    g, d = fit.start(1)
    theta, own = t[None].copy(), (np.zeros(6), np.zeros(1), t)
    for _ in range(3):
        g, d, theta, value, residual = fit.sweep(one(0.2, l1, group), g, d, theta, False)
        own = slow.sweep(*own, 0.2, l1, group, 0.1, list(BOX.values()), GROUPS)
        assert residual[0] < 1e-9
        assert abs(value[0] - slow.value(*own, 0.2, l1, group, 0.1, GROUPS)) < 1e-7 * max(1, value[0])
        pred = fit.plain(g, d, theta)[0]
        rows_pred = slow.ym + slow.ys * (slow.h(weak, own[2]) @ own[0] + slow.b(weak) @ own[1])
        assert np.abs(pred[0] + weak[:, :4] @ pred[1:] - rows_pred).max() < 2e-4
        assert np.abs(theta[0] - own[2]).max() < 2e-3


def test_without_penalties_the_fit_is_least_squares():
    """With and without scaling.  Scaled basis columns are centred, which weak rows, that see H alone, tell apart."""
    labeled, weak, t = rows(60, 3), rows(300, 4), np.array([1.5, -0.4])
    for scaled in (True, False):
        fit = W.Fit(W.Setting.of(TWO, BOX, scaled), part(labeled), part(weak), t)
        out = W.descend(fit, one(0.3, 0, 0, 0.0), *fit.start(1), t[None].copy(), False, W.Rule(sweeps=400, objective=1e-15, change=1e-9))
        z = labeled[:, 3].mean() if scaled else 0.0
        x = np.concatenate((labeled[:, :4] - [0, 0, 0, z], np.sqrt(0.3) * weak[:, :4] * [1, 1, 1, 0]))
        b = np.linalg.lstsq(x, np.concatenate((labeled[:, -1], np.sqrt(0.3) * weak[:, -1])))[0]
        coef = fit.plain(out["g"], out["d"], out["theta"])[0]
        assert np.abs(np.append(coef[0] + coef[1], coef[2:]) - [b[0] - b[3] * z, *b[1:]]).max() < 1e-6


@pytest.mark.parametrize("seed", range(6))
def test_optimum_meets_the_subgradient_conditions(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, 9))
    x[:, 8] = x[:, 0] + 1e-3 * x[:, 8]
    x[:, 7] = x[:, 1]  # the same column twice
    groups, n = [[0, 1, 2], [3, 4], [5, 6, 7]], 40
    q, c = np.repeat((x.T @ x)[None], n, axis=0), np.repeat((x.T @ rng.normal(size=30) * 3)[None], n, axis=0)
    l1, group = np.tile(np.geomspace(1e-3, 30, 8), 5), np.repeat([0.0, 0.1, 1.0, 5.0, 50.0], 8)
    sol, left = W.sparse_groups(q, c, np.zeros((n, 9)), l1, group, groups)
    assert left.max() < 1e-8
    for k in range(n):
        grad, v = q[k] @ sol[k] - c[k], sol[k]
        unit = abs(c[k]).max()
        for at in [*groups, [8]]:
            weight = group[k] if at != [8] else 0.0
            norm = np.linalg.norm(v[at])
            if norm:
                pull = grad[at] + weight * v[at] / norm
                on = v[at] != 0
                assert np.abs(pull + l1[k] * np.sign(v[at]))[on].max() < 1e-7 * unit
                assert (np.abs(pull[~on]) <= l1[k] + 1e-7 * unit).all()
            else:
                assert np.linalg.norm(np.maximum(np.abs(grad[at]) - l1[k], 0)) <= weight + 1e-7 * unit


def test_box_against_a_dense_grid():
    rng = np.random.default_rng(5)
    hit = set()
    for _ in range(60):
        m = rng.normal(size=(6, 2))
        a, b = m.T @ m, rng.normal(size=2) * 3
        low, high = np.array([-0.5, -0.7]), np.array([0.6, 0.4])
        x = W.in_box(a, b, np.zeros(2), low, high)
        u = np.stack(np.meshgrid(np.linspace(low[0], high[0], 201), np.linspace(low[1], high[1], 201)), axis=-1).reshape(-1, 2)
        best = (0.5 * np.einsum("ni,ij,nj->n", u, a, u) - u @ b).min()
        assert 0.5 * x @ a @ x - b @ x <= best + 1e-12
        hit |= {(k, "low") for k in range(2) if x[k] == low[k]} | {(k, "high") for k in range(2) if x[k] == high[k]}
    assert len(hit) == 4
    assert W.in_box(np.zeros((2, 2)), np.zeros(2), np.array([0.1, 9.0]), np.zeros(2), np.ones(2)).tolist() == [0.1, 1.0]


def test_moments_far_from_zero(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(1e6, 1, 4000)
    y = 2 * (x - 1e6) + rng.normal(size=4000)
    df = spark.createDataFrame([(int(k % 2), float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))] + [(0, None, 1.0)], "g int, x double, y double").repartition(7)
    for r in W.moments(df, ["g"], ["x", "y"]).collect():
        p, own = W.Part.of(r.moments, 2), np.column_stack((x, y))[r.g :: 2].astype(np.longdouble)
        c = own - own.mean(axis=0)
        want = c.T @ c
        assert p.n == 2000 and np.abs((p.co - want) / want).max() < 1e-10
    both = W.Part.of(W.moments(df, [], ["x", "y"]).first().moments, 2)
    halves = [W.Part.of(r.moments, 2) for r in W.moments(df, ["g"], ["x", "y"]).collect()]
    assert np.abs((halves[0] + halves[1]).co / both.co - 1).max() < 1e-10


def conditions(spark, parts):
    """A condition for each key of parts: (labeled rows, weak rows, validation rows)."""
    flat = [(k, role, *map(float, r)) for k, three in parts.items() for role, x in zip(("labeled", "weak", "validation"), three, strict=True) for r in x]
    df = spark.createDataFrame(flat, "k string, role string, one double, a double, b double, z double, y double")
    m = W.moments(df, ["k", "role"], ["one", "a", "b", "z", "y"])
    return m.groupBy("k").agg(*[F.max(F.when(F.col("role") == r, F.col("moments"))).alias(r) for r in ("labeled", "weak", "validation")])


def test_candidates_of_conditions(spark):
    parts = {"p": (rows(40, 1), rows(100, 2), rows(20, 3)), "q": (rows(30, 4, far=1e5), rows(80, 5, far=1e5), rows(15, 6, far=1e5)), "none": (rows(20, 7), rows(0, 1), rows(0, 1))}
    c = conditions(spark, parts)
    fits = W.fit_conditions(c, ["k"], TWO, BOX, [0.0, 0.5], [0.0, 0.05, 1.0], [0.0, 0.2], starts=2).cache()
    assert fits.count() == 3 * 2 * 3 * 2 * 2
    out = fits.collect()
    assert all(r.status == "ok" and (r.validation_mse is None) == (r.k == "none") for r in out)
    assert all(r.residual < 1e-8 for r in out if r.converged) and sum(r.converged for r in out) > 40
    for r in out:
        if r.k != "none":
            x = parts[r.k][2]
            pred = r.coef[0] + x[:, :4] @ np.array(r.coef[1:])
            assert abs(np.mean((x[:, -1] - pred) ** 2) - r.validation_mse) < 1e-6 * max(1.0, r.validation_mse)
    starts = {(r.k, r.start): tuple(r.theta0) for r in out}
    assert starts["p", 0] == starts["q", 0] == (1.25, 0.0) and starts["p", 1] != starts["q", 1]
    assert all(BOX["s"][0] <= t[0] <= BOX["s"][1] and BOX["t"][0] <= t[1] <= BOX["t"][1] for t in starts.values())
    best = {r.k: r for r in W.select(fits, ["k"]).collect()}
    assert best["none"].n_valid == 0 and best["none"].g is None and best["none"].n_candidates == 24
    for k in "pq":
        assert best[k].validation_mse == min(r.validation_mse for r in out if r.k == k and r.converged)
    # a limit nothing meets leaves every condition without a choice
    assert {r.n_valid for r in W.select(fits, ["k"], 1e-9).collect()} == {0}
    # a refit begun at the choice ends where it began
    again = W.select(fits, ["k"]).where("k = 'p'")
    warm = c.join(again.select("k", F.col("theta").alias("theta0"), F.col("g").alias("warm_g"), F.col("d").alias("warm_d")), "k")
    r = W.fit_conditions(warm, ["k"], TWO, BOX, [best["p"].weak_weight], [best["p"].l1], [best["p"].group_weight]).first()
    assert r.sweeps <= best["p"].sweeps


def test_calibration_in_two_parameters(spark):
    rng = np.random.default_rng(9)
    data = [(k, float(a), float(b), float((0.7 + 0.1 * k) * a * np.exp(-(0.3 + k) * b))) for k in range(3) for a, b in rng.random((50, 2)) + 0.2]
    df = spark.createDataFrame(data, "k int, a double, b double, y double")
    got = W.calibrate_box(df, ["k"], "y", lambda v: v["s"] * F.col("a") * F.exp(-v["t"] * F.col("b")), {"s": (0.0, 2.0), "t": (0.0, 3.0)}, 9, 6)
    for r in got.collect():
        assert abs(r.s - (0.7 + 0.1 * r.k)) < 1e-2 and abs(r.t - (0.3 + r.k)) < 2e-2
    with pytest.raises(ValueError, match="points a round"):
        W.calibrate_box(df, ["k"], "y", lambda v: v["s"], {c: (0.0, 1.0) for c in "abcd"})


ROD = ColumnLibrary("rod test", {"one": lambda: F.lit(1.0), "q": lambda: F.col("q"), "qh": lambda: F.col("q") / F.col("h")}, {"theta": ("q", "qh")}, {"pq": lambda: F.col("q") / F.col("p")}, {"q": ("q", "qh"), "theta": ("theta_q", "theta_qh")})


def rod(q, h, t, theta):
    """The closed form written for numbers."""
    k, length, low = 1 / theta, 0.1, 293.15
    a = (q * length * (length / (2 * k) + 1 / h) + t - low) / (length + k / h)
    return low - q * length**2 / (8 * k) + a * length / 2


def test_labels_scored_anew(spark):
    """Sweeps of a nonlinear reference equal those on rows, and conditions stop on their own."""
    rng = np.random.default_rng(11)
    box, flat = {"theta": (1 / 35, 1 / 15)}, []
    for k, true in enumerate((0.03, 0.055, 0.066)):
        for role, n in (("labeled", 25), ("weak", 120)):
            q, h, t, p = rng.uniform(1, 10, n), rng.uniform(3, 50, n), rng.uniform(273, 323, n), rng.uniform(0.5, 10, n)
            y = rod(q * 1e4, h, t, true if role == "labeled" else 0.04) + (0.3 * q / p + 0.05 * rng.normal(size=n) if role == "labeled" else 0)
            flat += [(f"c{k}", role, float(a), float(b), float(c), float(e), float(f)) for a, b, c, e, f in zip(q, h, t, p, y, strict=True)]
    df = spark.createDataFrame(flat, "k string, role string, q double, h double, t double, p double, y double")
    df = df.select("k", "role", "h", "t", "y", *ROD.shape_columns(), *ROD.basis_columns())
    columns = [*ROD.shape, *ROD.basis, "y"]
    m = W.moments(df, ["k", "role"], columns).groupBy("k").agg(*[F.max(F.when(F.col("role") == r, F.col("moments"))).alias(r) for r in ("labeled", "weak")])
    score = lambda v: rod_temperature(F.col("q") * 1e4, F.col("h"), F.col("t"), v["theta"])
    rule = W.Rule(sweeps=25, objective=1e-7, change=1e-3)
    weak = df.where("role = 'weak'").select("k", *ROD.shape, "h", "t", "y")
    out = {r.k: r for r in W.refresh_fits(m.withColumn("theta0", F.array(F.lit(0.045))), weak, ["k"], ["k"], ROD, box, score, 0.1, 0.01, 0.01, 1e-2, rule=rule).collect()}
    # one condition at a time on rows: labels from the closed form in numbers, products from the rows
    pdf = df.toPandas()
    for k, got in out.items():
        own = pdf[pdf.k == k]
        lab, far = (own[own.role == r] for r in ("labeled", "weak"))
        theta, drift, past = np.array([[0.045]]), [], far.y.to_numpy()
        g = d = None
        fit0 = W.Fit(W.Setting.of(ROD, box), part(lab[columns].to_numpy()), part(far[columns].to_numpy()), theta[0])
        for sweep in range(got.sweeps):
            label = rod(far.q.to_numpy() * 1e4, far.h.to_numpy(), far.t.to_numpy(), theta[0, 0])
            drift.append(np.abs(label - past).max() / fit0.frame.y_scale)
            past = label
            x = far[columns].to_numpy().copy()
            x[:, -1] = label
            fit = W.Fit(W.Setting.of(ROD, box), part(lab[columns].to_numpy()), part(x), np.array([0.045]))
            if g is None:
                g, d = fit.start(1)
            g, d, theta, value, _ = fit.sweep(W.Candidates(*(np.array([v]) for v in (0.1, 0.01, 0.01, 1e-2))), g, d, theta, False)
            assert abs(value[0] - got.history[sweep]) < 1e-6 * max(1, value[0])
        assert np.abs(theta[0] - got.theta).max() < 1e-6 and np.allclose(drift, got.drift, rtol=1e-5, atol=1e-9)
        assert len(got.drift) == got.sweeps and got.drift[-1] <= got.drift[0]
        assert got.converged == (got.sweeps < 25) or got.sweeps == 25
    assert len({r.sweeps for r in out.values()}) > 1


def audit_rows(spark):
    rows = [("a", 10, 0.1, 2.0, "ok", True, 0.8), ("a", 10, 1.0, 1.0, "ok", True, 1.0), ("b", 10, 0.1, 3.0, "ok", True, 1.0), ("b", 10, 1.0, None, "singular", False, None), ("c", 10, 0.1, float("nan"), "ok", True, 1.0), ("d", 10, 0.1, 0.5, "ok", False, 1.0)]
    return spark.createDataFrame([(b, n, w, v, s, c, [t] if t else None, 0) for b, n, w, v, s, c, t in rows], "batch string, size int, w double, validation_mse double, status string, converged boolean, theta array<double>, start int")


def test_selection_audit_counts_invalid(spark):
    """A candidate that did not converge is invalid everywhere; conditions without a choice stay in the rates."""
    chosen = spark.createDataFrame([(10, 0.1)], "size int, w double")
    r = W.selection_audit(audit_rows(spark), chosen, ["batch", "size"], ["w"], ["size"], (0.8, 1.2)).first()
    assert (r.n, r.mean_w, r.boundary_rate, r.mean_gap, r.max_gap, r.convergence_rate, r.invalid_share) == (2, 0.1, 0.5, 0.5, 1.0, 0.5, 0.5)


def test_gates_see_fits_that_do_not_converge(spark):
    """With one sweep no candidate converges: no condition has a choice, and the gates are red."""
    from plumbline.plans import catalog  # noqa: F401
    from plumbline.plans.rule_queries import fit_gates

    c = conditions(spark, {"p": (rows(40, 1), rows(100, 2), rows(20, 3)), "q": (rows(30, 4), rows(80, 5), rows(15, 6))})
    for sweeps, want in ((1, ["fail", "warn"]), (300, ["pass", "pass"])):
        tried = W.fit_conditions(c, ["k"], TWO, BOX, [0.5], [1.0], [0.2], rule=W.Rule(sweeps=sweeps))
        best = W.select(tried, ["k"])
        chosen = best.where("coef is not null").select("k", F.col("theta").alias("theta0"), F.col("g").alias("warm_g"), F.col("d").alias("warm_d"), F.array("weak_weight", "l1", "group_weight").alias("chosen"))
        final = W.choose_refit(best, W.fit_conditions(c.join(chosen, "k"), ["k"], TWO, BOX, [], [], [], pooled=True, rule=W.Rule(sweeps=sweeps)), ["k"])
        assert final.count() == 2
        gates = {r.check: r for r in fit_gates(final, tried).collect()}
        assert [gates[n].status for n in ("convergence_rate", "invalid_share")] == want
        assert gates["convergence_rate"].value == (0.0 if sweeps == 1 else 1.0)


def test_row_errors_in_parts(spark, monkeypatch):
    """Squared errors of all candidates over rows cut into parts are those of the rows."""
    monkeypatch.setattr(W, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    data = {k: rows(n, n) for k, n in (("p", 70), ("q", 1))}
    flat = [(k, *map(float, r)) for k, x in data.items() for r in x]
    df = spark.createDataFrame(flat, "k string, one double, a double, b double, z double, y double")
    coef = {(k, i): rng.normal(size=5).tolist() for k in ("p", "q", "no rows") for i in range(9)}
    f = spark.createDataFrame([(k, i, c) for (k, i), c in coef.items()], "k string, i int, coef array<double>")
    got = {(r.k, r.i): r for r in W.row_errors(df, f, ["k"], ["i"], TWO).collect()}
    assert set(got) == {(k, i) for k, i in coef if k != "no rows"}
    for (k, i), r in got.items():
        e2 = (data[k][:, -1] - coef[k, i][0] - data[k][:, :4] @ coef[k, i][1:]) ** 2
        assert r.n == len(e2) and np.isclose(r.mse, e2.mean()) and np.isclose(r.deviation, e2.std(ddof=1) if len(e2) > 1 else 0.0)


def test_diagnostics_equal_rows(spark):
    """R-squared, norms, residual and gap from moments are those of the rows."""
    x = {n: rows(40, k) for k, n in enumerate(("labeled", "weak", "test"))}
    x["weak"][:, -1] = 2.0
    c = conditions(spark, {"p": (x["labeled"], x["weak"], x["test"])}).withColumnRenamed("validation", "test")
    coef, g = [0.1, 2.5, 1.2, -0.3, 0.6], [0.5, 1.0, 2.0, 3.0, 4.0, 5.0]
    fit = c.select("k", *[c[n] for n in x], F.array(*map(F.lit, coef)).alias("coef"), F.array(*map(F.lit, g)).alias("g"), F.array(F.lit(2.0), F.lit(0.0)).alias("theta"), F.lit(0.5).alias("validation_mse"))
    r = W.diagnose(fit, ["k"], TWO, BOX).first()
    own = {n: coef[0] + v[:, :3] @ coef[1:4] for n, v in x.items()}
    e = {n: v[:, -1] - own[n] - coef[4] * v[:, 3] for n, v in x.items()}
    assert r.weak_r2 is None and r.at_bound and np.isclose(r.train_r2, 1 - e["labeled"] @ e["labeled"] / (40 * x["labeled"][:, -1].var()))
    assert np.isclose(r.shape_norm, np.linalg.norm(own["test"])) and np.isclose(r.basis_norm, 0.6 * np.linalg.norm(x["test"][:, 3]))
    assert np.isclose(r.residual, np.sqrt(np.mean(e["test"] ** 2))) and np.isclose(r.validation_gap, 0.5 - np.mean(e["labeled"] ** 2))
    assert np.isclose(r.g_norm_a, np.hypot(1.0, 3.0)) and np.isclose(r.g_norm_b, np.sqrt(2.0**2 + 4.0**2 + 5.0**2))


def test_library_that_names_what_it_lacks():
    with pytest.raises(ValueError, match="has no column nothing"):
        ColumnLibrary("wrong", {"one": lambda: F.lit(1.0)}, ("nothing",))
    with pytest.raises(ValueError, match="box must name"):
        W.Setting.of(TWO, {"s": (0, 1)})
    assert list(itertools.chain(*TWO.parameters().values())) == ["a", "b", "one"]
