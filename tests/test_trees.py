"""Tree baselines: splits against brute force, shallower and shorter models, one task a condition."""

import numpy as np
import pytest

from plumbline.operators import trees as T


def best_split(x, y, leaf):
    """All splits by brute force: (error, feature, threshold) of the least error."""
    found = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for a, b in zip(v, v[1:]):  # noqa: B905
            low = x[:, f] <= (a + b) / 2
            if min(low.sum(), (~low).sum()) >= leaf:
                found.append((((y[low] - y[low].mean()) ** 2).sum() + ((y[~low] - y[~low].mean()) ** 2).sum(), f, (a + b) / 2))
    least = min(e for e, *_ in found)
    return min(((f, t) for e, f, t in found if e <= least + 1e-9 * max(1.0, (y * y).sum())))


@pytest.mark.parametrize("leaf", [1, 4])
def test_every_split_is_the_best(leaf):
    rng = np.random.default_rng(leaf)
    x = np.column_stack((rng.normal(size=90), rng.integers(0, 4, 90), rng.normal(size=90)))
    y = np.sin(2 * x[:, 0]) + x[:, 1] + rng.normal(size=90) / 5
    tree = T.grow(x, y, leaf)
    rows = {0: np.arange(90)}
    for node in range(len(tree.feature)):
        at = rows[node]
        assert np.isclose(tree.value[node], y[at].mean())
        if tree.feature[node] >= 0:
            f, cut = best_split(x[at], y[at], leaf)
            assert (f, cut) == (tree.feature[node], pytest.approx(tree.threshold[node]))
            low = x[at, f] <= cut
            rows[tree.left[node]], rows[tree.left[node] + 1] = at[low], at[~low]
        else:
            assert len(at) < 2 * leaf or np.ptp(y[at]) < 1e-9 or len(np.unique(x[at], axis=0)) == 1 or leaf > 1
    if leaf == 1:
        assert np.allclose(tree.predict(x)[:, 0], y)
    for depth in (0, 1, 3):
        assert np.allclose(tree.predict(x, depth), T.grow(x, y, leaf, depth).predict(x))


def test_constant_and_tied_targets():
    x = np.array([[1.0, 1.0], [1.0, 2.0], [2.0, 2.0], [2.0, 1.0]])
    assert T.grow(x, np.ones(4), 1).feature.tolist() == [-1]
    assert T.grow(np.ones((4, 2)), np.arange(4.0), 1).feature.tolist() == [-1]
    assert T.grow(np.array([[1.0, 5.0], [2.0, 6.0]]), np.array([0.0, 1.0]), 1).feature[0] == 0  # ties go to the first feature


def test_series_share_their_start():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(60, 2)), rng.normal(size=60)
    models = {p["trees"]: m for p, m in T.boosted_models(x, y, {"rate": [0.3], "depth": [2], "trees": [3, 9]})}
    for n, m in models.items():
        pred, left = np.full(60, y.mean()), y - y.mean()
        for _ in range(n):
            step = T.grow(x, left, 1, 2).predict(x)[:, 0]
            pred, left = pred + 0.3 * step, left - 0.3 * step
        assert np.allclose(T.predict(m, x), pred)
    whole = {(p["depth"], p["leaf"]): T.predict(m, x) for p, m in T.forest_models(x, y, {"trees": [7], "depth": [T.DEEP, 2], "leaf": [1, 3]})}
    for (depth, leaf), pred in whole.items():
        assert np.allclose(pred, np.mean([T.grow(x[s], y[s], leaf, depth).predict(x)[:, 0] for s in (T.draws(t, 60) for t in range(7))], axis=0))


def test_conditions(spark, monkeypatch):
    """Each condition gets its own model; test rows in parts give the errors of the rows; too many rows are an error."""
    monkeypatch.setattr(T, "PART_ROWS", 50)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    y = np.where(x[:, 0] > 0, 2.0, -1.0) * np.repeat([1.0, -3.0], 200) + rng.normal(size=400) / 10
    flat = [("a" if k < 200 else "b", "test" if k % 200 >= 60 else "train" if k % 3 else "validation", k, *map(float, (*x[k], y[k]))) for k in range(400)]
    df = spark.createDataFrame(flat, "b string, role string, o long, u double, v double, y double")
    fitted = T.fit_trees(df.where("role <> 'test'"), ["b"], ["u", "v"], "y", "o", "tree", {"depth": [T.DEEP, 1, 3], "leaf": [1, 5]}, 60)
    got = {r.b: r for r in T.test_metrics(df.where("role = 'test'"), fitted, ["b"], ["b", "validation_mse"], ["u", "v"], "y").collect()}
    assert set(got) == {"a", "b"} and all(r.mse < 0.5 and np.isclose(r.rmse**2, r.mse) for r in got.values())
    for b, lo in (("a", 0), ("b", 200)):
        at = np.arange(lo, lo + 200)
        fit, test = at[at % 200 < 60], at[at % 200 >= 60]
        train = fit[fit % 3 != 0]
        held = np.setdiff1d(fit, train)
        tried = [(np.mean((y[held] - T.predict(m, x[held])) ** 2), p) for p, m in T.tree_models(x[train], y[train], {"depth": [T.DEEP, 1, 3], "leaf": [1, 5]})]
        loss, best = min(tried, key=lambda t: t[0])
        e = y[test] - T.grow(x[fit], y[fit], best["leaf"], best["depth"]).predict(x[test])[:, 0]
        assert np.isclose(got[b].validation_mse, loss) and np.isclose(got[b].mse, np.mean(e * e)) and np.isclose(got[b].mae, np.mean(np.abs(e)))
    with pytest.raises(Exception, match="labeled rows in a condition"):
        T.fit_trees(df, ["b"], ["u", "v"], "y", "o", "tree", {"depth": [1], "leaf": [1]}, 60).collect()
