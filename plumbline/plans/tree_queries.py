"""Queries of the tree baselines: every batch and size on its own, test metrics of the selected model."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import trees as T
from plumbline.operators.splits import by_role
from plumbline.plans.catalog import query
from plumbline.plans.tables import SIZES, SPLIT, observations, split

CONDITION, FEATURES = ["batch_id", "n_labeled"], ["price", "qty", "disc", "tax"]


def tree_arm(spark, sf, kind, grid):
    """The selected model of each condition: parameters, validation and test errors."""
    fitted = T.fit_trees(split(spark, sf), CONDITION, FEATURES, "y", "ord", kind, grid, max(SIZES))
    fitted = fitted.withColumn("parameters", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("parameters")))))
    return T.test_metrics(by_role(observations(spark, sf), ["test"]), fitted, ["batch_id"], [*CONDITION, "validation_mse", "parameters"], FEATURES, "y")


TREE_GRIDS = {
    "tree": ("tree", {"depth": [T.DEEP, 2, 3, 5], "leaf": [1, 3]}),
    "forest": ("forest", {"trees": [200], "depth": [T.DEEP, 5, 10], "leaf": [1, 2]}),
    "boosted": ("boosted", {"rate": [0.1, 0.15, 0.2], "depth": [2, 3, 5], "trees": [30, 100, 160]}),
}


@query("reg22_decision_tree")
def reg22(spark, sf):
    return tree_arm(spark, sf, *TREE_GRIDS["tree"])


@query("reg23_random_forest")
def reg23(spark, sf):
    return tree_arm(spark, sf, *TREE_GRIDS["forest"])


@query("reg24_gradient_boosting")
def reg24(spark, sf):
    return tree_arm(spark, sf, *TREE_GRIDS["boosted"])


# stumps in SQL -------------------------------------------------------------------------------------
AT = "CASE k " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(FEATURES)) + " END"


def stump_sql(name: str, source: str, target: str, g: str = "batch_id, n_labeled") -> str:
    """CTEs of the best split of the target by group: {name} holds g, feature k, threshold cut, means lo and hi."""
    long = " UNION ALL ".join(f"SELECT {g}, {k} AS k, {f} AS x, {target} AS t FROM {source}" for k, f in enumerate(FEATURES))
    return f"""{name}_v AS (SELECT {g}, k, x, count(*) AS c, sum(t) AS s FROM ({long}) GROUP BY ALL),
{name}_c AS (SELECT {g}, k, x, lead(x) OVER (PARTITION BY {g}, k ORDER BY x) AS nx, sum(c) OVER (PARTITION BY {g}, k ORDER BY x) AS nl, sum(s) OVER (PARTITION BY {g}, k ORDER BY x) AS sl, sum(c) OVER (PARTITION BY {g}, k) AS n, sum(s) OVER (PARTITION BY {g}, k) AS st FROM {name}_v),
{name}_g AS (SELECT *, sl * sl / nl + (st - sl) * (st - sl) / (n - nl) AS gain, max(sl * sl / nl + (st - sl) * (st - sl) / (n - nl)) OVER (PARTITION BY {g}) AS most FROM {name}_c WHERE nx IS NOT NULL),
{name} AS (SELECT {g}, k, (x + nx) / 2 AS cut, sl / nl AS lo, (st - sl) / (n - nl) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY k, x) AS p FROM {name}_g WHERE gain >= most - 1e-9 * abs(most)) WHERE p = 1)"""


METRICS = "avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae"
TEST = "(SELECT * FROM obs WHERE role = 'test') o"
STUMP = SPLIT + ", " + stump_sql("s", "split", "y")
STUMP_TEST = f"SELECT batch_id, n_labeled, y - CASE WHEN {AT} <= cut THEN lo ELSE hi END AS e FROM s JOIN {TEST} USING (batch_id)"


@query("reg22_stump", f"SELECT batch_id, n_labeled::INT AS n_labeled, {METRICS} FROM ({STUMP_TEST}) GROUP BY ALL", STUMP, "mse rmse mae", 5)
def reg22s(spark, sf):
    """One split, of train and validation rows."""
    return tree_arm(spark, sf, "tree", {"depth": [1], "leaf": [1]}).drop("validation_mse", "parameters")


BAGS = (
    SPLIT
    + """, placed AS (SELECT *, row_number() OVER (PARTITION BY batch_id, n_labeled ORDER BY ord) - 1 AS place, count(*) OVER (PARTITION BY batch_id, n_labeled) AS n FROM split),
bag AS (SELECT p.*, t.t AS tree FROM range(3) t(t), placed q JOIN placed p ON p.batch_id = q.batch_id AND p.n_labeled = q.n_labeled AND p.place = ('0x' || substr(md5(t.t || '|' || q.place || '|' || q.n), 1, 8))::BIGINT % q.n), """
    + stump_sql("s", "bag", "y", "batch_id, n_labeled, tree")
)


@query("reg23_three_stumps", f"SELECT batch_id, n_labeled::INT AS n_labeled, {METRICS} FROM (SELECT batch_id, n_labeled, ord, y - pred AS e FROM (SELECT batch_id, n_labeled, ord, any_value(y) AS y, avg(CASE WHEN {AT} <= cut THEN lo ELSE hi END) AS pred FROM s JOIN {TEST} USING (batch_id) GROUP BY ALL)) GROUP BY batch_id, n_labeled", BAGS, "mse rmse mae", 5)
def reg23s(spark, sf):
    """A forest of three single splits over rows drawn with replacement."""
    return tree_arm(spark, sf, "forest", {"trees": [3], "depth": [1], "leaf": [1]}).drop("validation_mse", "parameters")


ROUNDS = (
    SPLIT
    + ", r0 AS (SELECT *, avg(y) OVER (PARTITION BY batch_id, n_labeled) AS base, y - avg(y) OVER (PARTITION BY batch_id, n_labeled) AS r FROM split), "
    + stump_sql("s1", "r0", "r")
    + f", r1 AS (SELECT r0.* REPLACE (r - 0.1 * CASE WHEN {AT} <= cut THEN lo ELSE hi END AS r) FROM r0 JOIN s1 USING (batch_id, n_labeled)), "
    + stump_sql("s2", "r1", "r")
    + """, base AS (SELECT batch_id, n_labeled, any_value(base) AS base FROM r0 GROUP BY ALL)"""
)


@query(
    "reg24_two_rounds",
    f"SELECT batch_id, n_labeled::INT AS n_labeled, {METRICS} FROM (SELECT batch_id, n_labeled, y - base - 0.1 * first - 0.1 * CASE WHEN {AT} <= cut THEN lo ELSE hi END AS e FROM s2 JOIN base USING (batch_id, n_labeled) JOIN (SELECT batch_id, n_labeled, o.ord, o.y, o.price, o.qty, o.disc, o.tax, CASE WHEN {AT} <= cut THEN lo ELSE hi END AS first FROM s1 JOIN {TEST} USING (batch_id)) USING (batch_id, n_labeled)) GROUP BY ALL",
    ROUNDS, "mse rmse mae", 5,
)
def reg24s(spark, sf):
    """Two rounds of single splits."""
    return tree_arm(spark, sf, "boosted", {"rate": [0.1], "depth": [1], "trees": [2]}).drop("validation_mse", "parameters")
