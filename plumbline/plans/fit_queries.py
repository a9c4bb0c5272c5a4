"""Queries of regression, calibration and weakly supervised fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.expressions import log_grid
from plumbline.operators import joins
from plumbline.operators import metrics as M
from plumbline.operators import regression as R
from plumbline.operators.splits import by_role
from plumbline.plans.catalog import query
from plumbline.plans.stat_queries import GRAM_COLUMNS, gram_rows
from plumbline.plans.tables import ARMS, OBS, SPLIT, arm_metrics, fits, observations, scored, split

UNITS = {"one": "1.0::DOUBLE", "price": "price / 50", "qty": "qty / 50", "price_disc": "price * disc", "price_tax": "price * tax", "y": "y / 50"}


def solve_sql(name: str, source: str, g: str, x: list[str], y: str = "y", w: str = "1.0::DOUBLE") -> str:
    """CTEs that solve the weighted normal equations of y on the columns x by group: {name} holds g and b0, b1, ..."""
    p, cells = len(x), [(i, j) for i in range(len(x)) for j in range(len(x) + 1)]
    column = lambda j: x[j] if j < p else y
    out = f"{name}_0 AS (SELECT {g}, " + ", ".join(f"sum({w} * {x[i]} * {column(j)}) AS m{i}_{j}" for i, j in cells) + f" FROM {source} GROUP BY {g})"
    for k in range(p):
        row = {(i, j): f"m{k}_{j} / m{k}_{k}" if i == k else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k}" for i, j in cells}
        out += f", {name}_{k + 1} AS (SELECT {g}, " + ", ".join(f"{row[c]} AS m{c[0]}_{c[1]}" for c in cells) + f" FROM {name}_{k})"
    return out + f", {name} AS (SELECT {g}, " + ", ".join(f"m{i}_{p} AS b{i}" for i in range(p)) + f" FROM {name}_{p})"


def units(columns: list[str]) -> str:
    return ", ".join(f"{UNITS[c]} AS {c}" for c in columns)


def line(x: list[str]) -> str:
    return " + ".join(f"b{i} * {c}" for i, c in enumerate(x))


SHAPE, BASIS, Y = ["one", "price", "qty"], ["price_disc", "price_tax"], "y"
BOX = (0.8, 1.2)


def coefficients(df, names, keep):
    return df.select(*keep, *[F.element_at("coef", i + 1).alias(n) for i, n in enumerate(names)], "mse")


@query("reg01_affine_alignment", "SELECT batch_id, n_labeled::INT AS n_labeled, a + 5 * b AS a, b FROM arms WHERE model = 'affine'", ARMS, "a b")
def reg01(spark, sf):
    return R.affine_align(split(spark, sf).where("role = 'train'"), ["batch_id", "n_labeled"], "y", "price", 5.0).select("batch_id", "n_labeled", "a", "b")


@query(
    "reg02_two_columns",
    "SELECT supp, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2, (syy - (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) * s1y - (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) * s2y) / n AS mse FROM (SELECT supp, count(*) AS n, sum(x * x) AS s11, sum(x * q) AS s12, sum(q * q) AS s22, sum(x * y) AS s1y, sum(q * y) AS s2y, sum(y * y) AS syy FROM (SELECT supp, price / 50 AS x, qty / 50 AS q, y / 50 AS y FROM obs) GROUP BY supp)",
    OBS, "b1 b2 mse",
)
def reg02(spark, sf):
    g = R.gram(gram_rows(observations(spark, sf)), ["supp"], ["price", "qty", "y"])
    return coefficients(R.ols(g, ["supp"], ["price", "qty", "y"], ["price", "qty"], "y"), ["b1", "b2"], ["supp"])


M_ARMS = {"M0": ["price"], "M1": ["one", "price"], "M2": ["one", "price", "qty"], "M3": ["one", "price", "qty", *BASIS]}
ALL_UNITS = OBS + f", rows AS (SELECT supp, {units([*SHAPE, *BASIS, Y])} FROM obs)"


@query(
    "reg02_arms_mse",
    " UNION ALL ".join(f"SELECT supp, '{n}' AS arm, count(*) AS n, avg((y - ({line(x)})) ** 2) AS mse FROM rows JOIN {n} USING (supp) GROUP BY supp" for n, x in M_ARMS.items()),
    ALL_UNITS + ", " + ", ".join(solve_sql(n, "rows", "supp", x) for n, x in M_ARMS.items()), "mse",
)
def reg02a(spark, sf):
    """Residual mse of arms of one to five regressors."""
    return reg02m(spark, sf).select("supp", "arm", "n", "mse")


@query("reg02_many_columns")
def reg02m(spark, sf):
    """Arms of two to five regressors, fitted from the same Gram rows."""
    g = R.gram(gram_rows(observations(spark, sf)), ["supp"], GRAM_COLUMNS)
    arms = {"M0": ["price"], "M1": ["one", "price"], "M2": ["one", "price", "qty"], "M3": ["one", "price", "qty", *BASIS]}
    parts = [R.ols(g, ["supp"], GRAM_COLUMNS, x, Y).withColumn("arm", F.lit(n)) for n, x in arms.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("supp", "arm", "n", "coef", "mse")


@query("reg03_projection_mse", "SELECT supp, (sum(y * y) - sum(x * y) ** 2 / sum(x * x)) / count(*) AS mse FROM (SELECT supp, price / 50 AS x, y / 50 AS y FROM obs) GROUP BY supp", OBS, "mse")
def reg03(spark, sf):
    g = R.gram(gram_rows(observations(spark, sf)), ["supp"], ["price", "y"])
    return R.ols(g, ["supp"], ["price", "y"], ["price"], "y").select("supp", "mse")


@query("reg04_residualized", "SELECT ord, price_disc - price * w AS price_disc FROM (SELECT ord, supp, price / 50 AS price, price * disc AS price_disc FROM obs) JOIN (SELECT supp, sum(price / 50 * price * disc) / sum(price / 50 * price / 50) AS w FROM obs GROUP BY supp) USING (supp)", OBS, "price_disc")
def reg04(spark, sf):
    o = gram_rows(observations(spark, sf))
    columns = ["price", "price_disc"]
    p = R.projection(R.gram(o, ["supp"], columns), ["supp"], columns, ["price"], ["price_disc"])
    return R.residualize(o.select("supp", "ord", *columns), p, ["supp"], ["price"], ["price_disc"]).select("ord", "price_disc")


@query("reg05_coverage", "SELECT supp, corr(price, y) ** 2 AS r2_h FROM obs GROUP BY supp", OBS, "r2_h")
def reg05(spark, sf):
    g = R.gram(gram_rows(observations(spark, sf)), ["supp"], GRAM_COLUMNS)
    return R.coverage(g, ["supp"], GRAM_COLUMNS, ["one", "price"], BASIS, Y).select("supp", "r2_h")


@query(
    "reg05_coverage_all",
    f"SELECT supp, 1 - h / total AS r2_h, 1 - hb / total AS r2_hb, 1 - hb / h AS r2_b FROM (SELECT supp, var_pop(y) * count(*) AS total FROM rows GROUP BY supp) JOIN (SELECT supp, sum((y - ({line(['one', 'price'])})) ** 2) AS h FROM rows JOIN a USING (supp) GROUP BY supp) USING (supp) JOIN (SELECT supp, sum((y - ({line(['one', 'price', *BASIS])})) ** 2) AS hb FROM rows JOIN b USING (supp) GROUP BY supp) USING (supp)",
    ALL_UNITS + ", " + solve_sql("a", "rows", "supp", ["one", "price"]) + ", " + solve_sql("b", "rows", "supp", ["one", "price", *BASIS]), "r2_h r2_hb r2_b", 5,
)
def reg05a(spark, sf):
    g = R.gram(gram_rows(observations(spark, sf)), ["supp"], GRAM_COLUMNS)
    return R.coverage(g, ["supp"], GRAM_COLUMNS, ["one", "price"], BASIS, Y)


@query("reg06_canonical_correlation", "SELECT supp, abs(corr(price, y)) AS correlation FROM obs GROUP BY supp", OBS, "correlation")
def reg06(spark, sf):
    g = R.gram(gram_rows(observations(spark, sf)), ["supp"], ["one", "price", "y"])
    return R.canonical_correlation(g, ["supp"], ["one", "price", "y"], ["price"], ["y"])


@query(
    "reg06_canonical_columns", f"SELECT supp, sqrt(greatest(0, 1 - sum((y - ({line(SHAPE)})) ** 2) / (var_pop(y) * count(*)))) AS correlation FROM rows JOIN a USING (supp) GROUP BY supp",
    ALL_UNITS + ", " + solve_sql("a", "rows", "supp", SHAPE), "correlation", 5,
)
def reg06c(spark, sf):
    """Two columns against one: the root of R-squared."""
    g = R.gram(gram_rows(observations(spark, sf)), ["supp"], [*SHAPE, "y"])
    return R.canonical_correlation(g, ["supp"], [*SHAPE, "y"], ["price", "qty"], ["y"])


CAL = "SELECT batch_id, min(loss) AS loss, arg_min(theta, loss) AS theta FROM (SELECT batch_id, 0.8 + 0.02 * k AS theta, avg((y - (0.8 + 0.02 * k) * price) ** 2) AS loss FROM obs, range(21) r(k) GROUP BY batch_id, k) GROUP BY batch_id"


@query("reg07_calibration", CAL, OBS, "loss theta")
def reg07(spark, sf):
    return R.calibrate(observations(spark, sf), ["batch_id"], "y", lambda t: t * F.col("price"), *BOX, points=21)


@query("reg07_calibration_rounds")
def reg07r(spark, sf):
    return R.calibrate(observations(spark, sf), ["supp"], "y", lambda t: t * F.col("price"), *BOX, points=21, rounds=3)


@query("reg08_sensitivity", "SELECT supp, sqrt(avg((0.4 * price) ** 2)) / 3 AS sensitivity FROM obs GROUP BY supp", OBS, "sensitivity")
def reg08(spark, sf):
    return R.sensitivity(observations(spark, sf), ["supp"], lambda t: t * F.col("price"), *BOX, 3.0)


SCALE = """SELECT batch_id, target, scale, correlation, gap, lowest, highest FROM (
  SELECT *, abs(correlation - target) AS gap, row_number() OVER (PARTITION BY batch_id, target ORDER BY abs(correlation - target), scale) AS p,
         min(correlation) OVER (PARTITION BY batch_id, target) AS lowest, max(correlation) OVER (PARTITION BY batch_id, target) AS highest
  FROM (SELECT batch_id, pow(10::DOUBLE, -1 + 0.25 * k) AS scale, corr(price + pow(10::DOUBLE, -1 + 0.25 * k) * (qty * (20 * disc - 1)), y) AS correlation FROM obs, range(13) r(k) GROUP BY batch_id, k), (VALUES (0.9::DOUBLE), (0.7), (0.5)) t(target)) WHERE p = 1"""


@query("reg09_scale_calibration", SCALE, OBS, "scale correlation gap lowest highest")
def reg09(spark, sf):
    o = observations(spark, sf).withColumn("shift", F.col("qty") * (20 * F.col("disc") - 1))
    return R.calibrate_scale(o, ["batch_id"], "price", "shift", "y", [0.9, 0.7, 0.5], log_grid(-1.0, 2.0, 13))


@query("reg11_ridge_block", "SELECT supp, sum(price * disc * (y / 50 - price / 50)) / (sum((price * disc) ** 2) + 0.5) AS d FROM obs GROUP BY supp", OBS, "d")
def reg11(spark, sf):
    o = gram_rows(observations(spark, sf))
    return R.ridge_one(o, ["supp"], "price_disc", F.col("y") - F.col("price"), 0.5)


BLOCK = "SELECT supp, (r1 * s22 - r2 * s12) / (s11 * s22 - s12 * s12) AS d1, (r2 * s11 - r1 * s12) / (s11 * s22 - s12 * s12) AS d2 FROM (SELECT supp, sum(price_disc ** 2) + 0.5 AS s11, sum(price_disc * price_tax) AS s12, sum(price_tax ** 2) + 0.5 AS s22, sum(price_disc * (y - price)) AS r1, sum(price_tax * (y - price)) AS r2 FROM rows GROUP BY supp)"


@query("reg11_ridge_two_columns", BLOCK, ALL_UNITS, "d1 d2")
def reg11b(spark, sf):
    """The block (B'B + r I) d = B'(y - H g) of two columns, with H g the price."""
    o = gram_rows(observations(spark, sf)).withColumn("left", F.col("y") - F.col("price"))
    columns = [*BASIS, "left"]
    d = R.ols(R.gram(o, ["supp"], columns), ["supp"], columns, BASIS, "left", ridge=0.5)
    return d.select("supp", F.element_at("coef", 1).alias("d1"), F.element_at("coef", 2).alias("d2"))


@query(
    "reg12_objective_all_terms",
    "SELECT *, labeled_term + weak_term + l1_term + group_term + ridge_term AS objective FROM (SELECT batch_id, 0.5 * sum(CASE WHEN role = 'labeled' THEN e ** 2 ELSE 0 END) AS labeled_term, 0.1 * 0.5 * sum(CASE WHEN role = 'labeled' THEN 0 ELSE h ** 2 END) AS weak_term, 0.01 * 1.4::DOUBLE AS l1_term, 0.02 * (sqrt(0.2 ** 2 + 0.9 ** 2) + 0.3) AS group_term, 0.5 * 0.3 * (0.5 ** 2 + 0.25 ** 2) AS ridge_term FROM (SELECT batch_id, role, y - (0.2 + 1.2 * price) + 0.5 * price * disc - 0.25 * price * tax AS e, price - (0.2 + 1.2 * price) AS h FROM obs WHERE role <> 'test') GROUP BY batch_id)",
    OBS, "labeled_term weak_term l1_term group_term ridge_term objective", 4,
)
def reg12a(spark, sf):
    """g = (0.2, 0.9; 0.3 by theta 1) in two groups, d = (-0.5, 0.25); weak rows see H g only."""
    o = observations(spark, sf).where("role <> 'test'")
    labeled, h = F.col("role") == "labeled", 0.2 + 1.2 * F.col("price")
    d = -0.5 * F.col("price") * F.col("disc") + 0.25 * F.col("price") * F.col("tax")
    residual = F.when(labeled, F.col("y") - h - d).otherwise(F.col("price") - h)
    return R.objective_terms(o, ["batch_id"], residual, labeled, 0.1, 0.01, [0.2, 0.9, 0.3], [[0, 1], [2]], 0.02, [-0.5, 0.25], 0.3)


@query("reg12_objective", "SELECT batch_id, labeled_term, weak_term, 0.012::DOUBLE AS l1_term, labeled_term + weak_term + 0.012 AS objective FROM (SELECT batch_id, 0.5 * sum(CASE WHEN role = 'labeled' THEN e * e ELSE 0 END) AS labeled_term, 0.1 * 0.5 * sum(CASE WHEN role = 'labeled' THEN 0 ELSE e * e END) AS weak_term FROM (SELECT batch_id, role, CASE WHEN role = 'labeled' THEN y ELSE price END - (0.2 + price) AS e FROM obs WHERE role <> 'test') GROUP BY batch_id)", OBS, "labeled_term weak_term l1_term objective", 4)
def reg12(spark, sf):
    o = observations(spark, sf).where("role <> 'test'")
    labeled = F.col("role") == "labeled"
    residual = F.when(labeled, F.col("y")).otherwise(F.col("price")) - (0.2 + F.col("price"))
    return R.objective_terms(o, ["batch_id"], residual, labeled, 0.1, 0.01, [0.2, 1.0])


@query("reg13_weak_refresh", "SELECT batch_id, sum(price / 50 * theta * price / 50) AS xy, max(abs(theta * price - price)) AS drift FROM obs JOIN (SELECT batch_id, regr_slope(y, price) AS theta FROM obs WHERE role = 'labeled' GROUP BY batch_id) USING (batch_id) WHERE role = 'weak' GROUP BY batch_id", OBS, "xy drift", 5)
def reg13(spark, sf):
    from plumbline.functions.registry import score_reference

    o = observations(spark, sf)
    theta = R.affine_align(by_role(o, ["labeled"]), ["batch_id"], "y", "price").select("batch_id", F.col("b").alias("theta"))
    w = score_reference(joins.attach(by_role(o, ["weak"]), theta, ["batch_id"]), "list_price", F.col("theta"), "y_weak")
    return w.groupBy("batch_id").agg(F.sum(F.col("price") / 50 * F.col("y_weak") / 50).alias("xy"), F.max(F.abs(F.col("y_weak") - F.col("price"))).alias("drift"))


@query("reg14_output_mapping", "SELECT batch_id, n_labeled::INT AS n_labeled, regr_slope(y, 1.1 * price) AS b, regr_intercept(y, 1.1 * price) AS a FROM split WHERE role = 'train' GROUP BY ALL", SPLIT, "a b")
def reg14(spark, sf):
    s = split(spark, sf).where("role = 'train'").withColumn("score", 1.1 * F.col("price"))
    return R.affine_align(s, ["batch_id", "n_labeled"], "y", "score")


@query("reg16_grouped_scoring", "SELECT ord, a + b * price AS pred FROM obs JOIN (SELECT batch_id, regr_slope(y, price) AS b, regr_intercept(y, price) AS a FROM obs WHERE role = 'labeled' GROUP BY batch_id) USING (batch_id) WHERE role = 'test'", OBS, "pred")
def reg16(spark, sf):
    o = observations(spark, sf).withColumn("one", F.lit(1.0))
    m = R.affine_align(by_role(o, ["labeled"]), ["batch_id"], "y", "price")
    m = m.select("batch_id", F.array(F.col("a"), F.col("b"), F.lit(0.0)).alias("g"), F.array().cast("array<double>").alias("d"), F.lit(1.0).alias("theta"))
    return R.predict(by_role(o, ["test"]), m, ["batch_id"], ["one", "price"], ["price"], []).select("ord", "pred")


ACTIVE = "SELECT batch_id, n_labeled::INT AS n_labeled, concat_ws(',', CASE WHEN abs(a) > 1 THEN 'a' END, CASE WHEN abs(b) > 1 THEN 'b' END) AS active, concat_ws(',', CASE WHEN abs(a) <= 1 THEN 'a' END, CASE WHEN abs(b) <= 1 THEN 'b' END) AS dropped FROM arms WHERE model = 'affine'"


@query("reg17_active_features", ACTIVE, ARMS)
def reg17(spark, sf):
    f = fits(split(spark, sf)).where("model = 'affine'").withColumn("coef", F.array("a", "b"))
    return R.active_features(f, ["batch_id", "n_labeled"], ["a", "b"], "coef", 1.0)


RIDGE = ", f AS (SELECT batch_id, n_labeled, alpha, sum(price * y) / (sum(price * price) + any_value(alpha)) AS b FROM split, (VALUES (0.0::DOUBLE), (100.0), (10000.0)) a(alpha) WHERE role = 'train' GROUP BY ALL), v AS (SELECT batch_id, n_labeled, alpha, b, avg((y - b * price) ** 2) AS loss FROM split JOIN f USING (batch_id, n_labeled) WHERE role = 'validation' GROUP BY ALL)"


@query("reg21_ridge_baseline", "SELECT batch_id, n_labeled::INT AS n_labeled, alpha, b, loss FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, n_labeled ORDER BY loss, alpha) AS p FROM v) WHERE p = 1", SPLIT + RIDGE, "b loss")
def reg21(spark, sf):
    s = joins.candidate_grid(split(spark, sf), alpha=[0.0, 100.0, 10000.0])
    g = ["batch_id", "n_labeled", "alpha"]
    f = s.where("role = 'train'").groupBy(*g).agg((F.sum(F.col("price") * F.col("y")) / (F.sum(F.col("price") * F.col("price")) + F.col("alpha"))).alias("b"))
    v = s.where("role = 'validation'").join(f, g).groupBy(*g, "b").agg(F.avg((F.col("y") - F.col("b") * F.col("price")) ** 2).alias("loss"))
    best = v.groupBy("batch_id", "n_labeled").agg(F.min(F.struct("loss", "alpha", "b")).alias("x"))
    return best.select("batch_id", "n_labeled", "x.alpha", "x.b", "x.loss")


TWO_STAGE = (
    OBS
    + """, grid AS (SELECT batch_id, k, sum((y - (0.8 + 0.02 * k) * price) ** 2) AS loss FROM obs, range(21) r(k) WHERE role = 'labeled' GROUP BY ALL),
first AS (SELECT batch_id, arg_min(0.8 + 0.02 * k, loss) AS t FROM grid GROUP BY ALL),
box AS (SELECT batch_id, greatest(0.8, t - 0.02) AS lo, (least(1.2, t + 0.02) - greatest(0.8, t - 0.02)) / 20 AS step FROM first),
fine AS (SELECT batch_id, lo + step * k AS theta, sum((y - (lo + step * k) * price) ** 2) AS loss FROM obs JOIN box USING (batch_id), range(21) r(k) WHERE role = 'labeled' GROUP BY ALL),
best AS (SELECT batch_id, arg_min(theta, loss) AS theta FROM fine GROUP BY ALL),
rest AS (SELECT batch_id, price * disc AS x1, price * tax AS x2, y / 50 - theta * price / 50 AS r FROM obs JOIN best USING (batch_id) WHERE role = 'labeled'),
m AS (SELECT batch_id, sum(x1 * x1) + 1e-3 AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) + 1e-3 AS s22, sum(x1 * r) AS r1, sum(x2 * r) AS r2 FROM rest GROUP BY ALL),
d AS (SELECT batch_id, (r1 * s22 - r2 * s12) / (s11 * s22 - s12 * s12) AS d1, (r2 * s11 - r1 * s12) / (s11 * s22 - s12 * s12) AS d2 FROM m),
e AS (SELECT batch_id, y / 50 - theta * price / 50 - d1 * price * disc - d2 * price * tax AS e FROM obs JOIN best USING (batch_id) JOIN d USING (batch_id) WHERE role = 'test')"""
)


@query("reg25_two_stage", "SELECT batch_id, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM e GROUP BY batch_id", TWO_STAGE, "mse rmse mae", 5)
def reg25(spark, sf):
    """Calibrate theta, then model what the score leaves with a ridge on discount and tax."""
    o = gram_rows(observations(spark, sf))
    labeled, test = by_role(o, ["labeled"]), by_role(o, ["test"])
    theta = R.calibrate(labeled, ["batch_id"], "y", lambda t: t * F.col("price"), *BOX, points=21, rounds=2).select("batch_id", "theta")
    rest = labeled.join(theta, "batch_id").withColumn("r", F.col("y") - F.col("theta") * F.col("price"))
    g = R.gram(rest, ["batch_id"], [*BASIS, "r"])
    d = R.ols(g, ["batch_id"], [*BASIS, "r"], BASIS, "r", ridge=1e-3).select("batch_id", "coef")
    out = test.join(theta, "batch_id").join(d, "batch_id")
    pred = F.col("theta") * F.col("price") + F.element_at("coef", 1) * F.col("price_disc") + F.element_at("coef", 2) * F.col("price_tax")
    return M.regression_metrics(out.withColumn("pred", pred), ["batch_id"])


@query("reg26_reference_baseline", "SELECT batch_id, avg((y - price) ** 2) AS mse, sqrt(avg((y - price) ** 2)) AS rmse, avg(abs(y - price)) AS mae FROM obs WHERE role = 'test' GROUP BY batch_id", OBS, "mse rmse mae")
def reg26(spark, sf):
    from plumbline.functions.registry import score_reference

    return M.regression_metrics(score_reference(by_role(observations(spark, sf), ["test"]), "list_price", 1.0, "pred"), ["batch_id"])


DIAG = """SELECT repeat, n_labeled::INT AS n_labeled, 1 - sum((y - pred) ** 2) / nullif(var_pop(y) * count(y), 0) AS r2, sqrt(sum((b * price_) ** 2)) AS component, sqrt(avg((y - pred) ** 2)) AS residual, bool_or(abs(b - 0.8) < 1e-3 OR abs(b - 1.2) < 1e-3) AS boundary
FROM (SELECT *, (pred - a) / b AS price_ FROM scored WHERE model = 'affine') GROUP BY ALL"""


@query("reg27_diagnostics", DIAG, ARMS, "r2 component residual", 5)
def reg27(spark, sf):
    g = ["repeat", "n_labeled"]
    f = fits(split(spark, sf)).where("model = 'affine'").withColumnRenamed("batch_id", "repeat").drop("model")
    s = scored(spark, sf).where("model = 'affine'").join(f, g).withColumn("part", F.col("pred") - F.col("a"))
    at = s.groupBy(*g).agg(F.sqrt(F.avg((F.col("y") - F.col("pred")) ** 2)).alias("residual"), F.bool_or((F.abs(F.col("b") - BOX[0]) < 1e-3) | (F.abs(F.col("b") - BOX[1]) < 1e-3)).alias("boundary"))
    return M.r_squared(s, g).join(M.magnitudes(s, g, "part").select(*g, F.col("l2").alias("component")), g).join(at, g)
