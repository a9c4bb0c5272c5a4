"""Queries of weakly supervised fits: search, refit, diagnostics, labels scored anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.registry import ColumnLibrary, affine_parts, register_features
from plumbline.operators import metrics as M
from plumbline.operators import regression as R
from plumbline.operators import weakfit as W
from plumbline.operators.splits import by_role
from plumbline.plans.catalog import query
from plumbline.plans.fit_queries import BASIS, BOX, SHAPE, line, solve_sql
from plumbline.plans.stat_queries import gram_rows
from plumbline.plans.tables import OBS, SPLIT, observations, rod_temperature, split

CONDITION = ["batch_id", "n_labeled"]
THETA = {"theta": BOX}
named = lambda *names: {n: (lambda n=n: F.col(n)) for n in names}
UNITS = register_features(
    ColumnLibrary("units", named(*SHAPE), ("price",), named(*BASIS), groups={"shape": ("price", "qty"), "theta": ("theta_price",)})
)
PLAIN = register_features(ColumnLibrary("units without basis", named(*SHAPE), ("price",), groups={"shape": ("price", "qty"), "theta": ("theta_price",)}))
TWO = register_features(ColumnLibrary("two parameters", named(*SHAPE), {"level": ("price",), "load": ("qty", "one")}, groups={"level": ("price", "level_price"), "load": ("qty", "load_qty", "load_one")}))


def columns(library):
    return [*library.shape, *library.basis, "y"]


def role_moments(rows, keys, library, roles):
    """One row for the keys with the moments of each role, from one pass over the rows."""
    m = W.moments(rows, [*keys, "role"], columns(library))
    return m.groupBy(*keys).agg(*[F.max(F.when(F.col("role") == role, F.col("moments"))).alias(name) for role, name in roles.items()])


def conditions(spark, sf, library, start=None):
    """Batch and size with the moments of train, validation and weak rows.  Weak rows carry the reference score at theta 1 instead
    of the measured y; theta0 is `start`, or the calibrated parameter of the train rows."""
    s, weak = gram_rows(split(spark, sf)), gram_rows(by_role(observations(spark, sf), ["weak"])).withColumn("y", F.col("price"))
    own = role_moments(s, CONDITION, library, {"train": "labeled", "validation": "validation"})
    j = own.join(W.moments(weak, ["batch_id"], columns(library), "weak"), "batch_id")
    if start is not None:
        return j.withColumn("theta0", F.array(*[F.lit(float(t)) for t in start]).cast("array<double>"))
    c = W.calibrate_box(s.where("role = 'train'"), CONDITION, "y", lambda v: v["theta"] * F.col("price"), THETA, 21, 1)
    return j.join(c.select(*CONDITION, F.array("theta").alias("theta0")), CONDITION)


def held(spark, sf, library):
    """Moments of the test rows of a batch."""
    return W.moments(gram_rows(by_role(observations(spark, sf), ["test"])), ["batch_id"], columns(library), "test")


def search(c, library=UNITS, weak=(0.0, 0.1), l1=(0.0, 0.01), group=(0.0, 0.01), starts=2, keep=CONDITION, box=THETA, **more):
    return W.fit_conditions(c, list(keep), library, box, list(weak), list(l1), list(group), starts=starts, relative=True, **more)


def chosen_candidates(c, best, keep=CONDITION):
    """Conditions that a fit is begun from: where their chosen candidate ended, with its weights alone."""
    b = best.where("coef is not null").select(*keep, F.col("theta").alias("theta0"), F.col("g").alias("warm_g"), F.col("d").alias("warm_d"), F.array("weak_weight", "l1", "group_weight").alias("chosen"))
    return c.drop("theta0").join(b, list(keep))


def refits(c, best, library=UNITS, keep=CONDITION, box=THETA, **more):
    """The chosen candidates fitted anew to train and validation rows, and which of both fits stays."""
    again = search(chosen_candidates(c, best, keep), library, keep=keep, box=box, starts=1, pooled=True, **more)
    return W.choose_refit(best, again, list(keep))


def weak_fits(spark, sf, **more):
    return search(conditions(spark, sf, UNITS), **more)


@query("reg10_weak_fit")
def reg10(spark, sf):
    """Eight candidates from the calibrated and a random start: scaled columns, named groups, an optimality residual."""
    return weak_fits(spark, sf).drop("history")


# without penalties and basis, and with theta fixed at 1, the fit is a linear system: the same in SQL
WEIGHTS = (0.1, 1.0)
GRID7 = (0.0, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0)


def weak_rows_sql(weights):
    return (
        SPLIT
        + f""", k AS (SELECT * FROM (VALUES {", ".join(f"({w}::DOUBLE)" for w in weights)}) v(k)),
weak AS (SELECT batch_id, price, qty, count(*) OVER (PARTITION BY batch_id) AS n_weak FROM obs WHERE role = 'weak'),
n_train AS (SELECT batch_id, n_labeled, count(*) FILTER (role = 'train') AS n_train, count(*) AS n_both FROM split GROUP BY ALL),
pooled AS (SELECT batch_id, n_labeled, k AS share, role, 1.0::DOUBLE AS one, price / 50 AS price, qty / 50 AS qty, y / 50 AS y, 1.0::DOUBLE AS w, 1.0::DOUBLE AS w_refit FROM split, k
         UNION ALL SELECT batch_id, n_labeled, k, 'weak', 1.0, price / 50, qty / 50, price / 50, k * n_train / n_weak, k * n_both / n_weak FROM weak JOIN n_train USING (batch_id), k),
train AS (SELECT * FROM pooled WHERE role <> 'validation'), """
        + solve_sql("c", "train", "batch_id, n_labeled, share", SHAPE, w="w")
        + ", "
        + solve_sql("r", "pooled", "batch_id, n_labeled, share", SHAPE, w="w_refit")
        + f""", e AS (SELECT batch_id, n_labeled, share, (y - ({line(SHAPE)})) ** 2 AS e2 FROM pooled JOIN c USING (batch_id, n_labeled, share) WHERE role = 'validation'),
v AS (SELECT batch_id, n_labeled, share, avg(e2) AS validation_mse FROM e GROUP BY ALL),
o AS (SELECT batch_id, n_labeled, share, 0.5 * sum(w * (y - ({line(SHAPE)})) ** 2) AS objective FROM train JOIN c USING (batch_id, n_labeled, share) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, n_labeled ORDER BY validation_mse, share) AS p FROM v) WHERE p = 1)"""
    )


WEAK_ROWS = weak_rows_sql(WEIGHTS)
LINEAR = "c_one c_price c_qty"


def linear_conditions(spark, sf):
    return conditions(spark, sf, PLAIN, start=[1.0])


def linear_fits(c, weights=WEIGHTS, **more):
    more = {"scaled": False, **more}
    return search(c, PLAIN, weights, (0.0,), (0.0,), 1, fixed=True, **more)


def effective(f, *more):
    """Coefficients of the shape columns by which rows are scored; what stands for 1 joins the column of ones."""
    at = lambda i: F.element_at("coef", i)
    return f.select(*CONDITION, *more, (at(1) + at(2)).alias("c_one"), at(3).alias("c_price"), at(4).alias("c_qty"))


def share():
    return F.col("weak_weight").alias("share")


@query("reg15_fixed_theta_linear", "SELECT batch_id, n_labeled::INT AS n_labeled, share, objective, b0 AS c_one, b1 AS c_price, b2 AS c_qty, true AS converged FROM c JOIN o USING (batch_id, n_labeled, share)", WEAK_ROWS, "objective " + LINEAR, 5)
def reg15l(spark, sf):
    return effective(linear_fits(linear_conditions(spark, sf)), share(), "objective", "converged")


@query("reg10_weak_fit_linear", "SELECT batch_id, n_labeled::INT AS n_labeled, share, validation_mse, b0 AS c_one, b1 AS c_price, b2 AS c_qty, 'ok' AS status FROM c JOIN v USING (batch_id, n_labeled, share)", WEAK_ROWS, "validation_mse " + LINEAR, 5)
def reg10l(spark, sf):
    """Columns are scaled inside, which changes nothing here."""
    return effective(linear_fits(linear_conditions(spark, sf), scaled=True), share(), "validation_mse", "status")


@query("reg10_two_parameters", "SELECT batch_id, n_labeled::INT AS n_labeled, share, validation_mse, b0 AS c_one, b1 AS c_price, b2 AS c_qty, 0.9::DOUBLE AS level, 1.1::DOUBLE AS load FROM c JOIN v USING (batch_id, n_labeled, share)", WEAK_ROWS, "validation_mse " + LINEAR, 5)
def reg10t(spark, sf):
    """Two fixed parameters over scaled columns span the same columns as none."""
    c = conditions(spark, sf, TWO, start=[0.9, 1.1])
    f = search(c, TWO, WEIGHTS, (0.0,), (0.0,), 1, fixed=True, box={"level": (0.5, 1.5), "load": (0.5, 1.5)})
    return effective(f, share(), "validation_mse", F.element_at("theta", 1).alias("level"), F.element_at("theta", 2).alias("load"))


@query("reg10_two_parameters_free")
def reg10f(spark, sf):
    """Both parameters move within their box."""
    c = conditions(spark, sf, TWO, start=[0.9, 1.1])
    return search(c, TWO, (0.1,), (0.001, 0.01), (0.001, 0.01), 2, box={"level": (0.5, 1.5), "load": (0.5, 1.5)}).drop("history")


ONE = register_features(ColumnLibrary("one column", named("price"), groups={"price": ("price",)}))
PENALIZED = (
    SPLIT
    + """, far AS (SELECT batch_id, price, count(*) OVER (PARTITION BY batch_id) AS n_weak FROM obs WHERE role = 'weak'),
own AS (SELECT batch_id, n_labeled, price / 50 AS x, y / 50 AS y FROM split WHERE role = 'train'),
size AS (SELECT batch_id, n_labeled, count(*) AS n, avg(y) AS ym, stddev_pop(y) AS ys FROM own GROUP BY ALL),
mixed AS (SELECT batch_id, n_labeled, x, y, 1.0::DOUBLE AS w FROM own UNION ALL SELECT batch_id, n_labeled, price / 50, price / 50, 0.1 * n / n_weak FROM far JOIN size USING (batch_id)),
scale AS (SELECT batch_id, n_labeled, avg(x) AS xm, stddev_pop(x) AS xs FROM mixed GROUP BY ALL),
m AS (SELECT batch_id, n_labeled, sum(w * ((x - xm) / xs) ** 2) AS q, sum(w * (x - xm) / xs * (y - ym) / ys) AS c FROM mixed JOIN scale USING (batch_id, n_labeled) JOIN size USING (batch_id, n_labeled) GROUP BY ALL)"""
)


@query("reg10_penalized_column", "SELECT batch_id, n_labeled::INT AS n_labeled, l1, group_weight, sign(c) * greatest(greatest(abs(c) - l1, 0) - group_weight, 0) / q AS g FROM m, (VALUES (0.3::DOUBLE), (3.0)) a(l1), (VALUES (0.0::DOUBLE), (2.0)) b(group_weight)", PENALIZED, "g")
def reg10p(spark, sf):
    """One scaled column under both penalties: what is left after two thresholds."""
    f = search(conditions(spark, sf, ONE, start=[]), ONE, (0.1,), (0.3, 3.0), (0.0, 2.0), 1, box={})
    return f.select(*CONDITION, "l1", "group_weight", F.element_at("g", 1).alias("g"))


@query("reg15_fixed_theta")
def reg15(spark, sf):
    return search(conditions(spark, sf, UNITS, start=[1.0]), starts=1, fixed=True).drop("history")


@query("reg18_search")
def reg18(spark, sf):
    """Seven weights of each kind, 343 candidates a condition, the valid one of least validation error."""
    penalties = (0.0, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3)
    return W.select(weak_fits(spark, sf, weak=GRID7, l1=penalties, group=penalties, starts=1), CONDITION).drop("history")


@query("reg18_search_linear", "SELECT batch_id, n_labeled::INT AS n_labeled, 2::BIGINT AS n_candidates, 2::BIGINT AS n_valid, share, validation_mse, b0 AS c_one, b1 AS c_price, b2 AS c_qty FROM best JOIN c USING (batch_id, n_labeled, share)", WEAK_ROWS, "validation_mse " + LINEAR, 5)
def reg18l(spark, sf):
    return effective(W.select(linear_fits(linear_conditions(spark, sf)), CONDITION), "n_candidates", "n_valid", share(), "validation_mse")


LIMIT = 0.0025  # of the validation error, in units of gram_rows: some conditions have no candidate below it


@query("reg18_search_with_limit", f"SELECT batch_id, n_labeled::INT AS n_labeled, n_valid, share, validation_mse FROM (SELECT batch_id, n_labeled, count(*) FILTER (validation_mse <= {LIMIT}) AS n_valid, arg_min(share, validation_mse) FILTER (validation_mse <= {LIMIT}) AS share, min(validation_mse) FILTER (validation_mse <= {LIMIT}) AS validation_mse FROM v GROUP BY ALL)", WEAK_ROWS, "validation_mse", 8)
def reg18m(spark, sf):
    """Conditions without a valid candidate stay, without a choice."""
    return W.select(linear_fits(linear_conditions(spark, sf)), CONDITION, LIMIT).select(*CONDITION, "n_valid", share(), "validation_mse")


RULE = """SELECT batch_id, n_labeled::INT AS n_labeled, max(share) AS share FROM v JOIN (SELECT batch_id, n_labeled, min(validation_mse) + arg_min(se, validation_mse) AS bar FROM (SELECT batch_id, n_labeled, share, avg(e2) AS validation_mse, coalesce(stddev_samp(e2), 0) / sqrt(count(*)) AS se FROM e GROUP BY ALL) GROUP BY ALL) USING (batch_id, n_labeled) WHERE validation_mse <= bar GROUP BY ALL"""


def rule_of_rows(spark, sf, f, library):
    """The heaviest valid candidate within one standard error, of the validation rows' squared errors, of the least."""
    validation = gram_rows(split(spark, sf).where("role = 'validation'"))
    weights = ["weak_weight", "l1", "group_weight", "start"]
    e = W.row_errors(validation, f.where(W.valid()), CONDITION, weights, library)
    return R.one_standard_error(e, CONDITION, "mse", "deviation", "n")


@query("reg19_one_standard_error", RULE, weak_rows_sql(GRID7))
def reg19(spark, sf):
    f = linear_fits(linear_conditions(spark, sf), GRID7)
    return rule_of_rows(spark, sf, f, PLAIN).select(*CONDITION, share())


@query("reg19_weak_fit_rule")
def reg19w(spark, sf):
    """The rule over penalized candidates from two starts."""
    return rule_of_rows(spark, sf, weak_fits(spark, sf, weak=GRID7), UNITS)


@query("reg19_row_errors", "SELECT batch_id, n_labeled::INT AS n_labeled, share, count(*) AS n, avg(e2) AS mse, coalesce(stddev_samp(e2), 0) AS deviation FROM e GROUP BY ALL", weak_rows_sql(GRID7), "mse deviation", 7)
def reg19e(spark, sf):
    f = linear_fits(linear_conditions(spark, sf), GRID7)
    validation = gram_rows(split(spark, sf).where("role = 'validation'"))
    return W.row_errors(validation, f, CONDITION, ["weak_weight"], PLAIN).select(*CONDITION, share(), "n", "mse", "deviation")


@query("reg20_refit")
def reg20(spark, sf):
    """Selected on validation rows, fitted anew to both parts from where the selected fit ended."""
    c = conditions(spark, sf, UNITS)
    return refits(c, W.select(search(c), CONDITION))


@query("reg20_refit_linear", "SELECT batch_id, n_labeled::INT AS n_labeled, b0 AS c_one, b1 AS c_price, b2 AS c_qty, 'refit' AS source FROM best JOIN r USING (batch_id, n_labeled, share)", WEAK_ROWS, LINEAR, 5)
def reg20l(spark, sf):
    c = linear_conditions(spark, sf)
    return effective(refits(c, W.select(linear_fits(c), CONDITION), PLAIN, fixed=True, scaled=False), "source")


@query("udf03_group_function_linear", "SELECT batch_id, n_labeled::INT AS n_labeled, objective, true AS converged, 'ok' AS status FROM o WHERE share = 0.1", WEAK_ROWS, "objective", 5)
def udf03l(spark, sf):
    """The fit function over moments, one complete group a row."""
    return linear_fits(linear_conditions(spark, sf), (0.1,)).select(*CONDITION, "objective", "converged", "status")


@query("udf03_group_function")
def udf03(spark, sf):
    """A fit function over rows of moments, one complete group a row, candidates in parallel."""
    f = weak_fits(spark, sf, weak=(0.1,), l1=(0.0,), group=(0.0,))
    return f.select(*CONDITION, "start", "theta0", "theta", "objective", "converged", "status")


# diagnostics ---------------------------------------------------------------------------------------
def diagnosed(spark, sf, c, best, library):
    full = best.where("coef is not null").select(*CONDITION, "coef", "g", "theta", "validation_mse").join(c.select(*CONDITION, "labeled", "weak"), CONDITION).join(held(spark, sf, library), "batch_id")
    return W.diagnose(full, CONDITION, library, THETA)


@query("reg27_weak_fit_diagnostics")
def reg27w(spark, sf):
    """Diagnostics of the selected weak fit of each condition."""
    c = conditions(spark, sf, UNITS)
    return diagnosed(spark, sf, c, W.select(search(c), CONDITION), UNITS)


PARTS = (
    WEAK_ROWS
    + f""", chosen AS (SELECT batch_id, n_labeled, b0, b1, b2 FROM best JOIN c USING (batch_id, n_labeled, share)),
seen AS (SELECT batch_id, n_labeled, role, y, {line(SHAPE)} AS pred FROM pooled JOIN chosen USING (batch_id, n_labeled) WHERE share = 0.1),
held AS (SELECT batch_id, n_labeled, sqrt(sum(({line(SHAPE)}) ** 2)) AS shape_norm, sqrt(avg((y - ({line(SHAPE)})) ** 2)) AS residual FROM (SELECT batch_id, 1.0::DOUBLE AS one, price / 50 AS price, qty / 50 AS qty, y / 50 AS y FROM obs WHERE role = 'test') JOIN chosen USING (batch_id) GROUP BY ALL)"""
)


@query(
    "reg27_weak_fit_diagnostics_linear",
    "SELECT batch_id, n_labeled::INT AS n_labeled, 1 - sum((y - pred) ** 2) FILTER (role = 'weak') / (var_pop(y) FILTER (role = 'weak') * count(*) FILTER (role = 'weak')) AS weak_r2, 1 - sum((y - pred) ** 2) FILTER (role = 'train') / (var_pop(y) FILTER (role = 'train') * count(*) FILTER (role = 'train')) AS train_r2, any_value(shape_norm) AS shape_norm, 0.0::DOUBLE AS basis_norm, any_value(residual) AS residual, avg((y - pred) ** 2) FILTER (role = 'validation') - avg((y - pred) ** 2) FILTER (role = 'train') AS validation_gap, false AS at_bound FROM seen JOIN held USING (batch_id, n_labeled) GROUP BY ALL",
    PARTS, "weak_r2 train_r2 shape_norm basis_norm residual validation_gap", 5,
)
def reg27l(spark, sf):
    c = linear_conditions(spark, sf)
    return diagnosed(spark, sf, c, W.select(linear_fits(c), CONDITION), PLAIN).drop("g_norm_shape", "g_norm_theta")


# labels scored anew --------------------------------------------------------------------------------
@query("reg10_weak_fit_refreshed")
def reg10r(spark, sf):
    """Weak labels are mapped to the measured scale and scored anew at the current theta in every sweep; a condition stops on
    its own."""
    c = conditions(spark, sf, UNITS)
    train = gram_rows(split(spark, sf)).where("role = 'train'").join(c.select(*CONDITION, "theta0"), CONDITION).withColumn("score", F.element_at("theta0", 1) * F.col("price"))
    phi = R.affine_align(train, CONDITION, "y", "score").select(*CONDITION, F.array("a", "b").alias("phi"))
    weak = gram_rows(by_role(observations(spark, sf), ["weak"])).select("batch_id", *SHAPE, F.col("price").alias("y"))
    f = W.refresh_fits(c.join(phi, CONDITION), weak, CONDITION, ["batch_id"], UNITS, THETA, lambda v: v["theta"] * F.col("price"), 0.01, 0.01, 0.01, rule=W.Rule(sweeps=20))
    return f.drop("history").withColumn("drift", F.array_max("drift"))


LOAD = register_features(ColumnLibrary("rod load", {"load": lambda: F.col("load")}, ("load",), plain=()))
ROD_BOX, ROD_WEIGHT, ROD_L1 = (1 / 35, 1 / 15), 0.1, 0.02


def rod_rows(spark, sf):
    """Line items as heated rods: flux by price, convection by quantity, surroundings by part size; temperatures above the lower end's, in hundreds.
    Measured ones at 1 / 25 with a mechanism of discount, weak ones at 1 / 20."""
    o = by_role(observations(spark, sf), ["labeled", "weak"])
    hot = lambda t: (rod_temperature(F.col("price") * 1000, F.col("qty"), F.col("size") + 273, t) - 293.15) / 100
    y = F.when(F.col("role") == "labeled", hot(F.lit(0.04)) * (1 + F.col("disc"))).otherwise(hot(F.lit(0.05)))
    return o.select("batch_id", "role", "price", "qty", "size", (F.col("price") / F.col("qty")).alias("load"), y.alias("y")), hot


def rod_sql(theta):
    """The closed form over 100, above the lower end."""
    a = f"(price * 1000 * 0.1 * (0.1 * {theta} / 2 + 1 / qty) + size + 273 - 293.15) / (0.1 + 1 / (qty * {theta}))"
    return f"({a} * 0.1 / 2 - price * 1000 * {theta} * 0.01 / 8) / 100"


def _sweep_sql(k: int) -> str:
    """Sweep k from theta of th{k - 1}: labels, g by its threshold, theta within the box."""
    before = f"th{k - 1}"
    old = "y" if k == 1 else rod_sql("t_before")
    return f""", lab{k} AS (SELECT batch_id, load, {rod_sql('theta')} AS label, abs({rod_sql('theta')} - {old}) AS moved FROM rods JOIN {before} USING (batch_id) WHERE role = 'weak'),
w{k} AS (SELECT batch_id, sum(load * label) AS wy, max(moved) AS drift FROM lab{k} GROUP BY ALL),
g{k} AS (SELECT batch_id, theta, ly + {ROD_WEIGHT} * wy AS c, ll + {ROD_WEIGHT} * ww AS q, w{k}.drift AS drift FROM {before} JOIN sums USING (batch_id) JOIN w{k} USING (batch_id)),
h{k} AS (SELECT *, sign(c) * greatest(abs(theta * c) - {ROD_L1}, 0) / (theta * theta * q) AS g FROM g{k}),
th{k} AS (SELECT batch_id, theta AS t_before, least({ROD_BOX[1]!r}, greatest({ROD_BOX[0]!r}, c / (g * q))) AS theta, g, drift FROM h{k})"""


RODS = (
    OBS
    + f""", rods AS (SELECT batch_id, role, price, qty, size, price / qty AS load, CASE WHEN role = 'labeled' THEN {rod_sql('0.04')} * (1 + disc) ELSE {rod_sql('0.05')} END AS y FROM obs WHERE role <> 'test'),
sums AS (SELECT batch_id, sum(load * load) FILTER (role = 'labeled') AS ll, sum(load * y) FILTER (role = 'labeled') AS ly, sum(load * load) FILTER (role = 'weak') AS ww FROM rods GROUP BY ALL),
th0 AS (SELECT batch_id, 0.03::DOUBLE AS theta FROM sums)"""
    + _sweep_sql(1)
    + _sweep_sql(2)
    + f""", fin AS (SELECT batch_id, (SELECT 0.5 * sum((y - th2.theta * g * load) ** 2) FROM rods WHERE rods.batch_id = th2.batch_id AND role = 'labeled') + {ROD_WEIGHT} * 0.5 * (SELECT sum((label - th2.theta * g * load) ** 2) FROM lab2 WHERE lab2.batch_id = th2.batch_id) + {ROD_L1} * abs(g) AS objective, theta, g, drift FROM th2)"""
)


@query("reg13_refresh_sweeps", "SELECT batch_id, fin.theta AS theta, fin.g AS g, objective, w1.drift AS first_drift, fin.drift AS last_drift, 2 AS sweeps FROM fin JOIN w1 USING (batch_id)", RODS, "theta g objective first_drift last_drift", 5)
def reg13s(spark, sf):
    """Two sweeps of a reference that is not linear in theta: labels, threshold, box."""
    rows, hot = rod_rows(spark, sf)
    c = role_moments(rows, ["batch_id"], LOAD, {"labeled": "labeled", "weak": "weak"}).withColumn("theta0", F.array(F.lit(0.03)))
    weak = rows.where("role = 'weak'").drop("role")
    f = W.refresh_fits(c, weak, ["batch_id"], ["batch_id"], LOAD, {"theta": ROD_BOX}, lambda v: hot(v["theta"]), ROD_WEIGHT, ROD_L1, scaled=False, rule=W.Rule(sweeps=2, objective=0.0, change=0.0))
    at = lambda n, k: F.element_at(n, k)
    return f.select("batch_id", at("theta", 1).alias("theta"), at("g", 1).alias("g"), "objective", at("drift", 1).alias("first_drift"), at("drift", 2).alias("last_drift"), "sweeps")


@query("reg13_refresh_until_settled")
def reg13u(spark, sf):
    """Sweeps of the heated rod until each batch settles, over scaled columns and a basis of price."""
    rows, hot = rod_rows(spark, sf)
    library = ColumnLibrary("rods", {"one": lambda: F.lit(1.0), "price": lambda: F.col("price"), "load": lambda: F.col("load")}, {"theta": ("price", "load")}, groups={"price": ("price", "theta_price"), "load": ("load", "theta_load")})
    rows = rows.withColumn("one", F.lit(1.0))
    c = role_moments(rows, ["batch_id"], library, {"labeled": "labeled", "weak": "weak"}).withColumn("theta0", F.array(F.lit(0.05)))
    f = W.refresh_fits(c, rows.where("role = 'weak'").drop("role"), ["batch_id"], ["batch_id"], library, {"theta": ROD_BOX}, lambda v: hot(v["theta"]), 0.001, 0.01, 0.01, rule=W.Rule(sweeps=12))
    return f.select("batch_id", F.element_at("theta", 1).alias("theta"), "sweeps", "converged", F.element_at("drift", -1).alias("last_drift"))


# moments and calibration ---------------------------------------------------------------------------
@query("agg21_moments", "SELECT supp, count(*) AS n, avg(price) AS mean_price, avg(y) AS mean_y, var_pop(price) * count(*) AS price__price, covar_pop(price, y) * count(*) AS price__y, var_pop(y) * count(*) AS y__y FROM obs GROUP BY supp", OBS, "mean_price mean_y price__price price__y y__y", 5)
def agg21m(spark, sf):
    """Centred products, merged pairwise."""
    m = W.moments(observations(spark, sf), ["supp"], ["price", "y"]).select("supp", "moments.*")
    at = lambda n, k: F.element_at(n, k)
    return m.select("supp", "n", at("mean", 1).alias("mean_price"), at("mean", 2).alias("mean_y"), *[at("co", k + 1).alias(n) for k, n in enumerate(("price__price", "price__y", "y__y"))])


BOXES = {"level": (0.8, 1.2), "discount": (0.0, 2.0)}


@query(
    "reg07_calibration_two_parameters",
    "SELECT batch_id, arg_min(level, (loss, i, j)) AS level, arg_min(discount, (loss, i, j)) AS discount, min(loss) AS loss FROM (SELECT batch_id, i, j, 0.8 + 0.05 * i AS level, 0.25 * j AS discount, avg((y - (0.8 + 0.05 * i) * price * (1 - 0.25 * j * disc)) ** 2) AS loss FROM obs, range(9) a(i), range(9) b(j) GROUP BY ALL) GROUP BY batch_id",
    OBS, "level discount loss",
)
def reg07t(spark, sf):
    return W.calibrate_box(observations(spark, sf), ["batch_id"], "y", lambda v: v["level"] * F.col("price") * (1 - v["discount"] * F.col("disc")), BOXES, 9, 1)


@query("reg07_calibration_two_parameters_rounds")
def reg07u(spark, sf):
    return W.calibrate_box(observations(spark, sf), ["supp"], "y", lambda v: v["level"] * F.col("price") * (1 - v["discount"] * F.col("disc")), BOXES, 9, 4)


@query("prj11_affine_parts_two", "SELECT ord, 2.0 + 0.5 * (price / 50) - 0.1 * (qty / 50) AS c, 0.25 * (price / 50) AS slope_level, 0.75 - 0.5 * (qty / 50) AS slope_load FROM obs", OBS, "c slope_level slope_load", 10)
def prj11t(spark, sf):
    """A slope for each of two parameters."""
    g = {"one": 2.0, "price": 0.5, "qty": -0.1, "level_price": 0.25, "load_qty": -0.5, "load_one": 0.75}
    return affine_parts(gram_rows(observations(spark, sf)), "two parameters", g, ["ord"])


# ridge baseline ------------------------------------------------------------------------------------
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
INPUTS = ["price", "qty", "disc", "tax"]
RIDGE_INPUTS = register_features(ColumnLibrary("inputs", named(*INPUTS)))


def ridge_arm(spark, sf):
    """The standardized ridge of each condition and its test metrics."""
    c = role_moments(split(spark, sf), CONDITION, RIDGE_INPUTS, {"train": "labeled", "validation": "validation"})
    test = by_role(observations(spark, sf), ["test"]).select("batch_id", *INPUTS, "y")
    return M.regression_metrics(W.score(test, W.ridge_search(c, CONDITION, list(ALPHAS)), ["batch_id"], RIDGE_INPUTS), [*CONDITION, "alpha", "validation_mse"])


def ridge_sql(name: str, source: str, g: str, alpha: str) -> str:
    """CTEs of the ridge of y on standardized inputs by group: {name} holds g, the scaling and b0, b1, ... of the scaled columns."""
    scale = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) < 1e-12 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in INPUTS)
    out = f"{name}_s AS (SELECT {g}, avg(y) AS m_y, {scale} FROM {source} GROUP BY ALL), {name}_z AS (SELECT {g}, {alpha} AS alpha_, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in INPUTS) + f", y - m_y AS y FROM {source} JOIN {name}_s USING ({g})), "
    p, cells = len(INPUTS), [(i, j) for i in range(len(INPUTS)) for j in range(len(INPUTS) + 1)]
    column = lambda j: INPUTS[j] if j < p else "y"
    out += f"{name}_0 AS (SELECT {g}, " + ", ".join(f"sum({INPUTS[i]} * {column(j)})" + (" + any_value(alpha_)" if i == j else "") + f" AS m{i}_{j}" for i, j in cells) + f" FROM {name}_z GROUP BY {g})"
    for k in range(p):
        row = {(i, j): f"m{k}_{j} / m{k}_{k}" if i == k else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k}" for i, j in cells}
        out += f", {name}_{k + 1} AS (SELECT {g}, " + ", ".join(f"{row[c]} AS m{c[0]}_{c[1]}" for c in cells) + f" FROM {name}_{k})"
    return out + f", {name} AS (SELECT * FROM {name}_s JOIN (SELECT {g}, " + ", ".join(f"m{i}_{p} AS b{i}" for i in range(p)) + f" FROM {name}_{p}) USING ({g}))"


RIDGE_LINE = "m_y + " + " + ".join(f"b{i} * ({c} - m_{c}) / s_{c}" for i, c in enumerate(INPUTS))
RIDGES = (
    SPLIT
    + f""", al AS (SELECT * FROM (VALUES {", ".join(f"({a}::DOUBLE)" for a in ALPHAS)}) v(alpha)), own AS (SELECT batch_id, n_labeled, alpha, role, {", ".join(INPUTS)}, y FROM split, al), tr AS (SELECT * FROM own WHERE role = 'train'), """
    + ridge_sql("f", "tr", "batch_id, n_labeled, alpha", "alpha")
    + f""", lo AS (SELECT batch_id, n_labeled, alpha, avg((y - ({RIDGE_LINE})) ** 2) AS validation_mse FROM (SELECT * FROM own WHERE role = 'validation') JOIN f USING (batch_id, n_labeled, alpha) GROUP BY ALL),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, n_labeled ORDER BY validation_mse, alpha) AS p FROM lo) WHERE p = 1), """
    + ridge_sql("rg", "own", "batch_id, n_labeled, alpha", "alpha")
)
RIDGE_TEST = f"SELECT batch_id, n_labeled, alpha, validation_mse, y - ({RIDGE_LINE}) AS e FROM pick JOIN rg USING (batch_id, n_labeled, alpha) JOIN (SELECT batch_id, {', '.join(INPUTS)}, y FROM obs WHERE role = 'test') USING (batch_id)"


@query("reg21_ridge_standardized", f"SELECT batch_id, n_labeled::INT AS n_labeled, alpha, validation_mse, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM ({RIDGE_TEST}) GROUP BY ALL", RIDGES, "validation_mse mse rmse mae", 5)
def reg21s(spark, sf):
    """Four standardized inputs with an intercept, five alphas chosen on validation rows, fitted anew to both parts."""
    return ridge_arm(spark, sf)
