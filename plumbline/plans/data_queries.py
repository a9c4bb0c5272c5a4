"""Queries of sources, sinks, projections, filters, splits and joins."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import expressions as X
from plumbline.functions import registry
from plumbline.operators import gates, joins, splits
from plumbline.operators import metrics as M
from plumbline.operators import regression as R
from plumbline.plans.catalog import query
from plumbline.plans.tables import ARMS, OBS, SIZES, SPLIT, arm_metrics, observations, scored, split, table
from plumbline.sources import batches as S
from plumbline.sources.shared import scratch

COLUMNS = ["price", "qty", "disc", "tax", "y"]
REGIONS = {1: "AFRICA", 2: "AMERICA", 3: "ASIA", 4: "EUROPE", 5: "MIDDLE EAST"}


def write_csv(df: DataFrame, path: str, comment: str) -> None:
    """CSV parts that begin with a comment line and a header."""
    head, names = f"# {comment}\n{','.join(df.columns)}", df.columns

    def lines(parts):
        first = True
        for pdf in parts:
            rows = pdf[names].astype(str).agg(",".join, axis=1).tolist() if len(pdf) else []
            yield pd.DataFrame({"value": [head] * first + rows})
            first = False

    text = df.select(*[F.col(c).cast("string").alias(c) for c in names])
    text.mapInPandas(lines, "value string").write.text(path)


def export(spark, sf_dir) -> str:
    """The observations as batch directories with metadata."""
    root = scratch(spark, "batches")
    # the joined source is read once; each file is written from its own partition
    observations(spark, sf_dir).write.partitionBy("batch_id", "role").parquet(f"{root}/staged")
    obs = spark.read.parquet(f"{root}/staged")
    for k, region in REGIONS.items():
        own = obs.where(F.col("batch_id") == region)
        for role, file in S.ROLES.items():
            write_csv(own.where(F.col("role") == role).select("ord", *COLUMNS).withColumn("ord", F.conv(F.substring("ord", 1, 8), 16, 10).cast("double")), f"{root}/batch_{k:02d}/{file}", f"{region} {role}")
        sums = S.file_checksums(spark, f"{root}/batch_{k:02d}/*.csv/part-*").groupBy().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("file", "found")))).alias("sha256"))
        facts = own.agg(F.avg("price").alias("k_true"), F.stddev_pop("y").alias("sigma"))
        meta = facts.crossJoin(sums).select(F.to_json(F.struct(F.lit(k).alias("batch_index"), "k_true", "sigma", F.struct(F.lit(0.3).alias("threshold_p95"), F.lit(True).alias("pass")).alias("coverage"), "sha256")).alias("value"))
        meta.coalesce(1).write.text(f"{root}/batch_{k:02d}/metadata.json")
    return root


NAMED = "CASE batch_id WHEN 'AFRICA' THEN 'batch_01' WHEN 'AMERICA' THEN 'batch_02' WHEN 'ASIA' THEN 'batch_03' WHEN 'EUROPE' THEN 'batch_04' ELSE 'batch_05' END"


@query("src01_commented_csv", "SELECT qty, count(*) AS n, sum(disc) AS disc, sum(y) AS y FROM obs GROUP BY qty", OBS, "disc y", 4)
def src01(spark, sf):
    path = scratch(spark, "measurements")
    write_csv(observations(spark, sf).select(*COLUMNS), path, "all rows")
    d = S.read_measurements(spark, path, S.measurement_schema(["qty", "disc", "y"]))
    return d.groupBy("qty").agg(F.count(F.lit(1)).alias("n"), F.sum("disc").alias("disc"), F.sum("y").alias("y"))


@query("src02_batch_directories", f"SELECT {NAMED} AS batch_id, role, count(*) AS n, sum(y) AS y FROM obs GROUP BY ALL", OBS, "y", 4)
def src02(spark, sf):
    d = S.read_batches(spark, export(spark, sf), dict.fromkeys(S.ROLES, ["ord", *COLUMNS]), "ord")
    return d.groupBy("batch_id", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))


@query("src03_batch_metadata", f"SELECT {NAMED} AS batch_id, avg(price) AS k_true, stddev_pop(y) AS sigma, 0.3::DOUBLE AS threshold_p95, true AS covered FROM obs GROUP BY batch_id", OBS, "k_true sigma")
def src03(spark, sf):
    return S.read_batch_metadata(spark, export(spark, sf)).select("batch_id", "k_true", "sigma", "threshold_p95", "covered")


@query("src04_json_payload", "SELECT event_type, count(*) AS n, avg(CAST(props->>'k' AS DOUBLE)) AS mean_k FROM events GROUP BY event_type", "", "mean_k")
def src04(spark, sf):
    d = S.read_metrics(table(spark, sf, "events"), "props", "k int")
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("details.k").alias("mean_k"))


@query("src05_flat_summary", "SELECT model, n_labeled, avg(mse) AS mse_mean, stddev_samp(mse) AS mse_std FROM metrics GROUP BY ALL", ARMS, "mse_mean mse_std")
def src05(spark, sf):
    m = arm_metrics(spark, sf).groupBy("model", "n_labeled").agg(F.avg("mse"), F.stddev_samp("mse"))
    return S.flatten_summary(m, ["model", "n_labeled"])


@query("src06_checksums", f"SELECT {NAMED} AS batch_id, true AS ok FROM obs GROUP BY batch_id", OBS)
def src06(spark, sf):
    root = export(spark, sf)
    want = S.read_batch_metadata(spark, root).select("batch_id", F.explode("sha256").alias("file", "expected"))
    have = S.file_checksums(spark, f"{root}/batch_[0-9][0-9]/*.csv/part-*")
    ok = F.coalesce(F.col("expected") == F.col("found"), F.lit(False))
    return want.join(have, ["batch_id", "file"], "full").groupBy("batch_id").agg(F.bool_and(ok).alias("ok"))


HASHED = "md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_quantity::INT)"


@query(
    "src07_fingerprint",
    f"SELECT l_suppkey, md5(n || '-' || a || '-' || b) AS dataset_id FROM (SELECT l_suppkey, count(*) AS n, sum(('0x' || substr(h, 1, 12))::HUGEINT) AS a, sum(('0x' || substr(h, 13, 12))::HUGEINT) AS b FROM (SELECT l_suppkey, {HASHED} AS h FROM lineitem) GROUP BY l_suppkey)",
)
def src07(spark, sf):
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")] + [F.col("l_quantity").cast("int").cast("string")]
    return S.fingerprint(table(spark, sf, "lineitem"), ["l_suppkey"], parts)


@query("snk01_artifacts", "SELECT 'curve' AS experiment, model, count(*) AS n, avg(mse) AS mse FROM metrics GROUP BY model", ARMS, "mse")
def snk01(spark, sf):
    path = scratch(spark, "artifacts")
    m = arm_metrics(spark, sf).withColumn("experiment", F.lit("curve"))
    S.write_artifacts({"metrics": m, "summary": M.summarize(m, ["experiment", "model", "n_labeled"])}, path)
    back = spark.read.parquet(f"{path}/metrics")
    return back.groupBy("experiment", "model").agg(F.count(F.lit(1)).alias("n"), F.avg("mse").alias("mse"))


@query(
    "snk02_append_gates",
    "SELECT 'finite_metrics' AS \"check\", 'pass' AS status, (count(*) FILTER (mse IS NULL))::DOUBLE AS value, NULL::VARCHAR AS value_text, '= 0' AS threshold FROM metrics UNION ALL SELECT 'rows', 'info', count(*)::DOUBLE, NULL, '' FROM metrics",
    ARMS,
)
def snk02(spark, sf):
    m, path = arm_metrics(spark, sf), scratch(spark, "gates")
    bad = F.count_if(~X.is_finite("mse"))
    S.append_gates(gates.gate(m, "finite_metrics", bad, bad == 0, "= 0"), gates.info(m, "rows", F.count(F.lit(1)))).write.parquet(path)
    return spark.read.parquet(path)


@query("snk03_write_once", "SELECT role, count(*) AS n, true AS refused FROM obs GROUP BY role", OBS)
def snk03(spark, sf):
    path, o = scratch(spark, "batch"), observations(spark, sf)
    S.write_batch(o, path)
    refused = False
    try:
        S.write_batch(o.limit(0), path)
    except AnalysisException as e:
        refused = e.getCondition() == "PATH_ALREADY_EXISTS"
    return spark.read.parquet(path).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.lit(refused).alias("refused"))


# projections -------------------------------------------------------------------------------------
def obs_query(name, columns, sql, doubles):
    return query(name, f"SELECT ord, {sql} FROM obs", OBS, doubles, 10)(lambda spark, sf: observations(spark, sf).select("ord", *columns()))


@query("prj01_reference_score", "SELECT ord, 1.1 * price AS score, y - 1.1 * price AS gap FROM obs", OBS, "score gap")
def prj01(spark, sf):
    return registry.score_reference(observations(spark, sf), "list_price", 1.1).select("ord", "score", (F.col("y") - F.col("score")).alias("gap"))


obs_query("prj02_mechanism_column", lambda: [(F.col("price") * F.col("disc") / (1 + F.col("tax"))).alias("flux")], "price * disc / (1 + tax) AS flux", "flux")


@query("prj03_biased_reference", "SELECT ord, role, CASE WHEN role = 'weak' THEN price + 0.5 * (price * tax - price * disc) END AS y_weak FROM obs", OBS, "y_weak", 10)
def prj03(spark, sf):
    o = observations(spark, sf)
    discrepancy = F.col("price") * F.col("tax") - F.col("price") * F.col("disc")
    return o.select("ord", "role", F.when(F.col("role") == "weak", F.col("price") + 0.5 * discrepancy).alias("y_weak"))


@query("prj04_affine_features", "SELECT ord, 1.0::DOUBLE AS one, price, qty / 10 AS qty, 0.9 * price AS theta_price FROM obs", OBS, "price qty theta_price")
def prj04(spark, sf):
    return registry.features_h(observations(spark, sf), "charge", 0.9, ["ord"])


def named(columns: dict) -> list:
    return [c.alias(n) for n, c in columns.items()]


obs_query("prj05_inverse_powers", lambda: named(X.inverse_powers("qty", "size")), "size, 1 / size AS inv_size, size ** -0.5 AS root_size, qty / size AS qty_inv_size, qty * size ** -0.5 AS qty_root_size", "inv_size root_size qty_inv_size qty_root_size")
obs_query("prj06_mechanism_product", lambda: named(X.mechanism_product("price", "size")), "price * size ** -0.7 AS price_pow, price * size ** -0.7 * (1 + 1 / size) AS price_mod", "price_pow price_mod")
obs_query(
    "prj07_poly2", lambda: named(X.poly2(["price", "qty", "disc"], {"price"})),
    'qty, disc, price * price AS "price*price", price * qty AS "price*qty", price * disc AS "price*disc", qty * qty AS "qty*qty", qty * disc AS "qty*disc", disc * disc AS "disc*disc"', "price*price price*qty price*disc qty*disc disc*disc",
)
query("prj08_power_grid", "SELECT ord, qty * size ** -0.9 AS qty_p0, qty * size ** -0.7 AS qty_p1, qty * size ** 0.45 AS qty_p2, price * size ** -0.9 AS price_p0, price * size ** -0.7 AS price_p1, price * size ** 0.45 AS price_p2 FROM obs", OBS, "qty_p0 qty_p1 qty_p2 price_p0 price_p1 price_p2")(
    lambda spark, sf: observations(spark, sf).select("ord", *named(X.power_grid(["qty", "price"], "size", [-0.9, -0.7, 0.45])))
)
obs_query("prj09_intercept", lambda: [F.lit(1.0).alias("one")], "1.0::DOUBLE AS one", "")
RATIO = "qty / size AS ratio, size / qty AS inverse, (qty - size) / (qty + size) AS difference"
obs_query("prj10_ratio_basis", lambda: named(X.ratio_basis("qty", "size")), RATIO, "ratio inverse difference")
obs_query(
    "prj10_ratio_basis_expanded", lambda: named(X.ratio_basis("qty", "size", True)),
    RATIO + ", (qty / size) ** 2 AS ratio2, (size / qty) ** 2 AS inverse2, ((qty - size) / (qty + size)) ** 2 AS difference2, qty / size * qty AS ratio_a, qty / size * size AS ratio_b, size / qty * qty AS inverse_a, size / qty * size AS inverse_b, (qty - size) / (qty + size) * qty AS difference_a, (qty - size) / (qty + size) * size AS difference_b",
    "ratio inverse difference ratio2 inverse2 difference2 ratio_a ratio_b inverse_a inverse_b difference_a difference_b",
)


@query("prj11_affine_parts", "SELECT ord, 2.0 + 0.5 * price - 0.1 * (qty / 10) AS c, 0.25 * price AS slope FROM obs", OBS, "c slope", 10)
def prj11(spark, sf):
    return registry.affine_parts(observations(spark, sf), "charge", {"one": 2.0, "price": 0.5, "qty": -0.1, "theta_price": 0.25}, ["ord"])


SCALER = ", sc AS (SELECT batch_id, avg(price) AS pm, CASE WHEN stddev_pop(price) < 1e-12 THEN 1 ELSE stddev_pop(price) END AS ps, avg(qty) AS qm, CASE WHEN stddev_pop(qty) < 1e-12 THEN 1 ELSE stddev_pop(qty) END AS qs, avg(y) AS ym, stddev_pop(y) AS ys FROM obs WHERE role <> 'test' GROUP BY batch_id)"


@query("prj12_standardize", "SELECT ord, 1.0::DOUBLE AS one, (price - pm) / ps AS price, (qty - qm) / qs AS qty FROM obs JOIN sc USING (batch_id) WHERE role = 'test'", OBS + SCALER, "price qty")
def prj12(spark, sf):
    o = observations(spark, sf).withColumn("one", F.lit(1.0))
    c = ["one", "price", "qty"]
    scaler = R.fit_scaler(o.where("role <> 'test'"), ["batch_id"], c, ("one",))
    return R.apply_scaler(o.where("role = 'test'").select("batch_id", "ord", *c), scaler, ["batch_id"], c).drop("batch_id")


@query("prj13_target_scaling", "SELECT ord, (y - ym) / ys AS scaled, true AS restored FROM obs JOIN sc USING (batch_id)", OBS + SCALER, "scaled", 7)
def prj13(spark, sf):
    o = observations(spark, sf)
    scaler = R.fit_scaler(o.where("role <> 'test'"), ["batch_id"], ["y"])
    there = R.apply_scaler(o.select("batch_id", "ord", "y", F.col("y").alias("given")), scaler, ["batch_id"], ["y"]).withColumn("scaled", F.col("y"))
    back = R.apply_scaler(there, scaler, ["batch_id"], ["y"], inverse=True)
    return back.select("ord", "scaled", (F.abs(F.col("y") - F.col("given")) < 1e-9).alias("restored"))


obs_query("prj14_unit_cube", lambda: [X.unit_cube("qty", 1, 50).alias("qty"), X.unit_cube("size", 1, 50).alias("size")], "(qty - 1) / 49 AS qty, (size - 1) / 49 AS size", "qty size")


def rules() -> dict:
    return {
        "price_range": F.col("price").between(1.0, 100.0),
        "quantity_range": F.col("qty") >= 2,
        "discount_range": F.col("disc") <= 0.09,
        "tax_range": F.col("tax") <= 0.07,
        "positive_charge": F.col("y") > 0,
        "size_range": F.col("size") < 50,
        # the denominator must stay away from zero for every parameter of the box
        "denominator": F.least(F.lit(0.8) - 4 * F.col("disc"), F.lit(1.2) - 4 * F.col("disc")) > 0.42,
    }


RULES_SQL = {"price_range": "price BETWEEN 1.0 AND 100.0", "quantity_range": "qty >= 2", "discount_range": "disc <= 0.09", "tax_range": "tax <= 0.07", "positive_charge": "y > 0", "size_range": "size < 50", "denominator": "least(0.8::DOUBLE - 4 * disc, 1.2::DOUBLE - 4 * disc) > 0.42::DOUBLE"}
ALL_SQL = " AND ".join(f"({v})" for v in RULES_SQL.values())


def accepted():
    out = F.lit(True)
    for c in rules().values():
        out = out & c
    return out


obs_query("prj15_validity_masks", lambda: [*named(rules()), accepted().alias("accepted")], ", ".join(f"{v} AS {k}" for k, v in RULES_SQL.items()) + f", {ALL_SQL} AS accepted", "")


@query("prj16_predictions", "SELECT 'curve' AS experiment, model, repeat, n_labeled, ord AS row_id, y AS y_true, pred AS y_pred FROM scored", ARMS, "y_pred", 7)
def prj16(spark, sf):
    return scored(spark, sf).select(F.lit("curve").alias("experiment"), "model", "repeat", "n_labeled", F.col("ord").alias("row_id"), F.col("y").alias("y_true"), F.col("pred").alias("y_pred"))


EXPECTED = [("affine", 3.0), ("reference", 2.5), ("ratio", 0.0)]


def expected(spark):
    return spark.createDataFrame(EXPECTED, "model string, expected double")


GAP_SQL = "SELECT model, n_labeled, value, expected, value - expected AS gap, CASE WHEN expected <> 0 THEN (value - expected) / expected END AS relative_gap FROM (SELECT model, n_labeled, avg(rmse) AS value FROM metrics GROUP BY ALL) LEFT JOIN (VALUES ('affine', 3.0::DOUBLE), ('reference', 2.5), ('ratio', 0.0)) e(model, expected) USING (model)"


def against_expected(spark, sf):
    m = arm_metrics(spark, sf).groupBy("model", "n_labeled").agg(F.avg("rmse").alias("value"))
    return joins.reference_values(m, F.broadcast(expected(spark)), ["model"]).select("model", "n_labeled", "value", "expected", "gap", "relative_gap")


query("prj17_reference_gap", GAP_SQL, ARMS, "value gap relative_gap")(against_expected)
query("jn11_reference_values", GAP_SQL, ARMS, "value gap relative_gap")(against_expected)

# filters -----------------------------------------------------------------------------------------
obs_query("flt01_box", lambda: [X.clip("price", 10.0, 60.0).alias("clipped"), X.in_box("price", 10.0, 60.0).alias("inside")], "greatest(10.0::DOUBLE, least(60.0::DOUBLE, price)) AS clipped, price BETWEEN 10 AND 60 AS inside", "clipped")


@query("flt02_finite", "SELECT event_type, count(*) FILTER (100 / (CAST(props->>'k' AS DOUBLE) % 3) < 'inf'::DOUBLE AND CAST(props->>'k' AS DOUBLE) % 3 <> 0) AS finite, count(*) AS n FROM events GROUP BY event_type")
def flt02(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double") % 3
    d = table(spark, sf, "events").withColumn("ratio", F.when(k == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(100.0), k)))
    return d.groupBy("event_type").agg(F.count_if(X.all_finite(["ratio", "value"])).alias("finite"), F.count(F.lit(1)).alias("n"))


@query("flt03_role_subset", "SELECT role, count(*) AS n, sum(y) AS y FROM (SELECT role, y FROM obs WHERE role <> 'labeled' UNION ALL SELECT 'labeled', y FROM pos WHERE pos <= 60) GROUP BY role", SPLIT, "y", 4)
def flt03(spark, sf):
    s = split(spark, sf).where("n_labeled = 60").select("batch_id", "ord")
    return splits.only_split_rows(observations(spark, sf), s, ["batch_id", "ord"]).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))


@query("flt04_categories", "SELECT o_orderpriority, count(*) AS n, sum((o_orderstatus IN ('F', 'O'))::INT)::BIGINT AS closed, count(o_orderdate) AS dated FROM orders WHERE o_orderpriority LIKE '%-%' AND o_orderstatus IS NOT NULL AND (starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '5') OR o_orderstatus = 'P') GROUP BY o_orderpriority")
def flt04(spark, sf):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    d = table(spark, sf, "orders").where(p.contains("-") & s.isNotNull() & (p.startswith("1") | p.startswith("5") | (s == "P")))
    return d.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(s.isin("F", "O")).alias("closed"), F.count("o_orderdate").alias("dated"))


@query("flt05_relabel", "SELECT CASE model WHEN 'affine' THEN 'Best-supervised' WHEN 'reference' THEN 'Reference-only' ELSE model END AS arm, CASE n_labeled WHEN 10 THEN 'low' WHEN 120 THEN 'high' ELSE 'middle' END AS level, 'curve' AS experiment, count(*) AS n FROM metrics GROUP BY ALL", ARMS)
def flt05(spark, sf):
    names = F.create_map(F.lit("affine"), F.lit("Best-supervised"), F.lit("reference"), F.lit("Reference-only"))
    level = F.when(F.col("n_labeled") == 10, "low").when(F.col("n_labeled") == 120, "high").otherwise("middle")
    m = arm_metrics(spark, sf).select(F.coalesce(names[F.col("model")], "model").alias("arm"), level.alias("level"), F.lit("curve").alias("experiment"))
    return m.groupBy("arm", "level", "experiment").agg(F.count(F.lit(1)).alias("n"))


# splits ------------------------------------------------------------------------------------------
@query("smp01_nested_split", "SELECT batch_id, ord, n_labeled::INT AS n_labeled, role FROM split", SPLIT)
def smp01(spark, sf):
    return split(spark, sf).select("batch_id", "ord", "n_labeled", "role")


@query("smp02_weak_subsample", "SELECT batch_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ord) AS p FROM obs WHERE role = 'weak') WHERE p <= 200", OBS)
def smp02(spark, sf):
    return splits.sample_first(observations(spark, sf).where("role = 'weak'"), ["batch_id"], "ord", 200).select("batch_id", "ord")


@query("smp02_half_of_the_rows", "SELECT batch_id, count(*) AS n, min(pos) AS first, max(pos) AS last, sum(price) AS price, max(ord) AS last_ord FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ord) AS pos FROM obs) WHERE pos <= 5000 GROUP BY batch_id", OBS, "price", 4)
def smp02h(spark, sf):
    """A large subsample by counts of prefixes, no group sorted whole."""
    s = splits.ranked_rows(observations(spark, sf), ["batch_id"], "ord", 5000)
    return s.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("price").alias("price"), F.max("ord").alias("last_ord"))


@query("smp03_ordered_prefix", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS p FROM lineitem) WHERE p <= 5")
def smp03(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    d = table(spark, sf, "lineitem").withColumn("p", F.row_number().over(w)).where("p <= 5")
    return d.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("smp04_manifest", "SELECT batch_id, n_labeled::INT AS n_labeled, role, string_agg(ord, ',' ORDER BY ord) AS rows FROM split GROUP BY ALL", SPLIT)
def smp04(spark, sf):
    return splits.split_manifest(split(spark, sf), ["batch_id"], "ord")


@query("smp05_split_agreement", "SELECT (SELECT count(*) FROM (SELECT ord, role FROM split WHERE n_labeled = 60 INTERSECT SELECT ord, role FROM split WHERE n_labeled = 120)) AS same, (SELECT count(*) FROM split WHERE n_labeled = 60) AS left_rows, (SELECT count(*) FROM split WHERE n_labeled = 120) AS right_rows", SPLIT)
def smp05(spark, sf):
    s = split(spark, sf)
    return splits.split_agreement(s.where("n_labeled = 60").select("ord", "role"), s.where("n_labeled = 120").select("ord", "role"))


@query("smp06_role_merge", "SELECT batch_id, n_labeled::INT AS n_labeled, 'refit' AS role, count(*) AS n FROM split GROUP BY batch_id, n_labeled", SPLIT)
def smp06(spark, sf):
    return splits.merge_roles(split(spark, sf)).groupBy("batch_id", "n_labeled", "role").agg(F.count(F.lit(1)).alias("n"))


# joins -------------------------------------------------------------------------------------------
PAIRS = ", pairs AS (SELECT repeat, n_labeled, l.rmse AS left_value, r.rmse AS right_value FROM (SELECT * FROM metrics WHERE model = 'affine') l JOIN (SELECT * FROM metrics WHERE model = 'reference') r USING (repeat, n_labeled))"


@query("jn01_paired_arms", "SELECT repeat, n_labeled::INT AS n_labeled, left_value, right_value FROM pairs", ARMS + PAIRS, "left_value right_value")
def jn01(spark, sf):
    return joins.pair_arms(arm_metrics(spark, sf), "affine", "reference", "rmse", ["repeat", "n_labeled"])


@query("jn02_suffixed_join", "SELECT repeat, n_labeled::INT AS n_labeled, l.mae AS mae_a, r.mae AS mae_b FROM (SELECT * FROM metrics WHERE model = 'affine') l JOIN (SELECT * FROM metrics WHERE model = 'ratio') r USING (repeat, n_labeled)", ARMS, "mae_a mae_b")
def jn02(spark, sf):
    m = arm_metrics(spark, sf)
    arm = lambda n: m.where(F.col("model") == n).select("repeat", "n_labeled", "mae")
    return joins.suffixed_join(arm("affine"), arm("ratio"), ["repeat", "n_labeled"], ("_a", "_b"))


@query("jn03_parameters", "SELECT ord, theta, theta * price AS score FROM obs JOIN (SELECT batch_id, regr_slope(y, price) AS theta FROM obs WHERE role = 'weak' GROUP BY batch_id) USING (batch_id)", OBS, "theta score")
def jn03(spark, sf):
    o = observations(spark, sf)
    p = o.where("role = 'weak'").groupBy("batch_id").agg(F.regr_slope(F.col("y"), F.col("price")).alias("theta"))
    return registry.score_reference(joins.attach(o, p, ["batch_id"]), "list_price", F.col("theta")).select("ord", "theta", "score")


@query("jn04_candidate_grid", "SELECT batch_id, w AS weak_weight, l AS l1, g AS group_weight, t AS theta0 FROM (SELECT DISTINCT batch_id FROM obs), (VALUES (0.0::DOUBLE), (0.1), (1.0)) a(w), (VALUES (0.0::DOUBLE), (0.01)) b(l), (VALUES (0.0::DOUBLE), (0.01)) c(g), (VALUES (0.8::DOUBLE), (1.2)) d(t)", OBS)
def jn04(spark, sf):
    return joins.candidate_grid(observations(spark, sf).select("batch_id").distinct(), weak_weight=[0.0, 0.1, 1.0], l1=[0.0, 0.01], group_weight=[0.0, 0.01], theta0=[0.8, 1.2])


@query("jn05_conditions", "SELECT batch_id, n::INT AS n_labeled, m AS model FROM (SELECT DISTINCT batch_id FROM obs), (VALUES (10), (20), (30), (60), (120)) a(n), (VALUES ('weak'), ('affine'), ('fixed')) b(m) WHERE m <> 'fixed' OR n = 30", OBS)
def jn05(spark, sf):
    return joins.plan_conditions(observations(spark, sf).select("batch_id").distinct(), SIZES, {"weak": None, "affine": None, "fixed": [30]})


@query("jn06_nearest", "SELECT s_nationkey AS nation, s_suppkey, match, distance FROM (SELECT s_nationkey, s_suppkey, c_custkey AS match, abs(s_acctbal - c_acctbal) AS distance, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS p FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE p = 1", "", "distance")
def jn06(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.col("s_acctbal").alias("bal"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("bal"))
    return joins.nearest(s, c, ["nation"], ["bal"], "s_suppkey", "c_custkey")


@query("jn07_nearest_grid", "SELECT target, theta, loss, gap FROM (SELECT target, theta, loss, abs(loss - target) AS gap, row_number() OVER (PARTITION BY target ORDER BY abs(loss - target), theta) AS p FROM (VALUES (2.0::DOUBLE), (4.0), (8.0)) t(target), (SELECT 0.8 + 0.05 * k AS theta, sqrt(avg((y - (0.8 + 0.05 * k) * price) ** 2)) AS loss FROM obs, range(9) r(k) GROUP BY k)) WHERE p = 1", OBS, "theta loss gap")
def jn07(spark, sf):
    o = observations(spark, sf)
    theta = [F.lit(0.8) + F.lit(0.05) * F.lit(float(k)) for k in range(9)]
    loss = o.agg(*[F.sqrt(F.avg((F.col("y") - t * F.col("price")) ** 2)).alias(f"l{k}") for k, t in enumerate(theta)])
    grid = loss.select(F.explode(F.array(*[F.struct(t.alias("theta"), F.col(f"l{k}").alias("loss")) for k, t in enumerate(theta)])).alias("p")).select("p.*")
    return joins.nearest_grid(spark.createDataFrame([(2.0,), (4.0,), (8.0,)], "target double"), grid, "target", "loss", "theta")


OVER = "(SELECT DISTINCT price, qty, disc, tax FROM obs WHERE role = '{}')"


@query("jn08_overlap", f"SELECT count(*) AS shared FROM ({OVER.format('labeled')} INTERSECT {OVER.format('test')})", OBS)
def jn08(spark, sf):
    o = observations(spark, sf)
    return joins.overlap(splits.by_role(o, ["labeled"]), splits.by_role(o, ["test"]), ["price", "qty", "disc", "tax"])


BEST = ", best AS (SELECT n_labeled, model, mean FROM (SELECT n_labeled, model, avg(mse) AS mean, row_number() OVER (PARTITION BY n_labeled ORDER BY avg(mse), model) AS p FROM metrics GROUP BY n_labeled, model) WHERE p = 1)"


@query("jn09_winner_rows", "SELECT n_labeled::INT AS n_labeled, model, repeat, mse FROM metrics JOIN best USING (n_labeled, model)", ARMS + BEST, "mse")
def jn09(spark, sf):
    m = arm_metrics(spark, sf)
    return joins.winners(m, M.best_of(m)).select("n_labeled", "model", "repeat", "mse")


@query("jn10_replicated_arm", "SELECT repeat, s.end_ AS n_labeled, mse FROM metrics, sizes s WHERE model = 'affine' AND n_labeled = 30", ARMS, "mse")
def jn10(spark, sf):
    arm = (F.col("model") == "affine") & (F.col("n_labeled") == 30)
    return joins.replicate_arm(arm_metrics(spark, sf), arm, SIZES).select("repeat", "n_labeled", "mse")


