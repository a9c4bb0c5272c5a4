"""Queries of aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import metrics as M
from plumbline.operators import regression as R
from plumbline.plans.catalog import query
from plumbline.plans.data_queries import BEST, RULES_SQL, rules
from plumbline.plans.tables import ARMS, OBS, SPLIT, arm_metrics, observations, scored, split, table

@query("agg01_regression_metrics", "SELECT model, repeat, n_labeled::INT AS n_labeled, mse, rmse, mae FROM metrics", ARMS, "mse rmse mae")
def agg01(spark, sf):
    return arm_metrics(spark, sf)


R2 = "1 - sum((y - pred) ** 2) / {}"


@query("agg02_r_squared", f"SELECT model, repeat, n_labeled::INT AS n_labeled, {R2.format('nullif(var_pop(y) * count(y), 0)')} AS r2 FROM scored GROUP BY ALL", ARMS, "r2")
def agg02(spark, sf):
    return M.r_squared(scored(spark, sf), ["model", "repeat", "n_labeled"])


@query("agg02_r_squared_floored", "SELECT supp, 1 - sum((y - price) ** 2) / greatest(var_pop(y) * count(y), 1e-12) AS r2 FROM obs GROUP BY supp", OBS, "r2")
def agg02f(spark, sf):
    return M.r_squared(observations(spark, sf), ["supp"], "y", "price", 1e-12)


@query("agg03_correlation", "SELECT supp, corr(price, y) AS correlation FROM obs GROUP BY supp", OBS, "correlation")
def agg03(spark, sf):
    return M.correlation(observations(spark, sf), ["supp"], "price", "y")


@query("agg04_summary", "SELECT model, n_labeled::INT AS n_labeled, avg(mse) AS mse_mean, stddev_samp(mse) AS mse_std, avg(rmse) AS rmse_mean, stddev_samp(rmse) AS rmse_std, avg(mae) AS mae_mean, stddev_samp(mae) AS mae_std FROM metrics GROUP BY ALL", ARMS, "mse_mean mse_std rmse_mean rmse_std mae_mean mae_std")
def agg04(spark, sf):
    return M.summarize(arm_metrics(spark, sf), ["experiment", "model", "n_labeled", "source_model"])


@query("agg05_best_of", "SELECT n_labeled::INT AS n_labeled, min(mean) AS mean FROM (SELECT n_labeled, model, avg(rmse) AS mean FROM metrics GROUP BY ALL) GROUP BY n_labeled", ARMS, "mean")
def agg05(spark, sf):
    return M.best_of(arm_metrics(spark, sf), "rmse").select("n_labeled", "mean")


@query("agg06_best_model", "SELECT n_labeled::INT AS n_labeled, model, mean FROM best", ARMS + BEST, "mean")
def agg06(spark, sf):
    return M.best_of(arm_metrics(spark, sf))


@query("agg07_rates", "SELECT source, avg((quality = 1)::INT::DOUBLE) AS good, avg((toxic = 1)::INT::DOUBLE) AS toxic, avg((quality = 1 AND toxic = 0)::INT::DOUBLE) AS clean FROM labels JOIN documents USING (doc_id) GROUP BY source", "", "good toxic clean")
def agg07(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return M.rates(d, ["source"], {"good": good, "toxic": toxic, "clean": good & ~toxic})


@query("agg08_counter_ratio", "SELECT event_type, sum((k > 50)::INT * k)::BIGINT AS part, sum(k)::BIGINT AS whole, sum((k > 50)::INT * k)::DOUBLE / nullif(sum(k), 0) AS share FROM (SELECT event_type, CAST(props->>'k' AS INT) AS k FROM events) GROUP BY event_type", "", "share")
def agg08(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return M.counter_ratio(table(spark, sf, "events"), ["event_type"], F.when(k > 50, k).otherwise(0), k)


@query("agg09_residuals", "SELECT batch_id, count(*) AS n, avg(y - price * (1 - disc)) AS mean, stddev_pop(y - price * (1 - disc)) AS std, avg((y - price * (1 - disc)) ** 2) AS mse FROM obs GROUP BY batch_id", OBS, "mean std mse")
def agg09(spark, sf):
    return M.residual_statistics(observations(spark, sf).withColumn("clean", F.col("price") * (1 - F.col("disc"))), ["batch_id"], "y", "clean")


@query("agg10_quantiles", "SELECT batch_id, quantile_cont(abs(y - price), 0.95) AS p95, quantile_cont(abs(y - price), 0.99) AS q99 FROM obs GROUP BY batch_id", OBS, "p95 q99")
def agg10(spark, sf):
    return M.quantiles(observations(spark, sf), ["batch_id"], F.abs(F.col("y") - F.col("price")), {"p95": 0.95, "q99": 0.99})


@query("agg11_share_within", "SELECT nation, avg((d < 0.5)::INT::DOUBLE) AS near, avg((d < 2)::INT::DOUBLE) AS wide FROM (SELECT nation, abs(y - price) AS d FROM obs) GROUP BY nation", OBS, "near wide")
def agg11(spark, sf):
    return M.share_within(observations(spark, sf).withColumn("d", F.abs(F.col("y") - F.col("price"))), ["nation"], "d", {"near": 0.5, "wide": 2.0})


@query("agg12_median", "SELECT model, n_labeled::INT AS n_labeled, median(mae) AS median FROM metrics GROUP BY ALL", ARMS, "median")
def agg12(spark, sf):
    return M.median_by(arm_metrics(spark, sf), ["model", "n_labeled"], "mae")


@query("agg13_value_counts", "SELECT event_type, CAST(props->>'k' AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def agg13(spark, sf):
    return M.value_counts(table(spark, sf, "events").withColumn("k", F.from_json("props", "k int")["k"]), ["event_type", "k"])


@query("agg14_magnitudes", "SELECT label, sqrt(sum(x * x)) AS l2, max(abs(x)) AS max_abs, sqrt(avg(x * x)) AS rms FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label", "", "l2 max_abs rms")
def agg14(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return M.magnitudes(e, ["label"], "x")


@query("agg15_group_norms", "SELECT vec_id, CASE WHEN place < 16 THEN 'shape' WHEN place < 40 THEN 'theta' ELSE 'basis' END AS part, sqrt(sum(x * x)) AS norm FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings) GROUP BY ALL", "", "norm")
def agg15(spark, sf):
    part = F.when(F.col("id") < 16, "shape").when(F.col("id") < 40, "theta").otherwise("basis")
    groups = spark.range(64).select(F.col("id").cast("int").alias("place"), part.alias("part"))
    return M.group_norms(table(spark, sf, "embeddings"), "vec_id", "embedding", F.broadcast(groups))


@query("agg16_signal_to_noise", "SELECT batch_id, var_pop(price) / stddev_pop(y - price) ** 2 AS snr FROM obs GROUP BY batch_id", OBS, "snr")
def agg16(spark, sf):
    o = observations(spark, sf)
    sigma = o.groupBy("batch_id").agg(F.stddev_pop(F.col("y") - F.col("price")).alias("sigma"))
    return M.signal_to_noise(o, sigma, ["batch_id"], "price")


@query("agg17_range_of_firsts", "SELECT min(v) AS low, max(v) AS high FROM (SELECT supp, arg_min(price, ord) AS v FROM obs GROUP BY supp)", OBS)
def agg17(spark, sf):
    return M.range_of_firsts(observations(spark, sf), ["supp"], "price", "ord")


@query("agg18_one_dataset", "SELECT o_custkey, count(DISTINCT o_orderstatus) = 1 AS shared FROM orders GROUP BY o_custkey")
def agg18(spark, sf):
    return M.one_dataset(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus")


EVERY = " AND ".join(f"({v})" for v in RULES_SQL.values())


@query("agg19_rejection_audit", f"SELECT batch_id, count(*) AS drawn, count(*) FILTER ({EVERY}) AS accepted, avg(({EVERY})::INT::DOUBLE) AS acceptance, " + ", ".join(f"avg((NOT ({v}))::INT::DOUBLE) AS rejected_{k}" for k, v in RULES_SQL.items()) + " FROM obs GROUP BY batch_id", OBS, "acceptance " + " ".join(f"rejected_{k}" for k in RULES_SQL))
def agg19(spark, sf):
    return M.rejection_audit(observations(spark, sf), ["batch_id"], rules())


@query("agg20_normalized", "SELECT model, n_labeled::INT AS n_labeled, mse / 9 AS mse_noise, rmse / 3 AS rmse_noise, mse / max(CASE WHEN n_labeled = 120 THEN mse END) OVER (PARTITION BY model) AS mse_largest FROM (SELECT model, n_labeled, avg(mse) AS mse, avg(rmse) AS rmse FROM metrics GROUP BY ALL)", ARMS, "mse_noise rmse_noise mse_largest")
def agg20(spark, sf):
    return M.normalized(arm_metrics(spark, sf), 9.0)


GRAM_COLUMNS = ["one", "price", "qty", "price_disc", "price_tax", "y"]
GRAM_SQL = {"one": "1.0::DOUBLE", "price": "price / 50", "qty": "qty / 50", "price_disc": "price * disc", "price_tax": "price * tax", "y": "y / 50"}
_PAIRS = [(a, b) for i, a in enumerate(GRAM_COLUMNS) for b in GRAM_COLUMNS[i:]]


def gram_rows(obs):
    """Feature columns in units near one."""
    return obs.withColumns({"one": F.lit(1.0), "price_disc": F.col("price") * F.col("disc"), "price_tax": F.col("price") * F.col("tax")}).withColumns({"price": F.col("price") / 50, "qty": F.col("qty") / 50, "y": F.col("y") / 50})


ENTRIES = " ".join(f"{a}__{b}" for a, b in _PAIRS)


@query("agg21_gram", "SELECT supp, count(*) AS n, " + ", ".join(f"sum(({GRAM_SQL[a]}) * ({GRAM_SQL[b]})) AS {a}__{b}" for a, b in _PAIRS) + " FROM obs GROUP BY supp", OBS, ENTRIES, 5)
def agg21(spark, sf):
    g = R.gram(gram_rows(observations(spark, sf)), ["supp"], GRAM_COLUMNS)
    return g.select("supp", "n", *[R.cross(GRAM_COLUMNS, a, b).alias(f"{a}__{b}") for a, b in _PAIRS])


@query(
    "agg22_box_plot",
    "SELECT model, n_labeled::INT AS n_labeled, q1, q2, q3, min(rmse) FILTER (rmse >= q1 - 1.5 * (q3 - q1)) AS low, max(rmse) FILTER (rmse <= q3 + 1.5 * (q3 - q1)) AS high FROM metrics JOIN (SELECT model, n_labeled, quantile_cont(rmse, 0.25) AS q1, quantile_cont(rmse, 0.5) AS q2, quantile_cont(rmse, 0.75) AS q3 FROM metrics GROUP BY ALL) USING (model, n_labeled) GROUP BY ALL",
    ARMS, "q1 q2 q3 low high",
)
def agg22(spark, sf):
    return M.box_plot(arm_metrics(spark, sf), ["model", "n_labeled"], "rmse")


@query("agg23_mean_abs_coefficient", "SELECT name, avg(abs(x)) AS mean_abs FROM (SELECT a AS x, 'intercept' AS name FROM arms WHERE model = 'affine' UNION ALL SELECT b, 'slope' FROM arms WHERE model = 'affine') GROUP BY name", ARMS, "mean_abs")
def agg23(spark, sf):
    from plumbline.plans.tables import fits

    f = fits(split(spark, sf)).where("model = 'affine'")
    rows = f.select(F.posexplode(F.array("a", "b")).alias("place", "x")).withColumn("name", F.element_at(F.array(F.lit("intercept"), F.lit("slope")), F.col("place") + 1))
    return M.mean_abs_by_name(rows, "name", "x")


@query("agg24_target_audit", "SELECT batch_id, avg(y) AS mean, stddev_samp(y) AS std, quantile_cont(abs(y), 0.99) AS q99, max(abs(y)) AS max_abs FROM obs GROUP BY batch_id", OBS, "mean std q99 max_abs")
def agg24(spark, sf):
    return M.target_audit(observations(spark, sf), ["batch_id"], "y")


@query("agg25_curve", "SELECT model, n_labeled::INT AS n_labeled, avg(mae) AS mean, stddev_samp(mae) AS std FROM metrics GROUP BY ALL", ARMS, "mean std")
def agg25(spark, sf):
    return M.curve(arm_metrics(spark, sf), "model", "mae")


BLOCKS = SPLIT + ", per AS (SELECT batch_id, role, block, count(*) AS n, sum(price / 50 * price / 50) AS xx, sum(price / 50 * y / 50) AS xy FROM block GROUP BY ALL)"


@query("win08_cumulative_blocks", "SELECT batch_id, role, block, sum(n) OVER w::BIGINT AS n, sum(xx) OVER w AS xx, sum(xy) OVER w AS xy FROM per WINDOW w AS (PARTITION BY batch_id, role ORDER BY block)", BLOCKS, "xx xy")
def win08(spark, sf):
    from plumbline.operators.windows import cumulative

    s = split(spark, sf).where("n_labeled = 120")
    x, y = F.col("price") / 50, F.col("y") / 50
    per = s.groupBy("batch_id", "role", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    return cumulative(per, ["batch_id", "role"], "block", ["n", "xx", "xy"])
