"""Metrics, summaries and other aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, g: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    e = F.col(y) - F.col(pred)
    return df.groupBy(*g).agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def r_squared(df: DataFrame, g: list[str], y: str = "y", pred: str = "pred", floor: float | None = None) -> DataFrame:
    """1 - residual / total sum of squares; null where the total is zero, unless it has a floor."""
    e = F.col(y) - F.col(pred)
    total = F.var_pop(y) * F.count(y)
    total = F.greatest(total, F.lit(floor)) if floor is not None else F.when(total > 0, total)
    return df.groupBy(*g).agg((1 - F.sum(e * e) / total).alias("r2"))


def correlation(df: DataFrame, g: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*g).agg(F.corr(a, b).alias("correlation"))


def summarize(metrics: DataFrame, keys: list[str], values: tuple[str, ...] = ("mse", "rmse", "mae")) -> DataFrame:
    """Mean and sample deviation by the keys that exist; null keys form groups of their own."""
    present = [k for k in keys if k in metrics.columns]
    return metrics.groupBy(*present).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def best_of(metrics: DataFrame, value: str = "mse") -> DataFrame:
    """By size: the smallest of the models' means, and the model (first in name order on ties)."""
    means = metrics.groupBy("model", "n_labeled").agg(F.avg(value).alias("mean"))
    least = F.min(F.struct("mean", "model"))
    return means.groupBy("n_labeled").agg(least.alias("b")).select("n_labeled", F.col("b.model").alias("model"), F.col("b.mean").alias("mean"))


def rates(df: DataFrame, g: list[str], flags: dict[str, Column]) -> DataFrame:
    return df.groupBy(*g).agg(*[F.avg(c.cast("double")).alias(n) for n, c in flags.items()])


def counter_ratio(df: DataFrame, g: list[str], part: Column, whole: Column) -> DataFrame:
    return df.groupBy(*g).agg(F.sum(part).alias("part"), F.sum(whole).alias("whole"), F.try_divide(F.sum(part).cast("double"), F.sum(whole).cast("double")).alias("share"))


def residual_statistics(df: DataFrame, g: list[str], observed: str, clean: str) -> DataFrame:
    e = F.col(observed) - F.col(clean)
    return df.groupBy(*g).agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.avg(e * e).alias("mse"))


SKETCH = 10_000  # ranks of the quantile sketch are off by at most one in so many
WHOLE = 20 * SKETCH  # groups up to this size are sorted whole


def same(a: str, b: str, g: list[str]) -> Column:
    """Equal keys of two aliased frames, null keys included."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in g], F.lit(True))


def quantiles(df: DataFrame, g: list[str], x: Column, at: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation; null where a group has no value, and nulls don't count.

    A mergeable sketch brackets each quantile.  Values within brackets are then counted one by one, all others of a group
    as one count for each gap between brackets, so that ranks are exact while only about 1/2500 of a large group's
    values a quantile is sorted in one task (where Spark spills).  A bracket that misses its rank raises.
    """
    names = sorted(at, key=at.get)
    rows = df.select(*g, x.cast("double").alias("_x"))
    probes = [min(max(at[n] + d, 0.0), 1.0) for n in names for d in (-2 / SKETCH, 2 / SKETCH)]
    edges = rows.groupBy(*g).agg(F.count("_x").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.percentile_approx("_x", probes, SKETCH).alias("_cut"))
    whole = F.col("_n") <= WHOLE
    low = [F.when(whole | F.lit(at[n] <= 2 / SKETCH), F.col("_low")).otherwise(F.get("_cut", F.lit(2 * i))).alias(f"_a{i}") for i, n in enumerate(names)]
    high = [F.when(whole | F.lit(at[n] >= 1 - 2 / SKETCH), F.col("_high")).otherwise(F.get("_cut", F.lit(2 * i + 1))).alias(f"_b{i}") for i, n in enumerate(names)]
    edges = edges.select(*g, "_n", *low, *high)
    inside = reduce(lambda p, q: p | q, [F.col("_x").between(F.col(f"_a{i}"), F.col(f"_b{i}")) for i in range(len(names))])
    # a value between brackets stands under the end of the bracket below it, after all values there
    below = F.array_max(F.array(*[F.when(F.col(f"_b{i}") < F.col("_x"), F.col(f"_b{i}")) for i in range(len(names))]))
    held = rows.where("_x is not null").alias("r").join(edges.alias("e"), same("r", "e", g))
    held = held.select(*[F.col(f"r.{k}") for k in g], F.when(inside, F.col("_x")).otherwise(below).alias("_v"), (~inside).alias("_out"), "_n")
    counts = held.groupBy(*g, "_v", "_out").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    order = Window.partitionBy(*g).orderBy("_v", "_out").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("_c").over(order))

    def value(p: float) -> Column:
        place = F.lit(p) * (F.col("_n") - 1)
        pick = lambda k: F.min(F.when(F.col("_upto") > k, F.struct("_v", "_out")))
        a, b = pick(F.floor(place)), pick(F.ceil(place))
        part = F.max(place - F.floor(place))
        line = F.when((part == 0) | (a["_v"] == b["_v"]), a["_v"]).otherwise((1 - part) * a["_v"] + part * b["_v"])
        return F.when(a["_out"] | b["_out"], F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).otherwise(line)

    found = ranked.groupBy(*g).agg(*[value(at[n]).alias(n) for n in at])
    return edges.alias("e").join(found.alias("f"), same("e", "f", g), "left").select(*[F.col(f"e.{k}") for k in g], *[F.col(f"f.{n}") for n in at])


def share_within(df: DataFrame, g: list[str], d: str, thresholds: dict[str, float]) -> DataFrame:
    return rates(df, g, {n: F.col(d) < t for n, t in thresholds.items()})


def median_by(df: DataFrame, g: list[str], x: str) -> DataFrame:
    return quantiles(df, g, F.col(x), {"median": 0.5})


def value_counts(df: DataFrame, g: list[str]) -> DataFrame:
    return df.groupBy(*g).agg(F.count(F.lit(1)).alias("n"))


def magnitudes(df: DataFrame, g: list[str], x: str) -> DataFrame:
    c = F.col(x)
    return df.groupBy(*g).agg(F.sqrt(F.sum(c * c)).alias("l2"), F.max(F.abs(c)).alias("max_abs"), F.sqrt(F.avg(c * c)).alias("rms"))


def group_norms(vectors: DataFrame, key: str, vec: str, groups: DataFrame) -> DataFrame:
    """Norm of each named group of places of a vector.  groups: place, part (one row a place)."""
    rows = vectors.select(key, F.posexplode(vec).alias("place", "x"))
    return rows.join(groups, "place").groupBy(key, "part").agg(F.sqrt(F.sum(F.col("x").cast("double") * F.col("x"))).alias("norm"))


def signal_to_noise(df: DataFrame, sigma: DataFrame, g: list[str], y: str) -> DataFrame:
    return df.groupBy(*g).agg(F.var_pop(y).alias("v")).join(sigma, g).select(*g, (F.col("v") / (F.col("sigma") * F.col("sigma"))).alias("snr"))


def range_of_firsts(df: DataFrame, g: list[str], value: str, key: str) -> DataFrame:
    """One value for each group, that of the smallest key, then the range over the groups."""
    return df.groupBy(*g).agg(F.min_by(value, key).alias("v")).agg(F.min("v").alias("low"), F.max("v").alias("high"))


def one_dataset(df: DataFrame, g: list[str], dataset: str) -> DataFrame:
    return df.groupBy(*g).agg((F.count_distinct(dataset) == 1).alias("shared"))


def rejection_audit(df: DataFrame, g: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows drawn, rows that pass every rule, their share, and each rule's own rejection rate."""
    every = F.lit(True)
    for c in rules.values():
        every = every & c
    return df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("drawn"),
        F.count_if(every).alias("accepted"),
        F.avg(every.cast("double")).alias("acceptance"),
        *[F.avg((~c).cast("double")).alias(f"rejected_{n}") for n, c in rules.items()],
    )


def normalized(metrics: DataFrame, noise_variance: float) -> DataFrame:
    """Mean mse over the noise variance, mean rmse over its deviation, mse over that at the largest size."""
    m = metrics.groupBy("model", "n_labeled").agg(F.avg("mse").alias("mse"), F.avg("rmse").alias("rmse"))
    last = F.max_by("mse", "n_labeled").over(Window.partitionBy("model"))
    return m.select("model", "n_labeled", (F.col("mse") / noise_variance).alias("mse_noise"), (F.col("rmse") / noise_variance**0.5).alias("rmse_noise"), F.try_divide(F.col("mse"), last).alias("mse_largest"))


def box_plot(df: DataFrame, g: list[str], x: str) -> DataFrame:
    """Quartiles and the whisker ends: the extreme values within 1.5 quartile distances."""
    q = quantiles(df, g, F.col(x), {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    c, reach = F.col(x), 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, g)
    low, high = F.min(F.when(c >= F.col("q1") - reach, c)), F.max(F.when(c <= F.col("q3") + reach, c))
    return inside.groupBy(*g, "q1", "q2", "q3").agg(low.alias("low"), high.alias("high"))


def mean_abs_by_name(coefficients: DataFrame, name: str, value: str) -> DataFrame:
    return coefficients.groupBy(name).agg(F.avg(F.abs(value)).alias("mean_abs"))


def target_audit(df: DataFrame, g: list[str], y: str) -> DataFrame:
    a = F.abs(y)
    moments = df.groupBy(*g).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.max(a).alias("max_abs"))
    joined = moments.alias("m").join(quantiles(df, g, a, {"q99": 0.99}).alias("q"), same("m", "q", g))
    return joined.select(*[F.col(f"m.{k}") for k in g], "mean", "std", "q99", "max_abs")


def curve(metrics: DataFrame, arm: str, value: str) -> DataFrame:
    return metrics.groupBy(arm, "n_labeled").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
