"""Paired tests, equivalence and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import t_cdf, t_quantile
from plumbline.operators.windows import holm


def paired_t(pairs: DataFrame, g: list[str], alternative: str = "less", left: str = "left_value", right: str = "right_value") -> DataFrame:
    """One-sided paired t: n, mean difference, statistic, p.  Groups with one pair go; a deviation of zero
    gives null statistic and p."""
    d = F.col(left) - F.col(right)
    a = pairs.groupBy(*g).agg(F.count(d).alias("n_pairs"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd")).where("n_pairs >= 2")
    t = F.try_divide(F.col("mean_difference"), F.col("sd") / F.sqrt(F.col("n_pairs").cast("double")))
    a = a.withColumn("statistic", t)
    p = t_cdf("statistic", F.col("n_pairs") - 1)
    return a.withColumn("p_value", p if alternative == "less" else 1 - p).drop("sd")


def effects(pairs: DataFrame, g: list[str], left: str = "left_value", right: str = "right_value") -> DataFrame:
    """Mean, deviation, 95 % interval, standardized effect (infinite at deviation 0) and share below zero."""
    d = F.col(left) - F.col(right)
    a = pairs.groupBy(*g).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.avg((d < 0).cast("double")).alias("share_negative"))
    half = t_quantile(0.975, F.col("n") - 1) * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    dz = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).otherwise(F.when(F.col("mean") != 0, F.signum("mean") * float("inf")))
    return a.select(*g, "n", "mean", "sd", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), dz.alias("dz"), "share_negative")


def family(metrics: DataFrame, arm: str, others: list[str], values: list[str], keys: list[str], g: list[str], correct: list[str] | None = None) -> DataFrame:
    """One arm against others on several metrics, Holm over the whole family or within given columns.

    The metrics, a row for each arm and keys, are read once: arms become columns, comparisons rows.
    """
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]))
    long = metrics.where(F.col("model").isin(arm, *others)).select(*keys, "model", each.alias("m")).select(*keys, "model", "m.*")
    of = lambda n: F.max(F.when(F.col("model") == n, F.col("value")))
    wide = long.groupBy(*keys, "metric").agg(of(arm).alias("left_value"), *[of(o).alias(f"other {i}") for i, o in enumerate(others)])
    compared = F.explode(F.array(*[F.struct(F.lit(f"{arm} vs {o}").alias("comparison"), F.col(f"other {i}").alias("right_value")) for i, o in enumerate(others)]))
    pairs = wide.select(*keys, "metric", "left_value", compared.alias("c")).select(*keys, "metric", "left_value", "c.*").where("left_value is not null and right_value is not null")
    return holm(paired_t(pairs, [*g, "comparison", "metric"]), correct if correct is not None else [])


def equivalence(pairs: DataFrame, g: list[str], fraction: float) -> DataFrame:
    """Two one-sided tests with margin fraction * mean(left): p is the larger, equivalent below 0.05."""
    d = F.col("left_value") - F.col("right_value")
    a = pairs.groupBy(*g).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("sd"), (F.avg("left_value") * fraction).alias("margin")).where("n >= 2")
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    t = lambda shift: F.try_divide(F.col("m") + shift, se)
    p = F.greatest(1 - t_cdf(t(F.col("margin")), F.col("n") - 1), t_cdf(t(-F.col("margin")), F.col("n") - 1))
    return a.select(*g, F.col("n").alias("n_pairs"), F.col("m").alias("mean_difference"), "margin", p.alias("p_value"), (p < 0.05).alias("equivalent"))


def verdict(mean: Column, p: Column, low: Column, high: Column, dz: Column) -> Column:
    """Wording by sign, corrected p, interval and effect size."""
    return (
        F.when((mean < 0) & (p < 0.05) & (F.abs(dz) >= 0.5), "better")
        .when((mean < 0) & (p < 0.05), "better, small")
        .when((low <= 0) & (high >= 0), "no difference shown")
        .when(mean > 0, "worse")
        .otherwise("open")
    )
