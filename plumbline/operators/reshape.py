"""Unions, pivots and the way between vectors and rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def stack_fidelity(labeled: DataFrame, weak: DataFrame) -> DataFrame:
    return labeled.withColumn("fidelity", F.lit("labeled")).unionByName(weak.withColumn("fidelity", F.lit("weak")))


def common_repeats(arms: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of arms under their names, with only the repeats that all of them have."""
    named = reduce(lambda a, b: a.unionByName(b), [d.withColumn("arm", F.lit(n)) for n, d in arms.items()])
    common = named.groupBy(key).agg(F.count_distinct("arm").alias("n")).where(F.col("n") == len(arms))
    return named.join(common, key, "left_semi")


def shared_tuples(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys)).agg(F.count(F.lit(1)).alias("shared"))


def pivot_difference(metrics: DataFrame, row: list[str], column: str, values: list, metric: str, a, b) -> DataFrame:
    """Cells of mean metric with given columns, and the difference of two of them."""
    wide = metrics.groupBy(*row).pivot(column, values).agg(F.avg(metric))
    wide = wide.select(*row, *[F.col(f"`{v}`").alias(f"{column}_{v}") for v in values])
    return wide.withColumn("difference", F.col(f"{column}_{a}") - F.col(f"{column}_{b}"))


def segment_means(metrics: DataFrame, g: list[str], axis: str, value: str, segments: dict[str, tuple[int, int]]) -> DataFrame:
    """Averages of the per-size means within segments of the axis."""
    m = metrics.groupBy(*g, axis).agg(F.avg(value).alias("m"))
    return m.groupBy(*g).agg(*[F.avg(F.when(F.col(axis).between(a, b), F.col("m"))).alias(n) for n, (a, b) in segments.items()])


def vector_rows(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(key, F.posexplode(vec).alias("place", "x"))


def rows_vector(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("vec"))
