"""Ordered operators: step-down correction, ranks, changes, crossovers, cumulative sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holm(df: DataFrame, family: list[str], p: str = "p_value", name: str = "p_value_holm") -> DataFrame:
    """Step-down adjusted p within a family: the running maximum of min(1, (m - rank + 1) p).  Null p values
    stay null and don't count."""
    known = F.col(p).isNotNull()
    w = Window.partitionBy(*family, known)
    ordered = w.orderBy(p)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(w) - F.row_number().over(ordered) + 1) * F.col(p))
    out = df.withColumn("_step", step)
    running = F.max("_step").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn(name, F.when(known, running)).drop("_step")


def rank_of(df: DataFrame, g: list[str], value: str, name: str = "rank") -> DataFrame:
    """1 + the number of rows of the group that are strictly better."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*g).orderBy(value)))


def stagnation(df: DataFrame, g: list[str], order: list[str], value: str, tolerance: float, length: int = 5) -> DataFrame:
    """Whether the last rows differ by less than the tolerance of their mean's magnitude; needs a full window."""
    w = Window.partitionBy(*g).orderBy(*order).rowsBetween(-(length - 1), 0)
    spread = (F.max(value).over(w) - F.min(value).over(w)) / F.greatest(F.lit(1.0), F.abs(F.avg(value).over(w)))
    return df.withColumn("stagnant", (F.count(value).over(w) == length) & (spread < tolerance))


def relative_change(df: DataFrame, g: list[str], order: list[str], value: str) -> DataFrame:
    """|x - previous| / max(1, |previous|); null on the first row, where it is infinite."""
    before = F.lag(value).over(Window.partitionBy(*g).orderBy(*order))
    return df.withColumn("change", F.abs(F.col(value) - before) / F.greatest(F.lit(1.0), F.abs(before)))


def version_drift(df: DataFrame, row: list[str], version: str, value: str) -> DataFrame:
    """Largest change of a label from one version to the next, over all rows."""
    before = F.lag(value).over(Window.partitionBy(*row).orderBy(version))
    return df.withColumn("d", F.abs(F.col(value) - before)).groupBy(version).agg(F.max("d").alias("drift"))


def endpoint_change(df: DataFrame, g: list[str], axis: str, value: str) -> DataFrame:
    m = df.groupBy(*g, axis).agg(F.avg(value).alias("m"))
    return m.groupBy(*g).agg((F.max_by("m", axis) - F.min_by("m", axis)).alias("change"))


def strictly_rising(df: DataFrame, g: list[str], axis: str, value: str) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*g).orderBy(axis))
    up = F.coalesce(F.col(value) > before, F.lit(True))
    return df.withColumn("up", up).groupBy(*g).agg(F.bool_and("up").alias("rising"))


def cumulative(df: DataFrame, g: list[str], block: str, values: list[str]) -> DataFrame:
    """Sums over nested blocks: every size from one pass over the blocks' own sums."""
    w = Window.partitionBy(*g).orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(*g, block, *[F.sum(v).over(w).alias(v) for v in values])


def top_named(df: DataFrame, vec: str, names: list[str], k: int, wanted: list[str]) -> DataFrame:
    """Names of the k largest magnitudes of a vector (ties to the earlier place) and whether one is wanted."""
    pairs = F.transform(F.col(vec), lambda x, i: F.struct((-F.abs(x.cast("double"))).alias("m"), i.alias("i")))
    top = F.slice(F.array_sort(pairs), 1, k)
    named = F.transform(top, lambda p: F.element_at(F.array(*[F.lit(n) for n in names]), p["i"] + 1))
    return df.withColumn("top", F.array_join(named, ",")).withColumn("hit", F.arrays_overlap(named, F.array(*[F.lit(w) for w in wanted])))


def first_crossover(pairs: DataFrame, g: list[str], axis: str, a: str, b: str) -> DataFrame:
    """Smallest place on the axis where a <= b; null if there is none."""
    return pairs.groupBy(*g).agg(F.min(F.when(F.col(a) <= F.col(b), F.col(axis))).alias("crossover"))


def representative_sizes(df: DataFrame, axis: str, fixed: list[int]) -> DataFrame:
    """The fixed sizes if all are present, else the first, middle and last."""
    s = F.sort_array(F.collect_set(axis))
    want = F.array(*[F.lit(f) for f in fixed])
    three = F.array(F.element_at(s, 1), F.element_at(s, (F.size(s) / 2).cast("int") + 1), F.element_at(s, -1))
    return df.agg(F.array_join(F.when(F.size(F.array_except(want, s)) == 0, want).otherwise(F.array_distinct(three)), ",").alias("sizes"))


def ranking(df: DataFrame, name: str, value: Column, k: int) -> DataFrame:
    """The k largest, ties in name order, with their place."""
    top = df.select(F.col(name), value.alias("value")).orderBy(F.desc("value"), name).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), name)))
