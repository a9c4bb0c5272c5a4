"""Seeded orders, nested splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expressions import half_even


def seeded_order(seed: int, *keys: Column | str) -> Column:
    """An order fixed by a seed and a row's keys, the same in any SQL engine with md5."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def first_rows(df: DataFrame, g: list[str], order: str, n: int) -> DataFrame:
    """The first n rows of each group, with their position.  The limit holds in every task before the
    shuffle, so a group of any size sends n rows a task."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*g).orderBy(order))).where(F.col("pos") <= n)


LARGE, PREFIX = 100_000, 4


def ranked_rows(df: DataFrame, g: list[str], order: str, n: int, prefix: int = PREFIX) -> DataFrame:
    """first_rows for an n of any size: the position of a row is the number of rows of its group whose order has a smaller
    prefix, and its place within its own prefix.  No task sorts more than the rows of one prefix; prefixes that begin beyond n are
    left out before the sort.  `order` is a text that is spread evenly, such as seeded_order."""
    rows = df.withColumn("_bin", F.substring(F.col(order), 1, prefix))
    before = Window.partitionBy(*g).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*g, "_bin").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    near = rows.join(counts.where(F.col("_start") < n).drop("_n"), [*g, "_bin"])
    place = F.row_number().over(Window.partitionBy(*g, "_bin").orderBy(order))
    return near.withColumn("pos", F.col("_start") + place).where(F.col("pos") <= n).drop("_bin", "_start")


def sample_first(df: DataFrame, g: list[str], order: str, n: int, pool: int | None = None) -> DataFrame:
    """Nested subsample: a larger n only adds rows.  n above the pool's size is an error; from LARGE rows on no group is
    sorted in one task."""
    if pool is not None and n > pool:
        raise ValueError(f"{n} rows asked for of a pool of {pool}")
    return (ranked_rows if n >= LARGE else first_rows)(df, g, order, n).drop("pos")


def nested_split(df: DataFrame, g: list[str], order: str, sizes: list[int], fraction: float) -> DataFrame:
    """Rows of each size with their role.  The order is cut into blocks at the sizes; of each block
    round-half-even(fraction * length), at least one and not all, train; earlier roles never change."""
    starts = [0, *sizes[:-1]]
    rows = first_rows(df, g, order, sizes[-1])
    block = sum((F.when(F.col("pos") > s, 1).otherwise(0) for s in sizes), F.lit(0)).cast("int")
    begin = F.element_at(F.array(*[F.lit(s) for s in starts]), block + 1)
    length = F.element_at(F.array(*[F.lit(b - a) for a, b in zip(starts, sizes, strict=True)]), block + 1)
    train = F.greatest(F.lit(1), F.least(length - 1, half_even(length * F.lit(fraction))))
    rows = rows.withColumn("block", block).withColumn("role", F.when(F.col("pos") - begin <= train, "train").otherwise("validation"))
    # a row of block b belongs to the sizes from b on
    ends = F.array(*[F.lit(s) for s in sizes])
    return rows.withColumn("n_labeled", F.explode(F.slice(ends, F.col("block") + 1, F.lit(len(sizes)))))


def split_manifest(split: DataFrame, g: list[str], row: str) -> DataFrame:
    """Sorted row lists by group, size and role.  A split's largest size bounds them."""
    return split.groupBy(*g, "n_labeled", "role").agg(F.array_join(F.sort_array(F.collect_list(row)), ",").alias("rows"))


def split_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows of two manifests are the same, and how many each has."""
    same = a.intersect(b).agg(F.count(F.lit(1)).alias("same"))
    return same.crossJoin(a.agg(F.count(F.lit(1)).alias("left_rows"))).crossJoin(b.agg(F.count(F.lit(1)).alias("right_rows")))


def merge_roles(split: DataFrame) -> DataFrame:
    """Train and validation rows as one role for a refit."""
    return split.where(F.col("role").isin("train", "validation")).withColumn("role", F.lit("refit"))


def by_role(df: DataFrame, roles: list[str]) -> DataFrame:
    return df.where(F.col("role").isin(*roles))


def only_split_rows(df: DataFrame, split: DataFrame, keys: list[str]) -> DataFrame:
    """Labeled rows that a split names; weak and test rows stay."""
    named = df.where("role = 'labeled'").join(split.select(*keys).distinct(), keys, "left_semi")
    return named.unionByName(df.where("role <> 'labeled'"))
