"""Gates: rows check, status, value, value_text, threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.reshape import union_parts


def gate(df: DataFrame, name: str, value: Column, passed: Column, threshold: str, otherwise: str = "fail", text: Column | None = None) -> DataFrame:
    """One gate row of one aggregate; null counts as not passed."""
    a = df.agg(value.cast("double").alias("value"), passed.alias("ok"), (text if text is not None else F.lit(None)).cast("string").alias("value_text"))
    status = F.when(F.col("ok"), "pass").otherwise(otherwise)
    return a.select(F.lit(name).alias("check"), status.alias("status"), "value", "value_text", F.lit(threshold).alias("threshold"))


def gates(df: DataFrame, checks: list[tuple]) -> DataFrame:
    """Gate rows of one source from one aggregate: (name, value, passed, threshold[, status otherwise]) each; null counts as not
    passed."""
    rows = []
    for name, value, passed, threshold, *otherwise in checks:
        status = F.when(passed, "pass").otherwise(otherwise[0] if otherwise else "fail")
        rows.append(F.struct(F.lit(name).alias("check"), status.alias("status"), value.cast("double").alias("value"), F.lit(None).cast("string").alias("value_text"), F.lit(threshold).alias("threshold")))
    return df.agg(F.array(*rows).alias("_rows")).select(F.explode("_rows").alias("_r")).select("_r.*")


def info(df: DataFrame, name: str, value: Column) -> DataFrame:
    return gate(df, name, value, F.lit(False), "", "info")


def run_gates(gates: list[DataFrame]) -> DataFrame:
    return union_parts(gates)


def label_consistency(df: DataFrame, g: list[str], label: str, score: str, tolerance: float) -> DataFrame:
    """Per group the largest gap between stored labels and the reference scored again, how many labels are off (null ones too),
    and whether none is."""
    gap = F.abs(F.col(label) - F.col(score))
    off = ~F.coalesce(gap <= tolerance, F.lit(False))
    return df.groupBy(*g).agg(F.max(gap).alias("largest"), F.count_if(off).alias("wrong"), (F.count_if(off) == 0).alias("consistent"))


def tolerance_table(found: DataFrame, expected: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Reproduced beside expected values, their difference and PASS or FAIL."""
    j = found.join(expected, keys)
    d = F.col("value") - F.col("expected")
    return j.select(*keys, "value", "expected", d.alias("difference"), F.when(F.abs(d) <= tolerance, "PASS").otherwise("FAIL").alias("result"))


def unattained(calibrated: DataFrame, tolerance: float) -> DataFrame:
    """Targets whose calibration misses by more than the tolerance."""
    return calibrated.where(F.col("gap") > tolerance)
