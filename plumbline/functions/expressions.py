"""Scalar and feature expressions.  All stay in Catalyst: none runs Python per row."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column | str, low: float | Column, high: float | Column) -> Column:
    """Nearest value of the box [low, high]; null stays null."""
    x = col(x)
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def in_box(x: Column | str, low: float, high: float) -> Column:
    return col(x).between(low, high)


def is_finite(x: Column | str) -> Column:
    x = col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def all_finite(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & is_finite(c)
    return out


def guarded_ratio(a: Column | str, b: Column | str, eps: float = 1e-9) -> Column:
    """a / b, with b kept away from zero on its own side."""
    return col(a) / signed_floor(b, eps)


def signed_floor(x: Column | str, eps: float) -> Column:
    """x with a magnitude of at least eps and the sign of x (zero counts as positive)."""
    x = col(x)
    return F.when(F.abs(x) >= eps, x).when(x < 0, F.lit(-eps)).otherwise(F.lit(eps))


def saturating_exp(x: Column | str, limit: float) -> Column:
    """exp of x with the exponent held within [-limit, limit]."""
    return F.exp(clip(x, -limit, limit))


def half_even(x: Column | str) -> Column:
    """Nearest integer, halves to the even one."""
    return F.bround(col(x), 0).cast("long")


def log_grid(low: float, high: float, n: int) -> Column:
    """Array of n values spaced evenly in the logarithm, ends included."""
    step = (high - low) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pow(F.lit(10.0), F.lit(low) + i * F.lit(step)))


def inverse_powers(q: str, p: str) -> dict[str, Column]:
    """p, 1/p, p^-0.5, q/p and q p^-0.5; null where p is zero."""
    q_, p_ = col(q), col(p)
    root = F.when(p_ > 0, F.pow(p_, F.lit(-0.5)))
    return {p: p_, f"inv_{p}": F.try_divide(F.lit(1.0), p_), f"root_{p}": root, f"{q}_inv_{p}": F.try_divide(q_, p_), f"{q}_root_{p}": q_ * root}


def mechanism_product(m: str, p: str, power: float = -0.7, scale: float = 1.0) -> dict[str, Column]:
    """A derived column times a power of p, and the same modulated by 1 + scale / p."""
    base = col(m) * F.when(col(p) > 0, F.pow(col(p), F.lit(power)))
    return {f"{m}_pow": base, f"{m}_mod": base * (F.lit(1.0) + F.try_divide(F.lit(scale), col(p)))}


def poly2(columns: list[str], exclude: set[str] = frozenset()) -> dict[str, Column]:
    """All products of degree one and two but those named in exclude."""
    out = {c: col(c) for c in columns} | {f"{a}*{b}": col(a) * col(b) for a, b in combinations_with_replacement(columns, 2)}
    return {k: v for k, v in out.items() if k not in exclude}


def power_grid(bases: list[str], p: str, grid: list[float]) -> dict[str, Column]:
    """Each base column times each power of p."""
    return {f"{b}_p{k}": (col(b) * F.when(col(p) > 0, F.pow(col(p), F.lit(e)))) for b in bases for k, e in enumerate(grid)}


def ratio_basis(a: str, b: str, expanded: bool = False, eps: float = 1e-6) -> dict[str, Column]:
    """Guarded ratios of two columns: three, or twelve with their products, squares and inverses."""
    r, s = guarded_ratio(a, b, eps), guarded_ratio(b, a, eps)
    out = {"ratio": r, "inverse": s, "difference": guarded_ratio(col(a) - col(b), col(a) + col(b), eps)}
    if expanded:
        d = out["difference"]
        out |= {"ratio2": r * r, "inverse2": s * s, "difference2": d * d, "ratio_a": r * col(a), "ratio_b": r * col(b), "inverse_a": s * col(a), "inverse_b": s * col(b), "difference_a": d * col(a), "difference_b": d * col(b)}
    return out


def unit_cube(x: Column | str, low: float, high: float) -> Column:
    return (col(x) - F.lit(low)) / F.lit(high - low)


def t_cdf(t: Column | str, df: Column | str) -> Column:
    """Student's t distribution function for whole degrees of freedom, as a finite trigonometric sum.

    Null where t or df is null or df is below one.
    """
    t, df = col(t), col(df).cast("int")
    angle = F.atan(t / F.sqrt(df.cast("double")))
    sin, cos = F.sin(angle), F.cos(angle)
    even = df % 2 == 0
    terms = F.when(even, (df / 2).cast("int")).otherwise(((df - 1) / 2).cast("int"))

    def add(acc: Column, k: Column) -> Column:
        k = k.cast("double")
        up = F.when(even, (2 * k - 1) / (2 * k)).otherwise((2 * k) / (2 * k + 1))
        term = F.when(k == 0, F.when(even, F.lit(1.0)).otherwise(cos)).otherwise(acc["term"] * up * cos * cos)
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("term"))
    total = F.when(terms > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(terms - 1, F.lit(0))), start, add)["sum"]).otherwise(F.lit(0.0))
    area = F.when(even, sin * total).otherwise((angle + sin * total) * F.lit(2 / 3.141592653589793))
    return F.when((df >= 1) & t.isNotNull(), F.lit(0.5) + area / 2)


def t_quantile(p: float, df: Column | str, steps: int = 60) -> Column:
    """The t value with distribution function p, by bisection between 0 and 700 (p above one half)."""
    df = col(df)

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["low"] + acc["high"]) / 2
        below = t_cdf(mid, df) < F.lit(p)
        return F.struct(F.when(below, mid).otherwise(acc["low"]).alias("low"), F.when(below, acc["high"]).otherwise(mid).alias("high"))

    box = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("low"), F.lit(700.0).alias("high")), halve)
    return (box["low"] + box["high"]) / 2
