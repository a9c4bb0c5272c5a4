"""Named feature libraries and reference models, given as functions that build columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnLibrary:
    """Columns of a fit.  H holds the shape columns Phi(x) that stand alone (`plain`, all unless given) and, for each
    parameter, its value times some of them; B is a basis of discrepancy; penalty groups are named lists of H columns.

    `theta_of` names the shape columns of every parameter; plain names stand for one parameter, `theta`."""

    name: str
    shape: dict[str, Callable[[], Column]]
    theta_of: tuple[str, ...] | dict[str, tuple[str, ...]] = ()
    basis: dict[str, Callable[[], Column]] = field(default_factory=dict)
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    plain: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        known = set(self.h_names())
        asked = [n for names in self.parameters().values() for n in names] + list(self.plain or ())
        wrong = [n for n in asked if n not in self.shape] + [n for names in self.groups.values() for n in names if n not in known]
        if wrong:
            raise ValueError(f"library {self.name!r} has no column {', '.join(wrong)}")

    def parameters(self) -> dict[str, tuple[str, ...]]:
        if isinstance(self.theta_of, dict):
            return self.theta_of
        return {"theta": tuple(self.theta_of)} if self.theta_of else {}

    def alone(self) -> list[str]:
        return list(self.shape if self.plain is None else self.plain)

    def shape_columns(self) -> list[Column]:
        return [build().alias(n) for n, build in self.shape.items()]

    def basis_columns(self) -> list[Column]:
        return [build().alias(n) for n, build in self.basis.items()]

    def h_names(self) -> list[str]:
        return [*self.alone(), *(f"{p}_{n}" for p, names in self.parameters().items() for n in names)]

    def group_places(self) -> list[list[int]]:
        """Places of the H columns of every penalty group."""
        at = {n: k for k, n in enumerate(self.h_names())}
        return [[at[n] for n in names] for names in self.groups.values()]

    def values(self, theta: Column | float | dict[str, Column | float]) -> dict[str, Column]:
        """A column for each parameter; a single value serves the only one."""
        given = theta if isinstance(theta, dict) else dict.fromkeys(self.parameters(), theta)
        if set(given) != set(self.parameters()) or (not isinstance(theta, dict) and len(given) > 1):
            raise ValueError(f"library {self.name!r} has the parameters {', '.join(self.parameters())}")
        return {p: v if isinstance(v, Column) else F.lit(v) for p, v in given.items()}

    def h_columns(self, theta: Column | float | dict[str, Column | float]) -> list[Column]:
        value = self.values(theta)
        own = [self.shape[n]().alias(n) for n in self.alone()]
        return own + [(value[p] * self.shape[n]()).alias(f"{p}_{n}") for p, names in self.parameters().items() for n in names]


_FEATURES: dict[str, ColumnLibrary] = {}
_REFERENCES: dict[str, Callable[..., Column]] = {}


def register_features(library: ColumnLibrary) -> ColumnLibrary:
    _FEATURES[library.name] = library
    return library


def features(name: str) -> ColumnLibrary:
    if name not in _FEATURES:
        raise KeyError(f"unknown feature library {name!r}; known: {', '.join(sorted(_FEATURES))}")
    return _FEATURES[name]


def register_reference(name: str, build: Callable[[Column], Column]) -> None:
    """build(theta) gives the score column; a vectorized pandas_udf call is a column too."""
    _REFERENCES[name] = build


def reference(name: str) -> Callable[[Column], Column]:
    if name not in _REFERENCES:
        raise KeyError(f"unknown reference model {name!r}; known: {', '.join(sorted(_REFERENCES))}")
    return _REFERENCES[name]


def score_reference(df: DataFrame, model: str, theta: Column | float, name: str = "score") -> DataFrame:
    """Add the reference model's score at theta (a literal or a column)."""
    return df.withColumn(name, reference(model)(theta if isinstance(theta, Column) else F.lit(theta)))


def features_h(df: DataFrame, library: str, theta: Column | float | dict[str, Column | float], keep: list[str]) -> DataFrame:
    return df.select(*keep, *features(library).h_columns(theta))


def affine_parts(df: DataFrame, library: str, g: dict[str, float], keep: list[str]) -> DataFrame:
    """H(theta) g = c + the sum of slope times parameter: the constant part and a slope for each parameter of every row, named
    `slope` where there is one parameter, else slope_<parameter>."""
    s = features(library)
    total = lambda names, pick: sum((pick(n) * F.lit(float(g.get(k, 0.0))) for n, k in names), F.lit(0.0))
    c = total([(n, n) for n in s.alone()], lambda n: s.shape[n]())
    one = len(s.parameters()) == 1
    slopes = [total([(n, f"{p}_{n}") for n in names], lambda n: s.shape[n]()).alias("slope" if one else f"slope_{p}") for p, names in s.parameters().items()]
    return df.select(*keep, c.alias("c"), *slopes)
