"""Operators on tiny frames, and a few queries against their SQL."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import expressions as X
from plumbline.functions import registry
from plumbline.operators import joins
from plumbline.operators import metrics as M
from plumbline.operators import regression as R
from plumbline.operators import splits, windows
from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"


def test_holm_hand_example(spark):
    d = spark.createDataFrame([(0.01, "f"), (0.04, "f"), (0.03, "f"), (0.01, "f"), (0.2, "one"), (None, "f")], "p_value double, family string")
    got = sorted((r.family, r.p_value or -1, r.p_value_holm) for r in windows.holm(d, ["family"]).collect())
    want = [("f", -1, None), ("f", 0.01, 0.04), ("f", 0.01, 0.04), ("f", 0.03, 0.06), ("f", 0.04, 0.06), ("one", 0.2, 0.2)]
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and (g[2] == w[2] or math.isclose(g[2], w[2]))


@pytest.mark.parametrize(("t", "df", "p"), [(0.0, 1, 0.5), (1.0, 1, 0.75), (2.2, 2, 0.9205893), (-3.1, 4, 0.0181097), (2.2, 19, 0.9798107)])
def test_t_distribution(spark, t, df, p):
    got = spark.range(1).select(X.t_cdf(F.lit(t), F.lit(df))).first()[0]
    assert abs(got - p) < 1e-5


def test_nested_split_roles_never_change(spark):
    d = spark.createDataFrame([("a", f"{i:03d}") for i in range(40)], "g string, ord string")
    s = splits.nested_split(d, ["g"], "ord", [10, 15, 30], 0.7).collect()
    role = {}
    for r in s:
        assert role.setdefault(r.ord, r.role) == r.role
    assert sum(r.n_labeled == 30 for r in s) == 30
    # a block of five: 3.5 rounds to the even 4
    assert sum(r.block == 1 and r.role == "train" and r.n_labeled == 15 for r in s) == 4


def test_sample_larger_than_pool():
    with pytest.raises(ValueError):
        splits.sample_first(None, [], "o", 5, pool=4)


def test_unknown_library():
    with pytest.raises(KeyError, match="known"):
        registry.features("absent")


def grams(n=80, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.ones(n), rng.uniform(0.1, 2, n), rng.uniform(0, 0.1, n)])
    y = x @ [0.2, 1.05, -0.9] + rng.normal(0, 0.01, n)
    z = np.column_stack([x, y])
    w = z.copy()
    w[:, 3] = w[:, 1]
    return z, w


def test_residual_basis_is_orthogonal(spark):
    z, _ = grams()
    d = spark.createDataFrame([("g", *map(float, r)) for r in z], "g string, one double, x double, b double, y double")
    c = ["one", "x", "b"]
    p = R.projection(R.gram(d, ["g"], c), ["g"], c, ["one", "x"], ["b"])
    out = R.residualize(d, p, ["g"], ["one", "x"], ["b"]).select(F.abs(F.sum(F.col("b") * F.col("x"))), F.abs(F.sum("b"))).first()
    assert max(out) < 1e-8


def test_gram_doesn_t_depend_on_partitions(spark):
    z, _ = grams()
    d = spark.createDataFrame([("g", *map(float, r)) for r in z], "g string, one double, x double, b double, y double")
    a, b = (R.gram(d.repartition(k), ["g"], ["one", "x", "y"]).first().xtx for k in (1, 7))
    assert np.allclose(a, b, rtol=1e-12)


@pytest.mark.parametrize("name", ["entry_aligned_vs_reference", "src07_fingerprint", "prj15_validity_masks", "smp04_manifest", "agg21_gram", "reg02_two_columns", "win03_stagnation", "qa03_batch_acceptance", "reg12_objective_all_terms", "reg27_weak_fit_diagnostics_linear", "qa07_weak_fit_audit_linear", "exp02_level_tests_linear", "agg10_quantiles", "jn06_nearest", "reg10_two_parameters", "reg10_penalized_column", "reg13_refresh_sweeps", "reg19_one_standard_error", "qa01_fit_gates_with_limit"])
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.sql(f"create view {t} as select * from '{os.path.join(SF, t)}.parquet'")
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    a, b = a[sorted(a.columns)], b[sorted(b.columns)]
    assert list(a.columns) == list(b.columns)
    text = lambda d: sorted(tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in d.astype(object).itertuples(index=False))
    assert text(a) == text(b)


@pytest.mark.parametrize("whole", [None, 0])
def test_quantiles(spark, monkeypatch, whole):
    """Brackets give what sorting gives: skewed groups, heavy ties, null keys and groups without a value."""
    if whole is not None:
        monkeypatch.setattr(M, "WHOLE", whole)
        monkeypatch.setattr(M, "SKETCH", 200)
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.lognormal(0, 3, 30000)] + [(None, float(v)) for v in rng.integers(0, 4, 9000)] + [("none", None)] * 3
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    at = {"q99": 0.99, "q0": 0.0, "q3": 0.3, "median": 0.5, "q1": 1.0}
    got = {r.k: r for r in M.quantiles(df, ["k"], F.col("x"), at).collect()}
    assert set(got) == {"a", None, "none"} and all(got["none"][n] is None for n in at)
    for k in ("a", None):
        x = [v for g, v in rows if g == k]
        assert np.allclose([got[k][n] for n in at], np.quantile(x, list(at.values())), rtol=1e-12)
    assert M.quantiles(df.where("k = 'a'"), [], F.col("x"), {"m": 0.5}).first().m == pytest.approx(np.median([v for g, v in rows if g == "a"]))
    assert M.quantiles(df.limit(0), ["k"], F.col("x"), at).count() == 0


def test_nearest_on_line(spark):
    """Sorted neighbours give what all pairs give: ties, equal values, queries beyond both ends, nulls."""
    rng = np.random.default_rng(5)
    rows = [(k, i, float(v)) for k, n in (("a", 3000), ("b", 2)) for i, v in enumerate(rng.integers(0, 4000, n))] + [("a", 9999, None)]
    queries = [(k, i, float(v)) for k in ("a", "b", "c") for i, v in enumerate(rng.integers(-500, 4500, 400) / 2 * 2)] + [("a", 999, None)]
    r, q = spark.createDataFrame(rows, "k string, r long, x double"), spark.createDataFrame(queries, "k string, q long, x double")
    got = {(t.k, t.q): (t.distance, t.match) for t in joins.nearest(q, r, ["k"], ["x"], "q", "r").collect()}
    want = {(k, i): min((abs(x - v), m) for g, m, v in rows if g == k and v is not None) for k, i, x in queries if x is not None and k != "c"}
    assert got == want


@pytest.mark.parametrize("columns", [2, 4])
def test_nearest_in_cells(spark, monkeypatch, columns):
    """Cells give what all pairs give, over a few per cent of them: ties, equal points, far queries, empty cells, nulls."""
    monkeypatch.setattr(joins, "CELL_ROWS", 8)
    rng = np.random.default_rng(columns)
    names = [f"x{k}" for k in range(columns)]
    point = lambda n: np.round(np.concatenate((rng.random((n - n // 4, columns)), rng.normal(0.2, 0.02, (n // 4, columns)))), 3)
    rows = [("a", i, *map(float, p)) for i, p in enumerate(point(4000))] + [("b", i, *map(float, p)) for i, p in enumerate(point(3))]
    rows += [("a", 9000 + i, *r[2:]) for i, r in enumerate(rows[:50])] + [("a", 9999, *[None] * columns)]
    queries = [("a", i, *map(float, p)) for i, p in enumerate(point(300))] + [("a", 900, *[9.0] * columns), ("a", 901, *[-5.0] * columns), ("a", 902, *[None] * columns)]
    queries += [("b", i, *map(float, p)) for i, p in enumerate(point(9))] + [("c", 1, *[0.5] * columns)]
    schema = lambda n: f"k string, {n} long, " + ", ".join(f"{c} double" for c in names)
    r, q = spark.createDataFrame(rows, schema("r")), spark.createDataFrame(queries, schema("q"))
    got = {(t.k, t.q): (t.distance, t.match) for t in joins.nearest(q, r, ["k"], names, "q", "r").collect()}
    own = {k: [v for v in rows if v[0] == k and v[2] is not None] for k in "ab"}
    want = {}
    for k, i, *p in queries:
        if p[0] is not None and k != "c":
            d = np.zeros(len(own[k]))
            for c in range(columns):
                d = d + (p[c] - np.array([v[2 + c] for v in own[k]])) ** 2
            want[k, i] = min(zip(np.sqrt(d).tolist(), [v[1] for v in own[k]], strict=True))
    assert set(got) == set(want) and all(got[t][1] == want[t][1] and np.isclose(got[t][0], want[t][0], rtol=1e-12) for t in want)
    pairs = joins.near_pairs(q.where("k = 'a' and q < 900"), r, ["k"], names, "q", "r").count()
    assert pairs < (0.03 if columns == 2 else 0.12) * 300 * 4000
    assert joins.nearest(q, r.limit(0), ["k"], names, "q", "r").count() == 0


def test_ranked_rows_are_the_first(spark):
    """Positions by counts of prefixes are those of one sorted group, whatever shares a prefix."""
    rng = np.random.default_rng(8)
    rows = [(k, "".join(rng.choice(list("0123456789abcdef"), 12)), i) for i, k in enumerate(rng.choice(["a", "b", "c"], 20000, p=[0.8, 0.19, 0.01]))]
    rows += [("a", f"77777{i:07d}", 30000 + i) for i in range(3000)]
    df = spark.createDataFrame([(str(k), o, int(i)) for k, o, i in rows], "k string, o string, i long").repartition(5)
    got = {(r.k, r.pos): r.i for r in splits.ranked_rows(df, ["k"], "o", 9000, 2).collect()}
    want = {}
    for k in "abc":
        for pos, (_, i) in enumerate(sorted((o, i) for g, o, i in rows if g == k)[:9000]):
            want[k, pos + 1] = i
    assert got == want


def test_nearest_both_ways_by_hand(spark, monkeypatch):
    """Distances of both sides equal brute force: shared ids, nulls, groups without a partner; in one task or as pairs of cells."""
    import random

    draw = random.Random(11)
    point = lambda: tuple(None if draw.random() < 0.03 else draw.choice([0.0, 0.25, draw.random()]) for _ in range(3))
    few = [(draw.choice(["a", "b", "only few", None]), draw.randrange(15), *point()) for _ in range(40)]
    many = [(draw.choice(["a", "b", "only many", None]), f"m{draw.randrange(700)}", *point()) for _ in range(900)]
    whole = lambda rows: [r for r in rows if r[0] is not None and None not in r[2:]]

    def least(own, other, side):
        out = {}
        for k, i, *p in whole(own):
            for l, _, *q in whole(other):  # noqa: E741
                if k == l:
                    d = math.sqrt(sum((x - y) ** 2 for x, y in zip(p, q, strict=True)))
                    out[k, side, i] = min(d, out.get((k, side, i), d))
        return out

    wanted = least(few, many, "few") | least(many, few, "many")
    f = spark.createDataFrame(few, "k string, f long, x double, y double, z double")
    m = spark.createDataFrame(many, "k string, m string, x double, y double, z double").repartition(5)
    for limit, held, part in ((20_000, 1 << 16, 1 << 13), (40, 100, 7), (10, 1 << 16, 1 << 13)):
        monkeypatch.setattr(joins, "FEW", limit)
        monkeypatch.setattr(joins, "HELD", held)
        monkeypatch.setattr(joins, "PART", part)
        got = joins.nearest_both_ways(f, m, ["k"], ["x", "y", "z"], "f", "m").collect()
        assert len(got) == len(wanted)
        assert {(r.k, r.side, r.few_id if r.side == "few" else r.many_id): r.distance for r in got} == pytest.approx(wanted, abs=1e-15)
    monkeypatch.setattr(joins, "FEW", 20_000)
    assert joins.nearest_both_ways(f.limit(0), m, ["k"], ["x", "y", "z"], "f", "m").count() == 0
    assert joins.nearest_both_ways(f, m.limit(0), ["k"], ["x", "y", "z"], "f", "m").count() == 0


def test_coverage_of_the_cube_makes_no_pairs(spark, monkeypatch):
    """Every weak row has all labeled rows of its batch in few cells, so pairs of rows were as many as all pairs."""
    import __spark_entry__ as e

    def pairs(*_):
        raise AssertionError("pairs of rows are made")

    monkeypatch.setattr(joins, "near_pairs", pairs)
    assert len(e.queries()["qa04_coverage_cube"](spark, "/root/testdata/sf0.001").collect()) == 10
