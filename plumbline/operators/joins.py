"""Paired, planned and nearest joins."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.shared import written


def pair_arms(metrics: DataFrame, left: str, right: str, metric: str, keys: list[str]) -> DataFrame:
    """Keys that both arms have, with the metric as left and right.  The metrics, a row for each arm and keys, are read once."""
    arms = metrics.where(F.col("model").isin(left, right))
    of = lambda m, n: F.max(F.when(F.col("model") == m, F.col(metric))).alias(n)
    wide = arms.groupBy(*keys).agg(of(left, "left_value"), of(right, "right_value"), F.count_distinct("model").alias("_arms"))
    return wide.where(F.col("_arms") == len({left, right})).drop("_arms")


def against_best(metrics: DataFrame, arm: str, size: int, others: list[str], metric: str, keys: list[str]) -> DataFrame:
    """For every key the metric of one arm at one size (left) beside that of the best of the others at the key's size (right):
    best by its mean over the keys of the size, ties to the first name.  The metrics are read once; keys: repeat, n_labeled."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col(metric)))
    wide = metrics.where(F.col("model").isin(arm, *others)).groupBy(*keys).agg(of(arm).alias("_own"), *[of(o).alias(f"_{o}") for o in others])
    at_size = Window.partitionBy(*[k for k in keys if k != "repeat"])
    means = F.array_min(F.array_compact(F.array(*[F.when(F.avg(f"_{o}").over(at_size).isNotNull(), F.struct(F.avg(f"_{o}").over(at_size).alias("mean"), F.lit(o).alias("model"))) for o in others])))
    wide = wide.withColumn("left_value", F.max(F.when(F.col("n_labeled") == size, F.col("_own"))).over(Window.partitionBy("repeat"))).withColumn("_best", means["model"])
    right = F.coalesce(*[F.when(F.col("_best") == o, F.col(f"_{o}")) for o in others])
    return wide.select(*keys, "left_value", right.alias("right_value")).where("left_value is not null and right_value is not null")


def suffixed_join(a: DataFrame, b: DataFrame, keys: list[str], suffixes: tuple[str, str]) -> DataFrame:
    named = lambda d, s: d.select(*keys, *[F.col(c).alias(c + s) for c in d.columns if c not in keys])
    return named(a, suffixes[0]).join(named(b, suffixes[1]), keys)


def attach(df: DataFrame, parameters: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters of a group onto its rows.  Spark broadcasts them while they are below its threshold."""
    return df.join(parameters, keys)


def candidate_grid(conditions: DataFrame, **lists: list[float]) -> DataFrame:
    """Every condition with every combination of the listed values."""
    return reduce(lambda d, kv: d.withColumn(kv[0], F.explode(F.array(*[F.lit(v) for v in kv[1]]))), lists.items(), conditions)


def plan_conditions(repeats: DataFrame, sizes: list[int], models: dict[str, list[int] | None]) -> DataFrame:
    """Repeat x size x model; a model with a list of sizes runs at those only."""
    allowed = F.lit(False)
    for m, own in models.items():
        allowed = allowed | ((F.col("model") == m) & (F.lit(True) if own is None else F.col("n_labeled").isin(*own)))
    return candidate_grid(repeats, n_labeled=sizes, model=list(models)).where(allowed)


CELLS = 256


def nearest(queries: DataFrame, rows: DataFrame, g: list[str], columns: list[str], query_id: str, row_id: str) -> DataFrame:
    """Nearest row of each query within its group: smallest Euclidean distance, ties to the smaller id.  Queries
    and rows with a null coordinate take no part.

    One column: both sides are sorted and a query looks at its neighbours (nearest_on_line).  More columns: nearest_in_cells.
    """
    if len(columns) == 1:
        return nearest_on_line(queries, rows, g, columns[0], query_id, row_id)
    return nearest_in_cells(queries, rows, g, columns, query_id, row_id)


CUTS, CELL_ROWS = 64, 64


def _cell(column: str, k: int) -> Column:
    """Number of cuts of column k below a value."""
    return F.size(F.filter(F.get("_cuts", F.lit(k)), lambda c: c < F.col(column)))


def near_pairs(queries: DataFrame, rows: DataFrame, g: list[str], columns: list[str], query_id: str, row_id: str) -> DataFrame:
    """Pairs among which every query's nearest row is: group, _q, _m, distance d.

    Approximate quantiles cut every column of a group of n points so that a cell holds about CELL_ROWS of them.  A first bound on
    a query's distance comes from its own cell, and from one point of each coarser cell about it (pairs of cells joined, level after
    level, up to the whole group).  The ball of that bound lies between two cuts of every column; the cells between
    them whose walls are no further than the bound hold the nearest row, and no others are looked at.
    """
    dims = range(len(columns))
    x = [f"_x{k}" for k in dims]
    coordinates = lambda d: [F.col(c).cast("double").alias(n) for c, n in zip(columns, x, strict=True)]  # noqa: E731, ARG005
    # equal points count once, by their smallest id
    r = rows.dropna(subset=columns).select(*g, F.col(row_id).alias("_m"), *coordinates(rows)).groupBy(*g, *x).agg(F.min("_m").alias("_m"))
    q = queries.dropna(subset=columns).select(*g, F.col(query_id).alias("_q"), *coordinates(queries))
    marks = [i / CUTS for i in range(1, CUTS)]
    cuts = r.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.percentile_approx(c, marks, 20 * CUTS) for c in x]).alias("_all"))
    many = F.greatest(F.lit(1), F.least(F.lit(CUTS), F.floor(F.pow(F.col("_n") / CELL_ROWS, 1 / len(columns))))).cast("int")
    chosen = F.transform("_all", lambda a: F.when(F.col("_many") == 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), F.col("_many") - 1), lambda j: F.get(a, (j * CUTS / F.col("_many")).cast("int") - 1))))
    cuts = cuts.withColumn("_many", many).select(*g, "_many", chosen.alias("_cuts"))
    cell = lambda level=0: [F.shiftright(f"_c{k}", level).alias(f"_c{k}") for k in dims]
    key = [f"_c{k}" for k in dims]
    placed = lambda d: d.join(cuts, g).withColumns({f"_c{k}": _cell(n, k) for k, n in enumerate(x)})
    # each side is read several times from here on, its source once
    r, _ = written(placed(r).select(*g, *key, F.struct(*x).alias("_p"), "_m"), "near-rows")
    q, _ = written(placed(q).select(*g, "_q", *x, "_cuts", *key), "near-queries")
    far = lambda p: F.sqrt(reduce(lambda a, b: a + b, [(F.col(n) - p[n]) ** 2 for n in x]))
    # one point of each coarser cell; the number of levels follows the logarithm of CUTS
    levels = range(1, CUTS.bit_length() + 1)
    points = r.select(*g, F.explode(F.array(*[F.struct(F.lit(v).alias("_level"), *cell(v)) for v in levels])).alias("_l"), "_p").groupBy(*g, "_l").agg(F.min("_p").alias("_p"))
    asked = q.select(*g, "_q", *x, F.explode(F.array(*[F.struct(F.lit(v).alias("_level"), *cell(v)) for v in levels])).alias("_l"))
    bound = asked.join(points, [*g, "_l"]).select(*g, "_q", far(F.col("_p")).alias("_d"))
    own = q.select(*g, "_q", *x, *key).join(r, [*g, *key]).select(*g, "_q", far(F.col("_p")).alias("_d"))
    bound = bound.unionByName(own).groupBy(*g, "_q").agg((F.min("_d") * (1 + 1e-9) + 1e-300).alias("_d"))
    q = q.join(bound, [*g, "_q"])
    for k, n in enumerate(x):
        edge = lambda v, k=k: F.size(F.filter(F.get("_cuts", F.lit(k)), lambda c: c < v))
        near = F.sequence(edge(F.col(n) - F.col("_d")), edge(F.col(n) + F.col("_d")))
        wall = F.get("_cuts", F.lit(k))
        # distance to the slab between cut c - 1 and cut c
        q = q.withColumn(f"_c{k}", F.explode(near)).withColumn(
            f"_w{k}", F.greatest(F.lit(0.0), F.coalesce(F.get(wall, F.col(f"_c{k}") - 1) - F.col(n), F.lit(0.0)), F.coalesce(F.col(n) - F.get(wall, F.col(f"_c{k}")), F.lit(0.0)))
        )
        q = q.where(reduce(lambda a, b: a + b, [F.col(f"_w{i}") ** 2 for i in range(k + 1)]) <= F.col("_d") ** 2 * (1 + 1e-9) + 1e-300)
    return q.select(*g, "_q", *x, *key).join(r, [*g, *key]).select(*g, "_q", "_m", far(F.col("_p")).alias("d"))


def nearest_in_cells(queries: DataFrame, rows: DataFrame, g: list[str], columns: list[str], query_id: str, row_id: str) -> DataFrame:
    """nearest for several columns: exact, over the cells that can hold the nearest row (near_pairs)."""
    pairs = near_pairs(queries, rows, g, columns, query_id, row_id)
    best = pairs.groupBy(*g, "_q").agg(F.min(F.struct("d", "_m")).alias("b"))
    return best.select(*g, F.col("_q").alias(query_id), F.col("b._m").alias("match"), F.col("b.d").alias("distance"))


#: Points that a task holds at once; rows that are held against them together, and those of a group at a time.
FEW, HELD, PART = 20_000, 1 << 16, 1 << 13


def _against(rows: pa.Table, k: int, points: dict[int, tuple[np.ndarray, np.ndarray]], low: dict[int, np.ndarray]) -> pa.RecordBatch:
    """The least distance of every row from the points of its group; `low` keeps the least square of every point."""
    group = rows.column("_g").to_numpy()
    order = np.argsort(group, kind="stable")
    columns = [rows.column(f"_x{i}").to_numpy()[order] for i in range(k)]
    group, found = group[order], np.empty(len(group))
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for start, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)], strict=True):
        g = int(group[start])
        least = low.setdefault(g, np.full(len(points[g][0]), np.nan))
        for at in range(start, stop, PART):
            own = [x[at : min(at + PART, stop)] for x in columns]
            best, square, term = np.full(len(own[0]), np.nan), np.empty(len(own[0])), np.empty(len(own[0]))
            for j, point in enumerate(points[g][1]):
                np.subtract(own[0], point[0], out=square)
                np.multiply(square, square, out=square)
                for x, c in zip(own[1:], point[1:], strict=True):
                    np.subtract(x, c, out=term)
                    np.multiply(term, term, out=term)
                    np.add(square, term, out=square)
                np.fmin(best, square, out=best)
                least[j] = np.fmin(least[j], np.fmin.reduce(square))
            found[at : at + len(best)] = best
    out = np.empty(len(found))
    out[order] = np.sqrt(found)
    return pa.RecordBatch.from_arrays([rows.column("_g").combine_chunks(), pa.nulls(len(out), pa.int32()), rows.column("_id").combine_chunks(), pa.array(out)], ["_g", "_few", "_id", "_d"])


def _both_ways(batches, k: int, points: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Least distances of rows from points, and of points from the rows of this task."""
    low: dict[int, np.ndarray] = {}
    held, n, schema = [], 0, None
    for batch in batches:
        schema = batch.schema
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield _against(pa.Table.from_batches(held).combine_chunks(), k, points, low)
            held, n = [], 0
    if n:
        yield _against(pa.Table.from_batches(held).combine_chunks(), k, points, low)
    for g, least in low.items():
        codes = points[g][0]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), g, np.int32)), pa.array(codes), pa.nulls(len(codes), schema.field("_id").type), pa.array(np.sqrt(least))], ["_g", "_few", "_id", "_d"])


def nearest_both_ways(few: DataFrame, many: DataFrame, g: list[str], columns: list[str], few_id: str, many_id: str) -> DataFrame:
    """Distance of every row of either side to the nearest row of the other within its group: g, side (few, many), few_id,
    many_id (that of the row's side, the other is null), distance.  Rows that share an id are one; rows with a null
    coordinate or without a row to be near to take no part.

    The rows of `many`, of any number, are read once and held against up to FEW points of `few`, which pass the driver once;
    a task keeps the least distance of each point.  More points than that: nearest() both ways.
    """
    a, b = ("few_id", "many_id")
    x = [f"_x{i}" for i in range(len(columns))]
    coordinates = [F.col(c).cast("double").alias(n) for c, n in zip(columns, x, strict=True)]
    held = few.dropna(subset=[*g, *columns]).select(*g, F.col(few_id).alias(a), *coordinates).limit(FEW + 1).toArrow()
    if held.num_rows > FEW:
        there = nearest(few, many, g, columns, few_id, many_id).select(*g, F.lit("few").alias("side"), F.col(few_id).alias(a), F.lit(None).alias(b), "distance")
        back = nearest(many, few, g, columns, many_id, few_id).select(*g, F.lit("many").alias("side"), F.lit(None).alias(a), F.col(many_id).alias(b), "distance")
        return there.unionByName(back)
    spark = many.sparkSession
    groups, ids, points = {}, {}, {}
    rows = held.to_pylist()
    for r in rows:
        group = groups.setdefault(tuple(r[c] for c in g), len(groups))
        code = ids.setdefault((group, r[a]), len(ids))
        points.setdefault(group, []).append((code, [r[n] for n in x]))
    points = {k: (np.array([c for c, _ in v], np.int32), np.array([p for _, p in v])) for k, v in points.items()}
    fields = {f.name: f.dataType.simpleString() for f in few.schema.fields}
    table = lambda values, names: spark.createDataFrame(values, ", ".join(f"`{n}` {t}" for n, t in names))
    groups_of = table([(*v, k) for v, k in groups.items()], [*[(c, fields[c]) for c in g], ("_g", "int")])
    ids_of = table([(v[1], k) for v, k in ids.items()], [(a, fields[few_id]), ("_few", "int")])
    own = many.dropna(subset=columns).join(F.broadcast(groups_of), g).select("_g", F.col(many_id).alias("_id"), *coordinates)
    kind = own.schema["_id"].dataType.simpleString()
    found = own.mapInArrow(partial(_both_ways, k=len(columns), points=points), f"_g int, _few int, _id {kind}, _d double")
    least = found.groupBy("_g", "_few", "_id").agg(F.min("_d").alias("distance"))
    named = least.join(F.broadcast(groups_of), "_g").join(F.broadcast(ids_of), "_few", "left")
    return named.select(*g, F.when(F.col("_few").isNull(), "many").otherwise("few").alias("side"), a, F.col("_id").alias(b), "distance")


def coverage_shares(distances: DataFrame, g: list[str], diagonal: float, limit: float) -> DataFrame:
    """Coverage of one set by another from nearest distances: mean and 95th percentile, both over the cube's diagonal, shares of rows within
    10 and 15 per cent of it, and whether the percentile is under the limit.  The distances are read several times, their source once."""
    from plumbline.operators.metrics import quantiles

    distances, _ = written(distances.select(*g, "distance"), "distances")
    d = F.col("distance")
    share = lambda x: F.avg((d < x * diagonal).cast("double"))
    moments = distances.groupBy(*g).agg(F.avg(d).alias("mean"), share(0.10).alias("within_10"), share(0.15).alias("within_15"))
    q = quantiles(distances, g, d, {"p95": 0.95})
    out = moments.join(q, g) if g else moments.crossJoin(q)
    return out.select(*g, "mean", "p95", (F.col("mean") / diagonal).alias("mean_of_diagonal"), (F.col("p95") / diagonal).alias("p95_of_diagonal"), "within_10", "within_15", (F.col("p95") < limit).alias("passed"))


def nearest_on_line(queries: DataFrame, rows: DataFrame, g: list[str], column: str, query_id: str, row_id: str) -> DataFrame:
    """nearest for one column: no pairs are made.

    Rows with equal values count once, by their smallest id.  Approximate quantiles cut a group into CELLS cells of
    about equal size, which may lie in different tasks; within one, running extremes over the sorted values give the
    next row on either side, and the ends of other cells close the gaps at the borders.
    """
    r = rows.where(F.col(column).isNotNull()).groupBy(*g, F.col(column).cast("double").alias("_x")).agg(F.min(row_id).alias("_m"))
    q = queries.where(F.col(column).isNotNull()).select(*g, F.col(column).cast("double").alias("_x"), F.col(query_id).alias("_q"))
    cuts = r.groupBy(*g).agg(F.percentile_approx("_x", [i / CELLS for i in range(1, CELLS)], 20 * CELLS).alias("_cuts"))
    both = r.select(*g, "_x", "_m", F.lit(None).alias("_q"), F.lit(0).alias("_kind")).unionByName(q.select(*g, "_x", F.lit(None).alias("_m"), "_q", F.lit(1).alias("_kind")))
    cell = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
    both = both.join(cuts, g).select(*g, cell.alias("_cell"), "_x", "_m", "_q", "_kind")
    row = F.when(F.col("_kind") == 0, F.struct("_x", "_m"))
    own = Window.partitionBy(*g, "_cell")
    up, down = own.orderBy("_x", "_kind"), own.orderBy(F.desc("_x"), "_kind")
    seen = both.withColumn("_below", F.max(row).over(up)).withColumn("_above", F.min(row).over(down)).where("_kind = 1")
    ends = both.groupBy(*g, "_cell").agg(F.max(row).alias("_high"), F.min(row).alias("_low"))
    line = Window.partitionBy(*g)
    ends = ends.select(
        *g, "_cell",
        F.max("_high").over(line.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.min("_low").over(line.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    low, high = F.coalesce("_below", "_before"), F.coalesce("_above", "_after")
    at = lambda s: F.when(s.isNotNull(), F.struct(F.abs(F.col("_x") - s["_x"]).alias("d"), s["_m"].alias("m")))
    found = seen.join(ends, [*g, "_cell"]).select(*g, F.col("_q").alias(query_id), F.array_min(F.array_compact(F.array(at(low), at(high)))).alias("b"))
    return found.select(*g, query_id, F.col("b.m").alias("match"), F.col("b.d").alias("distance"))


def nearest_grid(targets: DataFrame, grid: DataFrame, target: str, statistic: str, value: str) -> DataFrame:
    """For each target the grid point whose statistic is closest, ties to the smaller value.  Both sides are
    lists of parameters."""
    pairs = targets.crossJoin(F.broadcast(grid))
    gap = F.abs(F.col(statistic) - F.col(target))
    return pairs.groupBy(target).agg(F.min(F.struct(gap.alias("gap"), F.col(value).alias("v"), F.col(statistic).alias("s"))).alias("b")).select(target, F.col("b.v").alias(value), F.col("b.s").alias(statistic), F.col("b.gap").alias("gap"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many distinct key tuples two sets share."""
    return a.select(*keys).intersect(b.select(*keys)).agg(F.count(F.lit(1)).alias("shared"))


def winners(metrics: DataFrame, best: DataFrame) -> DataFrame:
    return metrics.join(best.select("n_labeled", "model"), ["n_labeled", "model"])


def replicate_arm(metrics: DataFrame, arm: Column, sizes: list[int]) -> DataFrame:
    """Rows of one arm repeated at every size."""
    return metrics.where(arm).withColumnRenamed("n_labeled", "n_source").withColumn("n_labeled", F.explode(F.array(*[F.lit(s) for s in sizes])))


def reference_values(metrics: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics beside expected values, with absolute and relative gap; null where none is expected."""
    j = metrics.join(expected, keys, "left")
    gap = F.col("value") - F.col("expected")
    return j.withColumn("gap", gap).withColumn("relative_gap", F.try_divide(gap, F.col("expected")))
