"""The given tables in the engine's roles, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.registry import ColumnLibrary, register_features, register_reference
from plumbline.operators.splits import nested_split, seeded_order

SIZES = [10, 20, 30, 60, 120]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations: batch_id (supplier region), supp, ord, role, price, qty, size, disc, tax, y.

    Prices and y are in thousands.  The order's first hex digit gives the role.
    """
    li, su, na, re, pa = (table(spark, sf_dir, n) for n in ("lineitem", "supplier", "nation", "region", "part"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    order = seeded_order(7, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents, days)
    j = li.join(su, li.l_suppkey == su.s_suppkey).join(na, F.col("s_nationkey") == na.n_nationkey).join(re, F.col("n_regionkey") == re.r_regionkey).join(pa, li.l_partkey == pa.p_partkey)
    digit = F.substring("ord", 1, 1)
    return j.select(
        F.col("r_name").alias("batch_id"), F.col("n_name").alias("nation"), F.col("l_suppkey").alias("supp"), order.alias("ord"),
        (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").alias("qty"), F.col("p_size").cast("double").alias("size"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) / 1000).alias("y"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    ).withColumn("role", F.when(digit < "2", "labeled").when(digit < "9", "weak").otherwise("test"))


OBS = """
obs AS (
  SELECT *, CASE WHEN substr(ord, 1, 1) < '2' THEN 'labeled' WHEN substr(ord, 1, 1) < '9' THEN 'weak' ELSE 'test' END AS role FROM (
  SELECT r_name AS batch_id, n_name AS nation, l_suppkey AS supp,
         md5('7|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || round(l_extendedprice * 100)::BIGINT || '|' || date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) AS ord,
         l_extendedprice / 1000 AS price, l_quantity AS qty, p_size::DOUBLE AS size, l_discount AS disc, l_tax AS tax,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000 AS y, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey))"""

SPLIT = OBS + """,
pos AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ord) AS pos FROM obs WHERE role = 'labeled'),
sizes AS (SELECT * FROM (VALUES (0, 0, 10), (1, 10, 20), (2, 20, 30), (3, 30, 60), (4, 60, 120)) v(block, begin_, end_)),
block AS (SELECT pos.* EXCLUDE (role), s.block, CASE WHEN pos - begin_ <= greatest(1, least(end_ - begin_ - 1, round_even((end_ - begin_) * 0.7, 0))) THEN 'train' ELSE 'validation' END AS role
          FROM pos JOIN sizes s ON pos > begin_ AND pos <= end_),
split AS (SELECT block.*, s.end_ AS n_labeled FROM block JOIN sizes s ON s.block >= block.block)"""

ARMS = SPLIT + """,
fit AS (SELECT batch_id, n_labeled, regr_slope(y, price) AS b, regr_intercept(y, price) AS a, sum(price * y) / sum(price * price) AS r, avg(y) AS m FROM split WHERE role = 'train' GROUP BY ALL),
arms AS (SELECT batch_id, n_labeled, 'reference' AS model, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM fit UNION ALL SELECT batch_id, n_labeled, 'affine', a, b FROM fit
         UNION ALL SELECT batch_id, n_labeled, 'ratio', 0.0, r FROM fit UNION ALL SELECT batch_id, n_labeled, 'mean', m, 0.0 FROM fit),
scored AS (SELECT batch_id AS repeat, n_labeled, model, a, b, o.ord, o.y, a + b * price AS pred FROM arms JOIN (SELECT * FROM obs WHERE role = 'test') o USING (batch_id)),
metrics AS (SELECT model, repeat, n_labeled, avg((y - pred) * (y - pred)) AS mse, sqrt(avg((y - pred) * (y - pred))) AS rmse, avg(abs(y - pred)) AS mae FROM scored GROUP BY ALL)"""


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_split(observations(spark, sf_dir).where("role = 'labeled'").drop("role"), ["batch_id"], "ord", SIZES, 0.7)


def fits(split: DataFrame) -> DataFrame:
    """Arms reference, affine, ratio and mean by batch and size, as intercept a and slope b on price."""
    train = split.where("role = 'train'")
    f = train.groupBy("batch_id", "n_labeled").agg(
        F.regr_slope(F.col("y"), F.col("price")).alias("b"), F.regr_intercept(F.col("y"), F.col("price")).alias("a"), (F.sum(F.col("price") * F.col("y")) / F.sum(F.col("price") * F.col("price"))).alias("r"), F.avg("y").alias("m")
    )
    arm = lambda n, a, b: F.struct(F.lit(n).alias("model"), F.col(a).alias("a") if isinstance(a, str) else F.lit(a).alias("a"), F.col(b).alias("b") if isinstance(b, str) else F.lit(b).alias("b"))
    arms = F.explode(F.array(arm("reference", 0.0, 1.0), arm("affine", "a", "b"), arm("ratio", 0.0, "r"), arm("mean", "m", 0.0)))
    return f.select("batch_id", "n_labeled", arms.alias("m")).select("batch_id", "n_labeled", "m.*")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows scored by every arm."""
    test = observations(spark, sf_dir).where("role = 'test'").select("batch_id", "ord", "y", "price")
    j = test.join(fits(split(spark, sf_dir)), "batch_id")
    return j.select(F.col("batch_id").alias("repeat"), "n_labeled", "model", "ord", "y", (F.col("a") + F.col("b") * F.col("price")).alias("pred"))


def arm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics table: model, repeat, n_labeled, mse, rmse, mae.

    The arms of a batch (four a size) come to its test rows as one array, whose errors are summed without a row for
    each; a test row is read once.
    """
    count = 4 * len(SIZES)
    arms = fits(split(spark, sf_dir)).groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("n_labeled", "model", "a", "b"))).alias("arms"))
    test = observations(spark, sf_dir).where("role = 'test'").select("batch_id", "y", "price").join(arms, "batch_id")
    sums = []
    for k in range(count):
        own = F.get("arms", F.lit(k))
        e = F.col("y") - own["a"] - own["b"] * F.col("price")
        sums += [F.avg(e * e).alias(f"s{k}"), F.avg(F.abs(e)).alias(f"t{k}")]
    out = test.groupBy("batch_id").agg(F.first("arms").alias("arms"), *sums)
    rows = F.explode(F.array(*[F.struct(F.get("arms", F.lit(k)).alias("arm"), F.col(f"s{k}").alias("mse"), F.sqrt(f"s{k}").alias("rmse"), F.col(f"t{k}").alias("mae")) for k in range(count)]))
    return out.select("batch_id", rows.alias("r")).where("r.arm is not null").select("r.arm.model", F.col("batch_id").alias("repeat"), "r.arm.n_labeled", "r.mse", "r.rmse", "r.mae")


# fixed values of the heated rod: length in m, temperature of its lower end in K
ROD_LENGTH, ROD_LOW = 0.1, 293.15


def rod_temperature(q: Column, h: Column, t_inf: Column, theta: Column) -> Column:
    """Mean interface temperature of a heated rod with conductivity 1 / theta, flux q, convection h to t_inf: not linear in theta."""
    half, out = ROD_LENGTH * theta / 2, 1 / h
    flow = (q * ROD_LENGTH * (half + out) + t_inf - ROD_LOW) / (ROD_LENGTH + out / theta)
    return F.lit(ROD_LOW) + flow * ROD_LENGTH / 2 - q * half * ROD_LENGTH / 4


register_reference("list_price", lambda theta: theta * F.col("price"))
register_features(
    ColumnLibrary(
        "charge",
        shape={"one": lambda: F.lit(1.0), "price": lambda: F.col("price"), "qty": lambda: F.col("qty") / 10},
        theta_of=("price",),
        basis={"price_disc": lambda: F.col("price") * F.col("disc"), "price_tax": lambda: F.col("price") * F.col("tax")},
        groups={"shape": ("one", "price", "qty"), "theta": ("theta_price",)},
    )
)
