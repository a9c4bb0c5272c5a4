"""Batch directories, metadata, result tables, checksums and sinks.

A batch is a directory batch_NN with one commented CSV a role and a metadata.json.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.operators.reshape import union_parts

ROLES = {"labeled": "reference_measurements.csv", "test": "acceptance_tests.csv", "weak": "engineering_predictions.csv"}
METADATA = "batch_index int, k_true double, sigma double, coverage struct<threshold_p95: double, pass: boolean>, sha256 map<string, string>"


def measurement_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, DoubleType()) for c in columns])


def read_measurements(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a comment line before its header.  Columns may stand in any order; missing ones are named in
    an error."""
    found = spark.read.option("comment", "#").option("header", True).csv(path).columns
    missing = [f.name for f in schema if f.name not in found]
    if missing:
        raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
    known = {f.name: f for f in schema}
    full = StructType([known.get(c, StructField(c, DoubleType())) for c in found])
    rows = spark.read.schema(full).option("comment", "#").option("header", True).csv(path)
    return rows.select(*schema.names, "_metadata")


def read_batches(spark: SparkSession, root: str, columns: dict[str, list[str]], row_id: str | None = None) -> DataFrame:
    """All batches and roles as one table: batch_id, role, row_id and the roles' columns.

    Directories of other names are left out.  Rows are named by a column of the data, or by their content
    where there is none, never by the order in which they are read.
    """
    parts = []
    for role, names in columns.items():
        d = read_measurements(spark, f"{root}/batch_[0-9][0-9]/{ROLES[role]}", measurement_schema(names))
        batch = F.regexp_extract("_metadata.file_path", r".*/(batch_\d+)/", 1)
        key = F.col(row_id).cast("string") if row_id else F.md5(F.concat_ws("|", *[F.hex(F.col(c).cast("string").cast("binary")) for c in names]).cast("binary"))
        parts.append(d.select(batch.alias("batch_id"), F.lit(role).alias("role"), key.alias("row_id"), *names))
    return union_parts(parts)


def read_batch_metadata(spark: SparkSession, root: str) -> DataFrame:
    d = spark.read.option("multiLine", True).schema(METADATA).json(f"{root}/batch_[0-9][0-9]/metadata.json")
    batch = F.regexp_extract(F.input_file_name(), r".*/(batch_\d+)/", 1)
    return d.select(batch.alias("batch_id"), "k_true", "sigma", "sha256", F.col("coverage.threshold_p95").alias("threshold_p95"), F.col("coverage.pass").alias("covered"))


def read_metrics(df: DataFrame, payload: str, schema: str, name: str = "details") -> DataFrame:
    """Parse a JSON text column to a struct."""
    return df.withColumn(name, F.from_json(payload, schema))


def flatten_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Two-level names such as avg(mse) or mse.mean to mse_mean."""
    short = {"avg": "mean", "stddev_samp": "std", "stddev": "std"}

    def flat(n: str) -> str:
        if "(" in n:
            stat, value = n.rstrip(")").split("(", 1)
            return f"{value}_{short.get(stat, stat)}"
        return n.replace(".", "_")

    return df.toDF(*[n if n in keys else flat(n) for n in df.columns])


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """sha-256 of whole files.  A file is one value here, so this is for batch files, not for big tables."""
    d = spark.read.format("binaryFile").load(path)
    at = [F.regexp_extract("path", r".*/(batch_\d+)/", 1).alias("batch_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file")]
    return d.select(*at, F.sha2("content", 256).alias("found"))


def verify_checksums(spark: SparkSession, root: str) -> DataFrame:
    """Files of every batch beside the checksums of its metadata: expected, found, ok."""
    want = read_batch_metadata(spark, root).select("batch_id", F.explode("sha256").alias("file", "expected"))
    have = file_checksums(spark, f"{root}/batch_[0-9][0-9]/*.csv")
    return want.join(have, ["batch_id", "file"], "full").withColumn("ok", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)))


def fingerprint(df: DataFrame, g: list[str], columns: list[Column]) -> DataFrame:
    """One id for a group's content, whatever its order: row count and sums of two parts of the rows' md5.

    The sums are partial before the shuffle, so a group of any size sends one row a task.
    """
    h = F.md5(F.concat_ws("|", *columns).cast("binary"))
    part = lambda a: F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).alias("a"), F.sum(part(13)).alias("b")).select(
        *g, F.md5(F.concat_ws("-", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")).cast("binary")).alias("dataset_id")
    )


def write_artifacts(bundle: dict[str, DataFrame], path: str) -> None:
    """Result tables, those with an experiment column partitioned by it; metrics also as compressed CSV."""
    for name, df in bundle.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("experiment") if "experiment" in df.columns else w).parquet(f"{path}/{name}")
    if "metrics" in bundle:
        m = bundle["metrics"]
        flat = [F.to_json(c).alias(c) if m.schema[c].dataType.typeName() in ("struct", "map", "array") else F.col(c) for c in m.columns]
        m.select(*flat).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/metrics_csv")


def append_gates(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def write_batch(df: DataFrame, path: str) -> None:
    """Write once: an existing path is an error."""
    df.write.mode("errorifexists").parquet(path)
