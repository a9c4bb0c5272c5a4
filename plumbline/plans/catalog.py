"""All queries of the engine's own operators, by name, with their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: str = "", doubles: str = "", digits: int = 6):
    """Register a query; the named columns are rounded alike in Spark and in the SQL."""
    columns = doubles.split()

    def add(build):
        @functools.wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = build(spark, sf_dir)
            # adding zero turns a rounded -0.0 into 0.0
            return out.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c in columns}) if columns else out

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            replace = f"REPLACE ({', '.join(f'round({chr(34)}{c}{chr(34)}, {digits}) + 0.0::DOUBLE AS {chr(34)}{c}{chr(34)}' for c in columns)})" if columns else ""
            ORACLE_SQL[name] = f"{'WITH ' + base if base else ''} SELECT * {replace} FROM ({sql}) AS result"
        return run

    return add


from plumbline.plans import data_queries, fit_queries, rule_queries, stat_queries, tree_queries, weak_queries  # noqa: E402, F401
