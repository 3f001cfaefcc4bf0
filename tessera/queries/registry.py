"""Named queries and, where SQL can say the same, their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, make: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None = None) -> None:
    """make takes a function from table name to DataFrame."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and -0.0 as 0.0."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6(sql: str) -> str:
    return f"round({sql}, 6) + 0.0"


def col(name: str) -> Column:
    return F.col(name)
