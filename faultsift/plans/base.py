"""The registry of queries, and what they all use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Register a query under its function's name, with its SQL if there is any."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with whole seconds (sec), hours (hour) and days (day) since 1970, whatever the session's time zone."""
    e = table(spark, sf_dir, "events").withColumn("sec", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    return e.withColumn("hour", F.floor(F.col("sec") / 3600).cast("long")).withColumn("day", F.floor(F.col("sec") / 86400).cast("long"))


EV = """ev AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour,
  CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events)"""


def r6(c: str | Column) -> Column:
    return F.round(c, 6)
