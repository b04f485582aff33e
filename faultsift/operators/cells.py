"""Minute cells: one row per minute, entity and feature that was observed; a missing row means not observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultsift.functions import scalars as S


def project(observations: DataFrame) -> DataFrame:
    """(modality, minute, entity, feature, value, aggregation, arrival); observations without a node give none.

    Traffic belongs to the edge from its node to the target's service group, NetFlow to that of an
    interface, log lines to the node's log, all else to the node.
    """
    d = lambda k: F.col("dimensions")[k]
    src, node = F.col("source"), F.col("node_id")
    flow = S.token(F.coalesce(d("flow_type"), F.when(F.size(F.split("metric", r"\.")) > 2, F.split("metric", r"\.")[1]), F.lit("service")))
    region = F.nullif(S.token(F.coalesce(d("target_region"), F.lit("")), ""), F.lit(""))
    port = S.token(F.coalesce(d("interface_id"), F.lit("unknown")))
    edge = lambda target, kind: F.concat_ws(">", node, target, F.lit(kind))
    entity = (
        F.when(src == "traffic", edge(F.concat(F.lit("service-group:"), region, F.lit(":"), flow), "traffic"))
        .when(src == "netflow", edge(F.concat(F.lit("interface:"), node, F.lit(":"), port), "netflow"))
        .otherwise(node)
    )
    log = F.concat(F.lit("frr."), S.token(F.coalesce(d("event_family"), F.lit("other"))), F.lit("."), S.token(d("severity")), F.lit(".count"))
    feature = (
        F.when(src == "netflow", F.concat(F.col("metric"), F.lit(".protocol_"), S.token(d("protocol")))).when(src == "frr", log).otherwise(F.col("metric"))
    )
    return observations.where(node.isNotNull() & ((src != "traffic") | region.isNotNull())).select(
        F.when(src.isin("traffic", "netflow"), "edge").when(src == "frr", "log").otherwise("node").alias("modality"),
        S.minute_of(F.col("ts")).alias("minute"),
        entity.alias("entity"),
        feature.alias("feature"),
        "value",
        F.when(src == "frr", "sum").otherwise(S.aggregation(F.col("direction"), F.col("metric"))).alias("aggregation"),
        F.struct("ts", "metric", "value").alias("arrival"),
    )


def aggregate(rows: DataFrame, by: list[str], value: str, arrival: Column) -> DataFrame:
    """Per cell the sum, count, min, max, mean and last value; last is that of the greatest arrival."""
    return rows.groupBy(*by).agg(
        F.sum(value).alias("sum"),
        F.count(value).alias("count"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.max_by(value, arrival).alias("last"),
    )


def pick(policy: Column) -> Column:
    """A cell's value by its policy: sum, min, max, mean or last."""
    out = F.lit(None).cast("double")
    for name in ("sum", "min", "max", "mean", "last"):
        out = F.when(policy == name, F.col(name)).otherwise(out)
    return out


def cells(projected: DataFrame) -> DataFrame:
    """(modality, minute, entity, feature, value): the policy of a cell is that of its first arrival."""
    by = ["modality", "minute", "entity", "feature"]
    made = projected.groupBy(*by).agg(
        F.sum("value").alias("sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.max_by("value", "arrival").alias("last"),
        F.min_by("aggregation", "arrival").alias("policy"),
    )
    return made.select(*by, pick(F.col("policy")).alias("value"))


def consolidate(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n): the median of the values that share a place in their series."""
    return df.groupBy(*by).agg(F.percentile(value, 0.5).alias(value), F.count("*").alias("n"))


def summary(table: DataFrame) -> DataFrame:
    """Counts and the range of minutes by modality."""
    return table.groupBy("modality").agg(
        F.count("*").alias("cells"),
        F.countDistinct("entity").alias("entities"),
        F.countDistinct("feature").alias("features"),
        F.min("minute").alias("first_minute"),
        F.max("minute").alias("last_minute"),
    )
