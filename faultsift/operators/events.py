"""What belongs to one event: its evidence, its end where recovery begins, its subgraph, context and prototype."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultsift.functions.scalars import has, role_flags
from faultsift.plans import dims
from faultsift.plans import prototypes as P

DIRECT_SOURCES = ["node", "interface", "routing", "frr"]


def recovery(points: DataFrame, by: list[str], series: list[str], threshold: float = 5.0, initial: int = 3, after: int = 2) -> DataFrame:
    """(by, recovery): the first minute, after some, in which series that had run one way long enough strongly turn.

    points is (by, series, source, minute, start, direction, score) of an event's evidence.
    """
    rows = points.where(F.col("source").isin(DIRECT_SOURCES) & F.col("direction").isin("high", "low"))
    order = [F.col("minute"), F.col("score").desc(), F.col("direction")]
    w = W.partitionBy(*by, *series).orderBy(*order)
    rows = rows.withColumn("_first", F.first("direction").over(w))
    same = F.when(F.col("direction") == F.col("_first"), 1).otherwise(0)
    rows = rows.withColumn("_before", F.coalesce(F.sum(same).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    turned = rows.where((F.col("direction") != F.col("_first")) & (F.col("_before") >= initial))
    minutes = turned.groupBy(*by, "minute").agg(F.sum("score").alias("s"), F.min("start").alias("start"))
    return minutes.where((F.col("s") >= threshold) & (F.col("minute") >= F.col("start") + after)).groupBy(*by).agg(F.min("minute").alias("recovery"))


def summarise(events: DataFrame, points: DataFrame, energy: DataFrame, opens: float = 7.0) -> DataFrame:
    """(event, start, end, peak_minute, confidence, points, sources) of events (event, start, end) with evidence (minute, source, score).

    The points are joined by the event's listed minutes; the peak is the earliest minute of most energy.
    """
    spread = events.where("end > start").select("event", "start", "end", F.explode(F.expr("sequence(start, end - 1)")).alias("minute"))
    held = spread.join(points, "minute").groupBy("event").agg(F.count("*").alias("points"), F.array_sort(F.collect_set("source")).alias("sources"))
    peak = spread.join(energy, "minute").groupBy("event", "start", "end").agg(F.max_by("minute", F.struct("energy", -F.col("minute"))).alias("peak_minute"), F.max("energy").alias("e"))
    return peak.join(held, "event").select(
        "event", "start", "end", "peak_minute", F.least(F.lit(1.0), F.col("e") / max(opens, 1e-9) / 1.5).alias("confidence"), "points", "sources"
    )


def context(points: DataFrame, by: list[str], node: str, most: int = 6) -> DataFrame:
    """(by, node, anomalies, max_magnitude, score): score grows with the sum of a node's largest magnitudes (points: minute, magnitude)."""
    w = W.partitionBy(*by, node).orderBy(F.col("magnitude").desc(), "minute", "metric")
    ranked = points.withColumn("_r", F.row_number().over(w))
    got = ranked.groupBy(*by, node).agg(
        F.count("*").alias("anomalies"), F.max("magnitude").alias("max_magnitude"), F.sum(F.when(F.col("_r") <= most, F.col("magnitude")).otherwise(0.0)).alias("_s")
    )
    return got.select(*by, node, "anomalies", "max_magnitude", F.least(F.lit(1.0), 1 - 1 / (1 + F.col("_s"))).alias("score"))


def subgraph(edges: DataFrame, by: list[str], most: int = 20) -> DataFrame:
    """The strongest edges (by, source, target, score), and in truncated how many positive ones were left out."""
    live = edges.where(F.col("score") > 0)
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), "source", "target")
    rows = live.withColumn("rank", F.row_number().over(w)).withColumn("_n", F.count("*").over(W.partitionBy(*by)))
    return rows.where(F.col("rank") <= most).withColumn("truncated", F.greatest(F.lit(0).cast("long"), F.col("_n") - most)).drop("_n")


def _fits(metric: Column, pattern: str) -> Column:
    return metric.rlike("^" + ".*".join(map(re.escape, pattern.split("*"))) + "$")


def scale_floor(metric: Column, absolute: float = 0.01) -> Column:
    """The largest floor of the patterns that fit the metric, at least the absolute one."""
    return F.greatest(F.lit(absolute), *(F.when(_fits(metric, p), F.lit(v)).otherwise(0.0) for p, v in P.SCALE_FLOORS.items()))


def relative_floor(metric: Column, default: float = P.RELATIVE_FLOOR) -> Column:
    """The least scale as a part of the center: that of the last pattern that fits the metric."""
    return F.coalesce(*(F.when(_fits(metric, p), F.lit(v)) for p, v in reversed(P.RELATIVE_FLOORS.items())), F.lit(default))


def event_nodes(parts: DataFrame, score: Column, by: list[str], most: int = 20) -> DataFrame:
    """The nodes of an event's subgraph: those with a positive score, the best ones, and in truncated how many were left out."""
    live = parts.withColumn("score", score).where("score > 0")
    w = W.partitionBy(*by)
    rows = live.withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), "node"))).withColumn("_n", F.count("*").over(w))
    return rows.where(F.col("rank") <= most).select(*by, "node", "score", "rank", F.greatest(F.lit(0).cast("long"), F.col("_n") - most).alias("truncated"))


def first_points(points: DataFrame, by: list[str], most: int = 64) -> DataFrame:
    """The timeline of an event's context: its first points in time, the strongest of a minute first."""
    w = W.partitionBy(*by).orderBy("minute", F.col("magnitude").desc(), "metric", "node")
    return points.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def five_sigma_events(points: DataFrame, by: list[str], ts: str, metric: Column, magnitude: str = "magnitude", gap: str = "120 seconds") -> DataFrame:
    """(by, start_time, end_time, peak_time, confidence, points, sources) of five-sigma points as events, sources with their number of points."""
    rows = points.withColumn("_source", F.split(metric, r"\.")[0]).withColumn("_score", F.least(F.lit(25.0), F.col(magnitude)))
    of = rows.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(
        F.min(ts).alias("start_time"), (F.max(ts) + F.expr("interval 1 minute")).alias("end_time"), F.min_by(ts, F.struct(-F.col("_score"), F.col(ts))).alias("peak_time"),
        F.least(F.lit(1.0), F.max("_score") / 10).alias("confidence"), F.count("*").alias("points"), F.array_sort(F.collect_set("_source")).alias("sources"),
    )
    return of.drop("w")


def weighted_points(points: DataFrame, top5: DataFrame) -> DataFrame:
    """points (event, node, related, text, source, direction, score) with weight: the root's own points most, others by their rank."""
    root = top5.where("rank = 1").select("event", F.col("node").alias("_root"))
    others = top5.where("rank > 1").select("event", "node", F.greatest(F.lit(0.03), 0.10 - (F.col("rank") - 2) * 0.015).alias("_w"))
    rows = points.join(root, "event", "left").join(others, ["event", "node"], "left")
    near = F.when(F.col("node") == F.col("_root"), 5.0).when(F.array_contains("related", F.col("_root")), 0.10).otherwise(F.coalesce("_w", F.lit(0.01)))
    return rows.withColumn("weight", near * F.least(F.lit(1.0), F.col("score") / 15)).drop("_root", "_w")


def role_signals(top5: DataFrame) -> DataFrame:
    """(event, signal, weight): the role of each event's root as a signal."""
    role = role_flags(F.col("node"))
    named = F.coalesce(*(F.when(role[f"is_{r}"], F.lit(f"role_{r}")) for r in ("firewall", "router", "service", "traffic")))
    return top5.where("rank = 1").select("event", named.alias("signal"), F.lit(1.0).alias("weight")).where("signal is not null")


def missing_prototypes(spark: SparkSession, prototypes: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(fault_name) of the taxonomy's faults without a prototype; any means that the classifier can't be used."""
    have = spark.createDataFrame([(f,) for f in (P.PROTOTYPES if prototypes is None else prototypes)], "fault_name string")
    return dims.taxonomy(spark).join(have, "fault_name", "left_anti").select("fault_name")


def signals(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, signal, weight) summed over points (text, source, direction, weight)."""
    t, low = F.lower("text"), F.col("direction") == "low"
    found = [(has(t, *tokens), s, f) for tokens, s, f in P.METRIC_SIGNALS]
    found += [(has(t, a) & has(t, *tokens), s, f) for a, tokens, s, f in P.PAIRED_SIGNALS]
    found += [(F.col("source") == "interface", "interface", 0.5), (low & has(t, "success_ratio"), "service_error", 1.5)]
    found += [(low & has(t, "bytes_rate", "packets_rate", "throughput", "bandwidth"), "throughput_low", 1.3)]
    each = F.array(*(F.struct(F.lit(s).alias("signal"), F.when(c, F.lit(f)).alias("f")) for c, s, f in found))
    rows = points.select(*by, "weight", F.inline(F.filter(each, lambda x: x["f"].isNotNull())))
    return rows.groupBy(*by, "signal").agg(F.sum(F.col("weight") * F.col("f")).alias("weight"))


def prototype_scores(spark: SparkSession, found: DataFrame, by: str) -> DataFrame:
    """(by, fault, score): the cosine of each group's signals (by, signal, weight) with every fault's prototype.

    Every fault has a row. The prior of a device role counts for its faults.
    """
    rows = [(f, s, float(v)) for f, p in P.PROTOTYPES.items() for s, v in p.items()]
    table = F.broadcast(spark.createDataFrame(rows, "fault string, signal string, v double"))
    own = found.groupBy(by).agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"), *(F.coalesce(F.max(F.when(F.col("signal") == f"role_{r}", F.col("weight"))), F.lit(0.0)).alias(r) for r in ("firewall", "router", "service", "traffic"))
    )
    met = found.join(table, "signal").groupBy(by, "fault").agg(F.sum(F.col("weight") * F.col("v")).alias("dot"))
    sizes = F.array(*(F.struct(F.lit(f).alias("fault"), F.lit(float(sum(x * x for x in p.values()) ** 0.5)).alias("size")) for f, p in P.PROTOTYPES.items()))
    dots = own.select("*", F.inline(sizes)).join(met, [by, "fault"], "left").na.fill(0.0, ["dot"])
    prior = F.when(F.col("fault").startswith("firewall_"), F.col("firewall")).when(F.col("fault").startswith("route_"), F.col("router")).when(F.col("fault").startswith("service_"), F.col("service") + F.col("traffic")).otherwise(0.0)
    score = F.coalesce(F.try_divide("dot", F.col("n") * F.col("size")), F.lit(0.0)) + F.least(F.lit(1.0), prior) * P.ROLE_PRIOR
    return dots.select(by, "fault", F.greatest(F.lit(0.0), score).alias("score"))


def prototype_confidence(best: Column, second: Column) -> Column:
    return F.when(best <= 0, 0.0).otherwise(F.least(F.lit(1.0), best * 0.5 + F.try_divide(best - F.coalesce(second, F.lit(0.0)), best) * 0.5))


def overridden(category: Column, confidence: Column, direct: Column, direct_probability: Column, node: Column, disk: Column, disk_seen: Column) -> dict[str, Column]:
    """Category, confidence and anchor after direct evidence of the root itself has its say.

    direct is the family of its strongest specific strength; a disk diagnosis that the root's own
    disk does not back is capped at one half.
    """
    router, firewall = node.rlike("-(br|cr)-"), node.endswith("-fw")
    named = F.when(direct == "disk_space_pressure", "resource_disk_space_low").when(direct == "cpu_pressure", F.when(firewall, "firewall_cpu_pressure").otherwise("resource_cpu_high"))
    named = named.when(direct.isin("memory_pressure", "disk_io_pressure", "process_pressure"), F.concat(F.lit("resource_"), direct))
    fits = named.isNotNull() & (F.when(firewall, direct == "cpu_pressure").otherwise(~router))
    new = F.when(fits, named).otherwise(category)
    sure = F.when(fits, F.greatest(confidence, direct_probability)).otherwise(confidence)
    disk_fault = new == "resource_disk_io_pressure"
    anchor = F.when(~disk_fault, "not_checked").when(disk >= 5, "supported").when(disk_seen, "unsupported").otherwise("undetermined")
    return {"category": new, "confidence": F.when(disk_fault & (anchor != "supported"), F.least(F.lit(0.5), sure)).otherwise(sure), "anchor": anchor}


def records(events: DataFrame, top5: DataFrame) -> DataFrame:
    """Prediction records of events (event, start_time, end_time, fault_category) and ranked nodes (event, rank, node)."""
    nodes = top5.groupBy("event").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("node").alias("network_element_id")))).alias("root_cause_top5")
    )
    return events.join(nodes, "event").select(F.col("event").cast("string").alias("prediction_id"), "start_time", "end_time", "root_cause_top5", "fault_category")
