"""Fault categories from signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultsift.functions.scalars import has, role_flags
from faultsift.operators.rank import top
from faultsift.plans import dims


def signal_of(feature: Column) -> Column:
    """The signal of a feature (the first rule that fits), null for features that are no sign of one fault."""
    n = F.lower(feature)
    # The tokens of each signal, in the order in which the rules hold
    return (
        F.when(has(n, "wrong_record", "nxdomain", "servfail"), "dns_record")
        .when(has(n, "rule_order"), "rule_order")
        .when(has(n, "port_block", "connection_refused", "blocked_port"), "port_block")
        .when(has(n, "acl", "access_list", "access-list", "policy_drop"), "acl_drop")
        .when(has(n, "rate_limit", "policer"), "rate_limit")
        .when(has(n, "default_route"), "default_route")
        .when(has(n, "static_route"), "static_route")
        .when(has(n, "blackhole", "unreachable"), "blackhole")
        .when(has(n, "bgp") & has(n, "flap", "route_change", "update_count"), "bgp_flap")
        .when(has(n, "ospf") & has(n, "cost"), "ospf_cost")
        .when(has(n, "unique_dst_port", "unique_destination_port"), "port_selectivity")
        .when(has(n, "cpu") & ~has(n, "softirq"), "cpu")
        .when(has(n, "memory_available", "swap"), "memory")
        .when(has(n, "disk_io"), "disk_io")
        .when(has(n, "disk_read", "disk_write"), None)
        .when(has(n, "filesystem", "inode"), "disk_space")
        .when(has(n, "process_count"), "process")
        .when(has(n, "softirq"), "softirq")
        .when(has(n, "bgp"), "bgp_down")
        .when(has(n, "ospf"), "ospf_down")
        .when(has(n, "drop", "loss") | (has(n, "error_rate") & ~has(n, "traffic.")), "link_loss")
        .when(has(n, "traffic.web") & has(n, "error"), "web_error")
        .when(has(n, "traffic.web") & has(n, "latency"), "web_latency")
        .when(has(n, "traffic.auth") & has(n, "timeout"), "auth_timeout")
        .when(has(n, "traffic.auth") & has(n, "error"), "auth_error")
        .when(has(n, "traffic.auth") & has(n, "latency"), "auth_latency")
        .when(has(n, "traffic.dns") & has(n, "error", "success"), "dns_error")
        .when(has(n, "latency", "jitter"), "link_delay")
    )


def signal_is_low(feature: Column) -> Column:
    """Whether the signal of a feature is a fall of its value."""
    n, s = F.lower(feature), signal_of(feature)
    return (
        F.when(s == "memory", has(n, "memory_available"))
        .when(s == "bgp_down", has(n, "up", "success", "enabled"))
        .when(s == "ospf_down", has(n, "up", "state", "neighbor"))
        .when(s == "dns_error", has(n, "success"))
        .otherwise(F.lit(False))
    )


# The category of each signal, for firewalls, for routers, and for any device (firewalls and routers first).
FIREWALL = {
    "cpu": "firewall_cpu_pressure", "rate_limit": "firewall_rate_limit", "default_route": "firewall_default_route_error",
    "acl_drop": "firewall_acl_drop", "port_block": "firewall_port_block", "port_selectivity": "firewall_port_block",
    "rule_order": "firewall_rule_order_error",
}
ROUTER = {
    "bgp_down": "route_bgp_session_down", "ospf_down": "route_ospf6_neighbor_down", "blackhole": "route_blackhole",
    "bgp_flap": "route_bgp_route_flap", "static_route": "route_wrong_static_route", "ospf_cost": "route_ospf6_cost_anomaly",
    "default_route": "route_wrong_default_route",
}
ANY_DEVICE = {
    "cpu": "resource_cpu_high", "memory": "resource_memory_pressure", "disk_io": "resource_disk_io_pressure",
    "disk_space": "resource_disk_space_low", "process": "resource_process_pressure", "softirq": "resource_softirq_udp_pressure",
    "rate_limit": "link_rate_limit", "link_loss": "link_loss", "link_delay": "link_delay", "web_error": "service_web_5xx",
    "web_latency": "service_web_slow", "auth_timeout": "service_auth_timeout", "auth_latency": "service_auth_timeout",
    "auth_error": "service_auth_error", "dns_error": "service_dns_down", "dns_record": "service_dns_wrong_record",
}


def category_of(signal: Column, node: Column) -> Column:
    """The fault category that a signal of a node speaks for, null if none."""
    role = role_flags(node)
    look = lambda names: F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[signal]
    return F.coalesce(F.when(role["is_firewall"], look(FIREWALL)), F.when(role["is_router"], look(ROUTER)), look(ANY_DEVICE))


def signals_of(cells: DataFrame) -> DataFrame:
    """(feature, signal, low) of the different features of cells that are a signal: the rules see each name once."""
    names = cells.select("feature").distinct()
    return names.select("feature", signal_of(F.col("feature")).alias("signal"), signal_is_low(F.col("feature")).alias("low")).where("signal is not null")


def ranked(spark: SparkSession, df: DataFrame, by: list[str], score: str, k: int = 3, name: str = "category") -> DataFrame:
    """The k best rows of each group with their rank; scores that are equal to nine digits stand in the taxonomy's order."""
    order = dims.taxonomy(spark).select(F.col("fault_name").alias(name), F.col("ord").alias("_ord"))
    rows = df.join(order, name).withColumn("_s", F.round(score, 9))
    return top(rows, by, "_s", ["_ord"], k).select(*by, name, score, "rank")


def deviation(df: DataFrame, by: list[str], value: str, phase: str, low: Column, peak: bool = False) -> DataFrame:
    """(by, deviation) from the median of the phase before, in its quartile range; without a before, the largest size.

    With peak, also the largest value during the event.
    """
    before = F.when(F.col(phase) == "before", F.col(value))
    during = F.when(F.col(phase) == "during", F.col(value))
    got = df.groupBy(*by).agg(
        F.percentile(before, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.max(during).alias("hi"), F.min(during).alias("lo"), F.max(F.abs(during)).alias("size"), F.bool_or(low).alias("low"),
    ).where("hi is not null")
    center = F.col("q")[1]
    scale = F.greatest(F.col("q")[2] - F.col("q")[0], F.abs(center) * 0.05, F.lit(0.01))
    moved = F.when(F.col("low"), center - F.col("lo")).otherwise(F.col("hi") - center) / scale
    out = F.when(center.isNull(), F.col("size")).otherwise(F.greatest(F.lit(0.0), moved))
    return got.select(*by, F.least(F.lit(25.0), out).alias("deviation"), *([F.col("hi").alias("peak")] if peak else []))


def mixture(df: DataFrame, by: list[str], node: str, category: str, strength: str, root: str) -> DataFrame:
    """(by, category, p): each node's categories, normalised, weighted half by root score times strength and half by strength."""
    own = W.partitionBy(*by, node)
    rows = df.withColumn("_s", F.sum(strength).over(own)).withColumn("_first", F.row_number().over(own.orderBy(category)) == 1)
    rows = rows.where("_s > 0").withColumn("_both", F.greatest(F.lit(0.0), F.col(root)) * F.col("_s"))
    all_ = W.partitionBy(*by)
    once = lambda c: F.sum(F.when(F.col("_first"), F.col(c)).otherwise(0.0)).over(all_)
    n = F.sum(F.when(F.col("_first"), 1).otherwise(0)).over(all_)
    part = lambda c: F.when(once(c) > 0, F.col(c) / once(c)).otherwise(F.lit(1.0) / n)
    rows = rows.withColumn("_w", (part("_both") + part("_s")) * 0.5)
    return rows.groupBy(*by, category).agg(F.sum(F.col("_w") * F.col(strength) / F.col("_s")).alias("p"))


def default_category(node: Column) -> Column:
    role = role_flags(node)
    return F.when(role["is_firewall"], "firewall_cpu_pressure").when(role["is_router"], "route_bgp_session_down").otherwise("resource_cpu_high")


def cosine(a: DataFrame, b: DataFrame, left: str, right: str, key: str, weight: str) -> DataFrame:
    """(left, right, cosine) of sparse vectors (left, key, weight) and (right, key, weight) that share a key."""
    norm = lambda df, k: df.groupBy(k).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias(f"_n_{k}"))
    met = a.join(b.withColumnRenamed(weight, "_w"), key).groupBy(left, right).agg(F.sum(F.col(weight) * F.col("_w")).alias("_dot"))
    size = met.join(norm(a, left), left).join(norm(b, right), right)
    return size.select(left, right, F.try_divide("_dot", F.col(f"_n_{left}") * F.col(f"_n_{right}")).alias("cosine"))


def vote_is_legal(spark: SparkSession, votes: DataFrame) -> DataFrame:
    """votes (major_category, sub_category, confidence) with legal: a pair of the taxonomy, and a confidence from 0 to 1."""
    pairs = dims.taxonomy(spark).select(F.col("major").alias("major_category"), F.col("sub").alias("sub_category")).distinct().withColumn("_known", F.lit(True))
    rows = votes.join(F.broadcast(pairs), ["major_category", "sub_category"], "left")
    sure = F.col("confidence").between(0, 1) & ~F.isnan("confidence")
    return rows.withColumn("legal", F.coalesce(F.col("_known") & sure, F.lit(False))).drop("_known")


def consensus(spark: SparkSession, votes: DataFrame, by: list[str]) -> DataFrame:
    """(by, major_category, sub_category, votes, illegal): the pair that most legal votes name, ties to the first in order.

    Illegal votes count for nothing but illegal; a group with no other has nulls for its pair and no votes.
    """
    counts = vote_is_legal(spark, votes).groupBy(*by, "major_category", "sub_category").agg(F.count_if("legal").alias("n"), F.count_if(~F.col("legal")).alias("bad"))
    pair = F.struct((-F.col("n")).alias("_n"), "major_category", "sub_category", "n")
    best = counts.groupBy(*by).agg(F.min(F.when(F.col("n") > 0, pair)).alias("_b"), F.sum("bad").alias("illegal"))
    return best.select(*by, F.col("_b.major_category").alias("major_category"), F.col("_b.sub_category").alias("sub_category"), F.coalesce("_b.n", F.lit(0)).alias("votes"), "illegal")
