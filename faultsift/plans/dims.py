"""Small dimension and rule tables. Users extend them by adding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The network's cities, device roles, and the relations between roles.
CITIES = ["beida", "shenyang", "xian", "chengdu", "wuhan", "shanghai", "nanjing", "guangzhou"]
ROLES = ["br-1", "br-2", "cr-1", "cr-2", "fw", "traffic-vm", "service-vm-1", "service-vm-2", "service-vm-3", "monitor-vm"]
RELATIONS = [
    ("br-1", "cr-1", "routing_path"),
    ("br-2", "cr-2", "routing_path"),
    ("cr-1", "fw", "transit"),
    ("cr-2", "fw", "transit"),
    ("fw", "traffic-vm", "access"),
    ("fw", "service-vm-1", "access"),
    ("fw", "service-vm-2", "access"),
    ("fw", "service-vm-3", "access"),
]

# Fault names with major and sub category, in their order.
TAXONOMY = [
    ("link_delay", "link", "delay"),
    ("link_rate_limit", "link", "rate_limit"),
    ("link_loss", "link", "loss"),
    ("firewall_acl_drop", "firewall", "acl_drop"),
    ("firewall_rate_limit", "firewall", "rate_limit"),
    ("firewall_port_block", "firewall", "port_block"),
    ("firewall_cpu_pressure", "firewall", "cpu_pressure"),
    ("firewall_default_route_error", "firewall", "default_route_error"),
    ("firewall_rule_order_error", "firewall", "rule_order_error"),
    ("resource_cpu_high", "resource", "cpu_pressure"),
    ("resource_memory_pressure", "resource", "memory_pressure"),
    ("resource_disk_io_pressure", "resource", "disk_io_pressure"),
    ("resource_disk_space_low", "resource", "disk_space_low"),
    ("resource_process_pressure", "resource", "process_pressure"),
    ("resource_softirq_udp_pressure", "resource", "softirq_pressure"),
    ("route_blackhole", "routing", "blackhole"),
    ("route_bgp_session_down", "routing", "bgp_session_down"),
    ("route_bgp_route_flap", "routing", "bgp_route_flap"),
    ("route_wrong_static_route", "routing", "wrong_static_route"),
    ("route_ospf6_neighbor_down", "routing", "ospf6_neighbor_down"),
    ("route_ospf6_cost_anomaly", "routing", "ospf6_cost_anomaly"),
    ("route_wrong_default_route", "routing", "wrong_default_route"),
    ("service_dns_down", "service", "dns_down"),
    ("service_dns_wrong_record", "service", "dns_wrong_record"),
    ("service_web_5xx", "service", "web_5xx"),
    ("service_web_slow", "service", "web_slow"),
    ("service_auth_timeout", "service", "auth_timeout"),
    ("service_auth_error", "service", "auth_error"),
]

# Direct rules: metric, category, direction, scale floor, least value, most value, weight, immediate.
DIRECT_RULES = [
    ("node.cpu_usage", "cpu_pressure", 1, 4.0, 18.0, None, 1.0, False),
    ("node.load1", "cpu_pressure", 1, 1.5, None, None, 0.35, False),
    ("node.load5", "cpu_pressure", 1, 1.5, None, None, 0.35, False),
    ("node.memory_available_ratio", "memory_pressure", -1, 0.015, None, 0.90, 1.0, False),
    ("node.swap_used_ratio", "memory_pressure", 1, 0.03, None, None, 0.5, False),
    ("node.disk_io_util", "disk_io_pressure", 1, 10.0, 55.0, None, 1.0, False),
    ("node.disk_read_rate", "disk_io_pressure", 1, 1.0, None, None, 0.25, False),
    ("node.disk_write_rate", "disk_io_pressure", 1, 1.0, None, None, 0.25, False),
    ("node.filesystem_used_ratio", "disk_space_pressure", 1, 0.03, 0.8, None, 1.0, False),
    ("node.inode_used_ratio", "disk_space_pressure", 1, 0.03, 0.8, None, 1.0, False),
    ("node.process_count", "process_pressure", 1, 10.0, None, None, 1.0, False),
    ("interface.carrier_changes", "link_fault", 1, 0.1, 0.1, None, 1.0, True),
    ("interface.rx_drop_rate", "link_fault", 1, 0.1, 0.1, None, 1.0, False),
    ("interface.tx_drop_rate", "link_fault", 1, 0.1, 0.1, None, 1.0, False),
    ("interface.rx_error_rate", "link_fault", 1, 0.1, 0.1, None, 1.0, False),
    ("interface.tx_error_rate", "link_fault", 1, 0.1, 0.1, None, 1.0, False),
    ("routing.bgp_peer_up", "routing_fault", -1, 0.2, None, None, 1.0, True),
    ("routing.ospf6_interface_enabled", "routing_fault", -1, 0.2, None, None, 1.0, True),
    ("routing.ipv6_route_exists", "routing_fault", -1, 0.2, None, None, 1.0, True),
    ("routing.bgp_command_success", "routing_fault", -1, 0.2, None, None, 1.0, True),
    ("routing.ospf6_neighbor_state_code", "routing_fault", -1, 0.5, None, None, 1.0, True),
    ("routing.bgp_peer_prefix_received", "routing_fault", -1, 5.0, None, None, 0.6, False),
    ("routing.ipv6_route_count", "routing_fault", -1, 5.0, None, None, 0.6, False),
]
#: The families of direct rules, in the order in which equal ones stand.
FAMILIES = list(dict.fromkeys(r[1] for r in DIRECT_RULES))
RULE_SCHEMA = "feature string, category string, direction int, floor double, least double, most double, weight double, immediate boolean"


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def nodes(spark: SparkSession) -> DataFrame:
    """(node_id, city, role, node_idx), cities first; node_idx breaks ties."""
    rows = [(f"{c}-{r}", c, r, i * len(ROLES) + j) for i, c in enumerate(CITIES) for j, r in enumerate(ROLES)]
    return _table(spark, rows, "node_id string, city string, role string, node_idx int")


def topology(spark: SparkSession) -> DataFrame:
    """(source, target, relation) within each city."""
    rows = [(f"{c}-{a}", f"{c}-{b}", r) for c in CITIES for a, b, r in RELATIONS]
    return _table(spark, rows, "source string, target string, relation string")


def taxonomy(spark: SparkSession) -> DataFrame:
    """(fault_name, major, sub, ord); ord breaks ties."""
    return _table(spark, [(*t, i) for i, t in enumerate(TAXONOMY)], "fault_name string, major string, sub string, ord int")


def direct_rules(spark: SparkSession) -> DataFrame:
    return _table(spark, DIRECT_RULES, RULE_SCHEMA)
