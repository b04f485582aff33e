"""Rules of the prototype classifier: signals of metrics, prototypes of faults, floors of scales."""

from __future__ import annotations

# Tokens (any of them), signal, weight. A text that holds a token gives the signal.
METRIC_SIGNALS = [
    (["cpu"], "cpu", 1.35),
    (["load"], "cpu", 0.8),
    (["load"], "load", 1.0),
    (["memory_available"], "memory", 5.0),
    (["swap"], "memory", 1.8),
    (["swap"], "swap", 1.0),
    (["disk_io", "disk_read", "disk_write", "io_util"], "disk_io", 1.5),
    (["filesystem", "disk_space", "inode"], "disk_space", 1.8),
    (["process_count", "process_pressure"], "process", 1.5),
    (["softirq"], "softirq_udp", 2.0),
    (["udp"], "udp", 0.8),
    (["drop", "loss", "discard"], "loss", 1.6),
    (["carrier", "link_down", "oper_up"], "link_state", 1.7),
    (["bytes_rate", "packets_rate", "throughput", "bandwidth"], "throughput", 0.8),
    (["latency", "delay", "rtt"], "latency", 1.7),
    (["jitter"], "jitter", 1.2),
    (["bgp"], "bgp", 1.0),
    (["ospf"], "ospf", 1.0),
    (["default_route", "default route"], "default_route", 2.2),
    (["static_route", "static route"], "static_route", 2.0),
    (["blackhole", "unreachable"], "blackhole", 2.0),
    (["route_count", "route_total"], "route_table", 1.0),
    (["error_ratio", "5xx", "server_error"], "service_error", 2.0),
    (["timeout", "timed_out"], "timeout", 2.0),
    (["wrong_record", "nxdomain", "servfail"], "dns_record", 2.0),
    (["unique_dst_port", "unique_destination_port"], "port_selectivity", 1.2),
    (["protocol_byte_share"], "protocol_selectivity", 1.0),
    (["acl", "access-list", "access_list"], "acl", 2.0),
    (["rule_order", "rule order"], "rule_order", 2.0),
    (["port_block", "connection_refused"], "port_block", 2.0),
    (["rate_limit", "policer"], "rate_limit", 2.0),
    ([".web."], "web", 1.8),
    ([".dns."], "dns", 1.8),
    ([".auth."], "auth", 1.8),
]
# A first token that must be there too, tokens, signal, weight.
PAIRED_SIGNALS = [
    ("bgp", ["peer_up", "session_down", "neighbor_down"], "bgp_down", 2.1),
    ("bgp", ["flap", "route_change", "update"], "bgp_flap", 1.8),
    ("ospf", ["cost"], "ospf_cost", 2.0),
    ("ospf", ["neighbor", "peer", "down", "up"], "ospf_down", 1.8),
]
# The signals of each fault and their weights.
PROTOTYPES = {
    "link_delay": {"latency": 1.0, "jitter": 0.4, "interface": 0.3, "role_router": 0.15},
    "link_rate_limit": {"rate_limit": 1.0, "throughput_low": 0.8, "interface": 0.4, "role_router": 0.15},
    "link_loss": {"loss": 1.0, "interface": 0.5, "link_state": 0.3, "role_router": 0.15},
    "firewall_acl_drop": {"acl": 1.0, "loss": 0.7, "port_selectivity": 0.5, "role_firewall": 0.8},
    "firewall_rate_limit": {"rate_limit": 1.0, "throughput_low": 0.8, "role_firewall": 0.9},
    "firewall_port_block": {"port_block": 1.0, "port_selectivity": 0.8, "service_error": 0.4, "role_firewall": 0.9},
    "firewall_cpu_pressure": {"cpu": 1.0, "load": 0.6, "role_firewall": 1.0},
    "firewall_default_route_error": {"default_route": 1.0, "route_table": 0.4, "role_firewall": 0.9},
    "firewall_rule_order_error": {"rule_order": 1.0, "acl": 0.7, "port_selectivity": 0.4, "role_firewall": 0.9},
    "resource_cpu_high": {"cpu": 1.0, "load": 0.65, "role_service": 0.15},
    "resource_memory_pressure": {"memory": 1.0, "swap": 0.5, "role_service": 0.15},
    "resource_disk_io_pressure": {"disk_io": 1.0, "load": 0.2, "role_service": 0.15},
    "resource_disk_space_low": {"disk_space": 1.0, "role_service": 0.15},
    "resource_process_pressure": {"process": 1.0, "cpu": 0.25, "role_service": 0.15},
    "resource_softirq_udp_pressure": {"softirq_udp": 1.0, "udp": 0.6, "cpu": 0.25, "role_service": 0.15},
    "route_blackhole": {"blackhole": 1.0, "route_table": 0.5, "loss": 0.4, "role_router": 0.7},
    "route_bgp_session_down": {"bgp_down": 1.0, "bgp": 0.5, "link_state": 0.2, "role_router": 0.6},
    "route_bgp_route_flap": {"bgp_flap": 1.0, "bgp": 0.5, "route_table": 0.4, "role_router": 0.6},
    "route_wrong_static_route": {"static_route": 1.0, "route_table": 0.6, "role_router": 0.6},
    "route_ospf6_neighbor_down": {"ospf_down": 1.0, "ospf": 0.5, "link_state": 0.2, "role_router": 0.6},
    "route_ospf6_cost_anomaly": {"ospf_cost": 1.0, "ospf": 0.5, "role_router": 0.6},
    "route_wrong_default_route": {"default_route": 1.0, "route_table": 0.6, "role_router": 0.6},
    "service_dns_down": {"dns": 1.0, "timeout": 0.6, "service_error": 0.5, "role_service": 0.3},
    "service_dns_wrong_record": {"dns_record": 1.0, "dns": 0.6, "role_service": 0.3},
    "service_web_5xx": {"web": 0.8, "service_error": 1.0, "role_service": 0.3, "role_traffic": 0.2},
    "service_web_slow": {"web": 0.7, "latency": 1.0, "timeout": 0.3, "role_service": 0.3, "role_traffic": 0.2},
    "service_auth_timeout": {"auth": 0.8, "timeout": 1.0, "latency": 0.4, "role_service": 0.3},
    "service_auth_error": {"auth": 0.8, "service_error": 1.0, "role_service": 0.3},
}
# Least scales of metrics by pattern.
SCALE_FLOORS = {
    "node.cpu_usage": 1.0, "node.load*": 0.1, "node.memory_available_ratio": 0.005, "node.swap_used_ratio": 0.005,
    "node.disk_read_rate": 4096.0, "node.disk_write_rate": 4096.0, "node.disk_io_util": 1.0, "node.filesystem_used_ratio": 0.005,
    "node.inode_used_ratio": 0.005, "node.open_fd_ratio": 0.005, "node.process_count": 5.0, "interface.*_bytes_rate": 1024.0,
    "interface.*_packets_rate": 10.0, "interface.*_drop_rate": 0.1, "interface.*_error_rate": 0.1, "interface.carrier_changes": 0.5,
    "routing.*_uptime_seconds": 60.0, "routing.*_count": 1.0, "routing.*_total": 1.0, "routing.*_cost": 1.0, "routing.*_up": 0.1,
    "routing.*_enabled": 0.1, "routing.*_exists": 0.1, "routing.*_success": 0.1, "scrape.scrape_up": 0.1,
    "scrape.scrape_duration_seconds": 0.05, "scrape.scrape_samples": 50.0, "traffic.*.*_ratio": 0.02, "traffic.*.*latency*": 0.05,
    "traffic.*.*throughput*": 1000.0, "traffic.*.*jitter*": 0.01, "traffic.*.*_rate": 1.0, "netflow.bytes": 4096.0,
    "netflow.packets": 10.0, "netflow.flow_records": 5.0, "netflow.unique_*": 1.0, "netflow.protocol_byte_share": 0.05,
}
# The least scale as a part of the center, and for metrics by pattern (the last that fits).
RELATIVE_FLOOR = 0.02
RELATIVE_FLOORS = {
    "node.memory_available_ratio": 0.0, "node.swap_used_ratio": 0.0, "node.filesystem_used_ratio": 0.0, "node.inode_used_ratio": 0.0,
    "node.open_fd_ratio": 0.0, "traffic.*.*_ratio": 0.0, "netflow.protocol_byte_share": 0.0,
}
ROLE_PRIOR = 0.12
