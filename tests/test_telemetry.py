"""The seven sources on a small fixture, with values worked out by hand."""

import pytest

from faultsift.functions import repair
from faultsift.functions import scalars as S
from faultsift.operators import cells
from faultsift.sources import store, telemetry
from pyspark.sql import functions as F

NODE = """timestamp,region,node,node_type,cpu_usage,memory_available_ratio,process_count
2026-07-28 12:00:00,r,BR_1-x,br,10,0.8,100
2026-07-28 12:01:00,r,br-1,br,95,NULL,101
2026-07-28 12:01:00,r,probe,x,1,1,1
not a time,r,br-1,br,1,1,1
"""
TRAFFIC = """timestamp_utc,series_key,flow_type,source_region,target_region,target_domain,protocol,web_flow_requests_total,web_flow_success_total,web_flow_error_total,web_flow_latency_p95_seconds,dns_flow_requests_total
2026-07-28 12:00:00,a,web,xian,shanghai,w,http,240,231,9,0.02,7
2026-07-28 12:01:00,a,web,xian,shanghai,w,http,302,281,21,1.50,9
2026-07-28 12:02:00,a,web,xian,shanghai,w,http,5,4,1,0.03,9
2026-07-28 12:02:00,a,,xian,shanghai,w,http,5,4,1,0.03,9
"""
FLOWS = """minute_utc,node_key,node,interface_id,if_role,protocol,src_addr,src_port,dst_addr,dst_port,packets,bytes,flow_record_count
2026-07-28 12:00:00,br1,BR-1-x,ens4,uplink,6,a,1,c,80,10,100,1
2026-07-28 12:00:00,br1,BR-1-x,ens4,uplink,6,b,2,c,80,20,200,
2026-07-28 12:00:00,br1,BR-1-x,ens4,uplink,17,b,2,c,80,20,,1
"""
LOG = """received_at,event_time,hostname,severity,program,message
2026-07-28 12:00:05,2026-07-28 12:00:04,br-1,ERR,bgpd,neighbor   down
2026-07-28 12:00:05,,nobody,info,x,link up
"""


@pytest.fixture(scope="module")
def seen(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("case") / "xian_window"
    for folder in ("processed", "xian_window_data"):
        (base / folder).mkdir(parents=True)
    for name, text in (("node_metrics", NODE), ("traffic_flow_metrics", TRAFFIC), ("netflow_5tuple", FLOWS), ("frr_syslog_events", LOG)):
        (base / "processed" / f"{name}.csv").write_text(text)
    (base / "xian_window_data" / "node_metrics_raw.csv").write_text(NODE)
    (base / "xian_window_data" / "other.csv").write_text("a\n1\n")
    obs, stats = telemetry.observations(spark, str(base.parent))
    return obs.cache(), {r["source"]: r for r in stats.collect()}


def test_statistics(seen):
    _, stats = seen
    assert [stats["node"][k] for k in ("files", "rows", "bad_rows")] == [1, 4, 1]
    assert [stats["traffic"][k] for k in ("rows", "bad_rows")] == [4, 1]
    assert [stats["netflow"][k] for k in ("rows", "bad_rows")] == [3, 1]


def values(obs, source):
    return {(r["metric"], r["ts"].minute): r["value"] for r in obs.where(F.col("source") == source).collect()}


def test_dense(seen):
    got = values(seen[0], "node")
    assert got[("node.cpu_usage", 1)] == 95 and len(got) == 5
    assert {r[0] for r in seen[0].where("source = 'node'").select("node_id").distinct().collect()} == {"xian-br-1"}


def test_traffic(seen):
    got = values(seen[0], "traffic")
    assert got[("traffic.web.requests_rate", 1)] == 62
    assert got[("traffic.web.success_ratio", 1)] == pytest.approx(50 / 62)
    assert got[("traffic.web.error_ratio", 1)] == pytest.approx(12 / 62)
    assert got[("traffic.web.requests_rate", 2)] == 5 and got[("traffic.web.counter_reset", 2)] == 1
    assert ("traffic.web.requests_rate", 0) not in got and not any("dns" in k[0] for k in got)
    related = seen[0].where("source = 'traffic'").first()["related_node_ids"]
    assert related == [f"shanghai-service-vm-{i}" for i in (1, 2, 3)]


def test_netflow(seen):
    got = values(seen[0], "netflow")
    assert got[("netflow.packets", 0)] == 30 and got[("netflow.bytes", 0)] == 300 and got[("netflow.flow_records", 0)] == 1
    assert got[("netflow.unique_sources", 0)] == 2 and got[("netflow.unique_destinations", 0)] == 1
    assert got[("netflow.protocol_byte_share", 0)] == 1


def test_cells_and_store(spark, seen, tmp_path):
    table = cells.cells(cells.project(seen[0]))
    log = table.where("modality = 'log'").collect()
    assert [(r["entity"], r["feature"], r["value"]) for r in log] == [("xian-br-1", "frr.bgp.err.count", 1.0)]
    edges = {r[0] for r in table.where("modality = 'edge'").select("entity").distinct().collect()}
    assert edges == {"xian-traffic-vm>service-group:shanghai:web>traffic", "xian-br-1>interface:xian-br-1:ens4>netflow"}
    store.write_cells(table, str(tmp_path / "s"))
    assert store.read_cells(spark, str(tmp_path / "s")).count() == table.count()
    with pytest.raises(Exception):
        store.write_cells(table, str(tmp_path / "s"))


def test_scalars(spark):
    rows = [(" 1.5 ",), ("1d",), ("NaN",), ("inf",), ("\\N",), (None,), ("-2e3",), ("1e999",)]
    df = spark.createDataFrame(rows, "x string")
    assert [r[0] for r in df.select(S.number(F.col("x"))).collect()] == [1.5, None, None, None, None, None, -2000.0, None]
    t = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("2026-01-01 08:00:00+08:00",), ("2026-01-01 00:00:00",), ("x",)], "x string")
    assert [r[0] is not None for r in t.select(S.parse_utc(F.col("x"))).collect()] == [True, True, False, False]
    assert t.select(S.minute_of(S.parse_time(F.col("x"))).alias("m")).distinct().count() == 2
    d = spark.createDataFrame([('a="1", b="2", a="3"',), ("plain ",), ("",), (None,)], "x string")
    assert [r[0] for r in d.select(S.label_dimensions(F.col("x"))).collect()] == [{"b": "2", "a": "3"}, {"label": "plain"}, {}, {}]


def test_repair():
    assert repair.first_json('text {"a": 1} {"k": {"b": [1, 2', "k") == '{"k": {"b": [1, 2]}}'
    assert repair.first_json('[[{"x": {"k": "v', "k") == '{"k": "v"}'
    assert repair.first_json("nothing { here", "k") is None and repair.first_json(None, "k") is None


def test_predictions(spark, tmp_path):
    rows = [("p1", "2026-01-01T00:00:00Z", "2026-01-01T00:10:00Z", [(1, "xian-fw")], ("link", "delay"))]
    df = spark.createDataFrame(rows, store.PREDICTION)
    store.write_predictions(df, str(tmp_path / "p"))
    back = store.read_predictions(spark, str(tmp_path / "p"))
    assert back.select("prediction_id", "core_valid", "rca_valid", "major_valid", "sub_valid").collect() == [("p1", True, True, True, True)]
    with pytest.raises(ValueError):
        store.write_predictions(df.union(df), str(tmp_path / "q"))
    with pytest.raises(ValueError):
        store.write_predictions(df.withColumn("end_time", F.lit("2025-01-01T00:00:00Z")), str(tmp_path / "r"))
