"""The diagnosis on small networks with known answers, sinks and configuration."""

import json
import random

import pytest
from pyspark.sql import functions as F

from faultsift.functions import scalars as S
from faultsift.operators import diagnose, evaluate, rank
from faultsift.operators import events as event_ops
from faultsift.plans import dims
from faultsift.sources import store, telemetry

CELL = "modality string, minute long, entity string, feature string, value double"


def cells(spark):
    rng = random.Random(1)
    rows = []
    for m in range(120):
        hot = 60 <= m < 70
        for node in ("wuhan-fw", "wuhan-br-1", "xian-service-vm-2"):
            rows.append(("node", m, node, "node.cpu_usage", 90.0 if hot and node == "wuhan-fw" else 10 + rng.random()))
        edge = "wuhan-traffic-vm>service-group:wuhan:web>traffic"
        rows += [("edge", m, edge, "traffic.web.requests_rate", 100.0), ("edge", m, edge, "traffic.web.error_rate", 60.0 if hot else 0.0)]
        flow = "wuhan-fw>interface:wuhan-fw:ens4>netflow"
        rows += [("edge", m, flow, "netflow.flow_records.protocol_udp", 80.0 if m % 2 else 10.0 if m < 60 else 90.0), ("edge", m, flow, "netflow.protocol_byte_share.protocol_udp", 0.9 if hot else 0.2)]
    rows.append(("log", 63, "wuhan-br-1", "frr.bgp.warning.count", 2.0))
    return spark.createDataFrame(rows, CELL)


def test_the_whole_way(spark):
    got = diagnose.Diagnosis(spark, cells(spark), dims.direct_rules(spark))
    e = got.events.collect()
    assert [(r["start"], r["end"]) for r in e] == [(60, 70)]
    parts = {r["node"]: r for r in got.parts.collect()}
    assert len(parts) == 80 and parts["beida-fw"]["observed"] is False and parts["beida-fw"]["direct"] == 0
    assert parts["wuhan-fw"]["direct"] > 10 and parts["wuhan-fw"]["netflow"] > 0
    assert parts["wuhan-service-vm-3"]["traffic_target"] > 1 and parts["wuhan-service-vm-3"]["observed"]
    assert parts["xian-service-vm-2"]["traffic_target"] == 0 and parts["wuhan-traffic-vm"]["traffic_observer"] > 0
    top = sorted((r["rank"], r["node"]) for r in got.top5.collect())
    assert top[0] == (1, "wuhan-fw") and len(top) == 5
    best = {r["rank"]: r["category"] for r in got.categories.collect()}
    assert best[1] == "firewall_cpu_pressure"
    assert [(r["local"], r["category"], r["family"], r["anchor"]) for r in got.final.collect()] == [("firewall_cpu_pressure", "firewall_cpu_pressure", "cpu_pressure", "not_checked")]
    audited = got.audit()
    assert [(r["driver"], r["anchor"], r["city_conflict"]) for r in audited.collect()] == [("node", "supported", False)]
    assert {(r["kind"], r["value"]): r["n"] for r in diagnose.audit_counts(audited).collect()}[("driver", "node")] == 1
    made = evaluate.prediction_flags(got.records()).first()
    assert made["errors"] == [] and made["prediction_id"] == "pred_0_000001" and made["start_time"] == "1970-01-01T01:00:00.000Z"
    assert made["fault_category"].asDict() == {"major_category": "firewall", "sub_category": "cpu_pressure"} and made["root_cause_top5"][0]["network_element_id"] == "wuhan-fw"


def test_cases_are_computed_apart(spark):
    """Many cases in one run give what each gives alone; a null case takes no part."""
    rng = random.Random(2)
    rows = []
    for case in ("a", "b", "c", None):
        for m in range(80):
            hot = 20 + 10 * (case == "b") <= m < 30 and case != "c"
            rows += [(case, "node", m, n, "node.cpu_usage", 95.0 if hot and n.endswith("fw") else 10 + rng.random()) for n in ("wuhan-fw", "xian-br-1")]
            rows += [(case, "edge", m, "wuhan-traffic-vm>service-group:wuhan:web>traffic", f, v) for f, v in (("traffic.web.requests_rate", 100.0), ("traffic.web.error_rate", 70.0 if m in (60, 61, 62) else 0.0))]
    df = spark.createDataFrame(rows, "case string, " + CELL)
    rules = dims.direct_rules(spark)
    whole = diagnose.Diagnosis(spark, df, rules, ("case",))
    plain = lambda d, one: {
        k: sorted(str(tuple(v for c, v in r.asDict().items() if c not in ("case", "event", "prediction_id"))) for r in f.collect() if one is None or r["case"] == one)
        for k, f in (("line", d.line), ("events", d.events), ("parts", d.parts), ("top5", d.top5), ("final", d.final), ("records", d.records()), ("audit", d.audit()))
    }
    for case in ("a", "b", "c"):
        alone = diagnose.Diagnosis(spark, df.where(F.col("case") == case).drop("case"), rules)
        assert plain(whole, case) == plain(alone, None), case
    assert {r["case"] for r in whole.events.collect()} == {"a", "b", "c"}
    assert {r["n"] for r in evaluate.not_single(whole.events, "case", df.select("case").where("case is not null").distinct()).collect()} == {2}


def test_family_support_needs_two_families(spark):
    rows = [("a", 0, "x", 3.0), ("a", 0, "y", 2.9), ("a", 1, "x", 9.0), ("a", 2, "x", 4.0), ("a", 2, "y", 5.0), ("a", 2, "z", None), ("a", 3, "x", 1.0), ("a", 3, "y", 0.0), ("a", 3, "y", 8.0)]
    got = diagnose.family_support(spark.createDataFrame(rows, "case string, minute long, family string, z double"), ("case",))
    assert {r["minute"]: r["support"] for r in got.collect()} == {0: 0.5, 1: None, 2: 1.0, 3: 0.5}


def test_signals_of_the_city_stand_in(spark):
    top5 = spark.createDataFrame([("e", "xian-br-1", 1.0, 1), ("f", "xian-fw", 1.0, 1)], "event string, node string, score double, rank int")
    none = spark.createDataFrame([], "event string, node string, signal string, strength double")
    city = spark.createDataFrame([("e", "xian", "cpu", 3.0), ("e", "xian", "bgp_down", 9.0), ("e", "wuhan", "memory", 20.0), ("f", "xian", "cpu", 0.0)], "event string, city string, signal string, strength double")
    got = {(r["event"], r["rank"]): (r["category"], r["p"]) for r in diagnose.categories(spark, top5, none, city=city).collect()}
    assert got == {("e", 1): ("route_bgp_session_down", 0.75), ("e", 2): ("resource_cpu_high", 0.25), ("f", 1): ("firewall_cpu_pressure", 0.0)}


def test_direct_evidence_overrides(spark):
    """A disk that the root itself backs is named; one that it doesn't back is capped at one half."""
    rows = [("node", m, n, f, v) for m in range(40) for n, f, v in (
        ("xian-service-vm-1", "node.disk_io_util", 95.0 if 20 <= m < 26 else 10.0), ("xian-service-vm-1", "node.cpu_usage", 80.0 if 20 <= m < 26 else 10.0), ("xian-cr-1", "node.cpu_usage", 10.0))]
    got = diagnose.Diagnosis(spark, spark.createDataFrame(rows, CELL), dims.direct_rules(spark)).final.collect()
    assert [(r["category"], r["family"], r["anchor"]) for r in got] == [("resource_disk_io_pressure", "disk_io_pressure", "supported")]
    assert got[0]["confidence"] > 0.9


def test_an_event_without_signals_takes_a_default(spark):
    top5 = spark.createDataFrame([("e", "xian-cr-1", 0.0, 1), ("e", "xian-fw", 0.0, 2)], "event string, node string, score double, rank int")
    none = spark.createDataFrame([], "event string, node string, signal string, strength double")
    assert [(r["category"], r["p"]) for r in diagnose.categories(spark, top5, none).collect()] == [("route_bgp_session_down", 0.0)]


def test_disk_signals_are_weighed_by_use(spark):
    rows = [("node", m, "xian-fw", "node.disk_io_util", 1.0 if m >= 40 else 0.1) for m in range(45)]
    rows += [("node", m, "xian-cr-1", "node.disk_io_util", 90.0 if m >= 40 else 1.0) for m in range(45)]
    events = spark.createDataFrame([("e", 40, 45)], "event string, start long, end long")
    got = {r["node"]: r["strength"] for r in diagnose.candidate_signals(events, spark.createDataFrame(rows, CELL)).collect()}
    assert got["xian-fw"] == pytest.approx(0.25) and got["xian-cr-1"] == pytest.approx(22.5)


def test_fusion_counts_relations_and_penalties(spark):
    events = spark.createDataFrame([(1, 0, 10)], "event long, start long, end long")
    rows = [(1, "xian-fw", [], "node", "node.cpu", 0, 20.0), (1, "xian-traffic-vm", ["xian-service-vm-1", "xian-traffic-vm"], "traffic", "t", 5, 10.0), (1, "nowhere", [], "node", "cpu", 0, 25.0)]
    points = spark.createDataFrame(rows, "event long, node string, related array<string>, source string, metric string, minute long, score double")
    nodes = [f"xian-{r}" for r in dims.ROLES]
    got = {r["node"]: r for r in rank.fusion_parts(events, points, rank.distances(dims.topology(spark), 6), nodes).collect()}
    assert len(got) == 10 and got["xian-fw"]["severity"] == pytest.approx(0.64) and got["xian-fw"]["penalty"] == 0
    assert got["xian-service-vm-1"]["penalty"] == 0.8 and got["xian-service-vm-1"]["relational"] == pytest.approx(0.8 * 0.32)
    assert got["xian-traffic-vm"]["penalty"] == 0.35 and got["xian-traffic-vm"]["precedence"] == 0.5
    assert got["xian-br-1"]["topology"] > 0 and got["xian-br-1"]["severity"] == 0
    best = rank.fused(spark.createDataFrame(list(got.values())), ["event"]).orderBy("rank").first()
    assert best["node"] == "xian-fw"


def test_prototypes_are_complete_and_weighted(spark):
    assert event_ops.missing_prototypes(spark).count() == 0
    assert event_ops.missing_prototypes(spark, {"link_loss": {}}).count() == len(dims.TAXONOMY) - 1
    top5 = spark.createDataFrame([("e", "xian-br-1", 1), ("e", "xian-fw", 2), ("e", "xian-cr-1", 3)], "event string, node string, rank int")
    rows = [("e", n, r, 15.0) for n, r in (("xian-br-1", []), ("xian-fw", []), ("xian-cr-1", []), ("other", ["xian-br-1"]), ("other", []))]
    points = spark.createDataFrame(rows, "event string, node string, related array<string>, score double")
    assert sorted(r["weight"] for r in event_ops.weighted_points(points, top5).collect()) == pytest.approx([0.01, 0.085, 0.1, 0.1, 5.0])
    assert [(r["signal"], r["weight"]) for r in event_ops.role_signals(top5).collect()] == [("role_router", 1.0)]


def test_context_and_five_sigma_events(spark):
    pts = spark.createDataFrame([("e", m, float(m % 7), "x", "n") for m in range(100)], "event string, minute long, magnitude double, metric string, node string")
    got = event_ops.first_points(pts, ["event"]).collect()
    assert len(got) == 64 and max(r["minute"] for r in got) == 63
    hits = spark.createDataFrame([("a", f"2026-01-01 00:0{i}:00", "node.cpu", m) for i, m in ((0, 6.0), (1, 8.0), (6, 30.0))], "case string, ts string, metric string, magnitude double")
    made = event_ops.five_sigma_events(hits.withColumn("ts", F.to_timestamp("ts")), ["case"], "ts", F.col("metric")).orderBy("start_time").collect()
    assert [(r["points"], r["confidence"], r["peak_time"].minute, r["sources"]) for r in made] == [(2, 0.8, 1, ["node"]), (1, 1.0, 6, ["node"])]


def test_truths(spark):
    ok = ("g", "2026-01-01T00:00:00Z", "2026-01-01T01:00:00Z", ("xian-fw",), ("link", "delay"))
    rows = [ok, ("", *ok[1:]), (*ok[:2], ok[1], *ok[3:]), (*ok[:3], ("xian-x",), ok[4]), (*ok[:4], ("link", "dns_down")), (None, None, None, None, None)]
    kind = "ground_truth_id string, start_time string, end_time string, root_cause struct<network_element_id:string>, fault_category struct<major_category:string,sub_category:string>"
    got = [r["errors"] for r in evaluate.truth_flags(spark.createDataFrame(rows, kind)).collect()]
    assert got == [[], ["ground_truth_id"], ["interval"], ["root_cause"], ["fault_category"], ["ground_truth_id", "interval", "root_cause", "fault_category"]]


def test_sinks_and_configuration(spark, tmp_path):
    path = f"{tmp_path}/report.json"
    for n in (3, 2):
        store.write_json(spark.range(n).withColumn("x", F.lit("é")), path)
        assert sorted(x["id"] for x in json.load(open(path, encoding="utf-8"))) == list(range(n))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["report.json"]
    (tmp_path / "network_elements.json").write_text(json.dumps({"cities": ["a", "b"], "device_roles": ["x", "y"]}, indent=1))
    (tmp_path / "fault_taxonomy.json").write_text(json.dumps({"fault_categories": [{"fault_name": "f", "major_category": "m", "sub_category": "s"}]}))
    assert sorted((r["node_idx"], r["node_id"]) for r in store.read_config(spark, str(tmp_path), "network_elements").collect()) == [(0, "a-x"), (1, "a-y"), (2, "b-x"), (3, "b-y")]
    assert [tuple(r) for r in store.read_config(spark, str(tmp_path), "fault_taxonomy").collect()] == [("f", "m", "s", 0)]
    with pytest.raises(ValueError):
        store.read_config(spark, str(tmp_path), "secrets")
    before = store.digests(spark, f"{tmp_path}/fault_taxonomy.json").first()["sha256"]
    assert len(before) == 64


def test_scrape_errors_and_quoted_times(spark):
    rows = [("2026-01-01T00:00:00Z", "xian-fw", "snmp", "timed out"), ("2026-01-01T00:00:00Z", "xian-fw", "", "refused"), ("2026-01-01T00:00:00Z", "xian-fw", "snmp", "NULL"), ("x", "xian-fw", "snmp", "lost")]
    df = spark.createDataFrame(rows, "timestamp string, node string, exporter_type string, scrape_error string").withColumn("file", F.lit("/d/xian/processed/scrape_health.csv"))
    got = sorted((r["program"], r["message"], r["node_id"]) for r in telemetry.scrape_errors(df).collect())
    assert got == [("exporter", "refused", "xian-fw"), ("snmp", "timed out", "xian-fw")]
    one = spark.createDataFrame([('"2026-01-01T00:00:00Z"', "", "err")], "t string, program string, x string")
    assert one.select(S.parse_time(F.col("t")).isNotNull().alias("ok")).first()["ok"]
    log = spark.createDataFrame([("2026-01-01T00:00:00Z", "xian-fw", "err", " ", "bgp down")], "event_time string, hostname string, severity string, program string, message string")
    assert telemetry.text_events(log.withColumn("file", F.lit("/d/xian/processed/frr.csv"))).first()["program"] == "frr"


def test_small_columns(spark):
    got = spark.range(1).select(
        S.direction(F.lit("node"), F.lit("memory_available_ratio")).alias("d"), S.severity_score(F.lit("crit")).alias("s"), S.phase_features(F.lit(360))["day_sin"].alias("p"),
        event_ops.prototype_confidence(F.lit(0.8), F.lit(0.4)).alias("c"), event_ops.prototype_confidence(F.lit(0.0), F.lit(None).cast("double")).alias("z"),
    ).first()
    assert (got["d"], got["s"], round(got["p"], 6), round(got["c"], 6), got["z"]) == ("low", 18.0, 1.0, 0.65, 0.0)
    assert dims.nodes(spark).count() == 80 and dims.topology(spark).count() == 64
