"""Registered queries of the diagnosis of many cases in one job, from cells to records.

Every user of the events table is a case: the recording of one city's network. An event lasts for one to six steps,
its number picks a family of features and one of the case's two nodes, and its value gives the features' values.
So each case has faults with quiet stretches around them. The SQL states the same rows step by step; its rules,
thresholds and weights are spelled out here and not taken from the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.operators import build, classify, diagnose, evaluate, level, review
from faultsift.operators import events as event_ops
from faultsift.plans import dims
from faultsift.plans.base import EV, events, query, table
from faultsift.plans.diagnosis import NODES, r6
from faultsift.sources import ordered
from faultsift.sources.staging import shared_dir, staged

#: What names a case, and the seconds of a step.
BY, STEP = ("case",), 3600
#: Roles of which a case has two neighbouring ones.
CASE_ROLES = ["fw", "br-1", "service-vm-2", "traffic-vm"]
#: Family of features, and each feature's value in terms that Spark and DuckDB share.
FAMILIES = [
    ("node", [("node.cpu_usage", "value / 2"), ("node.memory_available_ratio", "1 / (1 + value / 50)"), ("node.disk_io_util", "least(100, value * value / 200)"), ("node.filesystem_used_ratio", "value / 250")]),
    ("node", [("interface.rx_drop_rate", "value / 1000"), ("routing.bgp_peer_up", "least(1, greatest(0, 2 - value / 100))"), ("node.process_count", "value / 10")]),
    ("web", [("traffic.web.requests_rate", "value"), ("traffic.web.error_rate", "value * least(1, greatest(0.02, (value - 100) / 100))"), ("traffic.web.success_rate", "value * 0.98"), ("traffic.web.latency_p95_seconds", "value / 400")]),
    ("auth", [("traffic.auth.requests_rate", "value"), ("traffic.auth.timeout_rate", "value / 20"), ("traffic.auth.error_rate", "value / 90")]),
    ("netflow", [("netflow.flow_records.protocol_tcp", "value + 25"), ("netflow.protocol_byte_share.protocol_tcp", "1 / (1 + value / 50)"), ("netflow.unique_destination_ports.protocol_tcp", "value * (event_id % 7) / 7")]),
    ("log", [("frr.bgp.err.count", "greatest(0, floor((value - 100) / 20))"), ("frr.ospf.warning.count", "greatest(0, floor((value - 60) / 50))")]),
]
_list = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


def case_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case, modality, minute, entity, feature, value) of all cases."""
    at = lambda names, i: F.get(F.array(*map(F.lit, names)), F.expr(i).cast("int"))
    e = events(spark, sf_dir).where("user_id is not null and value is not null")
    e = e.withColumns({
        "case": F.col("user_id"), "fam": F.col("event_id") % len(FAMILIES), "city": at(dims.CITIES, "user_id % 8"), "other": at(dims.CITIES, "(user_id * 3 + 1) % 8"),
        "role": at(CASE_ROLES, "(user_id + (event_id div 6) % 2) % 4"), "minute": F.explode(F.expr(f"sequence(sec div {STEP}, sec div {STEP} + least(5, cast(floor(value / 40) as bigint)))")),
    })
    node, rows = F.concat_ws("-", "city", "role"), []
    for i, (kind, features) in enumerate(FAMILIES):
        if kind in ("web", "auth"):
            entity, modality = F.concat(F.col("city"), F.lit("-traffic-vm>service-group:"), F.col("other"), F.lit(f":{kind}>traffic")), "edge"
        elif kind == "netflow":
            entity, modality = F.concat(F.col("city"), F.lit("-fw>interface:"), F.col("city"), F.lit("-fw:ens4>netflow")), "edge"
        else:
            entity, modality = node, kind
        each = [F.struct(F.lit(f).alias("feature"), F.expr(v).cast("double").alias("value")) for f, v in features]
        rows.append(F.when(F.col("fam") == i, F.struct(F.lit(modality).alias("modality"), entity.alias("entity"), F.array(*each).alias("cells"))))
    long = e.select("case", "minute", F.coalesce(*rows).alias("r")).select("case", "minute", "r.modality", "r.entity", F.inline("r.cells"))
    return long.groupBy("case", "modality", "minute", "entity", "feature").agg(F.max("value").alias("value"))


def _family_sql(i: int, kind: str, feature: str, value: str) -> str:
    entity = {"web": "city || '-traffic-vm>service-group:' || other || ':web>traffic'", "auth": "city || '-traffic-vm>service-group:' || other || ':auth>traffic'",
              "netflow": "city || '-fw>interface:' || city || '-fw:ens4>netflow'"}.get(kind, "city || '-' || role")
    modality = kind if kind in ("node", "log") else "edge"
    return f"SELECT k, '{modality}' AS modality, minute, {entity} AS entity, '{feature}' AS feature, CAST({value} AS DOUBLE) AS value FROM base WHERE fam = {i}"


CELLS = f"""{EV}, base AS (SELECT user_id AS k, event_id, value, event_id % 6 AS fam, {_list(dims.CITIES)}[user_id % 8 + 1] AS city, {_list(dims.CITIES)}[(user_id * 3 + 1) % 8 + 1] AS other,
  ['fw', 'br-1', 'service-vm-2', 'traffic-vm'][(user_id + (event_id // 6) % 2) % 4 + 1] AS role, unnest(range(sec // {STEP}, sec // {STEP} + 1 + least(5, CAST(floor(value / 40) AS BIGINT)))) AS minute FROM ev),
cells AS (SELECT k, modality, minute, entity, feature, max(value) AS value FROM ({" UNION ALL ".join(_family_sql(i, kind, f, v) for i, (kind, fs) in enumerate(FAMILIES) for f, v in fs)}) AS fams GROUP BY ALL)"""
_SIG = lambda x: f"1 / (1 + exp(-greatest(-20, least(20, ({x} - 3) / 0.9))))"


def _near(cte: str, source: str, by: str, flag: str) -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY minute RANGE BETWEEN 1 {{}} AND 1 {{}})"
    return f"{cte} AS (SELECT *, max({flag}) {w.format('PRECEDING', 'PRECEDING')} AS b, max({flag}) {w.format('FOLLOWING', 'FOLLOWING')} AS a FROM {source})"


def _reference(name: str, source: str, by: str) -> str:
    """SQL of median (center), scaled MAD but at least the floor (scale) and count (n) of value, by series."""
    cols = by.split(", ")
    on = " AND ".join(f"h.{c} = c.{c}" for c in cols)
    of = ", ".join(f"h.{c}" for c in cols)
    return f"""{name}c AS (SELECT {by}, median(value) AS center, count(*) AS n FROM {source} GROUP BY ALL),
{name} AS (SELECT {of}, any_value(center) AS center, any_value(n) AS n, greatest(median(abs(value - center)) * 1.4826, any_value(floor)) AS scale FROM {source} h JOIN {name}c c ON {on} GROUP BY {of})"""


LINES = f"""{CELLS}, rule(feature, category, direction, floor, least_v, most_v, immediate) AS (VALUES ('node.cpu_usage', 'cpu_pressure', 1, 4.0, 18.0, NULL, false),
  ('node.memory_available_ratio', 'memory_pressure', -1, 0.015, NULL, 0.9, false), ('node.disk_io_util', 'disk_io_pressure', 1, 10.0, 55.0, NULL, false), ('node.filesystem_used_ratio', 'disk_space_pressure', 1, 0.03, 0.8, NULL, false),
  ('node.process_count', 'process_pressure', 1, 10.0, NULL, NULL, false), ('interface.rx_drop_rate', 'link_fault', 1, 0.1, 0.1, NULL, false), ('routing.bgp_peer_up', 'routing_fault', -1, 0.2, NULL, NULL, true)),
held AS (SELECT k, minute, entity, c.feature, value, category, direction, floor, least_v, most_v, immediate FROM cells c JOIN rule ON c.feature = rule.feature WHERE modality = 'node'),
{_reference("rf", "held", "k, entity, feature")},
st AS (SELECT h.k, minute, h.entity, h.feature, category, immediate, CASE WHEN n >= 3 AND (least_v IS NULL OR value >= least_v) AND (most_v IS NULL OR value <= most_v)
  THEN least(16.0, greatest(0.0, direction * (value - center) / scale)) ELSE 0 END AS strength FROM held h JOIN rf ON h.k = rf.k AND h.entity = rf.entity AND h.feature = rf.feature
  UNION ALL SELECT k, minute, entity, feature, 'routing_fault', true, 5.0 FROM cells WHERE modality = 'log' AND regexp_matches(feature, 'err|crit|alert|warning') AND value > 0),
tops AS (SELECT k, minute, entity, max(strength) AS strongest, bool_or(immediate AND strength >= 3) AS imm FROM st GROUP BY 1, 2, 3),
{_near("tn", "tops", "k, entity", "strongest")},
np AS (SELECT k, minute, entity, strongest, {_SIG("strongest")} * CASE WHEN imm OR (strongest >= 2.5 AND greatest(coalesce(a, 0), coalesce(b, 0)) >= 2.5) THEN 1 ELSE 0.55 END AS p FROM tn),
tr AS (SELECT *, string_split(feature, '.')[-1] AS f FROM cells WHERE feature LIKE 'traffic.%'),
wide AS (SELECT k, minute, entity, max(value) FILTER (f = 'requests_rate') AS q, max(value) FILTER (f = 'error_rate') AS e, max(value) FILTER (f = 'success_rate') AS s FROM tr GROUP BY 1, 2, 3),
slow AS (SELECT k, minute, entity, feature, value, 0.25 AS floor FROM tr WHERE f = 'latency_p95_seconds'),
{_reference("sr", "slow", "k, entity, feature")},
sy AS (SELECT k, minute, entity, max(x) AS symptom FROM (
  SELECT k, minute, entity, greatest(CASE WHEN e IS NOT NULL THEN least(16.0, greatest(0, least(e, q)) * 15 / (q + 30)) END, CASE WHEN s IS NOT NULL THEN least(16.0, greatest(0, least(q - s, q)) * 15 / (q + 30)) END) AS x FROM wide WHERE q > 0
  UNION ALL SELECT h.k, minute, h.entity, CASE WHEN value >= 0.5 THEN greatest(0, least(16.0, (value - center) / scale)) ELSE 0 END FROM slow h JOIN sr ON h.k = sr.k AND h.entity = sr.entity WHERE n >= 3) AS u WHERE x IS NOT NULL GROUP BY 1, 2, 3),
sm AS (SELECT k, minute, max(symptom) AS x FROM sy GROUP BY 1, 2), {_near("sn", "sm", "k", "x")},
sp AS (SELECT k, minute, {_SIG("x")} * CASE WHEN x >= 2.5 AND greatest(coalesce(a, 0), coalesce(b, 0)) >= 2.5 THEN 0.9 ELSE 0.4 END AS p FROM sn),
fl AS (SELECT k, minute, entity, string_split(feature, '.')[2] AS name, value FROM cells WHERE feature LIKE 'netflow.%'),
comp AS (SELECT f.k, f.minute, f.entity, f.name, CASE f.name WHEN 'protocol_byte_share' THEN f.value ELSE greatest(0, least(1, f.value / greatest(d.value, 1))) END AS value, 0.05 AS floor
  FROM fl f JOIN fl d ON f.k = d.k AND f.minute = d.minute AND f.entity = d.entity AND d.name = 'flow_records' AND d.value >= 30 WHERE f.name <> 'flow_records'),
{_reference("cr", "comp", "k, entity, name")},
cz AS (SELECT h.k, minute, h.entity, h.name, greatest(0, least(4, (abs((value - center) / scale) - 2.5) / 2)) AS raw FROM comp h JOIN cr ON h.k = cr.k AND h.entity = cr.entity AND h.name = cr.name WHERE n >= 20),
{_near("cn", "cz", "k, entity, name", "raw")},
ns AS (SELECT k, minute, entity, max(CASE WHEN raw > 0 AND greatest(coalesce(a, 0), coalesce(b, 0)) > 0 THEN raw ELSE 0 END) AS support FROM cn GROUP BY 1, 2, 3),
sco AS (SELECT k, 'log' AS kind, minute, entity, max(least(8.0, ln(1 + greatest(value, 0)) * CASE feature WHEN 'frr.bgp.err.count' THEN 4 ELSE 2 END)) AS score FROM cells WHERE modality = 'log' GROUP BY ALL
  UNION ALL SELECT k, 'node', minute, entity, strongest FROM np
  UNION ALL SELECT k, 'edge', minute, entity, max(score) FROM (SELECT k, minute, entity, symptom AS score FROM sy UNION ALL SELECT k, minute, entity, support FROM ns) AS u GROUP BY ALL),
nm AS (SELECT k, minute, max(p) AS p FROM np GROUP BY 1, 2),
ml AS (SELECT coalesce(nm.k, sp.k) AS k, coalesce(nm.minute, sp.minute) AS minute, coalesce(nm.p, 0) AS node, coalesce(sp.p, 0) AS service, greatest(coalesce(nm.p, 0), coalesce(sp.p, 0)) AS probability FROM nm FULL JOIN sp ON nm.k = sp.k AND nm.minute = sp.minute)"""
LINE = f"""{LINES}, en0 AS (SELECT k, min(minute) AS a, max(minute) AS z FROM cells GROUP BY 1), spn AS (SELECT k, a, unnest(range(a, z + 1)) AS minute FROM en0),
dv AS (SELECT k, minute, max(z) AS z FROM (SELECT k, minute, 0.0 AS z FROM cells WHERE modality IN ('node', 'log') UNION ALL SELECT k, minute, strength FROM st) AS u GROUP BY 1, 2),
sv AS (SELECT k, minute, max(symptom) AS z FROM sy WHERE symptom > 0 GROUP BY 1, 2),
ln AS (SELECT s.k, a, s.minute, s.minute - a AS i, greatest(coalesce(probability, 0), CASE WHEN dv.k IS NULL THEN 0 ELSE 0.55 END * {_SIG("0")}, 0.4 * {_SIG("0")}) AS p,
  CASE WHEN dv.k IS NOT NULL AND sv.k IS NOT NULL THEN (CASE WHEN dv.z >= 3 THEN 0.5 ELSE 0 END + CASE WHEN sv.z >= 3 THEN 0.5 ELSE 0 END) END AS support
  FROM spn s LEFT JOIN ml ON s.k = ml.k AND s.minute = ml.minute LEFT JOIN dv ON s.k = dv.k AND s.minute = dv.minute LEFT JOIN sv ON s.k = sv.k AND s.minute = sv.minute)"""
# the decoder: intervals worth taking, then the best set of them, start by start
DECODED = f"""{LINE}, lw AS (SELECT *, lag(p) OVER (PARTITION BY k ORDER BY i) AS was, lead(p) OVER (PARTITION BY k ORDER BY i) AS nxt FROM ln),
so AS (SELECT k, i AS s, p AS p0, was AS w0 FROM lw WHERE p >= 0.4 AND ((p >= 0.8 AND (was IS NULL OR was < 0.8 OR p - was >= 0.2)) OR (was < 0.4 AND p - was >= 0.2))),
cd AS (SELECT so.k, s, i AS e, p0, w0, p, CASE WHEN nxt IS NULL THEN 0 ELSE greatest(0, p - nxt) END AS fall, i - s + 1 AS n, avg(greatest(0, p - 0.4)) OVER r AS over_, max(p) OVER r AS top, avg(support) OVER r AS sup, avg(p) OVER r AS conf
  FROM so JOIN lw ON lw.k = so.k AND i BETWEEN s AND s + 29 WINDOW r AS (PARTITION BY so.k, s ORDER BY i ROWS UNBOUNDED PRECEDING)),
cv AS (SELECT k, s, e, conf, over_ * sqrt(n) + least(ln(n), ln(30)) * 0.08 + greatest(0, top - 0.8) * 0.5 + (CASE WHEN w0 IS NOT NULL AND p0 >= 0.8 THEN greatest(0, p0 - w0) ELSE 0 END + CASE WHEN p >= 0.8 THEN fall ELSE 0 END) * 0.5
  + fall * 0.3 + coalesce(sup, 0) * 0.2 - 0.55 AS v FROM cd),
ofs AS (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY s) AS r, list({{'e': e, 'v': v, 'c': conf}} ORDER BY e) AS offers FROM cv WHERE v > 0 GROUP BY 1, 2),
dp AS (SELECT DISTINCT k, 0::BIGINT AS r, []::STRUCT(f DOUBLE, e BIGINT, path STRUCT(s BIGINT, e BIGINT, c DOUBLE)[])[] AS ends FROM ofs
  UNION ALL SELECT d.k, d.r + 1, list_concat(d.ends, list_transform(offers, lambda o: {{'f': b.f + o.v, 'e': o.e, 'path': list_append(b.path, {{'s': s, 'e': o.e, 'c': o.c}})}}))
  FROM (SELECT dp.k AS k, dp.r AS r, ends, s, offers, list_reduce(list_transform(list_filter(ends, lambda x: x.e < s), lambda x: {{'f': x.f - 0.5 * (20 - least(20, s - x.e - 1)) / 20, 'path': x.path}}),
    lambda x, y: CASE WHEN y.f > x.f THEN y ELSE x END, {{'f': 0.0, 'path': []::STRUCT(s BIGINT, e BIGINT, c DOUBLE)[]}}) AS b FROM dp JOIN ofs ON ofs.k = dp.k AND ofs.r = dp.r + 1) AS d),
ch AS (SELECT k, unnest(list_reduce(ends, lambda x, y: CASE WHEN y.f > x.f OR (y.f = x.f AND y.e > x.e) THEN y ELSE x END).path) AS w FROM dp WHERE r = (SELECT max(r) FROM ofs WHERE ofs.k = dp.k)),
wn AS (SELECT ch.k, ch.k || ':' || (a + w.s) AS event, a + w.s AS s, a + w.e + 1 AS e, least(1, greatest(0, w.c)) AS conf FROM ch JOIN en0 ON en0.k = ch.k)"""
_AGG = "0.7 * max(score) FILTER (phase = '{0}') + 0.3 * sum(score) FILTER (phase = '{0}') / any_value(b - a) FILTER (phase = '{0}')"
PARTS = f"""{DECODED}, ph AS (SELECT k, event, 'before' AS phase, greatest(0, s - 10) AS a, s AS b FROM wn UNION ALL SELECT k, event, 'during', s, e FROM wn
  UNION ALL SELECT k, event, 'early', s, s + greatest(1, (e - s) // 3) FROM wn UNION ALL SELECT k, event, 'recovery', e, e + 15 FROM wn),
g AS (SELECT event, kind, entity, coalesce({_AGG.format("before")}, 0) AS b, coalesce({_AGG.format("during")}, 0) AS d, coalesce({_AGG.format("early")}, 0) AS y, coalesce({_AGG.format("recovery")}, 0) AS r,
  CASE WHEN max(score) FILTER (phase = 'during') <> 0 THEN sum(score) FILTER (phase = 'during') / any_value(b - a) FILTER (phase = 'during') / max(score) FILTER (phase = 'during') END AS steady, count(*) FILTER (phase = 'during') > 0 AS seen
  FROM ph JOIN sco ON ph.k = sco.k AND minute >= a AND minute < b GROUP BY 1, 2, 3),
ee AS (SELECT DISTINCT entity, string_split(entity, '>')[1] AS source, string_split(entity, '>')[3] AS relation, string_split(string_split(entity, '>')[2], ':')[2] AS city FROM cells WHERE modality = 'edge'),
en AS (SELECT entity, city || '-service-vm-' || n AS node, 'target' AS part FROM ee, (SELECT unnest([1, 2, 3]) AS n) AS ns3 WHERE relation = 'traffic'
  UNION ALL SELECT entity, source, 'observer' FROM ee WHERE relation = 'traffic' UNION ALL SELECT entity, source, 'flow' FROM ee WHERE relation = 'netflow'),
ed AS (SELECT event, node, max((d + 0.25 * y) / 3) FILTER (part = 'target') AS tt, max(0.025 * d) FILTER (part = 'observer') AS ob, sum(0.25 * greatest(0, d - b) + 0.1 * greatest(0, y - b)) FILTER (part = 'flow') AS nf, bool_or(seen) AS seen
  FROM g JOIN en ON g.entity = en.entity WHERE kind = 'edge' GROUP BY 1, 2),
pa AS (SELECT w.k, w.event, w.node, coalesce(n.d, 0) AS direct, coalesce(n.y, 0) AS early, coalesce(n.b, 0) AS pre, coalesce(n.steady, 0) AS persistence, greatest(0, coalesce(n.d, 0) - coalesce(n.r, 0)) AS recovery, coalesce(l.d, 0) AS log,
  coalesce(tt, 0) AS traffic_target, coalesce(ob, 0) AS traffic_observer, coalesce(nf, 0) AS netflow, coalesce(n.seen, false) OR coalesce(l.seen, false) OR coalesce(ed.seen, false) AS observed
  FROM (SELECT k, event, unnest({_list(NODES)}) AS node FROM wn) AS w LEFT JOIN g n ON n.kind = 'node' AND w.event = n.event AND w.node = n.entity LEFT JOIN g l ON l.kind = 'log' AND w.event = l.event AND w.node = l.entity
  LEFT JOIN ed ON w.event = ed.event AND w.node = ed.node),
ro AS (SELECT k, event, node, 0.5 * direct + 0.2 * early + 0.15 * pre + 0.15 * recovery + 1.1 * log + 0.15 * traffic_target + traffic_observer + least(netflow, greatest(direct, log) * 0.2) AS score FROM pa),
t5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY round(score, 9) DESC, list_position({_list(NODES)}, node)) AS rank FROM ro) AS x WHERE rank <= 5)"""
_SIGNAL = """sg(feature, signal, low) AS (VALUES ('node.cpu_usage', 'cpu', false), ('node.memory_available_ratio', 'memory', true), ('node.disk_io_util', 'disk_io', false), ('node.filesystem_used_ratio', 'disk_space', false),
  ('interface.rx_drop_rate', 'link_loss', false), ('routing.bgp_peer_up', 'bgp_down', true), ('node.process_count', 'process', false), ('traffic.web.error_rate', 'web_error', false), ('traffic.web.latency_p95_seconds', 'web_latency', false),
  ('traffic.auth.timeout_rate', 'auth_timeout', false), ('traffic.auth.error_rate', 'auth_error', false), ('netflow.unique_destination_ports.protocol_tcp', 'port_selectivity', false), ('frr.bgp.err.count', 'bgp_down', false), ('frr.ospf.warning.count', 'ospf_down', false))"""


def _signal_sql(name: str, owners: str, owner: str) -> str:
    return f"""{name}x AS (SELECT wn.k, event, {owner}, c.modality, c.feature, signal, low, c.value, c.minute < s AS before FROM cells c JOIN sg ON c.feature = sg.feature JOIN {owners} o ON o.modality = c.modality AND o.entity = c.entity
  JOIN wn ON wn.k = c.k AND c.minute >= greatest(0, s - 30) AND c.minute < e),
{name}q AS (SELECT k, event, {owner}, modality, feature, signal, low, quantile_cont(value, [0.25, 0.5, 0.75]) FILTER (before) AS q, max(value) FILTER (NOT before) AS hi, min(value) FILTER (NOT before) AS lo, max(abs(value)) FILTER (NOT before) AS size FROM {name}x GROUP BY ALL),
{name} AS (SELECT k, event, {owner}, signal, max(least(25.0, CASE WHEN q IS NULL THEN size ELSE greatest(0, CASE WHEN low THEN q[2] - lo ELSE hi - q[2] END / greatest(q[3] - q[1], abs(q[2]) * 0.05, 0.01)) END)
  * CASE feature WHEN 'node.disk_io_util' THEN greatest(0, least(1, hi / 100)) ELSE 1 END) AS strength FROM {name}q WHERE hi IS NOT NULL GROUP BY 1, 2, 3, 4)"""


SIGNALS = f"""{PARTS}, {_SIGNAL}, ow AS (SELECT DISTINCT modality, entity, entity AS node FROM cells WHERE modality <> 'edge' UNION ALL SELECT 'edge', entity, node FROM en WHERE part <> 'observer'),
{_signal_sql("cs", "ow", "node")},
oc AS (SELECT DISTINCT modality, entity, string_split(entity, '-')[1] AS city FROM cells WHERE modality <> 'edge' UNION ALL SELECT 'edge', entity, CASE relation WHEN 'netflow' THEN string_split(source, '-')[1] ELSE city END FROM ee),
{_signal_sql("cy", "oc", "city")}"""
_CATEGORY = """CASE WHEN node LIKE '%-fw' AND signal = 'cpu' THEN 'firewall_cpu_pressure' WHEN node LIKE '%-fw' AND signal = 'port_selectivity' THEN 'firewall_port_block'
  WHEN regexp_matches(node, '-(br|cr)-[0-9]+$') AND signal = 'bgp_down' THEN 'route_bgp_session_down' WHEN regexp_matches(node, '-(br|cr)-[0-9]+$') AND signal = 'ospf_down' THEN 'route_ospf6_neighbor_down'
  ELSE CASE signal WHEN 'cpu' THEN 'resource_cpu_high' WHEN 'memory' THEN 'resource_memory_pressure' WHEN 'disk_io' THEN 'resource_disk_io_pressure' WHEN 'disk_space' THEN 'resource_disk_space_low' WHEN 'process' THEN 'resource_process_pressure'
  WHEN 'link_loss' THEN 'link_loss' WHEN 'web_error' THEN 'service_web_5xx' WHEN 'web_latency' THEN 'service_web_slow' WHEN 'auth_timeout' THEN 'service_auth_timeout' WHEN 'auth_error' THEN 'service_auth_error' END END"""
_TAXONOMY = ", ".join(f"('{name}', '{major}', '{sub}', {i})" for i, (name, major, sub) in enumerate(dims.TAXONOMY))
CATEGORIES = f"""{SIGNALS}, tx(name, major, sub, ord) AS (VALUES {_TAXONOMY}),
ca AS (SELECT event, node, category, max(strength) AS v, any_value(score) AS score FROM (SELECT event, node, score, strength, {_CATEGORY} AS category FROM t5 JOIN cs USING (k, event, node)) AS x WHERE category IS NOT NULL AND strength > 0 GROUP BY 1, 2, 3),
cn1 AS (SELECT event, node, sum(v) AS s, greatest(0, any_value(score)) * sum(v) AS bo FROM ca GROUP BY 1, 2),
cw AS (SELECT event, node, s, (CASE WHEN sum(bo) OVER w > 0 THEN bo / sum(bo) OVER w ELSE 1 / count(*) OVER w END + CASE WHEN sum(s) OVER w > 0 THEN s / sum(s) OVER w ELSE 1 / count(*) OVER w END) * 0.5 AS w FROM cn1 WINDOW w AS (PARTITION BY event)),
cp AS (SELECT ca.event, category, sum(w * v / s) AS p FROM ca JOIN cw ON ca.event = cw.event AND ca.node = cw.node GROUP BY 1, 2),
c31 AS (SELECT event, category, p, rank FROM (SELECT cp.*, row_number() OVER (PARTITION BY event ORDER BY round(p, 9) DESC, ord) AS rank FROM cp JOIN tx ON category = name) AS x WHERE rank <= 3),
cf AS (SELECT event, category, max(strength) AS p FROM (SELECT event, strength, {_CATEGORY} AS category FROM t5 JOIN cy USING (k, event) WHERE rank = 1 AND city = string_split(node, '-')[1] AND event NOT IN (SELECT event FROM c31)) AS x WHERE category IS NOT NULL AND strength > 0 GROUP BY 1, 2),
c32 AS (SELECT event, category, p / sum(p) OVER (PARTITION BY event) AS p, rank FROM (SELECT cf.*, row_number() OVER (PARTITION BY event ORDER BY p DESC, ord) AS rank FROM cf JOIN tx ON category = name) AS x WHERE rank <= 3),
c3 AS (SELECT * FROM c31 UNION ALL SELECT * FROM c32
  UNION ALL SELECT event, CASE WHEN node LIKE '%-fw' THEN 'firewall_cpu_pressure' WHEN regexp_matches(node, '-(br|cr)-[0-9]+$') THEN 'route_bgp_session_down' ELSE 'resource_cpu_high' END, 0, 1 FROM t5 WHERE rank = 1 AND event NOT IN (SELECT event FROM c31) AND event NOT IN (SELECT event FROM c32))"""
FINAL = f"""{CATEGORIES}, du AS (SELECT wn.event, wn.k, s, e, node FROM wn JOIN t5 ON wn.event = t5.event WHERE rank = 1),
fam AS (SELECT du.event, category, max(strength) AS x FROM du JOIN st ON st.k = du.k AND st.entity = du.node AND st.minute >= s AND st.minute < e GROUP BY 1, 2),
spc AS (SELECT event, coalesce(arg_max(category, (x, CASE category WHEN 'disk_io_pressure' THEN 3 WHEN 'memory_pressure' THEN 2 ELSE 1 END)) FILTER (category = 'disk_io_pressure' AND x >= 5 OR category IN ('memory_pressure', 'disk_space_pressure') AND x >= 4),
  arg_max(category, (x, -list_position(['cpu_pressure', 'memory_pressure', 'disk_io_pressure', 'disk_space_pressure', 'process_pressure', 'link_fault', 'routing_fault'], category))) FILTER (x >= 3)) AS family, coalesce(max(x) FILTER (category = 'disk_io_pressure'), 0) AS disk FROM fam GROUP BY 1),
sur AS (SELECT du.event, max(p) AS sure FROM du JOIN np ON np.k = du.k AND np.entity = du.node AND np.minute >= s AND np.minute < e GROUP BY 1),
dsk AS (SELECT DISTINCT du.event FROM du JOIN cells c ON c.k = du.k AND c.entity = du.node AND c.feature = 'node.disk_io_util' AND c.minute >= s AND c.minute < e),
fi0 AS (SELECT du.event, du.k, node, c3.category AS local, c3.p, family, coalesce(disk, 0) AS disk, coalesce(sure, 0) AS sure, dsk.event IS NOT NULL AS seen, CASE WHEN node LIKE '%-fw' THEN CASE family WHEN 'cpu_pressure' THEN 'firewall_cpu_pressure' END WHEN regexp_matches(node, '-(br|cr)-') THEN NULL
  ELSE CASE family WHEN 'cpu_pressure' THEN 'resource_cpu_high' WHEN 'disk_space_pressure' THEN 'resource_disk_space_low' WHEN 'memory_pressure' THEN 'resource_memory_pressure' WHEN 'disk_io_pressure' THEN 'resource_disk_io_pressure' WHEN 'process_pressure' THEN 'resource_process_pressure' END END AS new
  FROM du JOIN c3 ON c3.event = du.event AND rank = 1 LEFT JOIN spc ON spc.event = du.event LEFT JOIN sur ON sur.event = du.event LEFT JOIN dsk ON dsk.event = du.event),
fi1 AS (SELECT *, coalesce(new, local) AS category, CASE WHEN new IS NULL THEN p ELSE greatest(p, sure) END AS conf FROM fi0),
fi2 AS (SELECT *, CASE WHEN category <> 'resource_disk_io_pressure' THEN 'not_checked' WHEN disk >= 5 THEN 'supported' WHEN seen THEN 'unsupported' ELSE 'undetermined' END AS anchor FROM fi1),
fin AS (SELECT event, k, node, local, category, CASE WHEN anchor IN ('unsupported', 'undetermined') THEN least(0.5, conf) ELSE conf END AS confidence, family, anchor, disk FROM fi2)"""


def diagnosed(spark: SparkSession, sf_dir: str) -> diagnose.Diagnosis:
    return diagnose.Diagnosis(spark, staged(case_cells(spark, sf_dir), "cells"), dims.direct_rules(spark), BY)


@query(f"WITH {LINE} SELECT k AS case_id, minute, round(p + 1e-9, 6) AS p, round(support + 1e-9, 6) AS support FROM ln")
def family_support(spark, sf_dir):
    """The decoder's timeline: every step of every case, with the part of its families that stand out."""
    return diagnosed(spark, sf_dir).line.select(F.col("case").alias("case_id"), "minute", r6("p").alias("p"), r6("support").alias("support"))


@query(f'WITH RECURSIVE {DECODED} SELECT k AS case_id, event, s AS "start", e AS "end", round(conf + 1e-9, 6) AS confidence FROM wn')
def decoded_cases(spark, sf_dir):
    return diagnosed(spark, sf_dir).events.select(F.col("case").alias("case_id"), "event", "start", "end", r6("confidence").alias("confidence"))


_NUMBERS = ["direct", "early", "pre", "persistence", "recovery", "log", "traffic_target", "traffic_observer", "netflow"]


@query(f"WITH RECURSIVE {PARTS} SELECT event, node, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in _NUMBERS)}, observed FROM pa")
def candidate_evidence(spark, sf_dir):
    return diagnosed(spark, sf_dir).parts.select("event", "node", *(r6(c).alias(c) for c in _NUMBERS), "observed")


@query(f"WITH RECURSIVE {PARTS} SELECT event, node, round(score + 1e-9, 6) AS score, CAST(rank AS INTEGER) AS rank FROM t5")
def event_roots(spark, sf_dir):
    return diagnosed(spark, sf_dir).top5.select("event", "node", r6("score").alias("score"), "rank")


@query(f"""WITH RECURSIVE {PARTS}, v AS (SELECT event, node, round(direct + log + 1e-9, 6) AS score FROM pa), r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY score DESC, node) AS rank, count(*) OVER (PARTITION BY event) AS n FROM v WHERE score > 0)
SELECT event, node, score, CAST(rank AS INTEGER) AS rank, greatest(0, n - 20) AS truncated FROM r WHERE rank <= 20""")
def subgraph_nodes(spark, sf_dir):
    parts = diagnosed(spark, sf_dir).parts
    return event_ops.event_nodes(parts, r6(F.col("direct") + F.col("log")), ["event"]).select("event", "node", "score", "rank", "truncated")


@query(f"WITH RECURSIVE {SIGNALS} SELECT event, node, signal, round(strength + 1e-9, 6) AS strength FROM cs")
def candidate_signals(spark, sf_dir):
    d = diagnosed(spark, sf_dir)
    return d.signals.select("event", "node", "signal", r6("strength").alias("strength"))


@query(f"WITH RECURSIVE {SIGNALS} SELECT event, city, signal, round(strength + 1e-9, 6) AS strength FROM cy")
def city_signals(spark, sf_dir):
    d = diagnosed(spark, sf_dir)
    return d.city_signals.select("event", "city", "signal", r6("strength").alias("strength"))


@query(f"WITH RECURSIVE {CATEGORIES} SELECT event, category, round(p + 1e-9, 6) AS p, CAST(rank AS INTEGER) AS rank FROM c3")
def event_categories(spark, sf_dir):
    return diagnosed(spark, sf_dir).categories.select("event", "category", r6("p").alias("p"), "rank")


@query(f"WITH RECURSIVE {FINAL} SELECT event, local, category, round(confidence + 1e-9, 6) AS confidence, family, anchor, round(disk + 1e-9, 6) AS disk FROM fin")
def final_categories(spark, sf_dir):
    """Categories after the root's own direct evidence has had its say."""
    return diagnosed(spark, sf_dir).final.select("event", "local", "category", r6("confidence").alias("confidence"), "family", "anchor", r6("disk").alias("disk"))


@query(f"""WITH RECURSIVE {FINAL} SELECT wn.event AS event, s AS "start", e AS "end", round(conf + 1e-9, 6) AS confidence, nodes, category, round(fin.confidence + 1e-9, 6) AS category_p
FROM wn JOIN (SELECT event, string_agg(node, ',' ORDER BY rank) AS nodes FROM t5 GROUP BY 1) AS n ON wn.event = n.event JOIN fin ON wn.event = fin.event""")
def diagnosis(spark, sf_dir):
    """From cells to every event of every case: interval, five nodes and a category."""
    d = diagnosed(spark, sf_dir)
    nodes = d.top5.groupBy("event").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]), ",").alias("nodes"))
    best = d.final.select("event", "category", r6("confidence").alias("category_p"))
    return d.events.select("event", "start", "end", r6("confidence").alias("confidence")).join(nodes, "event").join(best, "event")


_TIME = "strftime(make_timestamp({} * 3600000000), '%Y-%m-%dT%H:%M:%S.000Z')"


@query(f"""WITH RECURSIVE {FINAL} SELECT k AS case_id, 'pred_' || k || '_' || lpad(CAST(row_number() OVER (PARTITION BY k ORDER BY s) AS VARCHAR), 6, '0') AS prediction_id, {_TIME.format("s")} AS start_time, {_TIME.format("e")} AS end_time,
  nodes, major AS major_category, sub AS sub_category, true AS valid
FROM wn JOIN (SELECT event, string_agg(node, ',' ORDER BY rank) AS nodes FROM t5 GROUP BY 1) AS n ON wn.event = n.event JOIN (SELECT event, category FROM fin) AS f ON wn.event = f.event JOIN tx ON category = name""")
def case_records(spark, sf_dir):
    """The sink's records of all cases, with whether the sink would take them."""
    d = diagnosed(spark, sf_dir)
    made = evaluate.prediction_flags(d.records(seconds=STEP))
    nodes = F.array_join(F.transform("root_cause_top5", lambda x: x["network_element_id"]), ",")
    return made.select(F.col("case").alias("case_id"), "prediction_id", "start_time", "end_time", nodes.alias("nodes"), "fault_category.major_category", "fault_category.sub_category", (F.size("errors") == 0).alias("valid"))


@query(f"WITH RECURSIVE {DECODED}, c AS (SELECT DISTINCT k FROM cells), n AS (SELECT c.k, count(event) AS n FROM c LEFT JOIN wn ON wn.k = c.k GROUP BY 1) SELECT k AS case_id, n FROM n WHERE n <> 1")
def cases_without_one_record(spark, sf_dir):
    """The batch run's check that every case gave one event."""
    d = diagnosed(spark, sf_dir)
    ids = lambda df: df.select(F.col("case").alias("case_id"))
    return evaluate.not_single(ids(d.events), "case_id", ids(d.cells).distinct())


AUDIT = f"""{FINAL}, an(category, family, metric, least) AS (VALUES ('resource_cpu_high', 'cpu_pressure', 'node.cpu_usage', 3.0), ('firewall_cpu_pressure', 'cpu_pressure', 'node.cpu_usage', 3.0), ('resource_memory_pressure', 'memory_pressure', 'node.memory_available_ratio', 4.0),
  ('resource_disk_io_pressure', 'disk_io_pressure', 'node.disk_io_util', 5.0), ('resource_disk_space_low', 'disk_space_pressure', 'node.filesystem_used_ratio', 4.0)),
pk AS (SELECT wn.k, event, s, e, arg_max({{'m': minute, 'n': node, 'v': service}}, (probability, -minute)) AS hit FROM wn JOIN ml ON ml.k = wn.k AND minute >= s AND minute < e GROUP BY 1, 2, 3, 4),
tie AS (SELECT event, count(*) AS ties, min(entity) AS dn FROM pk JOIN np ON np.k = pk.k AND np.minute = hit.m AND abs(np.p - hit.n) <= 1e-6 GROUP BY 1),
dr AS (SELECT pk.k, pk.event, s, e, dn, CASE WHEN greatest(hit.n, hit.v) <= 0 THEN 'undetermined' WHEN abs(hit.n - hit.v) <= 1e-6 THEN 'ambiguous' WHEN hit.v > hit.n THEN 'service' WHEN ties <> 1 OR ties IS NULL THEN 'ambiguous' ELSE 'node' END AS driver FROM pk LEFT JOIN tie ON pk.event = tie.event),
sw AS (SELECT event, entity, feature, category, max(strength) AS x FROM wn JOIN st ON st.k = wn.k AND st.minute >= s AND st.minute < e GROUP BY ALL),
au AS (SELECT dr.event, driver, fin.node AS root, fin.category, CASE WHEN metric IS NULL THEN 'not_evaluated' WHEN (SELECT count(*) FROM sw WHERE sw.event = dr.event AND sw.entity = fin.node AND sw.feature = metric) = 0 THEN 'undetermined'
  WHEN (SELECT max(x) FROM sw WHERE sw.event = dr.event AND sw.entity = fin.node AND sw.category = an.family) >= least THEN 'supported' ELSE 'unsupported' END AS anchor,
  driver = 'node' AND string_split(dn, '-')[1] <> string_split(fin.node, '-')[1] AS city_conflict
  FROM dr JOIN fin ON dr.event = fin.event LEFT JOIN an ON fin.category = an.category)"""


@query(f"WITH RECURSIVE {AUDIT} SELECT event, driver, root, category, anchor, city_conflict FROM au")
def evidence_audit(spark, sf_dir):
    return diagnosed(spark, sf_dir).audit().drop("case")


@query(f"""WITH RECURSIVE {AUDIT} SELECT 'driver' AS kind, driver AS value, count(*) AS n FROM au GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM au GROUP BY 2 UNION ALL SELECT 'anchor', anchor, count(*) FROM au GROUP BY 2
UNION ALL SELECT 'flag', 'unsupported_disk', count(*) FROM au WHERE category = 'resource_disk_io_pressure' AND anchor = 'unsupported' HAVING count(*) > 0 UNION ALL SELECT 'flag', 'city_conflict', count(*) FROM au WHERE city_conflict HAVING count(*) > 0""")
def audit_counters(spark, sf_dir):
    return diagnose.audit_counts(diagnosed(spark, sf_dir).audit())


# --- events from point evidence

_WEIGHTS = {"node": 1.0, "frr": 1.2, "traffic": 0.75, "netflow": 0.5}
BUILT = f"""{EV}, pt AS (SELECT user_id % 20 AS k, hour AS minute, ['node', 'interface', 'routing', 'frr', 'traffic', 'netflow'][event_id % 6 + 1] AS source, 'n' || user_id % 3 AS node, 'm' || event_id % 2 AS metric,
  CASE WHEN (hour // 12 % 2 = 0) = (event_id % 9 <> 0) THEN 'high' ELSE 'low' END AS direction, least(25.0, value / 8) AS score FROM ev),
rk AS (SELECT *, row_number() OVER (PARTITION BY k, minute, source ORDER BY score DESC) AS r FROM pt), so AS (SELECT k, minute, source, max(score) AS b, sum(score) AS t, count(*) AS n FROM rk WHERE r <= 3 GROUP BY 1, 2, 3),
sw AS (SELECT k, minute, least(25.0, (b + 0.25 * CASE WHEN n > 1 THEN (t - b) / (n - 1) ELSE 0 END) * CASE source WHEN 'node' THEN 1.0 WHEN 'frr' THEN 1.2 WHEN 'traffic' THEN 0.75 WHEN 'netflow' THEN 0.5 ELSE 1.0 END) AS e FROM so),
en AS (SELECT k, minute, least(25.0, max(e) + 0.25 * CASE WHEN count(*) > 1 THEN (sum(e) - max(e)) / (count(*) - 1) ELSE 0 END) AS energy FROM sw GROUP BY 1, 2),
hk AS (SELECT *, CASE WHEN minute - lag(minute) OVER (PARTITION BY k ORDER BY minute) <= 2 THEN 0 ELSE 1 END AS fresh FROM en WHERE energy >= 3), hi AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY minute) AS island FROM hk),
hw AS (SELECT k, min(minute) FILTER (energy >= 7) AS s, max(minute) + 1 AS e FROM hi GROUP BY k, island),
ls AS (SELECT x.k, any_value(h0) AS h0, list(coalesce(energy, 0) ORDER BY h) AS es FROM (SELECT k, h0, unnest(range(h0, h1 + 1)) AS h FROM (SELECT k, min(minute) AS h0, max(minute) AS h1 FROM en GROUP BY 1) AS y) AS x LEFT JOIN en ON en.k = x.k AND en.minute = h GROUP BY 1),
cu(k, a, b) AS (SELECT k, s, e FROM hw WHERE s IS NOT NULL UNION ALL SELECT k, x[1], x[2] FROM (
  SELECT k, unnest([[a, a + list_position(q, list_min(q))], [a + list_position(q, list_min(q)), b]]) AS x FROM (SELECT cu.k, a, b, es[a + 2 - h0 : b - h0] AS q FROM cu JOIN ls ON cu.k = ls.k WHERE b - a > 12) AS l) AS c),
wi AS (SELECT k, a AS s, b AS e FROM cu WHERE b - a <= 12), hd AS (SELECT wi.k, s, e, minute, source, node, metric, direction, score FROM wi JOIN pt ON pt.k = wi.k AND minute >= s AND minute < e),
rd AS (SELECT *, first_value(direction) OVER o AS f FROM hd WHERE source IN ('node', 'interface', 'routing', 'frr') WINDOW o AS (PARTITION BY k, s, source, node, metric ORDER BY minute, score DESC, direction)),
rb AS (SELECT *, coalesce(sum(CASE WHEN direction = f THEN 1 ELSE 0 END) OVER (PARTITION BY k, s, source, node, metric ORDER BY minute, score DESC, direction ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rd),
rt AS (SELECT k, s, min(minute) AS turn FROM (SELECT k, s, minute, sum(score) AS x FROM rb WHERE direction <> f AND before >= 2 GROUP BY 1, 2, 3) AS u WHERE x >= 5 AND minute >= s + 2 GROUP BY 1, 2),
kp AS (SELECT hd.* REPLACE (coalesce(turn, e) AS e) FROM hd LEFT JOIN rt ON hd.k = rt.k AND hd.s = rt.s WHERE minute < coalesce(turn, e)),
ev2 AS (SELECT k, s, e, string_agg(minute || ' ' || source || ' ' || node || ' ' || metric || ' ' || direction || ' ' || CAST(round(score * 1000) AS BIGINT), ',' ORDER BY score DESC, minute, metric, source, node, direction) AS evidence, count(*) AS points FROM kp GROUP BY 1, 2, 3),
sc AS (SELECT k, s, string_agg(source || ' ' || n, ',' ORDER BY source) AS sources FROM (SELECT k, s, source, count(*) AS n FROM kp GROUP BY 1, 2, 3) AS u GROUP BY 1, 2),
pk AS (SELECT ev2.k, ev2.s, arg_max(minute, (energy, -minute)) AS peak_minute, max(energy) AS x FROM ev2 JOIN en ON en.k = ev2.k AND minute >= s AND minute < e GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {BUILT} SELECT ev2.k AS case_id, ev2.s AS "start", e AS "end", peak_minute, round(least(1.0, x / 7.0 / 1.5) + 1e-9, 6) AS confidence, points, evidence, sources
FROM ev2 JOIN sc ON ev2.k = sc.k AND ev2.s = sc.s JOIN pk ON ev2.k = pk.k AND ev2.s = pk.s""")
def built_events(spark, sf_dir):
    """Events of twenty cases from their points: cut at twelve steps, trimmed at recovery, with all their evidence in order."""
    at = lambda names, i: F.get(F.array(*map(F.lit, names)), F.expr(i).cast("int"))
    turned = (F.expr("hour div 12 % 2") == 0) == (F.col("event_id") % 9 != 0)
    points = events(spark, sf_dir).select(
        (F.col("user_id") % 20).alias("case_id"), F.col("hour").alias("minute"), at(["node", "interface", "routing", "frr", "traffic", "netflow"], "event_id % 6").alias("source"), F.concat(F.lit("n"), F.col("user_id") % 3).alias("node"),
        F.concat(F.lit("m"), F.col("event_id") % 2).alias("metric"), F.when(turned, "high").otherwise("low").alias("direction"), F.least(F.lit(25.0), F.col("value") / 8).alias("score"),
    )
    got = build.detected(points, ["case_id"], _WEIGHTS, longest=12, initial=2)
    line = lambda p: F.concat_ws(" ", p["minute"], p["source"], p["node"], p["metric"], p["direction"], F.round(p["score"] * 1000).cast("long"))
    return got.select(
        "case_id", "start", "end", "peak_minute", r6("confidence").alias("confidence"), F.size("evidence").cast("long").alias("points"), F.array_join(F.transform("evidence", line), ",").alias("evidence"),
        F.array_join(F.transform("sources", lambda x: F.concat_ws(" ", x["source"], x["n"])), ",").alias("sources"),
    )


# --- review and learned scores

_RATIONALE = "the first two stand close"


@query(f"""WITH RECURSIVE {FINAL}, ms AS (SELECT event, list(node ORDER BY rank) AS roots, (max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2)) / greatest(abs(max(score) FILTER (rank = 1)), 1e-8) AS margin FROM t5 GROUP BY 1),
nd AS (SELECT wn.k, wn.event, s, roots, category, wn.conf < 0.75 OR fin.confidence < 0.6 OR margin < 0.12 AS needs, (wn.k + s) % 9 AS kind FROM wn JOIN fin ON fin.event = wn.event JOIN ms ON ms.event = wn.event),
rvf AS (SELECT *, coalesce(sum(CASE WHEN needs AND kind >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS closed FROM nd),
rs AS (SELECT *, CASE WHEN NOT needs THEN 'skipped_confident' WHEN closed OR kind >= 4 THEN 'fallback' WHEN kind <= 1 THEN 'accepted' ELSE 'not_applied' END AS status FROM rvf)
SELECT event, needs, status, CASE WHEN status = 'fallback' THEN CASE WHEN closed THEN 'review circuit open' ELSE 'review unavailable or response invalid' END END AS reason,
  array_to_string(CASE WHEN status = 'accepted' THEN list_reverse(roots) ELSE roots END, ',') AS roots, CASE WHEN status = 'accepted' THEN 'link_loss' ELSE category END AS category FROM rs""")
def event_review(spark, sf_dir):
    """Events that need a review, with canned answers of nine kinds: two that apply, two that don't, five that are not legal."""
    d = diagnosed(spark, sf_dir)
    found = staged(review.needed(d.events, d.final, d.top5, list(BY)), "needs")
    kind = (F.col("case") + F.col("start")) % 9
    pick = lambda *v: F.get(F.array(*(x if not isinstance(x, (str, float)) else F.lit(x) for x in v)), kind.cast("int"))
    first = F.concat(F.lit("root:"), F.col("roots")[0])
    back = F.reverse("roots")
    answer = F.to_json(F.struct(
        pick("supports", "contradicts", "uncertain", "supports", "supports", "maybe", "supports", "supports", "supports").alias("event_opinion"),
        F.when(kind == 4, F.array_append(F.slice(back, 1, F.size(back) - 1), back[0])).otherwise(back).alias("root_cause_top5"),
        F.struct(F.lit("link").alias("major_category"), F.when(kind == 6, "dns_down").otherwise("loss").alias("sub_category")).alias("fault_category"),
        F.when(kind == 7, F.array(F.lit("root:elsewhere"))).otherwise(F.array(first)).alias("evidence_ids"),
        pick(0.9, 0.65, 0.95, 0.6, 0.9, 0.9, 0.9, 0.9, 0.9).alias("confidence"), F.lit(_RATIONALE).alias("rationale"),
    ))
    answers = found.where("needs").select(*BY, "event", F.when(kind == 8, F.lit("no {json")).otherwise(answer).alias("answer"))
    got = review.reviewed(found, list(BY), answers).join(found.select(*BY, "event", "needs"), [*BY, "event"])
    return got.select("event", "needs", "status", "reason", F.array_join("roots", ",").alias("roots"), "category")


@query(f"""WITH RECURSIVE {PARTS}, lg AS (SELECT ro.event, ro.node, greatest(score, 0) + 1 AS lift, 0.3 * direct + 0.2 * log - 0.1 * pre + CASE WHEN observed THEN 0.5 ELSE 0 END AS logit FROM ro JOIN pa ON pa.event = ro.event AND pa.node = ro.node),
lsm AS (SELECT event, node, lift / sum(lift) OVER (PARTITION BY event) AS rule, exp(logit) / sum(exp(logit)) OVER (PARTITION BY event) AS learned FROM lg)
SELECT event, node, round(rule + 1e-9, 6) AS rule, round(learned + 1e-9, 6) AS learned, round(0.75 * rule + 0.25 * learned + 1e-9, 6) AS score FROM lsm""")
def learned_blend(spark, sf_dir):
    """Rules and a linear model's scores of all candidates, blended."""
    d = diagnosed(spark, sf_dir)
    parts = d.parts
    scores = diagnose.roots(parts, len(NODES), BY).select(*BY, "event", "node", "score")
    logit = F.col("direct") * 0.3 + F.col("log") * 0.2 - F.col("pre") * 0.1 + F.when(F.col("observed"), 0.5).otherwise(0.0)
    got = review.blended(scores, parts.select(*BY, "event", "node", logit.alias("logit")), [*BY, "event"])
    return got.select("event", "node", *(r6(c).alias(c) for c in ("rule", "learned", "score")))


# --- files in the order of their lines


@query("""SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS line, round(c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1e-9, 2) AS moved FROM customer""")
def rows_by_line(spark, sf_dir):
    """Customers written as a CSV file for each nation and read back: the line of each, and how its balance differs from that of the line before."""
    from pyspark.sql import Window as W

    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"))
    rows.repartition("nation").sortWithinPartitions("nation", "c_custkey").write.partitionBy("nation").csv(path, header=True)
    got = ordered.csv_rows(spark, path, ["c_custkey", "c_acctbal"])
    balance = F.col("c_acctbal").cast("double")
    before = F.lag(balance).over(W.partitionBy("file").orderBy("line"))
    nation = F.regexp_extract("file", "nation=([0-9]+)", 1).cast("int")
    return got.select(F.col("c_custkey").cast("long").alias("c_custkey"), nation.alias("c_nationkey"), "line", F.round(balance - before + 1e-9, 2).alias("moved"))


# --- votes on categories


@query("""WITH v AS (SELECT user_id, CASE event_id % 5 WHEN 0 THEN 'link' WHEN 1 THEN 'routing' WHEN 2 THEN 'service' ELSE 'resource' END AS major_category,
  CASE event_id % 7 WHEN 0 THEN 'loss' WHEN 1 THEN 'delay' WHEN 2 THEN 'bgp_session_down' WHEN 3 THEN 'web_5xx' WHEN 4 THEN 'disk_space_low' ELSE 'cpu_pressure' END AS sub_category, value / 400 AS confidence FROM events),
l AS (SELECT *, (major_category, sub_category) IN (('link', 'loss'), ('link', 'delay'), ('routing', 'bgp_session_down'), ('service', 'web_5xx'), ('resource', 'disk_space_low'), ('resource', 'cpu_pressure')) AND confidence <= 1 AS legal FROM v),
c AS (SELECT user_id, major_category, sub_category, count(*) AS n FROM l WHERE legal GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, major_category, sub_category) AS r FROM c),
b AS (SELECT user_id, count(*) FILTER (NOT legal) AS illegal FROM l GROUP BY 1)
SELECT b.user_id AS user_id, major_category, sub_category, coalesce(n, 0) AS votes, illegal FROM b LEFT JOIN r ON b.user_id = r.user_id AND r = 1""")
def category_consensus(spark, sf_dir):
    """What most rounds of a classifier say, without votes outside the taxonomy."""
    at = lambda names, i: F.get(F.array(*map(F.lit, names)), (F.col("event_id") % i).cast("int"))
    votes = table(spark, sf_dir, "events").select(
        "user_id", at(["link", "routing", "service", "resource", "resource"], 5).alias("major_category"),
        at(["loss", "delay", "bgp_session_down", "web_5xx", "disk_space_low", "cpu_pressure", "cpu_pressure"], 7).alias("sub_category"), (F.col("value") / 400).alias("confidence"),
    )
    return classify.consensus(spark, votes, ["user_id"])


# --- level channel

LEVELS = f"""{CELLS}, qf AS (SELECT modality, feature, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM cells GROUP BY 1, 2),
zl AS (SELECT k, c.modality, minute, entity, avg(least(25, abs((value - q[2]) / CASE WHEN q[3] - q[1] < 1e-6 THEN greatest(abs(q[2]) * 0.01, 1) ELSE q[3] - q[1] END))) AS level FROM cells c JOIN qf ON c.modality = qf.modality AND c.feature = qf.feature GROUP BY 1, 2, 3, 4),
fl AS (SELECT k, modality AS family, minute, avg(level) AS score FROM (SELECT *, row_number() OVER (PARTITION BY k, modality, minute ORDER BY level DESC, entity) AS r FROM zl) AS x WHERE r <= 3 GROUP BY 1, 2, 3),
en0 AS (SELECT k, min(minute) AS a, max(minute) - min(minute) + 1 AS n FROM cells GROUP BY 1),
ws AS (SELECT DISTINCT k, a, n, s FROM (SELECT k, a, n, unnest(list_append(range(0, greatest(0, n - 120) + 1, 30), greatest(0, n - 120))) AS s FROM en0) AS x),
lv AS (SELECT fl.k, fl.minute, family, any_value(score) AS score, count(*) AS windows FROM fl JOIN ws ON ws.k = fl.k AND minute - a >= s AND minute - a < s + 120 GROUP BY 1, 2, 3)"""


def _fit_sql(name: str, source: str) -> str:
    return f"""{name}q AS (SELECT k, family, quantile_cont(ln(1 + score), [0.25, 0.5, 0.75]) AS q FROM {source} GROUP BY 1, 2),
{name} AS (SELECT h.k, h.family, any_value(q[2]) AS c, greatest(median(abs(ln(1 + score) - q[2])) * 1.4826, any_value(q[3] - q[1]) * 0.5, abs(any_value(q[2])) * 0.01, 0.15) AS s FROM {source} h JOIN {name}q q ON h.k = q.k AND h.family = q.family GROUP BY 1, 2)"""


@query(f"WITH {LEVELS} SELECT k AS case_id, minute, family, round(score + 1e-9, 6) AS score, windows FROM lv")
def level_scores(spark, sf_dir):
    got = level.level_scores(staged(case_cells(spark, sf_dir), "cells"), list(BY))
    return got.select(F.col("case").alias("case_id"), "minute", "family", r6("score").alias("score"), "windows")


@query(f"""WITH {LEVELS}, tl AS (SELECT k, min(minute) AS a, max(minute) AS b, least(60, greatest(3, (max(minute) - min(minute) + 1) // 4)) AS r FROM lv GROUP BY 1),
bd AS (SELECT lv.* FROM lv JOIN tl ON lv.k = tl.k WHERE b - a + 1 <= 2 * r OR minute < a + r OR minute > b - r), {_fit_sql("k1", "bd")},
sz AS (SELECT lv.k, minute, lv.family, score, round(greatest(0, (ln(1 + score) - c) / s), 9) AS z FROM lv JOIN k1 ON lv.k = k1.k AND lv.family = k1.family),
qt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, family ORDER BY z, minute) AS r, count(*) OVER (PARTITION BY k, family) AS n FROM sz) AS x WHERE r <= ceil(n * 0.6)), {_fit_sql("k2", "qt")},
z2 AS (SELECT lv.k, minute, list_sort(list(greatest(0, (ln(1 + score) - c) / s)), 'DESC') AS z FROM lv JOIN k2 ON lv.k = k2.k AND lv.family = k2.family GROUP BY 1, 2)
SELECT k AS case_id, minute, round(1 / (1 + exp(-((CASE WHEN len(z) > 1 THEN z[1] * 0.75 + z[2] * 0.25 ELSE z[1] END) - 4) / 1.5)) + 1e-9, 6) AS probability FROM z2""")
def level_probability(spark, sf_dir):
    """The probability of every case's minutes from the levels of its families."""
    got = level.level_probability(staged(case_cells(spark, sf_dir), "cells"), list(BY))
    return got.select(F.col("case").alias("case_id"), "minute", r6("probability").alias("probability"))
