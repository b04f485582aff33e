"""Registered queries of the detectors' timelines: every event of the events table stands for cells of a network.

An event's number picks a family of features, its user a node of the network, and its value gives
the features' values. The SQL states the same rows step by step, each step as named subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.operators import diagnose, evaluate, rank, robust
from faultsift.operators import events as event_ops
from faultsift.plans import dims
from faultsift.plans.base import EV, events, query, table

#: Seconds in a step of these timelines.
STEP = 3600
#: Family of features, their modality, and each feature's value in terms that Spark and DuckDB share.
FAMILIES = [
    ("node", [("node.cpu_usage", "value / 20"), ("node.memory_available_ratio", "1 / (1 + value / 50)"), ("node.disk_io_util", "value / 6"), ("node.filesystem_used_ratio", "value / 500")]),
    ("node", [("interface.rx_drop_rate", "value / 1000"), ("routing.bgp_peer_up", "least(1, greatest(0, 2 - value / 400))"), ("node.process_count", "value / 10")]),
    ("web", [("traffic.web.requests_rate", "value"), ("traffic.web.error_rate", "value * least(1, greatest(0.02, (value - 400) / 100))"), ("traffic.web.success_rate", "value * 0.98"), ("traffic.web.latency_p95_seconds", "value / 400")]),
    ("auth", [("traffic.auth.requests_rate", "value"), ("traffic.auth.timeout_rate", "value / 20"), ("traffic.auth.error_rate", "value / 90")]),
    ("netflow", [("netflow.flow_records.protocol_tcp", "value"), ("netflow.protocol_byte_share.protocol_tcp", "1 / (1 + value / 50)"), ("netflow.unique_destination_ports.protocol_tcp", "value * (event_id % 7) / 7")]),
    ("log", [("frr.bgp.err.count", "greatest(0, floor((value - 400) / 20))"), ("frr.ospf.warning.count", "value / 50")]),
]
_CITIES = "[" + ", ".join(f"'{c}'" for c in dims.CITIES) + "]"
_ROLES = "[" + ", ".join(f"'{r}'" for r in dims.ROLES) + "]"
NODES = [f"{c}-{r}" for c in dims.CITIES for r in dims.ROLES]
_NODES = "[" + ", ".join(f"'{n}'" for n in NODES) + "]"


def r6(c: str | Column) -> Column:
    """Six digits; inputs have few digits, so values often lie just between two, where both engines must go one way."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


def network_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(modality, minute, entity, feature, value) of the network."""
    e = events(spark, sf_dir).withColumn("u", F.col("user_id") % 80)
    at = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    e = e.withColumns({"minute": F.expr(f"sec div {STEP}"), "fam": F.col("event_id") % len(FAMILIES), "city": at(dims.CITIES, F.expr("u div 10")), "other": at(dims.CITIES, F.col("u") * 3 % 8)})
    node = F.concat_ws("-", "city", at(dims.ROLES, F.col("u") % 10))
    rows = []
    for i, (kind, features) in enumerate(FAMILIES):
        if kind in ("web", "auth"):
            entity, modality = F.concat(F.col("city"), F.lit("-traffic-vm>service-group:"), F.col("other"), F.lit(f":{kind}>traffic")), "edge"
        elif kind == "netflow":
            entity, modality = F.concat(F.col("city"), F.lit("-fw>interface:"), F.col("city"), F.lit("-fw:ens4>netflow")), "edge"
        else:
            entity, modality = node, kind
        each = [F.struct(F.lit(f).alias("feature"), F.expr(v).cast("double").alias("value")) for f, v in features]
        rows.append(F.when(F.col("fam") == i, F.struct(F.lit(modality).alias("modality"), entity.alias("entity"), F.array(*each).alias("cells"))))
    long = e.select("minute", F.coalesce(*rows).alias("r")).select("minute", "r.modality", "r.entity", F.inline("r.cells"))
    return long.groupBy("modality", "minute", "entity", "feature").agg(F.max("value").alias("value"))


def _family_sql(i: int, kind: str, feature: str, value: str) -> str:
    entity = {"web": "city || '-traffic-vm>service-group:' || other || ':web>traffic'", "auth": "city || '-traffic-vm>service-group:' || other || ':auth>traffic'",
              "netflow": "city || '-fw>interface:' || city || '-fw:ens4>netflow'"}.get(kind, "node")
    modality = kind if kind in ("node", "log") else "edge"
    return f"SELECT '{modality}' AS modality, minute, {entity} AS entity, '{feature}' AS feature, CAST({value} AS DOUBLE) AS value FROM base WHERE fam = {i}"


CELLS = f"""{EV}, base AS (SELECT event_id, value, sec // {STEP} AS minute, event_id % {len(FAMILIES)} AS fam, {_CITIES}[(user_id % 80) // 10 + 1] AS city,
  {_CITIES}[((user_id % 80) * 3) % 8 + 1] AS other, {_CITIES}[(user_id % 80) // 10 + 1] || '-' || {_ROLES}[user_id % 10 + 1] AS node FROM ev),
cells AS (SELECT modality, minute, entity, feature, max(value) AS value FROM ({" UNION ALL ".join(_family_sql(i, k, f, v) for i, (k, fs) in enumerate(FAMILIES) for f, v in fs)}) AS fams GROUP BY 1, 2, 3, 4)"""
_RULES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in dims.DIRECT_RULES)


def _near(cte: str, source: str, by: str, flag: str) -> str:
    """SQL of source with a and b: the flag one step after and before in the same series."""
    w = f"OVER (PARTITION BY {by} ORDER BY minute RANGE BETWEEN 1 {{}} AND 1 {{}})"
    return f"{cte} AS (SELECT *, max({flag}) {w.format('PRECEDING', 'PRECEDING')} AS b, max({flag}) {w.format('FOLLOWING', 'FOLLOWING')} AS a FROM {source})"


def _reference(name: str, source: str, by: str, floor: str) -> str:
    """SQL of median (center), scaled MAD or at least the floor (scale) and count (n) of value, by series."""
    on = " AND ".join(f"h.{c} = c.{c}" for c in by.split(", "))
    return f"""{name}c AS (SELECT {by}, median(value) AS center, count(*) AS n FROM {source} GROUP BY ALL),
{name} AS (SELECT {", ".join(f"h.{c}" for c in by.split(", "))}, any_value(center) AS center, any_value(n) AS n, greatest(median(abs(value - center)) * 1.4826, any_value({floor})) AS scale FROM {source} h JOIN {name}c c ON {on} GROUP BY {", ".join(f"h.{c}" for c in by.split(", "))})"""


_SIG = lambda x: f"1 / (1 + exp(-greatest(-20, least(20, ({x} - 3) / 0.9))))"
DIRECT = f"""{CELLS}, rule(feature, category, direction, floor, least, most, weight, immediate) AS (VALUES {_RULES}),
held AS (SELECT minute, entity, c.feature, value, category, direction, floor, CAST(least AS DOUBLE) AS least_v, CAST(most AS DOUBLE) AS most_v, weight, immediate
  FROM cells c JOIN rule ON c.feature = rule.feature WHERE modality = 'node'),
{_reference("rf", "held", "entity, feature", "floor")},
st AS (SELECT minute, h.entity, h.feature, category, immediate, CASE WHEN n >= 3 AND (least_v IS NULL OR value >= least_v) AND (most_v IS NULL OR value <= most_v)
  THEN least(CASE WHEN weight >= 1 THEN 16.0 ELSE 2.0 END, greatest(0.0, direction * (value - center) / scale) * weight) ELSE 0 END AS strength FROM held h JOIN rf ON h.entity = rf.entity AND h.feature = rf.feature
  UNION ALL SELECT minute, entity, feature, 'routing_fault', true, 5.0 FROM cells WHERE modality = 'log' AND regexp_matches(feature, 'err|crit|alert|warning') AND value > 0),
tops AS (SELECT minute, entity, max(strength) AS strongest, bool_or(immediate AND strength >= 3) AS imm FROM st GROUP BY 1, 2),
{_near("tn", "tops", "entity", "strongest")},
np AS (SELECT minute, entity, strongest, {_SIG("strongest")} * CASE WHEN imm OR (strongest >= 2.5 AND greatest(coalesce(a, 0), coalesce(b, 0)) >= 2.5) THEN 1 ELSE 0.55 END AS p FROM tn)"""
SYMPTOMS = f"""tr AS (SELECT *, string_split(feature, '.')[-1] AS k FROM cells WHERE feature LIKE 'traffic.%'),
wide AS (SELECT minute, entity, max(value) FILTER (k = 'requests_rate') AS q, max(value) FILTER (k = 'error_rate') AS e, max(value) FILTER (k = 'success_rate') AS s FROM tr GROUP BY 1, 2),
slow AS (SELECT minute, entity, feature, value, CASE k WHEN 'loss_rate' THEN 0.03 ELSE 0.25 END AS floor, CASE k WHEN 'loss_rate' THEN 0.05 ELSE 0.5 END AS low FROM tr WHERE k IN ('latency_p95_seconds', 'loss_rate')),
{_reference("sr", "slow", "entity, feature", "floor")},
sy AS (SELECT minute, entity, max(x) AS symptom FROM (
  SELECT minute, entity, greatest(CASE WHEN e IS NOT NULL THEN least(16.0, greatest(0, least(e, q)) * 15 / (q + 30)) END, CASE WHEN s IS NOT NULL THEN least(16.0, greatest(0, least(q - s, q)) * 15 / (q + 30)) END) AS x FROM wide WHERE q > 0
  UNION ALL SELECT minute, h.entity, CASE WHEN value >= low THEN greatest(0, least(16.0, (value - center) / scale)) ELSE 0 END FROM slow h JOIN sr ON h.entity = sr.entity AND h.feature = sr.feature WHERE n >= 3) AS u WHERE x IS NOT NULL GROUP BY 1, 2),
sm AS (SELECT minute, max(symptom) AS x FROM sy GROUP BY 1), sp AS (SELECT minute, {_SIG("x")} * CASE WHEN x >= 2.5 AND EXISTS (SELECT 1 FROM sm o WHERE o.x >= 2.5 AND abs(o.minute - sm.minute) = 1) THEN 0.9 ELSE 0.4 END AS p FROM sm)"""
FLOWS = f"""fl AS (SELECT minute, entity, string_split(feature, '.')[2] AS name, string_split(feature, '.')[-1] AS protocol, value FROM cells WHERE feature LIKE 'netflow.%'),
comp AS (SELECT f.minute, f.entity, f.name, f.protocol, CASE f.name WHEN 'protocol_byte_share' THEN f.value ELSE greatest(0, least(1, f.value / greatest(d.value, 1))) END AS value, 0.05 AS floor
  FROM fl f JOIN fl d ON f.minute = d.minute AND f.entity = d.entity AND f.protocol = d.protocol AND d.name = 'flow_records' AND d.value >= 30 WHERE f.name IN ('protocol_byte_share', 'unique_destination_ports', 'unique_destinations')),
{_reference("cr", "comp", "entity, name, protocol", "floor")},
cz AS (SELECT minute, h.entity, h.name, h.protocol, greatest(0, least(4, (abs((value - center) / scale) - 2.5) / 2)) AS raw FROM comp h JOIN cr ON h.entity = cr.entity AND h.name = cr.name AND h.protocol = cr.protocol WHERE n >= 20),
{_near("cn", "cz", "entity, name, protocol", "raw")},
ns AS (SELECT minute, entity, max(CASE WHEN raw > 0 AND greatest(coalesce(a, 0), coalesce(b, 0)) > 0 THEN raw ELSE 0 END) AS support FROM cn GROUP BY 1, 2)"""
LINES = f"""{DIRECT}, {SYMPTOMS}, {FLOWS},
lsc AS (SELECT minute, entity, max(least(8.0, ln(1 + greatest(value, 0)) * CASE WHEN string_split(feature, '.')[-2] IN ('err', 'crit', 'alert', 'emerg') THEN 4 WHEN string_split(feature, '.')[-2] = 'warning' THEN 2 ELSE 0 END)) AS score
  FROM cells WHERE modality = 'log' GROUP BY 1, 2),
nsc AS (SELECT minute, entity, strongest AS score FROM np),
esc AS (SELECT minute, entity, max(score) AS score FROM (SELECT minute, entity, symptom AS score FROM sy UNION ALL SELECT minute, entity, support FROM ns) AS u GROUP BY 1, 2),
nm AS (SELECT minute, max(p) AS p FROM np GROUP BY 1),
ml AS (SELECT coalesce(nm.minute, sp.minute) AS minute, coalesce(nm.p, 0) AS node, coalesce(sp.p, 0) AS service, greatest(coalesce(nm.p, 0), coalesce(sp.p, 0)) AS probability FROM nm FULL JOIN sp ON nm.minute = sp.minute)"""


def lines(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return diagnose.timelines(network_cells(spark, sf_dir), dims.direct_rules(spark))


@query(f"WITH {DIRECT} SELECT minute, entity, feature, category, round(strength + 1e-9, 6) AS strength FROM st")
def direct_and_log_strength(spark, sf_dir):
    return lines(spark, sf_dir)["direct"].select("minute", "entity", "feature", "category", r6("strength").alias("strength"))


@query(f"WITH {LINES} SELECT minute, round(node + 1e-9, 6) AS node, round(service + 1e-9, 6) AS service, round(probability + 1e-9, 6) AS probability FROM ml")
def minute_probability(spark, sf_dir):
    return lines(spark, sf_dir)["minutes"].select("minute", *(r6(c).alias(c) for c in ("node", "service", "probability")))


@query(f"WITH {CELLS}, {FLOWS} SELECT minute, entity, round(support + 1e-9, 6) AS support FROM ns")
def netflow_support(spark, sf_dir):
    return diagnose.netflow_support(network_cells(spark, sf_dir)).withColumn("support", r6("support"))


@query(f"WITH {LINES} SELECT minute, entity, round(score + 1e-9, 6) AS score FROM esc")
def edge_scores(spark, sf_dir):
    return lines(spark, sf_dir)["edge"].withColumn("score", r6("score"))


# --- calibration

FAMILY3 = f"""{EV}, f3 AS (SELECT day, CASE event_type WHEN 'error' THEN 'node' WHEN 'view' THEN 'edge' ELSE 'log' END AS family, max(value) AS v FROM ev WHERE event_id % 3 <> 0 GROUP BY 1, 2)"""


def _fit_sql(name: str, source: str) -> str:
    return f"""{name}q AS (SELECT family, quantile_cont(ln(1 + v), [0.25, 0.5, 0.75]) AS q FROM {source} GROUP BY 1),
{name} AS (SELECT h.family, any_value(q[2]) AS c, greatest(median(abs(ln(1 + v) - q[2])) * 1.4826, any_value(q[3] - q[1]) * 0.5, abs(any_value(q[2])) * 0.01, 0.15) AS s FROM {source} h JOIN {name}q q ON h.family = q.family GROUP BY 1)"""


CALIBRATED = f"""{FAMILY3}, tl AS (SELECT min(day) AS a, max(day) AS b, least(60, greatest(3, (max(day) - min(day) + 1) // 4)) AS r FROM f3),
bd AS (SELECT f3.* FROM f3, tl WHERE b - a + 1 <= 2 * r OR day < a + r OR day > b - r), {_fit_sql("k1", "bd")},
sz AS (SELECT day, f3.family, v, greatest(0, (ln(1 + v) - c) / s) AS z FROM f3 JOIN k1 ON f3.family = k1.family),
qt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY z, day) AS r, count(*) OVER (PARTITION BY family) AS n FROM sz) AS x WHERE r <= ceil(n * 0.6)), {_fit_sql("k2", "qt")},
cz2 AS (SELECT day, list_sort(list(greatest(0, (ln(1 + v) - c) / s)), 'DESC') AS z FROM f3 JOIN k2 ON f3.family = k2.family GROUP BY 1)"""


def family_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_id % 3 <> 0")
    family = F.when(F.col("event_type") == "error", "node").when(F.col("event_type") == "view", "edge").otherwise("log")
    return e.groupBy("day", family.alias("family")).agg(F.max("value").alias("v"))


@query(f"WITH {CALIBRATED} SELECT family, round(c + 1e-9, 6) AS center, round(s + 1e-9, 6) AS scale FROM k2")
def timeline_calibration(spark, sf_dir):
    got = robust.timeline_calibration(family_scores(spark, sf_dir), ["family"], "day", "v")
    return got.select("family", r6("center").alias("center"), r6("scale").alias("scale"))


@query(f"""WITH {CALIBRATED} SELECT day, round(1 / (1 + exp(-((CASE WHEN len(z) > 1 THEN z[1] * 0.75 + z[2] * 0.25 ELSE z[1] END) - 4) / 1.5)) + 1e-9, 6) AS probability FROM cz2""")
def calibrated_probability(spark, sf_dir):
    f = family_scores(spark, sf_dir)
    fitted = robust.timeline_calibration(f, ["family"], "day", "v")
    return robust.calibrated_probability(f, fitted, ["family"], "day", "v").withColumn("probability", r6("probability"))


# --- graph fusion

_TOPOLOGY = ", ".join(f"('{c}-{a}', '{c}-{b}')" for c in dims.CITIES for a, b, _ in dims.RELATIONS)
FUSION = f"""{EV}, po AS (SELECT event_id, day // 5 AS event, {_CITIES}[(user_id % 80) // 10 + 1] || '-' || {_ROLES}[user_id % 10 + 1] AS node,
  CASE event_id % 5 WHEN 0 THEN {_CITIES}[(user_id % 80) // 10 + 1] || '-fw' END AS rel, ['node', 'interface', 'traffic', 'netflow', 'scrape', 'frr'][event_id % 6 + 1] AS source,
  ['cpu', 'drop', 'bytes'][event_id % 3 + 1] AS metric, hour AS minute, least(25.0, value / 10) AS score FROM ev WHERE user_id % 3 <> 0),
fe AS (SELECT DISTINCT event, event * 120 AS s, event * 120 + 120 AS e FROM po),
tw AS (SELECT *, CASE WHEN source = 'interface' AND metric = 'drop' THEN 0.9 ELSE CASE source WHEN 'node' THEN 1.0 WHEN 'frr' THEN 1.0 WHEN 'interface' THEN 0.82 WHEN 'netflow' THEN 0.48 WHEN 'traffic' THEN 0.35 WHEN 'scrape' THEN 0.18 ELSE 0.3 END END AS w FROM po),
sv AS (SELECT event, node, least(1.0, 0.8 * max(score) / 25 + 0.2 * CASE WHEN count(*) > 1 THEN (sum(score) - max(score)) / 25 / (count(*) - 1) ELSE 0 END) AS severity
  FROM (SELECT *, row_number() OVER (PARTITION BY event, node ORDER BY score DESC) AS r FROM po) AS x WHERE r <= 3 GROUP BY 1, 2),
rv AS (SELECT event, rel AS node, least(1.0, 0.8 * least(1.0, 0.8 * max(score) / 25 + 0.2 * CASE WHEN count(*) > 1 THEN (sum(score) - max(score)) / 25 / (count(*) - 1) ELSE 0 END)) AS relational
  FROM (SELECT *, row_number() OVER (PARTITION BY event, rel ORDER BY score DESC) AS r FROM po WHERE rel IS NOT NULL AND rel <> node) AS x WHERE r <= 3 GROUP BY 1, 2),
ow AS (SELECT t.event, node, least(1.0, count(DISTINCT minute) / any_value(e - s)) AS persistence, greatest(0, 1 - greatest(0, min(minute) - any_value(s)) / any_value(e - s)) AS precedence,
  least(1.0, count(DISTINCT source) / 3) AS diversity, CASE WHEN sum(score) <> 0 THEN sum(w * score) / sum(score) ELSE 0 END AS directness FROM tw t JOIN fe ON t.event = fe.event GROUP BY 1, 2),
lk(x, y) AS (VALUES {_TOPOLOGY}), un AS (SELECT x, y FROM lk UNION SELECT y, x FROM lk),
wa(a, b, hops) AS (SELECT DISTINCT x, x, 0 FROM un UNION SELECT a, un.y, hops + 1 FROM wa JOIN un ON wa.b = un.x WHERE hops < 6), hp AS (SELECT a, b, min(hops) AS hops FROM wa GROUP BY 1, 2),
tp AS (SELECT event, a AS node, severity / (1 + hops) AS part, row_number() OVER (PARTITION BY event, a ORDER BY severity / (1 + hops) DESC, b) AS r FROM sv JOIN hp ON sv.node = hp.b WHERE a <> b),
ts2 AS (SELECT event, node, least(1.0, sum(part) FILTER (r <= 5) / least(3, count(*))) AS topology FROM tp GROUP BY 1, 2),
fp AS (SELECT w.event, w.node, coalesce(severity, 0) AS severity, coalesce(persistence, 0) AS persistence, coalesce(precedence, 0) AS precedence, coalesce(diversity, 0) AS diversity, coalesce(directness, 0) AS directness,
  coalesce(relational, 0) AS relational, coalesce(topology, 0) AS topology, CASE WHEN severity IS NULL AND relational IS NOT NULL THEN 0.8 WHEN severity IS NOT NULL AND directness < 0.5 THEN 0.35 ELSE 0 END::DOUBLE AS penalty
  FROM (SELECT event, unnest({_NODES}) AS node FROM fe) AS w LEFT JOIN sv ON w.event = sv.event AND w.node = sv.node LEFT JOIN ow ON w.event = ow.event AND w.node = ow.node LEFT JOIN rv ON w.event = rv.event AND w.node = rv.node LEFT JOIN ts2 ON w.event = ts2.event AND w.node = ts2.node),
fs AS (SELECT *, greatest(0, severity * 0.28 + persistence * 0.15 + precedence * 0.16 + diversity * 0.14 + directness * 0.16 + relational * 0.07 + topology * 0.08 + penalty * -0.04) AS score FROM fp)"""


def fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every node in events of five days."""
    e = events(spark, sf_dir).where("user_id % 3 <> 0").withColumn("u", F.col("user_id") % 80)
    at = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    city = at(dims.CITIES, F.expr("u div 10"))
    related = F.when(F.col("event_id") % 5 == 0, F.array(F.concat(city, F.lit("-fw")))).otherwise(F.array().cast("array<string>"))
    points = e.select(
        F.expr("day div 5").alias("event"), F.concat_ws("-", city, at(dims.ROLES, F.col("u") % 10)).alias("node"), related.alias("related"),
        at(["node", "interface", "traffic", "netflow", "scrape", "frr"], F.col("event_id") % 6).alias("source"), at(["cpu", "drop", "bytes"], F.col("event_id") % 3).alias("metric"),
        F.col("hour").alias("minute"), F.least(F.lit(25.0), F.col("value") / 10).alias("score"),
    )
    found = points.select("event").distinct().select("event", (F.col("event") * 120).alias("start"), (F.col("event") * 120 + 120).alias("end"))
    return rank.fusion_parts(found, points, rank.distances(dims.topology(spark), 6), NODES)


_PARTS = list(rank.FUSION_WEIGHTS)


@query(f"WITH RECURSIVE {FUSION} SELECT event, node, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in _PARTS)} FROM fp")
def fusion_parts(spark, sf_dir):
    return fusion(spark, sf_dir).select("event", "node", *(r6(c).alias(c) for c in _PARTS))


@query(f"""WITH RECURSIVE {FUSION}, r AS (SELECT event, node, score, row_number() OVER (PARTITION BY event ORDER BY round(score, 9) DESC, round(directness, 9) DESC, round(precedence, 9) DESC, node) AS rank FROM fs)
SELECT event, node, round(score + 1e-9, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def graph_fusion(spark, sf_dir):
    parts = fusion(spark, sf_dir).select("event", "node", *(F.round(c, 9).alias(c) for c in _PARTS))
    return rank.fused(parts, ["event"]).select("event", "node", r6("score").alias("score"), "rank")


# --- floors, truths, prototypes

_FLOOR_METRICS = ["node.cpu_usage", "node.swap_used_ratio", "traffic.web.error_ratio", "netflow.protocol_byte_share", "interface.rx_bytes_rate", "other"]


@query("SELECT event_id, [1.0, 0.01, 0.02, 0.05, 1024.0, 0.01][event_id % 6 + 1]::DOUBLE AS absolute, [0.02, 0.0, 0.0, 0.0, 0.02, 0.02][event_id % 6 + 1]::DOUBLE AS relative FROM events")
def metric_floors(spark, sf_dir):
    m = F.get(F.array(*map(F.lit, _FLOOR_METRICS)), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", event_ops.scale_floor(m).alias("absolute"), event_ops.relative_floor(m).alias("relative"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'ground_truth_id' END, CASE WHEN o_orderkey % 5 = 0 THEN 'interval' END, CASE WHEN o_orderkey % 3 = 1 THEN 'root_cause' END,
  CASE WHEN o_orderkey % 7 <= 1 THEN 'fault_category' END) AS errors FROM orders""")
def truth_validity(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(
        "o_orderkey", F.when(k % 11 == 0, "").otherwise(k.cast("string")).alias("ground_truth_id"), F.lit("2026-01-01T00:00:00Z").alias("start_time"),
        F.when(k % 5 == 0, "2025-12-31T23:59:00Z").otherwise("2026-01-01T00:10:00+00:00").alias("end_time"),
        F.struct(F.when(k % 3 == 1, "xian-printer").otherwise("xian-fw").alias("network_element_id")).alias("root_cause"),
        F.struct(F.when(k % 7 == 0, "weather").otherwise("link").alias("major_category"), F.when(k % 7 == 1, "dns_down").otherwise("delay").alias("sub_category")).alias("fault_category"),
    )
    return evaluate.truth_flags(rows).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark, sf_dir):
    return evaluate.repeated(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT c_custkey AS case_id, n FROM n WHERE n <> 1")
def cases_without_one_event(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return evaluate.not_single(orders.select(F.col("o_custkey").alias("case_id")), "case_id", customers.select(F.col("c_custkey").alias("case_id")))
