"""The registered queries: each operator over the given tables, and DuckDB SQL for the same rows.

The tables stand in for telemetry: events are observations (a user's number names a node), lineitem
holds flows and wide measures, orders, customer, supplier and nation hold entities and their links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.functions import repair
from faultsift.functions import scalars as S
from faultsift.operators import cells, classify, detect, evaluate, quantiles, rank, robust, segment, windows
from faultsift.operators import events as event_ops
from faultsift.plans import cases, diagnosis, dims
from faultsift.plans import prototypes as P
from faultsift.plans.base import EV, ORACLE, QUERIES, events, query, r6, table
from faultsift.sources import telemetry

__all__ = ["ORACLE", "QUERIES", "cases", "diagnosis"]

# --- cells and sources


@query(f"""WITH {EV} SELECT sec // 60 AS minute, user_id, event_type, round(sum(value), 6) AS "sum", count(value) AS n, min(value) AS "min",
  max(value) AS "max", round(avg(value), 6) AS mean, arg_max(value, event_id) AS last FROM ev GROUP BY 1, 2, 3""")
def cell_minute_agg(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("minute", F.expr("sec div 60"))
    got = cells.aggregate(e, ["minute", "user_id", "event_type"], "value", F.col("event_id"))
    return got.select("minute", "user_id", "event_type", r6("sum").alias("sum"), F.col("count").alias("n"), "min", "max", r6("mean").alias("mean"), "last")


@query(f"""WITH {EV}, c AS (SELECT hour, user_id, event_type, sum(value) AS s, min(value) AS a, max(value) AS b FROM ev GROUP BY 1, 2, 3)
SELECT hour AS minute, 'n' || user_id AS entity, event_type AS feature,
  round(CASE event_type WHEN 'signup' THEN a WHEN 'error' THEN s ELSE b END, 6) AS value FROM c""")
def cell_policy_value(spark, sf_dir):
    e = events(spark, sf_dir)
    policy = F.when(F.col("event_type") == "signup", S.aggregation(F.lit("low"), F.lit("x"))).when(
        F.col("event_type") == "error", S.aggregation(F.lit("high"), F.lit("error_rate"))
    ).otherwise(S.aggregation(F.lit("high"), F.lit("x")))
    rows = e.select(
        F.lit("node").alias("modality"), F.col("hour").alias("minute"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("entity"),
        F.col("event_type").alias("feature"), "value", policy.alias("aggregation"), F.col("event_id").alias("arrival"),
    )
    return cells.cells(rows).select("minute", "entity", "feature", r6("value").alias("value"))


@query(f"""WITH {EV} SELECT event_type AS modality, count(DISTINCT (hour, user_id, sign(value))) AS cells, count(DISTINCT user_id) AS entities,
  count(DISTINCT sign(value)) AS features, min(hour) AS first_minute, max(hour) AS last_minute FROM ev GROUP BY 1""")
def cell_summary(spark, sf_dir):
    e = events(spark, sf_dir).select(
        F.col("event_type").alias("modality"), F.col("hour").alias("minute"), F.col("user_id").alias("entity"), F.signum("value").alias("feature")
    )
    return cells.summary(e.distinct())


FLOW = """SELECT l_shipdate, l_suppkey, l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS packets, round(sum(l_extendedprice), 2) AS bytes,
  round(sum(l_linenumber), 6) AS flow_records, count(DISTINCT l_partkey) AS unique_sources, count(DISTINCT l_orderkey) AS unique_destinations
  FROM lineitem GROUP BY 1, 2, 3, 4"""


@query(f"""WITH g AS ({FLOW}) SELECT *, round(CASE WHEN sum(bytes) OVER w > 0 THEN bytes / sum(bytes) OVER w ELSE 0 END, 6) AS protocol_byte_share
FROM g WINDOW w AS (PARTITION BY l_shipdate, l_suppkey, l_returnflag)""")
def flow_groups(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns({"p": F.col("l_partkey").cast("string"), "o": F.col("l_orderkey").cast("string")})
    li = li.withColumn("l_linenumber", F.col("l_linenumber").cast("double"))
    share = ["l_shipdate", "l_suppkey", "l_returnflag"]
    got = telemetry.flow_groups(
        li, [*share, "l_linestatus"], "l_quantity", "l_extendedprice", "l_linenumber", {"unique_sources": "p", "unique_destinations": "o"}, share
    )
    return got.select(
        *share, "l_linestatus", r6("packets").alias("packets"), F.round("bytes", 2).alias("bytes"), r6("flow_records").alias("flow_records"),
        "unique_sources", "unique_destinations", r6("protocol_byte_share").alias("protocol_byte_share"),
    )


@query("""SELECT l_orderkey, l_linenumber, 'node.quantity' AS metric, l_quantity AS value FROM lineitem UNION ALL
SELECT l_orderkey, l_linenumber, 'node.discount', l_discount FROM lineitem UNION ALL
SELECT l_orderkey, l_linenumber, 'node.tax', l_tax FROM lineitem""")
def wide_unpivot(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text = li.select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit("fw").alias("node"), F.lit("/data/xian/processed/x.csv").alias("file"),
        F.col("l_quantity").cast("string").alias("quantity"), F.col("l_discount").cast("string").alias("discount"), F.col("l_tax").cast("string").alias("tax"),
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("target_id"), F.lit(0).alias("row"),
    )
    got = telemetry.dense(text.withColumn("file", F.concat("file", F.lit("#"), "target_id")), "node")
    at = F.split(F.split("file", "#")[1], ":")
    return got.select(at[0].cast("long").alias("l_orderkey"), at[1].cast("int").alias("l_linenumber"), "metric", "value")


@query("""WITH w AS (SELECT *, lag(value) OVER s AS v, lag(ts) OVER s AS t FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, value < v AS reset, round(CASE WHEN value < v THEN value ELSE value - v END, 6) AS delta,
  round((CASE WHEN value < v THEN value ELSE value - v END) / ((epoch_us(ts) - epoch_us(t)) / 6e7), 6) AS rate
FROM w WHERE epoch_us(ts) > epoch_us(t)""")
def counter_rate_reset(spark, sf_dir):
    got = telemetry.counter_rates(table(spark, sf_dir, "events"), ["user_id"], "ts", ["ts", "event_id"], "value")
    return got.where("rate is not null").select("event_id", "user_id", "reset", r6("delta").alias("delta"), r6("rate").alias("rate"))


@query(f"""WITH {EV}, h AS (SELECT hour, count(*) FILTER (event_type = 'view') AS req, count(*) FILTER (event_type = 'click') AS ok FROM ev GROUP BY 1)
SELECT hour, round(least(1.0, greatest(0.0, ok / req)), 6) AS success_ratio FROM h WHERE req > 0""")
def success_ratio(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("hour").agg(
        F.count_if(F.col("event_type") == "view").alias("req"), F.count_if(F.col("event_type") == "click").alias("ok")
    )
    return h.where("req > 0").select("hour", r6(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("ok") / F.col("req")))).alias("success_ratio"))


_FAMILY = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(x, '{t}')" for t in ts) + f" THEN '{f}'"
    for f, ts in [
        ("bgp", ["bgp"]), ("ospf", ["ospf"]), ("route", ["route", "rib", "nexthop", "zebra"]), ("interface", ["interface", "link", "carrier"]),
        ("config", ["config", "command", "reload"]), ("process", ["process", "signal", "crash", "exit"]),
    ]
) + " ELSE 'other' END"


@query(f"""WITH t AS (SELECT role, lower(concat_ws(' ', role, text)) AS x FROM conversations)
SELECT role, {_FAMILY} AS family, count(*) AS lines FROM t GROUP BY 1, 2""")
def log_family_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role", S.event_family(F.col("role"), F.col("text")).alias("family")).agg(F.count("*").alias("lines"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"([^"]*)"', 1) AS k,
  regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"([^"]*)"', 2) AS v FROM pages)
SELECT page_id, len(list_distinct(k)) AS n, v[len(k) - list_position(list_reverse(k), 'href') + 1] AS href FROM p WHERE len(k) > 0""")
def label_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", S.label_dimensions(F.col("html")).alias("d"))
    return p.select("page_id", F.size("d").cast("long").alias("n"), F.col("d")["href"].alias("href"))


@query(r"""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_type)), '[^a-z0-9_\-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS slug,
  CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS number FROM part""")
def slug_and_number(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("e0 "))).when(F.col("p_size") % 3 == 1, "NaN").otherwise("1d")
    return p.select("p_partkey", S.token(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"), S.number(raw).alias("number"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS utc,
  epoch_us(ts) // 60000000 AS minute, event_id % 2 = 0 AS strict FROM events""")
def time_texts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    utc = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = F.when(F.col("event_id") % 2 == 0, utc).otherwise(F.regexp_replace(utc, "Z$", ""))
    minute = F.expr("timestampdiff(MINUTE, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select("event_id", utc.alias("utc"), minute.alias("minute"), S.parse_utc(text).isNotNull().alias("strict"))


@query("""WITH f AS (SELECT DISTINCT source, doc_id % 50 AS base, doc_id % 7 = 0 AS done FROM documents),
g AS (SELECT source, base, bool_or(done) AS has FROM f GROUP BY 1, 2)
SELECT 'data/' || f.source || '_' || f.base || '/' || CASE WHEN f.done THEN 'processed' ELSE 'x_data' END || '/node_metrics.csv' AS path, 'node' AS source
FROM f JOIN g ON f.source = g.source AND f.base = g.base WHERE f.done OR NOT has""")
def source_precedence(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 7 == 0, "processed").otherwise("x_data")
    path = F.concat(F.lit("data/"), "source", F.lit("_"), (F.col("doc_id") % 50).cast("string"), F.lit("/"), folder, F.lit("/node_metrics.csv"))
    return telemetry.prefer_processed(d.select(path.alias("path")).distinct())


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '{"k": ' || json_extract_string(props, '$.k') || '}' END AS found FROM events""")
def json_repaired(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.lit("no value { here")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Answer: [{} ] "), "props")).otherwise(
        F.concat(F.lit("["), F.regexp_replace("props", r"\}$", ""))
    )
    return e.select("event_id", repair.json_with(text, "k").alias("found"))


# --- robust statistics


@query(f"WITH {EV} SELECT user_id, hour, median(value) AS value, count(*) AS n FROM ev GROUP BY 1, 2")
def consolidated_median(spark, sf_dir):
    return cells.consolidate(events(spark, sf_dir), ["user_id", "hour"], "value")


@query("""WITH c AS (SELECT user_id, event_type, median(value) AS center, count(value) AS n FROM events GROUP BY 1, 2)
SELECT e.user_id, e.event_type, center, round(greatest(median(abs(value - center)) * 1.4826, 4.0), 6) AS scale, n
FROM events e JOIN c ON e.user_id = c.user_id AND e.event_type = c.event_type GROUP BY 1, 2, 3, 5""")
def robust_reference(spark, sf_dir):
    got = robust.reference(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", 4.0)
    return got.withColumn("scale", r6("scale"))


@query("""WITH q AS (SELECT l_suppkey, quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q FROM lineitem GROUP BY 1)
SELECT l_suppkey, q[2] AS center, CASE WHEN q[3] - q[1] < 1e-6 THEN greatest(abs(q[2]) * 0.01, 1.0) ELSE q[3] - q[1] END AS scale FROM q""")
def quartile_scaler(spark, sf_dir):
    return robust.quartile_scaler(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


@query("""WITH x AS (SELECT event_type, ln(1 + value) AS x FROM events), q AS (SELECT event_type, quantile_cont(x, [0.25, 0.5, 0.75]) AS q FROM x GROUP BY 1)
SELECT x.event_type, round(q[2], 6) AS center, round(greatest(median(abs(x - q[2])) * 1.4826, (q[3] - q[1]) * 0.5, abs(q[2]) * 0.01, 0.15), 6) AS scale
FROM x JOIN q ON x.event_type = q.event_type GROUP BY x.event_type, q""")
def calibration(spark, sf_dir):
    got = robust.calibration(table(spark, sf_dir, "events"), ["event_type"], "value")
    return got.select("event_type", r6("center").alias("center"), r6("scale").alias("scale"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, max(value) AS top, median(value) AS center FROM r WHERE r <= ceil(n * 0.6) GROUP BY 1""")
def quiet_reference(spark, sf_dir):
    q = robust.quiet(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id")
    return q.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.percentile("value", 0.5).alias("center"))


@query("""SELECT l_returnflag, count(l_extendedprice) AS n, [round(x, 4) FOR x IN quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.9, 1.0])] AS q FROM lineitem GROUP BY 1""")
def split_quantiles(spark, sf_dir):
    """Exact quantiles of three groups that hold all rows, found range by range."""
    got = quantiles.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.01, 0.25, 0.5, 0.9, 1.0], least=200)
    return got.select("l_returnflag", "n", F.transform("q", lambda x: F.round(x, 4)).alias("q"))


@query("""WITH h AS (SELECT *, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS past,
  count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT *, coalesce(len(past), 0) AS history, list_median(past) AS center FROM h),
s AS (SELECT *, greatest(list_median(list_transform(past, lambda x: abs(x - center))) * 1.4826, 0.01, greatest(1.0, abs(center)) * 0.02) AS scale FROM c)
SELECT event_id, history, center, round(CASE WHEN history >= CASE WHEN n >= 60 THEN 15 ELSE 4 END THEN least(25.0, abs(value - center) / scale) END, 6) AS score FROM s""")
def rolling_robust_score(spark, sf_dir):
    got = robust.rolling_score(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return got.select("event_id", F.col("history").cast("long").alias("history"), "center", r6("score").alias("score"))


@query(f"""WITH {EV}, m AS (SELECT hour, event_type, max(ln(1 + value)) AS z, count(*) AS n, sum(ln(1 + value)) AS s FROM ev GROUP BY 1, 2),
r AS (SELECT hour, z, row_number() OVER (PARTITION BY hour ORDER BY z DESC, event_type) AS r FROM m),
g AS (SELECT hour, max(z) FILTER (r = 1) AS a, max(z) FILTER (r = 2) AS b FROM r GROUP BY 1)
SELECT hour, round(1 / (1 + exp(-((CASE WHEN b IS NULL THEN a ELSE a * 0.75 + b * 0.25 END) - 4) / 1.5)), 6) AS p FROM g""")
def combined_probability(spark, sf_dir):
    m = events(spark, sf_dir).groupBy("hour", "event_type").agg(F.max(F.log1p("value")).alias("z"))
    two = rank.top(m, ["hour"], "z", ["event_type"], 2).groupBy("hour").agg(
        F.max(F.when(F.col("rank") == 1, F.col("z"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("z"))).alias("b")
    )
    return two.select("hour", r6(robust.combined_probability(F.col("a"), F.col("b"))).alias("p"))


# --- detection

FEATURE = {"error": "node.cpu_usage", "purchase": "node.disk_io_util", "click": "node.process_count", "view": "node.load1", "signup": "interface.rx_drop_rate"}
_CASE_FEATURE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEATURE.items()) + " END"
_RULES = ", ".join(
    "(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in dims.DIRECT_RULES
)


def node_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cells (minute, entity, feature, value) of eighty nodes."""
    e = events(spark, sf_dir)
    feature = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in FEATURE.items()))
    return e.groupBy(F.col("day").alias("minute"), (F.col("user_id") % 80).alias("entity"), feature.alias("feature")).agg(F.max("value").alias("value"))


NODE_CELLS = f"""{EV}, cell AS (SELECT day AS minute, user_id % 80 AS entity, {_CASE_FEATURE} AS feature, max(value) AS value FROM ev GROUP BY 1, 2, 3)"""
STRENGTH = f"""{NODE_CELLS},
rule(feature, category, direction, floor, least, most, weight, immediate) AS (VALUES {_RULES}),
held AS (SELECT cell.*, category, direction, floor, CAST(least AS DOUBLE) AS least_v, CAST(most AS DOUBLE) AS most_v, weight, immediate FROM cell JOIN rule ON cell.feature = rule.feature),
c AS (SELECT entity, feature, median(value) AS center, count(*) AS n FROM held GROUP BY 1, 2),
m AS (SELECT h.entity, h.feature, any_value(center) AS center, any_value(n) AS n, greatest(median(abs(value - center)) * 1.4826, any_value(floor)) AS scale
  FROM held h JOIN c ON h.entity = c.entity AND h.feature = c.feature GROUP BY 1, 2),
st AS (SELECT minute, h.entity, h.feature, category, immediate, CASE WHEN n >= 3 AND (least_v IS NULL OR value >= least_v) AND (most_v IS NULL OR value <= most_v)
  THEN least(CASE WHEN weight >= 1 THEN 16.0 ELSE 2.0 END, greatest(0.0, direction * (value - center) / scale) * weight) ELSE 0 END AS strength
  FROM held h JOIN m ON h.entity = m.entity AND h.feature = m.feature),
top AS (SELECT minute, entity, max(strength) AS strongest, bool_or(immediate AND strength >= 3) AS imm FROM st GROUP BY 1, 2),
near AS (SELECT *, max(strongest) OVER (PARTITION BY entity ORDER BY minute RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS b,
  max(strongest) OVER (PARTITION BY entity ORDER BY minute RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS a FROM top),
prob AS (SELECT minute, entity, strongest, strongest >= 2.5 AND greatest(coalesce(a, 0), coalesce(b, 0)) >= 2.5 AS sustained, imm,
  1 / (1 + exp(-greatest(-20, least(20, (strongest - 3) / 0.9)))) AS p FROM near)"""


@query(f"WITH {STRENGTH} SELECT minute, entity, feature, category, round(strength, 6) AS strength FROM st")
def direct_strength(spark, sf_dir):
    got = detect.strengths(node_cells(spark, sf_dir), dims.direct_rules(spark))
    return got.select("minute", "entity", "feature", "category", r6("strength").alias("strength"))


@query(f"""WITH {STRENGTH} SELECT minute, entity, round(strongest, 6) AS strongest, sustained,
  round(CASE WHEN sustained OR imm THEN p ELSE p * 0.55 END, 6) AS probability FROM prob""")
def direct_probability(spark, sf_dir):
    got = detect.node_probability(detect.strengths(node_cells(spark, sf_dir), dims.direct_rules(spark)))
    return got.select("minute", "entity", r6("strongest").alias("strongest"), "sustained", r6("probability").alias("probability"))


@query(f"""WITH {STRENGTH}, w AS (SELECT minute, entity, max(strength) FILTER (category = 'cpu_pressure') AS cpu, max(strength) FILTER (category = 'disk_io_pressure') AS disk,
  max(strength) FILTER (category = 'link_fault') AS link FROM st GROUP BY 1, 2)
SELECT minute, entity, CASE WHEN disk >= 5 THEN 'disk_io_pressure' WHEN greatest(coalesce(cpu, 0), coalesce(disk, 0), coalesce(link, 0)) < 3 THEN NULL
  WHEN coalesce(cpu, 0) >= greatest(coalesce(disk, 0), coalesce(link, 0)) THEN 'cpu_pressure'
  WHEN coalesce(disk, 0) >= coalesce(link, 0) THEN 'disk_io_pressure' ELSE 'link_fault' END AS category FROM w""")
def specific_category(spark, sf_dir):
    st = detect.strengths(node_cells(spark, sf_dir), dims.direct_rules(spark))
    names = ["cpu_pressure", "disk_io_pressure", "link_fault"]
    wide = st.groupBy("minute", "entity").agg(*(F.max(F.when(F.col("category") == n, F.col("strength"))).alias(n) for n in names))
    return wide.select("minute", "entity", detect.specific_category({n: F.col(n) for n in names}).alias("category"))


@query(f"""WITH {EV}, h AS (SELECT hour AS minute, user_id % 80 AS entity, count(*) FILTER (event_type = 'view') AS q, count(*) FILTER (event_type = 'error') AS e,
  count(*) FILTER (event_type = 'click') AS s FROM ev GROUP BY 1, 2)
SELECT minute, entity, round(greatest(least(16.0, greatest(0, least(e, q)) * 15.0 / (q + 30)), least(16.0, greatest(0, least(q - s, q)) * 15.0 / (q + 30))), 6) AS symptom
FROM h WHERE q > 0""")
def service_symptom(spark, sf_dir):
    name = {"view": "requests_rate", "error": "error_rate", "click": "success_rate"}
    e = events(spark, sf_dir).where(F.col("event_type").isin(list(name))).withColumn("entity", F.col("user_id") % 80)
    feature = F.concat(F.lit("traffic.web."), F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in name.items())))
    got = e.groupBy(F.col("hour").alias("minute"), "entity").pivot("event_type", list(name)).count().na.fill(0)
    long = got.select("minute", "entity", F.inline(F.array(*(F.struct(F.lit(f"traffic.web.{v}").alias("feature"), F.col(k).cast("double").alias("value")) for k, v in name.items()))))
    return detect.service_symptoms(long).select("minute", "entity", r6("symptom").alias("symptom"))


@query(f"""WITH {EV}, n AS (SELECT day, user_id, count(*) AS n, CASE event_type WHEN 'error' THEN 'err' WHEN 'click' THEN 'warning' ELSE event_type END AS severity FROM ev GROUP BY 1, 2, 4)
SELECT day, user_id, round(max(least(8.0, ln(1 + n) * CASE severity WHEN 'err' THEN 4.0 WHEN 'warning' THEN 2.0 ELSE 0 END)), 6) AS support FROM n GROUP BY 1, 2""")
def log_support(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", "err").when(F.col("event_type") == "click", "warning").otherwise(F.col("event_type"))
    n = events(spark, sf_dir).groupBy("day", "user_id", severity.alias("severity")).agg(F.count("*").alias("n"))
    return n.groupBy("day", "user_id").agg(r6(F.max(detect.log_support(F.col("n"), F.col("severity")))).alias("support"))


SHARE = """d AS (SELECT date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS day, l_returnflag, round(sum(l_quantity), 6) AS q FROM lineitem GROUP BY 1, 2),
s AS (SELECT day, l_returnflag, q / sum(q) OVER (PARTITION BY day) AS share FROM d)"""


@query(f"""WITH {SHARE}, c AS (SELECT l_returnflag, median(share) AS center, count(*) AS n FROM s GROUP BY 1),
m AS (SELECT s.l_returnflag, center, n, greatest(median(abs(share - center)) * 1.4826, 0.05) AS scale FROM s JOIN c ON s.l_returnflag = c.l_returnflag GROUP BY 1, 2, 3),
z AS (SELECT day, s.l_returnflag, abs((share - center) / scale) AS z FROM s JOIN m ON s.l_returnflag = m.l_returnflag WHERE n >= 20),
r AS (SELECT *, greatest(0, least(4.0, (z - 2.5) / 2)) AS raw FROM z),
t AS (SELECT *, coalesce(max(raw) OVER (PARTITION BY l_returnflag ORDER BY day RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS b,
  coalesce(max(raw) OVER (PARTITION BY l_returnflag ORDER BY day RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING), 0) AS a FROM r)
SELECT day, l_returnflag, round(CASE WHEN raw > 0 AND greatest(a, b) > 0 THEN raw ELSE 0 END, 5) AS support FROM t""")
def share_shift_support(spark, sf_dir):
    day = F.expr("timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)")
    d = table(spark, sf_dir, "lineitem").groupBy(day.alias("day"), "l_returnflag").agg(r6(F.sum("l_quantity")).alias("q"))
    from pyspark.sql import Window as W

    d = d.withColumn("share", F.col("q") / F.sum("q").over(W.partitionBy("day")))
    return detect.shift_support(d, ["l_returnflag"], "day", "share").select("day", "l_returnflag", F.round("support", 5).alias("support"))


FIVE = """r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events),
b AS (SELECT user_id, event_type, avg(value) AS mean, stddev_pop(value) AS dev FROM r WHERE n >= 4 AND i <= greatest(3, floor(n * 0.2)) GROUP BY 1, 2),
hit AS (SELECT r.*, abs(value - mean) / greatest(dev, 1e-12) AS magnitude FROM r JOIN b ON r.user_id = b.user_id AND r.event_type = b.event_type
  WHERE n >= 4 AND (abs(value - mean) > dev * 5 OR (dev = 0 AND value <> mean)))"""


@query(f"WITH {FIVE} SELECT event_id, round(magnitude, 4) AS magnitude FROM hit")
def five_sigma_points(spark, sf_dir):
    hit = detect.five_sigma(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")
    return hit.select("event_id", F.round("magnitude", 4).alias("magnitude"))


@query(f"""WITH {FIVE}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM hit),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, min(ts) AS start_time, max(ts) + INTERVAL 1 MINUTE AS end_time, count(*) AS points FROM s GROUP BY user_id, s""")
def five_sigma_sessions(spark, sf_dir):
    hit = detect.five_sigma(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")
    return segment.sessions(hit, ["user_id"], "ts", "12 hours")


SOURCE_WEIGHTS = {"error": 1.2, "purchase": 0.75, "signup": 0.5}
ENERGY = f"""{EV}, k AS (SELECT hour AS minute, event_type, least(25.0, value / 4) AS s, row_number() OVER (PARTITION BY hour, event_type ORDER BY least(25.0, value / 4) DESC) AS r FROM ev),
o AS (SELECT minute, event_type, max(s) AS b, sum(s) AS t, count(*) AS n FROM k WHERE r <= 3 GROUP BY 1, 2),
w AS (SELECT minute, least(25.0, (b + 0.25 * CASE WHEN n > 1 THEN (t - b) / (n - 1) ELSE 0 END)
  * CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in SOURCE_WEIGHTS.items())} ELSE 1.0 END) AS e FROM o),
energy AS (SELECT minute, round(least(25.0, max(e) + 0.25 * CASE WHEN count(*) > 1 THEN (sum(e) - max(e)) / (count(*) - 1) ELSE 0 END), 6) AS energy FROM w GROUP BY 1)"""


@query(f"WITH {ENERGY} SELECT * FROM energy")
def minute_energy(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("hour").alias("minute"), F.col("event_type").alias("source"), F.least(F.lit(25.0), F.col("value") / 4).alias("score"))
    return detect.minute_energy(e, SOURCE_WEIGHTS).select("minute", r6("energy").alias("energy"))


# --- segmentation

HYST = f"""{EV}, en AS (SELECT event_type, hour, round(max(value) / 10, 6) AS energy FROM ev GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN hour - lag(hour) OVER (PARTITION BY event_type ORDER BY hour) <= 2 THEN 0 ELSE 1 END AS fresh FROM en WHERE energy >= 3),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY hour) AS island FROM k),
win AS (SELECT event_type, min(hour) FILTER (energy >= 7) AS "start", max(hour) + 1 AS "end", max(energy) AS peak FROM i GROUP BY event_type, island)"""


def hourly_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type", "hour").agg(r6(F.max("value") / 10).alias("energy"))


@query(f'WITH {HYST} SELECT * FROM win WHERE "start" IS NOT NULL')
def hysteresis_windows(spark, sf_dir):
    return segment.hysteresis(hourly_energy(spark, sf_dir), ["event_type"], "hour", "energy")


@query(f"""WITH RECURSIVE {HYST}, hs AS (SELECT min(hour) AS h0, max(hour) AS h1 FROM en),
es AS (SELECT t.event_type, any_value(h0) AS h0, list(coalesce(energy, 0) ORDER BY h) AS es FROM (SELECT event_type, h0, unnest(range(h0, h1 + 1)) AS h FROM hs, (SELECT DISTINCT event_type FROM en) AS x) AS t LEFT JOIN en ON en.event_type = t.event_type AND en.hour = h GROUP BY 1),
sp(event_type, a, b) AS (SELECT event_type, "start", "end" FROM win WHERE "start" IS NOT NULL UNION ALL SELECT event_type, x[1], x[2] FROM (
  SELECT event_type, unnest([[a, a + list_position(s, list_min(s))], [a + list_position(s, list_min(s)), b]]) AS x FROM (SELECT sp.event_type, a, b, es[a + 2 - h0 : b - h0] AS s FROM sp JOIN es ON sp.event_type = es.event_type WHERE b - a > 6) AS l) AS c)
SELECT event_type, a AS "start", b AS "end" FROM sp WHERE b - a <= 6""")
def split_windows(spark, sf_dir):
    h = hourly_energy(spark, sf_dir)
    return segment.split_long(segment.hysteresis(h, ["event_type"], "hour", "energy").drop("peak"), h, ["event_type"], "hour", "energy", 6)


TIMELINE = f"""{EV}, hours AS (SELECT min(hour) AS a, max(hour) AS b FROM ev),
grid AS (SELECT t AS event_type, unnest(range(0, b - a + 1)) AS i, a FROM hours, (SELECT DISTINCT event_type AS t FROM ev) AS ts),
pv AS (SELECT event_type, hour, least(1.0, max(value) / 100) AS p FROM ev GROUP BY 1, 2),
line AS (SELECT g.event_type, g.i, coalesce(p, 0.0) AS p FROM grid g LEFT JOIN pv ON g.event_type = pv.event_type AND g.i + g.a = pv.hour)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, i, p, support): an hourly probability for each type; hours without events have 0."""
    e = events(spark, sf_dir)
    ends = e.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    grid = e.select("event_type").distinct().crossJoin(F.broadcast(ends)).select("event_type", "a", F.explode(F.expr("sequence(0L, b - a)")).alias("i"))
    p = e.groupBy("event_type", "hour").agg(F.least(F.lit(1.0), F.max("value") / 100).alias("p"))
    got = grid.withColumn("hour", F.col("a") + F.col("i")).join(p, ["event_type", "hour"], "left")
    return got.select("event_type", "i", F.coalesce("p", F.lit(0.0)).alias("p"), F.lit(None).cast("double").alias("support"))


CANDIDATES = f"""{TIMELINE}, l AS (SELECT *, lag(p) OVER w AS b, lead(p) OVER w AS a FROM line WINDOW w AS (PARTITION BY event_type ORDER BY i)),
st AS (SELECT event_type, i AS s, p AS ps, b AS bs FROM l WHERE p >= 0.4 AND ((p >= 0.8 AND (b IS NULL OR b < 0.8 OR p - b >= 0.2)) OR (b < 0.4 AND p - b >= 0.2))),
pr AS (SELECT st.event_type, s, ps, bs, l.i AS e, p, a, avg(greatest(0, p - 0.4)) OVER w AS m, max(p) OVER w AS pk, avg(p) OVER w AS c
  FROM st JOIN l ON st.event_type = l.event_type AND l.i BETWEEN s AND s + 29 WINDOW w AS (PARTITION BY st.event_type, s ORDER BY l.i)),
sc AS (SELECT event_type, s AS "start", e AS "end", m * sqrt(e - s + 1) + 0.08 * least(ln(e - s + 1), ln(30)) + 0.5 * greatest(0, pk - 0.8)
  + 0.5 * (CASE WHEN bs IS NOT NULL AND ps >= 0.8 THEN greatest(0, ps - bs) ELSE 0 END + CASE WHEN a IS NOT NULL AND p >= 0.8 THEN greatest(0, p - a) ELSE 0 END)
  + 0.3 * CASE WHEN a IS NOT NULL THEN greatest(0, p - a) ELSE 0 END - 0.55 AS score, c AS confidence FROM pr)"""
_NO_PATH = "[]::STRUCT(s BIGINT, e BIGINT, c DOUBLE)[]"
# the best chain up to each end, start by start; of the ends more than a gap away only the best one matters
CHOSEN = f"""{CANDIDATES}, ofs AS (SELECT event_type AS k, "start" AS s, row_number() OVER (PARTITION BY event_type ORDER BY "start") AS r, list({{'e': "end", 'v': score, 'c': confidence}} ORDER BY "end") AS offers FROM sc WHERE score > 0 GROUP BY 1, 2),
dp AS (SELECT DISTINCT k, 0::BIGINT AS r, []::STRUCT(f DOUBLE, e BIGINT, path STRUCT(s BIGINT, e BIGINT, c DOUBLE)[])[] AS ends FROM ofs
  UNION ALL SELECT k, r, list_concat(list_filter(ends, lambda x: x.e >= s - 21), CASE WHEN far IS NULL THEN [] ELSE [far] END,
    list_transform(offers, lambda o: {{'f': b.f + o.v, 'e': o.e, 'path': list_append(b.path, {{'s': s, 'e': o.e, 'c': o.c}})}}))
  FROM (SELECT dp.k AS k, ofs.r AS r, ends, s, offers, list_reduce(list_filter(list_prepend(NULL, ends), lambda x: x IS NULL OR x.e < s - 21), lambda x, y: CASE WHEN x IS NULL OR y.f >= x.f THEN y ELSE x END) AS far,
    list_reduce(list_transform(list_filter(ends, lambda x: x.e < s), lambda x: {{'f': x.f - 0.5 * (20 - least(20, s - x.e - 1)) / 20, 'path': x.path}}),
      lambda x, y: CASE WHEN y.f > x.f THEN y ELSE x END, {{'f': 0.0, 'path': {_NO_PATH}}}) AS b FROM dp JOIN ofs ON ofs.k = dp.k AND ofs.r = dp.r + 1) AS d)"""


@query(f"""WITH {CANDIDATES}
SELECT event_type, "start", "end", round(score + 1e-9, 4) AS score, round(confidence + 1e-9, 4) AS confidence FROM sc WHERE score > 1e-9""")
def decoder_candidates(spark, sf_dir):
    got = segment.candidates(timeline(spark, sf_dir), ["event_type"]).where("score > 1e-9")
    return got.select("event_type", "start", "end", F.round(F.col("score") + 1e-9, 4).alias("score"), F.round(F.col("confidence") + 1e-9, 4).alias("confidence"))


@query(f"""WITH RECURSIVE {CHOSEN}, ch AS (SELECT k, unnest(list_reduce(ends, lambda x, y: CASE WHEN y.f > x.f OR (y.f = x.f AND y.e > x.e) THEN y ELSE x END).path) AS w FROM dp WHERE r = (SELECT max(r) FROM ofs WHERE ofs.k = dp.k))
SELECT k AS event_type, w.s AS "start", w.e + 1 AS "end", round(least(1, greatest(0, w.c)) + 1e-9, 6) AS confidence FROM ch""")
def decoded_events(spark, sf_dir):
    return segment.decode(timeline(spark, sf_dir), ["event_type"]).withColumn("confidence", F.round(F.col("confidence") + 1e-9, 6))


# --- localisation

PHASE = f"""{HYST}, e AS (SELECT event_type || ':' || "start" AS event, "start" AS s, "end" AS e FROM win WHERE "start" IS NOT NULL),
ph AS (SELECT event, 'before' AS phase, greatest(0, s - 10) AS a, s AS b FROM e UNION ALL SELECT event, 'during', s, e FROM e
  UNION ALL SELECT event, 'early', s, s + greatest(1, (e - s) // 3) FROM e UNION ALL SELECT event, 'recovery', e, e + 15 FROM e),
sc AS (SELECT hour, user_id % 80 AS entity, max(value) AS score FROM ev GROUP BY 1, 2),
ps AS (SELECT event, phase, entity, round(0.7 * max(score) + 0.3 * sum(score) / any_value(b - a), 6) AS strength FROM ph JOIN sc ON hour >= a AND hour < b GROUP BY 1, 2, 3)"""


def window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of each type as an event, named by its type and start."""
    win = segment.hysteresis(hourly_energy(spark, sf_dir), ["event_type"], "hour", "energy")
    return win.select(F.concat_ws(":", "event_type", F.col("start").cast("string")).alias("event"), "start", "end")


def strengths_of_phases(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    sc = events(spark, sf_dir).groupBy(F.col("hour").alias("step"), (F.col("user_id") % 80).alias("entity")).agg(F.max("value").alias("score"))
    found = window_events(spark, sf_dir) if found is None else found
    return rank.phase_strength(found, sc).withColumn("strength", r6("strength"))


@query(f"WITH {PHASE} SELECT * FROM ps")
def phase_strength(spark, sf_dir):
    return strengths_of_phases(spark, sf_dir)


@query(f"""WITH {PHASE}, w AS (SELECT event, entity, coalesce(max(strength) FILTER (phase = 'during'), 0) AS d, coalesce(max(strength) FILTER (phase = 'early'), 0) AS y,
  coalesce(max(strength) FILTER (phase = 'before'), 0) AS b, coalesce(max(strength) FILTER (phase = 'recovery'), 0) AS a FROM ps GROUP BY 1, 2),
s AS (SELECT event, entity, round(0.5 * d + 0.2 * y + 0.15 * b + 0.15 * greatest(0, d - a) + least(0.25 * greatest(0, d - b) + 0.1 * greatest(0, y - b), 0.2 * d), 6) AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY score DESC, entity) AS rank FROM s) SELECT event, entity, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def root_topk(spark, sf_dir):
    return ranked_roots(strengths_of_phases(spark, sf_dir))


def ranked_roots(strengths: DataFrame) -> DataFrame:
    """(event, entity, score, rank) of the five best entities of each event."""
    w = strengths.groupBy("event", "entity").pivot("phase", ["before", "during", "early", "recovery"]).agg(F.max("strength")).na.fill(0.0)
    d, y, b, a = (F.col(c) for c in ("during", "early", "before", "recovery"))
    flow = F.greatest(F.lit(0.0), d - b) * 0.25 + F.greatest(F.lit(0.0), y - b) * 0.10
    parts = {"direct": d, "early": y, "pre": b, "recovery": F.greatest(F.lit(0.0), d - a), "netflow": flow}
    parts |= {k: F.lit(0.0) for k in ("log", "traffic_target", "traffic_observer")}
    scored = w.select("event", "entity", r6(rank.root_score(parts)).alias("score"))
    return rank.top(scored, ["event"], "score", ["entity"]).select("event", "entity", "score", "rank")


GRAPH = """l AS (SELECT 'n' || n_nationkey AS x, 'r' || n_regionkey AS y FROM nation), u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
walk(a, b, hops) AS (SELECT DISTINCT x, x, 0 FROM u UNION SELECT a, u.y, hops + 1 FROM walk JOIN u ON walk.b = u.x WHERE hops < 4),
hop AS (SELECT a, b, min(hops) AS hops FROM walk GROUP BY 1, 2)"""


def nation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target"))


@query(f"WITH RECURSIVE {GRAPH} SELECT a, b, hops FROM hop")
def graph_distance(spark, sf_dir):
    return rank.distances(nation_links(spark, sf_dir), 4)


@query(f"""WITH RECURSIVE {GRAPH}, s AS (SELECT 'n' || s_nationkey AS node, max(s_acctbal) / 20000 AS severity FROM supplier GROUP BY 1)
SELECT a AS node, round(least(1.0, sum(part) FILTER (r <= 5) / least(3, count(*))), 6) AS support FROM (
  SELECT a, severity / (1 + hops) AS part, row_number() OVER (PARTITION BY a ORDER BY severity / (1 + hops) DESC, b) AS r FROM s JOIN hop ON s.node = hop.b WHERE a <> b) AS x GROUP BY 1""")
def topology_explanation(spark, sf_dir):
    severity = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("node")).agg((F.max("s_acctbal") / 20000).alias("severity"))
    got = rank.topology_support(severity, rank.distances(nation_links(spark, sf_dir), 4))
    return got.withColumn("support", r6("support"))


@query("""WITH s AS (SELECT l_suppkey AS node, l_returnflag AS event, max(l_quantity) / 50 AS severity, count(DISTINCT l_shipdate) / 100 AS persistence,
  count(DISTINCT l_linestatus) / 2 AS diversity, round(avg(l_discount), 6) AS directness, round(avg(l_tax), 6) AS precedence FROM lineitem GROUP BY 1, 2),
f AS (SELECT event, node, round(severity * 0.28 + persistence * 0.15 + precedence * 0.16 + diversity * 0.14 + directness * 0.16, 6) AS score, directness, precedence FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY score DESC, directness DESC, precedence DESC, node) AS rank FROM f)
SELECT event, node, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def fused_rank(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node"), F.col("l_returnflag").alias("event")).agg(
        (F.max("l_quantity") / 50).alias("severity"), (F.countDistinct("l_shipdate") / 100).alias("persistence"),
        (F.countDistinct("l_linestatus") / 2).alias("diversity"), r6(F.avg("l_discount")).alias("directness"), r6(F.avg("l_tax")).alias("precedence"),
    )
    got = rank.fused(s, ["event"])
    return got.select("event", "node", r6("score").alias("score"), "rank")


SHARES = """b AS (SELECT p_brand, p_type, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1, 2), n AS (SELECT *, size / sum(size) OVER (PARTITION BY p_brand) AS share FROM b)"""


@query(f"""WITH {SHARES}, w AS (SELECT *, row_number() OVER o AS rank, coalesce(sum(size) OVER (PARTITION BY p_brand ORDER BY size DESC, p_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  / sum(size) OVER (PARTITION BY p_brand) AS before FROM n WINDOW o AS (PARTITION BY p_brand ORDER BY size DESC, p_type))
SELECT p_brand, p_type, round(share, 6) AS share, CAST(rank AS INTEGER) AS rank FROM w WHERE rank <= 5 AND (rank <= 2 OR before < 0.85 - 1e-12)""")
def top_p_shortlist(spark, sf_dir):
    b = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("size"))
    n = rank.normalised(b, ["p_brand"], "size")
    got = rank.shortlist(n, ["p_brand"], "share", ["p_type"], 0.85 - 1e-12, 2, 5)
    return got.select("p_brand", "p_type", r6("share").alias("share"), "rank")


@query("""WITH r AS (SELECT c_mktsegment, c_nationkey, max(c_acctbal) AS v FROM customer GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY v DESC, c_nationkey) AS k FROM r), s AS (SELECT c_nationkey, CAST(sum(k) AS BIGINT) AS rank_sum FROM k GROUP BY 1)
SELECT c_nationkey, rank_sum, round((1 / rank_sum) / sum(1 / rank_sum) OVER (), 6) AS share FROM s""")
def rank_of_ranks(spark, sf_dir):
    r = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.max("c_acctbal").alias("v"))
    return rank.rank_of_ranks(r, [], "c_mktsegment", "c_nationkey", "v").withColumn("share", r6("share"))


@query("""WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS votes FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, l_returnflag) AS r FROM c) SELECT l_suppkey, l_returnflag, votes FROM r WHERE r = 1""")
def vote_majority(spark, sf_dir):
    return rank.majority(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag")


# --- classification


FEATURE_NAMES = [r[0] for r in dims.DIRECT_RULES] + [
    "traffic.web.latency_p95_seconds", "traffic.web.error_ratio", "traffic.auth.timeout_rate", "traffic.dns.success_ratio",
    "netflow.unique_destination_ports.protocol_tcp", "firewall.acl_hits", "link.loss", "node.softirq_rate", "traffic.web.throughput",
]
FEATURE_LIST = "[" + ", ".join(f"'{n}'" for n in FEATURE_NAMES) + "]"


def feature_names(e: DataFrame) -> Column:
    """A telemetry feature for each event, dealt by its number."""
    return F.get(F.array(*map(F.lit, FEATURE_NAMES)), (F.col("event_id") % len(FEATURE_NAMES)).cast("int"))


_SIGNALS = [
    "cpu", None, None, "memory", "memory", "disk_io", None, None, "disk_space", "disk_space", "process", None, "link_loss", "link_loss", "link_loss", "link_loss",
    "bgp_down", "ospf_down", None, "bgp_down", "ospf_down", "bgp_down", None, "web_latency", "web_error", "auth_timeout", "dns_error",
    "port_selectivity", "acl_drop", "link_loss", "softirq", None,
]
_SIGNAL_LIST = "[" + ", ".join("NULL" if s is None else f"'{s}'" for s in _SIGNALS) + "]"
_FW = {"cpu": "firewall_cpu_pressure", "acl_drop": "firewall_acl_drop", "port_selectivity": "firewall_port_block"}
_ROUTER = {"bgp_down": "route_bgp_session_down", "ospf_down": "route_ospf6_neighbor_down"}
_ANY = {
    "memory": "resource_memory_pressure", "disk_io": "resource_disk_io_pressure", "disk_space": "resource_disk_space_low", "process": "resource_process_pressure",
    "softirq": "resource_softirq_udp_pressure", "link_loss": "link_loss", "web_latency": "service_web_slow", "web_error": "service_web_5xx",
    "auth_timeout": "service_auth_timeout", "dns_error": "service_dns_down",
}
_SIGNAL_CTE = f"""sg AS (SELECT event_id, value, user_id % 10 AS role, {_SIGNAL_LIST}[event_id % {len(_SIGNALS)} + 1] AS signal FROM events),
cat AS (SELECT *, CASE {" ".join(f"WHEN role = 4 AND signal = '{k}' THEN '{v}'" for k, v in _FW.items())} WHEN signal = 'cpu' THEN 'resource_cpu_high'
  {" ".join(f"WHEN role < 4 AND signal = '{k}' THEN '{v}'" for k, v in _ROUTER.items())} {" ".join(f"WHEN signal = '{k}' THEN '{v}'" for k, v in _ANY.items())} END AS category FROM sg)"""


def categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    node = F.concat(F.lit("xian-"), F.get(F.array(*map(F.lit, dims.ROLES)), (F.col("user_id") % 10).cast("int")))
    e = e.withColumn("role", F.col("user_id") % 10).withColumn("feature", feature_names(e))
    e = e.join(classify.signals_of(e), "feature", "left")
    return e.withColumn("node", node).withColumn("category", classify.category_of(F.col("signal"), node))


@query(f"WITH {_SIGNAL_CTE} SELECT event_id, signal, category FROM cat")
def signal_categories(spark, sf_dir):
    return categorised(spark, sf_dir).select("event_id", "signal", "category")


@query(f"""WITH {_SIGNAL_CTE}, x AS (SELECT role, category, max(value) AS v FROM cat WHERE category IS NOT NULL AND value > 0 GROUP BY 1, 2),
n AS (SELECT role, sum(v) AS s FROM x GROUP BY 1), w AS (SELECT role, s, 0.5 * ((role + 1) * s) / sum((role + 1) * s) OVER () + 0.5 * s / sum(s) OVER () AS w FROM n)
SELECT category, round(sum(w * v / s), 6) AS p FROM x JOIN w ON x.role = w.role GROUP BY 1""")
def category_mixture(spark, sf_dir):
    x = categorised(spark, sf_dir).where("category is not null and value > 0").groupBy("role", "category").agg(F.max("value").alias("v"))
    x = x.withColumn("event", F.lit(0)).withColumn("root", (F.col("role") + 1).cast("double"))
    return classify.mixture(x, ["event"], "role", "category", "v", "root").select("category", r6("p").alias("p"))


@query("""WITH d AS (SELECT vec_id, label, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings),
c AS (SELECT label, k, avg(w) AS w FROM d GROUP BY 1, 2), nd AS (SELECT vec_id, sqrt(sum(w * w)) AS n FROM d GROUP BY 1), nc AS (SELECT label, sqrt(sum(w * w)) AS n FROM c GROUP BY 1),
m AS (SELECT vec_id, c.label AS label, sum(d.w * c.w) AS dot FROM d JOIN c ON d.k = c.k GROUP BY 1, 2)
SELECT m.vec_id AS vec_id, m.label AS label, round(dot / (nd.n * nc.n), 5) AS cosine FROM m JOIN nd ON m.vec_id = nd.vec_id JOIN nc ON m.label = nc.label""")
def prototype_cosine(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "w")).withColumn("w", F.col("w").cast("double"))
    protos = d.groupBy("label", "k").agg(F.avg("w").alias("w"))
    got = classify.cosine(d.select("vec_id", "k", "w"), protos, "vec_id", "label", "k", "w")
    return got.select("vec_id", "label", F.round("cosine", 5).alias("cosine"))


@query(f"""WITH {PHASE}, b AS (SELECT event, phase, entity, sc.score AS v FROM ph JOIN sc ON hour >= a AND hour < b WHERE phase IN ('before', 'during')),
g AS (SELECT event, entity, quantile_cont(v, [0.25, 0.5, 0.75]) FILTER (phase = 'before') AS q, max(v) FILTER (phase = 'during') AS hi, min(v) FILTER (phase = 'during') AS lo FROM b GROUP BY 1, 2)
SELECT event, entity, round(least(25.0, CASE WHEN q IS NULL THEN hi ELSE greatest(0, (CASE WHEN entity % 2 = 0 THEN q[2] - lo ELSE hi - q[2] END)
  / greatest(q[3] - q[1], abs(q[2]) * 0.05, 0.01)) END), 6) AS deviation FROM g WHERE hi IS NOT NULL""")
def event_deviation(spark, sf_dir):
    sc = events(spark, sf_dir).groupBy(F.col("hour").alias("step"), (F.col("user_id") % 80).alias("entity")).agg(F.max("value").alias("score"))
    rows = rank.phases(window_events(spark, sf_dir)).where("phase in ('before', 'during')").join(sc, "step")
    got = classify.deviation(rows, ["event", "entity"], "score", "phase", F.col("entity") % 2 == 0)
    return got.withColumn("deviation", r6("deviation"))


# --- evaluation, audit, windows

INTERVALS = """t AS (SELECT user_id, 't' || event_id AS truth_id, epoch_us(ts) // 1000000 AS "start", epoch_us(ts) // 1000000 + 7200 AS "end" FROM events WHERE event_type = 'error'),
p AS (SELECT user_id, 'p' || event_id AS prediction_id, epoch_us(ts) // 1000000 AS "start", epoch_us(ts) // 1000000 + 5400 AS "end" FROM events WHERE event_type = 'view'),
pair AS (SELECT t.user_id, truth_id, prediction_id, t."start" - p."start" AS ds, t."end" - p."end" AS de,
  2.0 * (least(t."end", p."end") - greatest(t."start", p."start")) / 12600 AS dice FROM t JOIN p ON t.user_id = p.user_id AND t."start" < p."end" AND p."start" < t."end")"""


def intervals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(truths, predictions): the two hours after an error, the ninety minutes after a view."""
    e = events(spark, sf_dir)
    made = lambda kind, name, s: e.where(F.col("event_type") == kind).select(
        "user_id", F.concat(F.lit(name[0]), F.col("event_id").cast("string")).alias(name), F.col("sec").alias("start"), (F.col("sec") + s).alias("end")
    )
    return made("error", "truth_id", 7200), made("view", "prediction_id", 5400)


@query(f"WITH {INTERVALS} SELECT user_id, truth_id, prediction_id, round(dice, 6) AS dice FROM pair WHERE dice >= 0.4")
def interval_dice(spark, sf_dir):
    return evaluate.dice_pairs(*intervals(spark, sf_dir), ["user_id"]).withColumn("dice", r6("dice"))


# the best set of pairs of each stretch of overlapping intervals, truth by truth over all choices
MATCHING = f"""{INTERVALS}, al AS (SELECT user_id, "start", "end", truth_id AS x FROM t UNION ALL SELECT user_id, "start", "end", prediction_id FROM p),
fr AS (SELECT *, CASE WHEN "start" < max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM al),
rn AS (SELECT x, user_id || ':' || sum(fresh) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS run FROM fr),
pp AS (SELECT run, truth_id, prediction_id, dice, dense_rank() OVER (PARTITION BY run ORDER BY truth_id) AS i FROM pair JOIN rn ON truth_id = x WHERE dice >= 0.4),
cnt AS (SELECT run, max(i) AS n FROM pp GROUP BY 1), op AS (SELECT run, i, prediction_id, dice, truth_id FROM pp UNION ALL SELECT DISTINCT run, i, NULL, 0.0, NULL FROM pp),
walk(run, i, used, total) AS (SELECT run, CAST(0 AS BIGINT), CAST([] AS STRUCT(truth_id VARCHAR, prediction_id VARCHAR)[]), CAST(0 AS DOUBLE) FROM cnt
  UNION ALL SELECT w.run, w.i + 1, CASE WHEN prediction_id IS NULL THEN used ELSE list_append(used, {{'truth_id': truth_id, 'prediction_id': prediction_id}}) END, total + dice
  FROM walk w JOIN op ON w.run = op.run AND op.i = w.i + 1 AND (prediction_id IS NULL OR NOT list_contains(list_transform(used, lambda u: u.prediction_id), prediction_id))),
best AS (SELECT w.run, arg_max(used, total) AS used FROM walk w JOIN cnt ON w.run = cnt.run AND w.i = n GROUP BY 1),
mt AS (SELECT u.truth_id AS truth_id, u.prediction_id AS prediction_id FROM (SELECT unnest(used) AS u FROM best) AS b),
mp AS (SELECT pair.* FROM mt JOIN pair ON mt.truth_id = pair.truth_id AND mt.prediction_id = pair.prediction_id)"""


@query(f"WITH RECURSIVE {MATCHING} SELECT user_id, truth_id, prediction_id, dice FROM mp")
def interval_match(spark, sf_dir):
    return evaluate.match(*intervals(spark, sf_dir), ["user_id"])


@query(f"""WITH RECURSIVE {MATCHING},
m AS (SELECT *, 0.7 + 0.3 * greatest(0, 1 - (abs(ds) + abs(de)) / 360.0) AS d, [1.0, 0.8, 0.6, 0.4, 0.2][user_id % 6 + 1] AS rca FROM mp),
c AS (SELECT (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM p) AS np, count(*) AS tp, sum(d) AS d, sum(coalesce(rca, 0)) AS r, count(*) FILTER (user_id % 2 = 0) AS mj,
  count(*) FILTER (user_id % 4 = 0) AS mi FROM m)
SELECT round(40 * d / nt * (0.7 + 0.3 * tp / np), 6) AS ad, round(40 * r / nt, 6) AS rca, round(10 * mj / nt, 6) AS major, round(10 * mi / nt, 6) AS minor, tp, np - tp AS fp, nt - tp AS fn FROM c""")
def challenge_score(spark, sf_dir):
    t, p = intervals(spark, sf_dir)
    best = evaluate.match(t, p, ["user_id"])
    ends = best.join(t.select("truth_id", F.col("start").alias("a"), F.col("end").alias("b")), "truth_id").join(
        p.select("prediction_id", F.col("start").alias("c"), F.col("end").alias("d")), "prediction_id"
    )
    node = lambda i: F.concat(F.lit("n"), i.cast("string"))
    top5 = F.array(*(F.lit(f"n{i}") for i in range(5)))
    matched = ends.select(
        evaluate.detection_score(F.col("a") - F.col("c"), F.col("b") - F.col("d")).alias("detection"),
        evaluate.rank_score(top5, node(F.col("user_id") % 6)).alias("rca"),
        (F.col("user_id") % 2 == 0).alias("major_ok"), (F.col("user_id") % 4 == 0).alias("minor_ok"),
    )
    # both counts come from the same scan of the intervals as the matching, as a table of one row
    sizes = t.agg(F.count("*").alias("nt")).join(p.agg(F.count("*").alias("np")))
    got = evaluate.challenge(matched.join(F.broadcast(sizes), how="right"), F.max("nt"), F.max("np"))
    return got.select(*(r6(c).alias(c) for c in ("ad", "rca", "major", "minor")), "tp", "fp", "fn")


@query(f"""WITH {EV}, h AS (SELECT hour, coalesce(max(value) FILTER (event_type = 'error'), 0) AS a, coalesce(max(value) FILTER (event_type = 'view'), 0) AS b FROM ev GROUP BY 1)
SELECT CASE WHEN a <= 0 AND b <= 0 THEN 'undetermined' WHEN abs(a - b) <= 1e-6 THEN 'ambiguous' WHEN a > b THEN 'node' ELSE 'service' END AS driver, count(*) AS hours FROM h GROUP BY 1""")
def peak_drivers(spark, sf_dir):
    of = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    h = events(spark, sf_dir).groupBy("hour").agg(of("error").alias("a"), of("view").alias("b"))
    return h.groupBy(evaluate.peak_driver(F.col("a"), F.col("b")).alias("driver")).agg(F.count("*").alias("hours"))


@query(f"""WITH {_SIGNAL_CTE} SELECT CASE WHEN role = 9 THEN 'not_evaluated' WHEN category IS NULL THEN 'undetermined'
  WHEN category = 'link_loss' THEN 'supported' ELSE 'unsupported' END AS status, count(*) AS events FROM cat GROUP BY 1""")
def anchor_statuses(spark, sf_dir):
    c = categorised(spark, sf_dir)
    status = evaluate.anchor_status(F.lit("link_loss"), F.col("category"), F.col("role") != 9)
    return c.groupBy(status.alias("status")).agg(F.count("*").alias("events"))


@query("""WITH c AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey % 7 <> 0), o AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey % 5 <> 0)
SELECT id, 'right' AS missing_in FROM c WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT id, 'left' FROM o WHERE id NOT IN (SELECT id FROM c)""")
def id_differences(spark, sf_dir):
    return evaluate.id_differences(table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0"), table(spark, sf_dir, "orders").where("o_custkey % 5 <> 0"), "c_custkey", "o_custkey")


@query("""SELECT o_orderkey, o_orderkey % 5 <> 0 AS core_valid, o_orderkey % 3 <> 1 AS rca_valid, o_orderkey % 7 <> 0 AS major_valid, o_orderkey % 7 = 1 AS sub_valid FROM orders""")
def prediction_validity(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    start = F.lit("2026-01-01T00:00:00Z")
    end = F.when(k % 5 == 0, F.lit("2026-01-01 00:10:00")).otherwise("2026-01-01T00:10:00+00:00")
    item = lambda i, n: F.struct(F.lit(i).alias("rank"), F.lit(n).alias("network_element_id"))
    top5 = F.when(k % 3 == 1, F.array(item(1, "xian-fw"), item(2, "xian-fw"))).otherwise(F.array(item(1, "xian-fw"), item(2, "wuhan-br-1")))
    major = F.when(k % 7 == 0, "weather").otherwise("link")
    sub = F.when(k % 7 == 1, "delay").otherwise("dns_down")
    rows = o.select(
        "o_orderkey", k.cast("string").alias("prediction_id"), start.alias("start_time"), end.alias("end_time"), top5.alias("root_cause_top5"),
        F.struct(major.alias("major_category"), sub.alias("sub_category")).alias("fault_category"),
    )
    return evaluate.prediction_flags(rows).select("o_orderkey", "core_valid", "rca_valid", "major_valid", "sub_valid")


@query(f"""WITH {EV}, d AS (SELECT user_id, day - min(day) OVER (PARTITION BY user_id) AS i, value FROM ev), n AS (SELECT user_id, max(i) + 1 AS len FROM d GROUP BY 1),
w AS (SELECT user_id, len, unnest(list_distinct(list_concat(range(0, greatest(0, len - 7) + 1, 3), [greatest(0, len - 7)]))) AS s FROM n),
c AS (SELECT w.user_id, w.s, d.i, sum(d.value) OVER (PARTITION BY w.user_id, w.s) AS t FROM w JOIN (SELECT user_id, i, round(sum(value), 6) AS value FROM d GROUP BY 1, 2) AS d
  ON w.user_id = d.user_id AND d.i >= w.s AND d.i < w.s + 7)
SELECT user_id, i AS step, round(avg(t), 5) AS score, count(*) AS windows FROM c GROUP BY 1, 2""")
def window_average(spark, sf_dir):
    from pyspark.sql import Window as W

    d = events(spark, sf_dir).withColumn("step", F.col("day") - F.min("day").over(W.partitionBy("user_id")))
    d = d.groupBy("user_id", "step").agg(r6(F.sum("value")).alias("value"))
    n = d.groupBy("user_id").agg((F.max("step") + 1).alias("length"))
    rows = windows.steps(windows.enumerate_windows(n, 7, 3), 7).join(d, ["user_id", "step"])
    rows = rows.withColumn("score", F.sum("value").over(W.partitionBy("user_id", "window")))
    return windows.average(rows, ["user_id", "step"], "score").withColumn("score", F.round("score", 5))


# --- events


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, day, hour, user_id, source, metric, direction, score) from events."""
    e = events(spark, sf_dir)
    source = F.when(F.col("event_type") == "error", "node").when(F.col("event_type") == "view", "routing").otherwise("traffic")
    way = F.when(F.col("event_id") % 3 == 0, "low").otherwise("high")
    return e.select("event_id", "day", "hour", "user_id", source.alias("source"), F.col("event_type").alias("metric"), way.alias("direction"), F.col("value").alias("score"))


_POINTS = """pt AS (SELECT event_id, day, hour, user_id, event_type AS metric, value AS score, CASE WHEN event_id % 3 = 0 THEN 'low' ELSE 'high' END AS direction,
  CASE event_type WHEN 'error' THEN 'node' WHEN 'view' THEN 'routing' ELSE 'traffic' END AS source FROM ev)"""
_EVIDENCE = f"{EV}, {_POINTS}"


@query(f"""WITH {_EVIDENCE}, w AS (SELECT *, first_value(direction) OVER o AS f FROM pt WHERE source IN ('node', 'routing')
  WINDOW o AS (PARTITION BY user_id, metric ORDER BY day, score DESC, direction)),
b AS (SELECT *, coalesce(sum(CASE WHEN direction = f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, metric ORDER BY day, score DESC, direction ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM w),
m AS (SELECT user_id, day, sum(score) AS s FROM b WHERE direction <> f AND n >= 3 GROUP BY 1, 2), st AS (SELECT user_id, min(day) AS a FROM ev GROUP BY 1)
SELECT m.user_id AS user_id, min(day) AS recovery FROM m JOIN st ON m.user_id = st.user_id WHERE s >= 5 AND day >= a + 2 GROUP BY 1""")
def recovery_start(spark, sf_dir):
    from pyspark.sql import Window as W

    p = evidence(spark, sf_dir).withColumn("start", F.min("day").over(W.partitionBy("user_id"))).withColumn("minute", F.col("day"))
    return event_ops.recovery(p, ["user_id"], ["metric"])


@query(f"""WITH {ENERGY}, {_POINTS},
e AS (SELECT DISTINCT event_type || ':' || hour // 30 AS event, hour // 30 * 30 AS s, hour // 30 * 30 + 30 AS t FROM ev),
pk AS (SELECT event, s, t, arg_max(minute, (energy, -minute)) AS peak_minute, max(energy) AS x FROM e JOIN energy ON minute >= s AND minute < t GROUP BY 1, 2, 3),
n AS (SELECT event, count(*) AS points, list_sort(list(DISTINCT source)) AS sources FROM e JOIN pt ON hour >= s AND hour < t GROUP BY 1)
SELECT pk.event AS event, s AS "start", t AS "end", peak_minute, round(least(1.0, x / 7.0 / 1.5), 6) AS confidence, points, sources FROM pk JOIN n ON pk.event = n.event""")
def event_summary(spark, sf_dir):
    part = F.expr("hour div 30")
    spans = events(spark, sf_dir).select(F.concat_ws(":", "event_type", part.cast("string")).alias("event"), (part * 30).alias("start"), (part * 30 + 30).alias("end")).distinct()
    points = evidence(spark, sf_dir).withColumn("minute", F.col("hour"))
    return event_ops.summarise(spans, points, minute_energy(spark, sf_dir)).withColumn("confidence", r6("confidence"))


@query(f"""WITH {_EVIDENCE}, r AS (SELECT *, row_number() OVER (PARTITION BY day, user_id ORDER BY score DESC, hour, metric) AS r FROM pt)
SELECT day, user_id, count(*) AS anomalies, max(score) AS max_magnitude, round(least(1.0, 1 - 1 / (1 + sum(CASE WHEN r <= 2 THEN score ELSE 0 END))), 6) AS score FROM r GROUP BY 1, 2""")
def evidence_context(spark, sf_dir):
    p = evidence(spark, sf_dir).withColumnRenamed("score", "magnitude").withColumn("minute", F.col("hour"))
    return event_ops.context(p, ["day"], "user_id", 2).withColumn("score", r6("score"))


@query("""WITH e AS (SELECT l_returnflag, l_suppkey AS source, l_linenumber AS target, round(sum(l_quantity) - 300, 4) AS score FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, source, target) AS rank, count(*) OVER (PARTITION BY l_returnflag) AS n FROM e WHERE score > 0)
SELECT l_returnflag, source, target, score, CAST(rank AS INTEGER) AS rank, greatest(0, n - 20) AS truncated FROM r WHERE rank <= 20""")
def event_subgraph(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("target"))
    return event_ops.subgraph(e.agg(F.round(F.sum("l_quantity") - 300, 4).alias("score")), ["l_returnflag"])


_FLOOR_NAMES = ["node.cpu_usage", "node.load15", "interface.rx_bytes_rate", "routing.bgp_peer_up", "traffic.web.latency_ratio", "netflow.unique_sources", "other"]
_FLOOR_VALUES = [1.0, 0.1, 1024.0, 0.1, 0.05, 1.0, 0.01]


@query(f"SELECT event_id, {_FLOOR_VALUES}[event_id % {len(_FLOOR_VALUES)} + 1]::DOUBLE AS floor FROM events")
def scale_floors(spark, sf_dir):
    metric = F.get(F.array(*map(F.lit, _FLOOR_NAMES)), (F.col("event_id") % len(_FLOOR_NAMES)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", event_ops.scale_floor(metric).alias("floor"))


_TOKENS = ", ".join([f"('', {t!r}, '{s}', {f})" for t, s, f in P.METRIC_SIGNALS] + [f"('{a}', {t!r}, '{s}', {f})" for a, t, s, f in P.PAIRED_SIGNALS])
_PROTOS = ", ".join(f"('{f}', '{s}', {w})" for f, p in P.PROTOTYPES.items() for s, w in p.items())
_ORDER = ", ".join(f"('{t[0]}', {i})" for i, t in enumerate(dims.TAXONOMY))
_LOW = "contains(x, 'bytes_rate') OR contains(x, 'packets_rate') OR contains(x, 'throughput') OR contains(x, 'bandwidth')"


@query(f"""WITH pt AS (SELECT user_id, lower({FEATURE_LIST}[event_id % len({FEATURE_LIST}) + 1]) AS x, event_id % 2 = 0 AS low, least(1.0, value / 15) AS w FROM events),
ru(first, tokens, signal, f) AS (VALUES {_TOKENS}),
hits AS (SELECT user_id, signal, w * f AS w FROM pt JOIN ru ON contains(x, first) AND len(list_filter(tokens, lambda t: contains(x, t))) > 0
  UNION ALL SELECT user_id, 'interface', w * 0.5 FROM pt WHERE x LIKE 'interface.%' UNION ALL SELECT user_id, 'service_error', w * 1.5 FROM pt WHERE low AND contains(x, 'success_ratio')
  UNION ALL SELECT user_id, 'throughput_low', w * 1.3 FROM pt WHERE low AND ({_LOW})),
sg AS (SELECT user_id, signal, sum(w) AS w FROM hits GROUP BY 1, 2), pr(fault, signal, v) AS (VALUES {_PROTOS}), tx(fault, ord) AS (VALUES {_ORDER}),
nn AS (SELECT user_id, sqrt(sum(w * w)) AS n FROM sg GROUP BY 1), np AS (SELECT fault, sqrt(sum(v * v)) AS n FROM pr GROUP BY 1),
dt AS (SELECT user_id, fault, sum(w * v) AS d FROM sg JOIN pr ON sg.signal = pr.signal GROUP BY 1, 2),
sc AS (SELECT nn.user_id, tx.fault, ord, round(greatest(0, coalesce(d, 0) / (nn.n * np.n)), 6) AS score FROM nn, tx JOIN np ON tx.fault = np.fault LEFT JOIN dt ON dt.user_id = nn.user_id AND dt.fault = tx.fault),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ord) AS r FROM sc) SELECT user_id, CAST(r AS INTEGER) AS rank, fault, score FROM rk WHERE r <= 3""")
def prototype_ranking(spark, sf_dir):
    """The three best faults of every user's events, by prototype; ties in the taxonomy's order."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("text", feature_names(e)).withColumn("source", F.split("text", r"\.")[0]).withColumn("direction", F.when(F.col("event_id") % 2 == 0, "low").otherwise("high"))
    found = event_ops.signals(e.withColumn("weight", F.least(F.lit(1.0), F.col("value") / 15)), ["user_id"])
    scored = event_ops.prototype_scores(spark, found, "user_id")
    best = classify.ranked(spark, scored.withColumn("score", r6("score")), ["user_id"], "score", 3, "fault")
    return best.select("user_id", "rank", "fault", "score")


@query(f"""WITH {_SIGNAL_CTE}, o AS (SELECT event_id, value, ['xian-br-1', 'xian-br-2', 'xian-cr-1', 'xian-cr-2', 'xian-fw', 'xian-traffic-vm', 'xian-service-vm-1', 'xian-service-vm-2', 'xian-service-vm-3', 'xian-monitor-vm'][role + 1] AS node,
  coalesce(category, 'link_delay') AS category, [NULL, 'cpu_pressure', 'memory_pressure', 'disk_io_pressure', 'disk_space_pressure'][event_id % 5 + 1] AS direct FROM cat),
n AS (SELECT *, CASE WHEN direct IS NULL THEN NULL WHEN node LIKE '%-fw' THEN CASE WHEN direct = 'cpu_pressure' THEN 'firewall_cpu_pressure' END
  WHEN node LIKE '%-br-%' OR node LIKE '%-cr-%' THEN NULL WHEN direct = 'cpu_pressure' THEN 'resource_cpu_high' WHEN direct = 'disk_space_pressure' THEN 'resource_disk_space_low' ELSE 'resource_' || direct END AS new FROM o),
c AS (SELECT event_id, value, coalesce(new, category) AS category, CASE WHEN new IS NOT NULL THEN 0.9 ELSE 0.6 END AS conf FROM n)
SELECT event_id, category, CASE WHEN category <> 'resource_disk_io_pressure' THEN 'not_checked' WHEN value / 10 >= 5 THEN 'supported' WHEN event_id % 2 = 0 THEN 'unsupported' ELSE 'undetermined' END AS anchor,
  CAST(CASE WHEN category = 'resource_disk_io_pressure' AND value / 10 < 5 THEN least(0.5, conf) ELSE conf END AS DOUBLE) AS confidence FROM c""")
def direct_override(spark, sf_dir):
    c = categorised(spark, sf_dir)
    direct = F.get(F.array(F.lit(None).cast("string"), *map(F.lit, ("cpu_pressure", "memory_pressure", "disk_io_pressure", "disk_space_pressure"))), (F.col("event_id") % 5).cast("int"))
    got = event_ops.overridden(
        F.coalesce("category", F.lit("link_delay")), F.lit(0.6), direct, F.lit(0.9), F.col("node"), F.col("value") / 10, F.col("event_id") % 2 == 0
    )
    return c.select("event_id", *(v.alias(k) for k, v in got.items()))


@query(f"""WITH {STRENGTH}, q AS (SELECT entity, CASE WHEN sustained OR imm THEN p ELSE p * 0.55 END AS p FROM prob)
SELECT entity, round(min(p), 6) AS least, round(median(p), 6) AS middle, round(max(p), 6) AS most FROM q GROUP BY 1""")
def probability_summary(spark, sf_dir):
    p = detect.node_probability(detect.strengths(node_cells(spark, sf_dir), dims.direct_rules(spark)))
    return p.groupBy("entity").agg(r6(F.min("probability")).alias("least"), r6(F.percentile("probability", 0.5)).alias("middle"), r6(F.max("probability")).alias("most"))


@query(None)
def prediction_records(spark, sf_dir):
    """Records of all windows, with their ranked nodes and the first node's default category, as the sink takes them."""
    found = window_events(spark, sf_dir)
    node = F.get(F.array(*map(F.lit, diagnosis.NODES)), F.col("entity").cast("int"))
    top5 = ranked_roots(strengths_of_phases(spark, sf_dir, found)).withColumn("node", node)
    taxonomy = dims.taxonomy(spark).select(F.col("fault_name").alias("_fault"), F.struct(F.col("major").alias("major_category"), F.col("sub").alias("sub_category")).alias("fault_category"))
    category = top5.where("rank = 1").select("event", classify.default_category(F.col("node")).alias("_fault")).join(taxonomy, "_fault")
    utc = lambda c: S.utc_text(F.timestamp_seconds(c * 3600))
    e = found.select(
        "event", utc(F.col("start")).alias("start_time"), utc(F.col("end")).alias("end_time")
    ).join(category.drop("_fault"), "event")
    return evaluate.prediction_flags(event_ops.records(e, top5))
