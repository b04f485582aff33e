"""The seven telemetry sources as one table of observations.

Each source is read on its own, as the files' headers differ. An observation is (ts, source,
node_id, related_node_ids, metric, value, dimensions, direction).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultsift.functions import scalars as S

# File prefix, time columns by precedence, and columns that are no measures.
SOURCES = {
    "node": ("node_metrics", ["timestamp"]),
    "interface": ("interface_metrics", ["timestamp"]),
    "routing": ("routing_metrics", ["timestamp"]),
    "scrape": ("scrape_health", ["timestamp"]),
    "traffic": ("traffic_flow_metrics", ["timestamp_utc", "prometheus_sample_time_utc"]),
    "netflow": ("netflow", ["minute_utc", "first_seen"]),
    "frr": ("frr_syslog_events", ["event_time", "received_at"]),
}
IDENTITY = {
    "timestamp", "region", "region_code", "node", "node_key", "node_type", "interface_id", "if_role", "target_id",
    "exporter_type", "scrape_error", "metric_name", "label", "job", "instance",
}
OBSERVATION = ["ts", "source", "node_id", "related_node_ids", "metric", "value", "dimensions", "direction", "file"]


def prefer_processed(files: DataFrame) -> DataFrame:
    """(path, source): CSV files in a folder named processed or ending _data, routed by name.

    Of the files of one source and grandparent folder, raw ones go if any is processed.
    """
    parts = files.select(
        "path",
        F.lower(F.regexp_extract("path", r"([^/]+)$", 1)).alias("name"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parent"),
        F.regexp_extract("path", r"^(.*)/[^/]+/[^/]+$", 1).alias("base"),
    ).where(F.col("name").endswith(".csv") & ((F.col("parent") == "processed") | F.col("parent").endswith("_data")))
    source = F.coalesce(*(F.when(F.col("name").startswith(p), F.lit(s)) for s, (p, _) in SOURCES.items()))
    routed = parts.withColumn("source", source).where("source is not null")
    done = routed.where("parent = 'processed'").select("source", "base").distinct()
    raw = routed.where("parent <> 'processed'").join(done, ["source", "base"], "left_anti")
    return routed.where("parent = 'processed'").select("path", "source").union(raw.select("path", "source"))


def discover(spark: SparkSession, root: str) -> DataFrame:
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root)
    return prefer_processed(listed.select("path"))


def read_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All columns as text, with the file's path (file) and the row's place in it (row)."""
    rows = spark.read.csv(paths, header=True, encoding="UTF-8", mode="PERMISSIVE", inferSchema=False)
    clean = [F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in rows.columns]
    return rows.select(*clean, F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _time(df: DataFrame, source: str) -> Column:
    return S.first_time(*(_column(df, c) for c in SOURCES[source][1]))


def _node(df: DataFrame, city: Column) -> Column:
    return S.node_id(F.coalesce(F.nullif(F.trim(_column(df, "node")), F.lit("")), _column(df, "node_key")), city)


def _observed(df: DataFrame) -> DataFrame:
    made = df if "related_node_ids" in df.columns else df.withColumn("related_node_ids", F.array().cast("array<string>"))
    made = made if "direction" in df.columns else made.withColumn("direction", S.direction(F.col("source"), F.col("metric")))
    return made.select(*OBSERVATION)


def bad_rows(df: DataFrame, source: str) -> DataFrame:
    """(source, files, rows, bad_rows) of one source's raw rows."""
    ts, city = _time(df, source), S.city_of_path(F.col("file"))
    bad = ts.isNull()
    if source == "netflow":
        bad = bad | _node(df, city).isNull() | S.number(_column(df, "packets")).isNull() | S.number(_column(df, "bytes")).isNull()
    if source == "traffic":
        blank = lambda c: F.coalesce(F.trim(_column(df, c)), F.lit("")) == ""
        bad = bad | blank("flow_type") | blank("source_region") | blank("target_region")
    return df.agg(
        F.lit(source).alias("source"), F.countDistinct("file").alias("files"), F.count("*").alias("rows"), F.count_if(bad).alias("bad_rows")
    )


def dense(df: DataFrame, source: str) -> DataFrame:
    """node, interface, routing and scrape rows: a row for each measure that has a value."""
    city = S.city_of_path(F.col("file"))
    base = df.withColumn("ts", _time(df, source)).withColumn("node_id", _node(df, city)).where("ts is not null and node_id is not null")
    if source == "routing":
        rows = base.withColumn("metric", F.concat(F.lit("routing."), F.trim("metric_name"))).withColumn("raw", F.col("value"))
        dims = S.label_dimensions(F.col("label"))
    else:
        measures = [c for c in df.columns if c not in IDENTITY and c not in ("file", "row")]
        pairs = F.array(*(F.struct(F.lit(f"{source}.{c}").alias("metric"), F.col(c).alias("raw")) for c in measures))
        keys = {"interface": ["interface_id", "if_role"], "scrape": ["target_id", "exporter_type"]}.get(source, [])
        rows = base.select("*", F.inline(pairs))
        dims = S.dimensions(**{k: _column(df, k) for k in keys}) if keys else F.create_map().cast("map<string,string>")
    rows = rows.withColumn("value", S.number(F.col("raw"))).where("value is not null")
    return _observed(rows.withColumn("source", F.lit(source)).withColumn("dimensions", dims))


def counter_rates(df: DataFrame, by: list[str], ts: str, order: list[str], value: str, per_minute: bool = True) -> DataFrame:
    """df with delta, rate and reset from each row's predecessor in its series; the first row of a series gets none.

    A value below its predecessor is a counter that began anew. Without per_minute the rate is the
    delta. Rows at the time of their predecessor, or before it, get none but still precede the next.
    """
    w = W.partitionBy(*by).orderBy(*order)
    before, was = F.lag(value).over(w), F.lag(ts).over(w)
    df = df.withColumn("_v", before).withColumn("_t", was)
    elapsed = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp"))) / 60e6
    df = df.withColumn("reset", F.col(value) < F.col("_v"))
    ok = (elapsed > 0) if per_minute else F.col("_v").isNotNull()
    delta = F.when(ok, F.when(F.col("reset"), F.col(value)).otherwise(F.col(value) - F.col("_v")))
    df = df.withColumn("delta", delta).withColumn("rate", F.when(ok, delta / elapsed if per_minute else delta))
    return df.drop("_v", "_t")


def traffic(df: DataFrame, per_minute: bool = True, clamp: bool = True) -> DataFrame:
    """Traffic rows: gauges, counter rates, success and error ratios, and a mark where a counter began anew."""
    lower = lambda c: F.lower(F.trim(_column(df, c)))
    dims = S.dimensions(**{c: _column(df, c) for c in ("series_key", "flow_type", "source_region", "target_region", "target_domain", "protocol")})
    base = (
        df.withColumn("ts", _time(df, "traffic"))
        .withColumn("flow", lower("flow_type"))
        .withColumn("src", lower("source_region"))
        .withColumn("dst", lower("target_region"))
        .where("ts is not null and flow <> '' and src <> '' and dst <> ''")
        .withColumn("dimensions", dims)
        .withColumn("node_id", S.node_id(F.lit("traffic-vm"), F.col("src")))
        .withColumn("related_node_ids", S.service_nodes(F.col("dst")))
        .withColumn("identity", F.coalesce(_column(df, "series_key"), F.to_json(F.map_entries("dimensions"))))
    )
    blocks = [c for c in df.columns if "_flow_" in c]
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in blocks))
    keep = ["ts", "node_id", "related_node_ids", "dimensions", "identity", "flow", "file", "row"]
    long = base.select(*keep, F.inline(cells)).where(F.col("field").startswith(F.concat("flow", F.lit("_flow_"))))
    long = long.withColumn("suffix", F.expr("substr(field, length(flow) + 7)")).withColumn("value", S.number(F.col("raw"))).where("value is not null")
    counted = counter_rates(long.where(S.is_counter(F.col("suffix"))), ["file", "identity", "field"], "ts", ["row"], "value", per_minute)
    counted = counted.where("rate is not null").withColumn("name", S.rate_name(F.col("suffix")))
    named = lambda c: F.concat(F.lit("traffic."), F.col("flow"), F.lit("."), c)
    gauges = long.where(~S.is_counter(F.col("suffix"))).withColumn("metric", named(F.col("suffix")))
    rates = counted.withColumn("metric", named(F.col("name"))).withColumn("value", F.col("rate"))
    of_row = counted.groupBy(*[c for c in keep if c != "dimensions"]).agg(
        F.first("dimensions").alias("dimensions"),
        *(F.max(F.when(F.col("name") == n, F.col("delta"))).alias(n) for n in ("requests_rate", "success_rate", "error_rate")),
        F.bool_or("reset").alias("reset"),
    )
    ratio = lambda c: F.col(c) / F.col("requests_rate")
    bound = (lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))) if clamp else (lambda c: c)
    ratios = of_row.where("requests_rate > 0").select(
        *keep,
        F.inline(F.array(*(F.struct(F.lit(n).alias("name"), bound(ratio(c)).alias("value")) for c, n in (("success_rate", "success_ratio"), ("error_rate", "error_ratio"))))),
    ).where("value is not null").withColumn("metric", named(F.col("name")))
    resets = of_row.where("reset").withColumn("metric", named(F.lit("counter_reset"))).withColumn("value", F.lit(1.0)).withColumn("direction", F.lit("state"))
    parts = [_observed(x.withColumn("source", F.lit("traffic"))) for x in (gauges, rates, ratios, resets)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def flow_groups(df: DataFrame, by: list[str], packets: str, volume: str, records: str, addresses: dict[str, str], share_of: list[str]) -> DataFrame:
    """Sums, distinct addresses and ports, and each group's share of the bytes of share_of."""
    distinct = [F.countDistinct(F.nullif(F.col(c), F.lit(""))).alias(name) for name, c in addresses.items()]
    groups = df.groupBy(*by).agg(F.sum(packets).alias("packets"), F.sum(volume).alias("bytes"), F.sum(records).alias("flow_records"), *distinct)
    total = F.sum("bytes").over(W.partitionBy(*share_of))
    return groups.withColumn("protocol_byte_share", F.when(total > 0, F.col("bytes") / total).otherwise(0.0))


def netflow(df: DataFrame) -> DataFrame:
    city = S.city_of_path(F.col("file"))
    rows = (
        df.withColumn("ts", _time(df, "netflow"))
        .withColumn("node_id", _node(df, city))
        .withColumn("p", S.number(F.col("packets")))
        .withColumn("b", S.number(F.col("bytes")))
        .withColumn("r", F.coalesce(S.number(_column(df, "flow_record_count")), F.lit(0.0)))
        .where("ts is not null and node_id is not null and p is not null and b is not null")
    )
    share = ["file", "ts", "node_id", "interface_id", "if_role"]
    addresses = {"unique_sources": "src_addr", "unique_destinations": "dst_addr", "unique_source_ports": "src_port", "unique_destination_ports": "dst_port"}
    groups = flow_groups(rows, [*share, "protocol"], "p", "b", "r", addresses, share)
    names = ["packets", "bytes", "flow_records", *addresses, "protocol_byte_share"]
    cells = F.array(*(F.struct(F.lit(f"netflow.{n}").alias("metric"), F.col(n).cast("double").alias("value")) for n in names))
    dims = S.dimensions(interface_id=F.col("interface_id"), if_role=F.col("if_role"), protocol=F.col("protocol"))
    return _observed(groups.withColumn("dimensions", dims).select("*", F.inline(cells)).withColumn("source", F.lit("netflow")))


def text_events(df: DataFrame) -> DataFrame:
    """(ts, source, node_id, severity, program, event_family, message); the message at most 240 characters long."""
    city = S.city_of_path(F.col("file"))
    message = F.substring(F.regexp_replace(F.trim(F.coalesce(_column(df, "message"), F.lit(""))), r"\s+", " "), 1, 240)
    return df.select(
        _time(df, "frr").alias("ts"),
        F.lit("frr").alias("source"),
        S.node_id(F.coalesce(F.nullif(F.trim(_column(df, "hostname")), F.lit("")), _column(df, "node")), city).alias("node_id"),
        F.lower(F.coalesce(F.nullif(F.trim(_column(df, "severity")), F.lit("")), F.lit("unknown"))).alias("severity"),
        F.lower(F.coalesce(F.nullif(F.trim(_column(df, "program")), F.lit("")), F.lit("frr"))).alias("program"),
        S.event_family(_column(df, "program"), _column(df, "message")).alias("event_family"),
        message.alias("message"),
        "file",
    ).where("ts is not null")


def scrape_errors(df: DataFrame) -> DataFrame:
    """Text events (as text_events) of the scrape rows that carry an error."""
    error = F.trim(_column(df, "scrape_error"))
    rows = df.where(F.coalesce(~F.lower(error).isin(S.NULL_TOKENS) & (error != ""), F.lit(False)))
    return rows.select(
        _time(df, "scrape").alias("ts"), F.lit("scrape").alias("source"), _node(df, S.city_of_path(F.col("file"))).alias("node_id"), F.lit("error").alias("severity"),
        F.coalesce(F.nullif(F.trim(_column(df, "exporter_type")), F.lit("")), F.lit("exporter")).alias("program"), F.lit("scrape_error").alias("event_family"), error.alias("message"), "file",
    ).where("ts is not null and node_id is not null")


def log_counts(events: DataFrame) -> DataFrame:
    """Observations frr.event_count: lines a minute, node, severity, program and family."""
    by = [F.date_trunc("minute", "ts").alias("ts"), "node_id", "severity", "program", "event_family"]
    counts = events.groupBy(*by).agg(F.count("*").cast("double").alias("value"), F.min("file").alias("file"))
    dims = S.dimensions(severity=F.col("severity"), program=F.col("program"), event_family=F.col("event_family"))
    return _observed(counts.withColumn("dimensions", dims).withColumn("metric", F.lit("frr.event_count")).withColumn("source", F.lit("frr")))


def observations(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(observations, statistics by source) of all files under root."""
    paths: dict[str, list[str]] = {}
    for r in discover(spark, root).collect():  # a list of files
        paths.setdefault(r["source"], []).append(r["path"])
    if not paths:
        raise FileNotFoundError(f"no telemetry files under {root}")
    parts, stats = [], []
    for source in [s for s in SOURCES if s in paths]:
        raw = read_csv(spark, sorted(paths[source]))
        stats.append(bad_rows(raw, source))
        if source == "traffic":
            parts.append(traffic(raw))
        elif source == "netflow":
            parts.append(netflow(raw))
        elif source == "frr":
            parts.append(log_counts(text_events(raw)))
        else:
            parts.append(dense(raw, source))
    all_parts, all_stats = parts[0], stats[0]
    for p, s in zip(parts[1:], stats[1:], strict=True):
        all_parts, all_stats = all_parts.unionByName(p), all_stats.unionByName(s)
    return all_parts, all_stats


def text_observations(spark: SparkSession, root: str) -> DataFrame:
    """The text events of all files under root: log lines and failed scrapes, as text_events gives them."""
    paths: dict[str, list[str]] = {}
    for r in discover(spark, root).where("source in ('frr', 'scrape')").collect():  # a list of files
        paths.setdefault(r["source"], []).append(r["path"])
    parts = [make(read_csv(spark, sorted(paths[source]))) for source, make in (("frr", text_events), ("scrape", scrape_errors)) if source in paths]
    if not parts:
        raise FileNotFoundError(f"no log or scrape files under {root}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
