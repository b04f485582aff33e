"""Column expressions: parsing, normalising and naming of telemetry fields."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultsift.plans.dims import CITIES, ROLES

# Cells that mean "no value"; the last is a backslash and an n (or N).
NULL_TOKENS = ["", "null", "none", "nan", "\\n"]
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def has(text: Column, *tokens: str) -> Column:
    """Whether text holds one of the tokens."""
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(text, F.lit(t))
    return out


def number(c: Column) -> Column:
    """A finite double, or null for null tokens and what is no decimal number."""
    t = F.trim(c)
    ok = ~F.lower(t).isin(NULL_TOKENS) & t.rlike(_NUMBER)
    v = F.when(ok, t.try_cast("double"))
    return F.when(F.abs(v) < float("inf"), v)


def parse_time(c: Column) -> Column:
    """A UTC time; one without an offset is UTC, what can't be read is null."""
    return F.try_to_timestamp(F.trim(F.translate(c, '"', "")))


def parse_utc(c: Column) -> Column:
    """As parse_time, but null without a Z or an offset."""
    return F.when(F.trim(c).rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.trim(c)))


def first_time(*candidates: Column) -> Column:
    return F.coalesce(*map(parse_time, candidates))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def minute_of(ts: Column) -> Column:
    """Whole minutes since 1970."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 60).cast("long")


def dimensions(**columns: Column) -> Column:
    """A map of the trimmed values that are not blank, null or none."""
    pairs = [x for k, v in columns.items() for x in (F.lit(k), F.trim(v))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & ~F.lower(v).isin("", "null", "none"))


def label_dimensions(label: Column) -> Column:
    """A map of the pairs key="value"; other text stands under the key label. The last of equal keys wins."""
    # a name begins where none goes on, and nothing is given back: a long word is read once
    pattern = r'(?<![A-Za-z_])([A-Za-z_][A-Za-z0-9_]*+)\s*+=\s*+"([^"]*+)"'
    found = F.struct(F.regexp_extract_all(label, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(label, F.lit(pattern), F.lit(2)).alias("v"))

    def last(d: Column) -> Column:
        back = F.reverse(d["v"])
        names, turned = F.array_distinct(d["k"]), F.reverse(d["k"])
        return _let(F.struct(names.alias("k"), turned.alias("r"), back.alias("v")), lambda x: F.map_from_arrays(x["k"], F.transform(x["k"], lambda n: F.get(x["v"], (F.array_position(x["r"], n) - 1).cast("int")))))

    text = F.trim(label)
    plain = F.when(F.length(text) > 0, F.create_map(F.lit("label"), text)).otherwise(F.create_map().cast("map<string,string>"))
    return _let(found, lambda d: F.when(F.size(d["k"]) > 0, last(d)).otherwise(plain))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once per row, also where use names it within a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def city_of_path(path: Column, cities: list[str] = CITIES) -> Column:
    """The first city (in their order) that a path component equals or begins with, before _ or -."""
    low = F.lower(path)
    return F.coalesce(*(F.when(low.rlike(rf"(^|/){c}([_/-]|$)"), F.lit(c)) for c in cities))


def node_id(name: Column, city: Column, roles: list[str] = ROLES) -> Column:
    """<city>-<role> for the longest role that the name holds, else null."""
    low = F.replace(F.lower(name), F.lit("_"), F.lit("-"))
    role = F.coalesce(*(F.when(F.contains(low, F.lit(r)), F.lit(r)) for r in sorted(roles, key=len, reverse=True)))
    return F.when(role.isNotNull() & city.isNotNull(), F.concat(F.lower(city), F.lit("-"), role))


def direction(source: Column, metric: Column) -> Column:
    """Which way a metric is bad: high, low or both."""
    m = F.lower(metric)
    return (
        F.when((source == "node") & has(m, "memory_available"), "low")
        .when((source == "interface") & has(m, "drop", "error", "carrier"), "high")
        .when((source == "routing") & has(m, "peer_up", "enabled", "route_exists", "command_success", "state_code"), "low")
        .when((source == "scrape") & has(m, "scrape_up", "samples"), "low")
        .when(source == "scrape", "high")
        .when((source == "traffic") & has(m, "success_ratio", "throughput", "observed_qps"), "low")
        .when((source == "traffic") & has(m, "error", "timeout", "latency", "loss", "retransmit", "jitter"), "high")
        .when(source == "frr", "high")
        .otherwise("both")
    )


def is_counter(field: Column) -> Column:
    return field.rlike("(_total|_sum|_count)$|_bucket_le_")


def rate_name(field: Column) -> Column:
    """The name of a counter's rate."""
    return (
        F.when(field.endswith("_total"), F.regexp_replace(field, "_total$", "_rate"))
        .when(field.endswith("_sum"), F.concat(field, F.lit("_rate")))
        .when(field.endswith("_count"), F.concat(field, F.lit("_rate")))
        .when(F.contains(field, F.lit("_bucket_le_")), F.replace(field, F.lit("_bucket_le_"), F.lit("_bucket_rate_le_")))
        .otherwise(F.concat(field, F.lit("_rate")))
    )


def service_nodes(city: Column) -> Column:
    """The three service machines of a city."""
    return F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda i: F.concat(city, F.lit("-service-vm-"), i.cast("string")))


def event_family(program: Column, message: Column) -> Column:
    """The family of a log line by its words, the first that fits."""
    t = F.lower(F.concat_ws(" ", program, message))
    return (
        F.when(has(t, "bgp"), "bgp")
        .when(has(t, "ospf"), "ospf")
        .when(has(t, "route", "rib", "nexthop", "zebra"), "route")
        .when(has(t, "interface", "link", "carrier"), "interface")
        .when(has(t, "config", "command", "reload"), "config")
        .when(has(t, "process", "signal", "crash", "exit"), "process")
        .otherwise("other")
    )


def token(c: Column, fallback: str = "unknown") -> Column:
    """Lower case, other characters than a-z 0-9 _ - as underscores, none of these at the ends."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9_\-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))


def aggregation(direction_: Column, metric: Column) -> Column:
    """How the observations of a cell are put together."""
    summed = has(F.lower(metric), "bytes", "packets", "flow_records", "requests_rate", "success_rate", "error_rate", "event_count")
    return F.when(direction_ == "low", "min").when(summed, "sum").otherwise("max")


def probability(strength: Column, center: float = 3.0, width: float = 0.9) -> Column:
    x = (strength - center) / width
    return 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))))


def severity_score(severity: Column) -> Column:
    """The score of a log line by its severity."""
    scores = {"emerg": 25, "alert": 22, "crit": 18, "err": 14, "warning": 9, "notice": 6, "info": 4, "debug": 2}
    out = F.lit(5.0)
    for name, score in reversed(scores.items()):
        out = F.when(F.lower(severity) == name, float(score)).otherwise(out)
    return out


def role_flags(node: Column) -> dict[str, Column]:
    return {
        "is_service": F.contains(node, F.lit("-service-vm-")),
        "is_firewall": node.endswith("-fw"),
        "is_router": node.rlike("-(br|cr)-[0-9]+$"),
        "is_traffic": node.endswith("-traffic-vm"),
    }


def phase_features(minute: Column) -> dict[str, Column]:
    """Sine and cosine of the place in the day and in the week (from Monday)."""
    day = minute % 1440
    week = (minute + 3 * 1440) % 10080
    turn = 2 * math.pi
    return {
        "day_sin": F.sin(day / 1440 * turn),
        "day_cos": F.cos(day / 1440 * turn),
        "week_sin": F.sin(week / 10080 * turn),
        "week_cos": F.cos(week / 10080 * turn),
    }


def dice(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Twice the overlap of two intervals over the sum of their lengths; 0 if both are empty."""
    overlap = F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))
    return F.coalesce(F.try_divide(2.0 * overlap, (end_a - start_a) + (end_b - start_b)), F.lit(0.0))
