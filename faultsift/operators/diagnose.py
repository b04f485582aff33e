"""From cells to diagnosed events: timelines, decoded events, the evidence of all candidates, records and audit.

Cells are (case, modality, minute, entity, feature, value): operators.cells with the columns in by before them, which
name the recording (case, network, tenant) that a cell belongs to; everything is computed within one, for all of
them in the same jobs. The entity of an edge is source>target>relation. Events are (by, event, start, end) in
minutes, end exclusive; an event's name is different from all others, also of other cases. Cells without a case
(null) take no part.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultsift.functions.scalars import probability, service_nodes, utc_text
from faultsift.operators import classify, detect, rank, segment
from faultsift.operators import events as event_ops
from faultsift.plans import dims
from faultsift.sources.staging import staged

#: Minutes before an event that its signals are compared with.
CONTEXT = 30
#: Fewest flows of a minute whose composition counts, and fewest such minutes of a series.
LEAST_FLOWS, LEAST_MINUTES = 30.0, 20
# The features whose composition is watched.
COMPOSITION = ["protocol_byte_share", "unique_destination_ports", "unique_destinations"]
# For each category, its direct family, the metric that anchors it, the least strength, and whether low is bad.
ANCHORS = [
    ("resource_cpu_high", "cpu_pressure", "node.cpu_usage", 3.0),
    ("firewall_cpu_pressure", "cpu_pressure", "node.cpu_usage", 3.0),
    ("resource_memory_pressure", "memory_pressure", "node.memory_available_ratio", 4.0),
    ("resource_disk_io_pressure", "disk_io_pressure", "node.disk_io_util", 5.0),
    ("resource_disk_space_low", "disk_space_pressure", "node.filesystem_used_ratio", 4.0),
]
#: All candidates: the nodes of the network, in its order.
NODES = [f"{c}-{r}" for c in dims.CITIES for r in dims.ROLES]
#: Stores a table under a name and reads it back, or leaves it as it is.
Keep = Callable[[DataFrame, str], DataFrame]
_NUMBERS = ["direct", "early", "pre", "persistence", "recovery", "log", "traffic_target", "traffic_observer", "netflow"]


def edge_parts(entity: Column) -> dict[str, Column]:
    """source, target and relation of an edge's entity, and the city of a traffic target (else null)."""
    parts = F.split(entity, ">")
    target = F.get(parts, 1)
    city = F.when(target.startswith("service-group:"), F.get(F.split(target, ":"), 1))
    return {"source": F.get(parts, 0), "target": target, "relation": F.get(parts, 2), "city": city}


def edge_nodes(edges: DataFrame) -> DataFrame:
    """(entity, node, part) of edges (entity): target for the three service machines of a traffic target's city,
    observer for a traffic source, flow for the node of a NetFlow interface."""
    rows = edges.select("entity").distinct().withColumns(edge_parts(F.col("entity")))
    traffic = (F.col("relation") == "traffic") & F.col("city").isNotNull()
    ends = F.when(
        traffic,
        F.concat(F.transform(service_nodes(F.col("city")), lambda n: F.struct(n.alias("node"), F.lit("target").alias("part"))), F.array(F.struct(F.col("source").alias("node"), F.lit("observer").alias("part")))),
    ).when(F.col("relation") == "netflow", F.array(F.struct(F.col("source").alias("node"), F.lit("flow").alias("part"))))
    return rows.select("entity", F.inline(ends))


def netflow_support(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, minute, entity, support): shifts of the composition of flows, for minutes with enough flows; the strongest feature.

    Unique counts are taken per flow. A shift counts if its own series shifts a minute before or after, too.
    """
    parts = F.split("feature", r"\.")
    rows = cells.where(F.col("feature").startswith("netflow.")).select(*by, "minute", "entity", F.get(parts, 1).alias("name"), F.element_at(parts, -1).alias("protocol"), "value")
    flows = rows.where("name = 'flow_records'").select(*by, "minute", "entity", "protocol", F.col("value").alias("flows")).where(F.col("flows") >= LEAST_FLOWS)
    held = rows.where(F.col("name").isin(COMPOSITION)).join(flows, [*by, "minute", "entity", "protocol"])
    per_flow = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / F.greatest(F.col("flows"), F.lit(1.0))))
    held = held.withColumn("value", F.when(F.col("name") == "protocol_byte_share", F.col("value")).otherwise(per_flow))
    got = detect.shift_support(held, [*by, "entity", "name", "protocol"], "minute", "value", LEAST_MINUTES, 0.05)
    return got.groupBy(*by, "minute", "entity").agg(F.max("support").alias("support"))


def log_scores(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, minute, entity, score) of log cells frr.<family>.<severity>.count."""
    parts = F.split("feature", r"\.")
    rows = cells.where(F.col("feature").startswith("frr.") & F.col("feature").endswith(".count"))
    return rows.groupBy(*by, "minute", "entity").agg(F.max(detect.log_support(F.greatest(F.col("value"), F.lit(0.0)), F.get(parts, F.size(parts) - 2))).alias("score"))


def timelines(cells: DataFrame, rules: DataFrame, by: tuple[str, ...] = (), keep: Keep = lambda df, _: df) -> dict[str, DataFrame]:
    """What the detectors say of cells.

    direct: strengths by category; node, edge, log: (by, minute, entity, score) for ranking (edges take the larger
    of symptom and flow support); symptoms: (by, minute, entity, symptom); minutes: (by, minute, node, service, probability).
    Flow support never opens an event, so it is no part of minutes. keep may store what several timelines are made of.
    """
    of = lambda m: cells.where(F.col("modality") == m)
    direct = keep(detect.strengths(of("node"), rules, by).unionByName(detect.log_faults(of("log"), by)), "direct")
    nodes = detect.node_probability(direct, by)
    traffic = of("edge").where(F.col("feature").startswith("traffic."))
    symptoms = keep(detect.service_symptoms(traffic, by), "symptoms")
    edge = symptoms.select(*by, "minute", "entity", F.col("symptom").alias("score")).union(netflow_support(of("edge"), by))
    by_node = nodes.groupBy(*by, "minute").agg(F.max("probability").alias("node"))
    minutes = by_node.join(detect.service_probability(symptoms, by).withColumnRenamed("probability", "service"), [*by, "minute"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return {
        "direct": direct,
        "symptoms": symptoms,
        "node": nodes.select(*by, "minute", "entity", F.col("strongest").alias("score")),
        "edge": keep(edge.groupBy(*by, "minute", "entity").agg(F.max("score").alias("score")), "edge"),
        "log": log_scores(of("log"), by),
        "minutes": minutes.select(*by, "minute", zero("node"), zero("service"), F.greatest(zero("node"), zero("service")).alias("probability")),
    }


def family_support(families: DataFrame, by: tuple[str, ...], z: float = 3.0, least: int = 2) -> DataFrame:
    """(by, minute, support): the part of the observed families (by, minute, family, z) whose z is that large.

    Null where fewer than least families are observed; a family without a row, or whose z is null, isn't.
    """
    seen = families.where("z is not null").groupBy(*by, "minute", "family").agg(F.max("z").alias("z")).groupBy(*by, "minute")
    out = seen.agg(F.count("*").alias("n"), F.count_if(F.col("z") >= z).alias("k"))
    return out.select(*by, "minute", F.when(F.col("n") >= least, F.col("k") / F.col("n")).alias("support"))


def spine(cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, first, minute): every minute of each case from its first to its last cell."""
    ends = cells.groupBy(*by).agg(F.min("minute").alias("first"), F.max("minute").alias("_last"))
    return ends.select(*by, "first", F.explode(F.expr("sequence(first, _last)")).alias("minute"))


def decoder_line(cells: DataFrame, lines: dict[str, DataFrame], by: tuple[str, ...]) -> DataFrame:
    """(by, first, minute, i, p, support): the decoder's dense timeline, i from 0.

    The families are devices (node and log cells; the largest direct strength) and services (minutes with a symptom;
    the largest). A minute without evidence has the probability of no strength in its observed family, single.
    """
    devices = cells.where(F.col("modality").isin("node", "log")).select(*by, "minute", F.lit(0.0).alias("z")).distinct()
    devices = devices.unionByName(lines["direct"].select(*by, "minute", F.col("strength").alias("z"))).withColumn("family", F.lit("device"))
    services = lines["symptoms"].where("symptom > 0").select(*by, "minute", F.col("symptom").alias("z"), F.lit("service").alias("family"))
    keys = [*by, "minute"]
    calm = probability(F.lit(0.0))
    seen = devices.select(*keys).distinct().withColumn("_floor", calm * 0.55)
    rows = spine(cells, by).join(lines["minutes"].select(*keys, "probability"), keys, "left").join(family_support(devices.unionByName(services), by), keys, "left").join(seen, keys, "left")
    p = F.greatest(F.coalesce("probability", F.lit(0.0)), F.coalesce("_floor", F.lit(0.0)), calm * 0.4)
    return rows.select(*by, "first", "minute", (F.col("minute") - F.col("first")).alias("i"), p.alias("p"), "support")


def decoded(line: DataFrame, by: tuple[str, ...], decoder: segment.Decoder = segment.Decoder()) -> DataFrame:
    """(by, event, start, end, confidence): the decoder's events in minutes; an event is named by its case and start."""
    found = segment.decode(line, list(by), decoder)
    first = line.groupBy(*by).agg(F.min("first").alias("first"))
    start = F.col("first") + F.col("start")
    return found.join(first, list(by)).select(*by, F.concat_ws(":", *by, start).alias("event"), start.alias("start"), (F.col("first") + F.col("end")).alias("end"), "confidence")


def candidate_parts(events: DataFrame, node: DataFrame, edge: DataFrame, log: DataFrame, nodes: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, event, node, direct, early, pre, persistence, recovery, log, traffic_target, traffic_observer, netflow, observed).

    Every node has a row for every event, whether it was observed or not. Scores are (by, minute, entity, score). The
    steps of the phases are joined once with the scores of all kinds, and all phases summed up in one aggregation.
    """
    scores = node.withColumn("kind", F.lit("node")).unionByName(edge.withColumn("kind", F.lit("edge"))).unionByName(log.withColumn("kind", F.lit("log")))
    met = rank.phases(events, by).join(scores.withColumnRenamed("minute", "step"), [*by, "step"])
    during, score = F.col("phase") == "during", F.col("score")

    def strength(phase: str) -> Column:
        at = F.col("phase") == phase
        got = F.max(F.when(at, score)) * 0.7 + F.sum(F.when(at, score)) / F.max(F.when(at, F.col("length"))) * 0.3
        return F.coalesce(got, F.lit(0.0)).alias(phase)

    steady = F.try_divide(F.sum(F.when(during, score)) / F.max(F.when(during, F.col("length"))), F.max(F.when(during, score)))
    found = met.groupBy(*by, "event", "kind", "entity").agg(
        *(strength(p) for p in ("before", "during", "early", "recovery")), steady.alias("steady"), (F.count_if(during) > 0).alias("seen")
    )
    edges = found.where("kind = 'edge'").join(edge_nodes(edge), "entity")
    own = found.where("kind <> 'edge'").select(*found.columns, F.col("entity").alias("node"), F.col("kind").alias("part"))
    of = lambda part, v: F.when(F.col("part") == part, v)
    more = lambda a: F.greatest(F.lit(0.0), F.col(a) - F.col("before"))
    of = lambda part, v: F.when(F.col("part") == part, v)
    more = lambda a: F.greatest(F.lit(0.0), F.col(a) - F.col("before"))
    all_nodes = events.select(*by, "event", F.explode(F.array(*map(F.lit, nodes or NODES))).alias("node"))
    rows = all_nodes.select("*", F.lit(True).alias("_own")).unionByName(own.unionByName(edges), allowMissingColumns=True)
    held = own.unionByName(edges).where("node is not null").groupBy(*by, "event", "node").agg(
        F.max(of("node", F.col("during"))).alias("direct"),
        F.max(of("node", F.col("early"))).alias("early"),
        F.max(of("node", F.col("before"))).alias("pre"),
        F.max(of("node", F.col("steady"))).alias("persistence"),
        F.max(of("node", more_than("during", "recovery"))).alias("recovery"),
        F.max(of("log", F.col("during"))).alias("log"),
        F.max(of("target", (F.col("during") + F.col("early") * 0.25) / 3)).alias("traffic_target"),
        F.max(of("observer", F.col("during") * 0.025)).alias("traffic_observer"),
        F.sum(of("flow", more("during") * 0.25 + more("early") * 0.10)).alias("netflow"),
        F.bool_or("seen").alias("observed"),
    )
    # nodes without evidence have nothing to shuffle: an event's evidence is packed, and the network's nodes look theirs up
    found = F.struct(*_NUMBERS, "observed")
    packed = held.groupBy(*by, "event").agg(F.map_from_entries(F.collect_list(F.struct(F.col("node"), found.alias("found")))).alias("_held"))
    each = events.select(*by, "event").join(packed, [*by, "event"], "left").select("*", F.explode(F.array(*map(F.lit, nodes or NODES))).alias("node"))
    out = each.select(*by, "event", "node", F.col("_held")[F.col("node")].alias("_found")).select(*by, "event", "node", "_found.*")
    return out.na.fill(0.0, _NUMBERS).na.fill(False, ["observed"]).select(*by, "event", "node", *_NUMBERS, "observed")


def more_than(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(a) - F.col(b))


def roots(parts: DataFrame, k: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, event, node, score, rank) of the k best candidates of each event; scores equal to nine digits stand in the network's order."""
    place = F.array_position(F.array(*map(F.lit, NODES)), F.col("node"))
    scored = parts.select(*by, "event", "node", rank.root_score({c: F.col(c) for c in ("direct", "early", "pre", "recovery", "log", "traffic_target", "traffic_observer", "netflow")}).alias("score"), place.alias("_place"))
    return rank.top(scored.withColumn("_s", F.round("score", 9)), [*by, "event"], "_s", ["_place", "node"], k).drop("_place", "_s")


def _context(events: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, event, phase, minute): the minutes of an event (during) and those before it (before)."""
    first = F.greatest(F.lit(0).cast("long"), F.col("start") - CONTEXT)
    steps = F.explode(F.expr("sequence(_first, end - 1)"))
    rows = events.where("end > start").withColumn("_first", first).select(*by, "event", "start", steps.alias("minute"))
    return rows.select(*by, "event", F.when(F.col("minute") < F.col("start"), "before").otherwise("during").alias("phase"), "minute")


def _signals(events: DataFrame, cells: DataFrame, owners: DataFrame, owner: str, by: tuple[str, ...]) -> DataFrame:
    """(by, event, owner, signal, strength): cells of the entities that an owner has, pooled by feature; the strongest feature."""
    names = classify.signals_of(cells)
    # cells outside the events' minutes go before each of the others is repeated for its owners
    rows = cells.join(names, "feature").join(_context(events, by), [*by, "minute"]).join(owners, ["modality", "entity"])
    keys = [*by, "event", owner, "modality", "feature", "signal"]
    moved = classify.deviation(rows, keys, "value", "phase", F.col("low"), peak=True)
    disk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("peak") / 100))
    strength = F.when(F.col("feature") == "node.disk_io_util", F.col("deviation") * disk).otherwise(F.col("deviation"))
    return moved.groupBy(*by, "event", owner, "signal").agg(F.max(strength).alias("strength"))


def candidate_signals(events: DataFrame, cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, event, node, signal, strength): each node's own cells, its NetFlow edges, and for service machines their city's traffic edges."""
    own = cells.where("modality <> 'edge'").select("modality", "entity", F.col("entity").alias("node")).distinct()
    edges = edge_nodes(cells.where("modality = 'edge'")).where("part <> 'observer'").select(F.lit("edge").alias("modality"), "entity", "node")
    return _signals(events, cells, own.union(edges), "node", by)


def city_signals(events: DataFrame, cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, event, city, signal, strength): all of a city's nodes, its NetFlow edges, and the traffic edges that aim at it."""
    own = cells.where("modality <> 'edge'").select("modality", "entity", city_of(F.col("entity")).alias("city")).distinct()
    at = edge_parts(F.col("entity"))
    edges = cells.where("modality = 'edge'").select("modality", "entity", F.when(at["relation"] == "netflow", city_of(at["source"])).otherwise(at["city"]).alias("city")).distinct()
    return _signals(events, cells, own.union(edges).where("city is not null"), "city", by)


def city_of(node: Column) -> Column:
    return F.get(F.split(node, "-"), 0)


def categories(spark: SparkSession, top5: DataFrame, signals: DataFrame, k: int = 3, by: tuple[str, ...] = (), city: DataFrame | Callable[[DataFrame], DataFrame] | None = None, keep: Keep = lambda df, _: df) -> DataFrame:
    """(by, event, category, p, rank): the k best categories of each event, from the signals of its ranked nodes.

    An event whose candidates have no signal takes those of its first node's city (city: by, event, city, signal,
    strength, or what makes it for events that are given): p is the best one's part of the k best, the others keep their strength's part. Without those, too, it takes the
    default of its first node, with p 0. keep may store what is read more than once.
    """
    keys = [*by, "event"]
    found = top5.join(signals, [*keys, "node"]).withColumn("category", classify.category_of(F.col("signal"), F.col("node")))
    found = found.where("category is not null and strength > 0").groupBy(*keys, "node", "category").agg(F.max("strength").alias("strength"), F.max("score").alias("score"))
    ranked = keep(classify.ranked(spark, classify.mixture(found, keys, "node", "category", "strength", "score"), keys, "p", k), "ranked")
    bare = keep(top5.where("rank = 1").join(ranked.select(*keys).distinct(), keys, "left_anti").select(*keys, "node"), "bare")
    if city is not None:
        city = city(bare.select(*keys)) if callable(city) else city
        met = bare.withColumn("city", city_of(F.col("node"))).join(city, [*keys, "city"]).withColumn("category", classify.category_of(F.col("signal"), F.col("node")))
        of = met.where("category is not null and strength > 0").groupBy(*keys, "category").agg(F.max("strength").alias("p"))
        best = keep(classify.ranked(spark, of, keys, "p", k), "by-city")
        total = best.groupBy(*keys).agg(F.sum("p").alias("_all"))
        ranked = ranked.unionByName(best.join(total, keys).select(*keys, "category", (F.col("p") / F.col("_all")).alias("p"), "rank"))
        bare = bare.join(best.select(*keys).distinct(), keys, "left_anti")
    return ranked.unionByName(bare.select(*keys, classify.default_category(F.col("node")).alias("category"), F.lit(0.0).alias("p"), F.lit(1).alias("rank")))


def overridden(events: DataFrame, lines: dict[str, DataFrame], cells: DataFrame, top5: DataFrame, found: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, event, local, category, confidence, family, anchor, disk) of each event: its best category after the root's direct evidence.

    local: the category before; family: the root's strongest specific family during the event, null if none is strong
    enough; disk: the root's direct disk strength.
    """
    keys = [*by, "event"]
    root = top5.where("rank = 1").select(*keys, F.col("node").alias("entity"))
    during = events.join(root, keys).select(*keys, "entity", F.explode(F.expr("sequence(start, end - 1)")).alias("minute"))
    at = [*by, "minute", "entity"]
    families = dims.FAMILIES
    held = during.join(lines["direct"], at).groupBy(*keys).pivot("category", families).agg(F.max("strength"))
    sure = during.join(detect.node_probability(lines["direct"], by).select(*at, "probability"), at).groupBy(*keys).agg(F.max("probability").alias("_sure"))
    seen = during.join(cells.where("modality = 'node' and feature = 'node.disk_io_util'").select(*at), at).select(*keys).distinct().withColumn("_seen", F.lit(True))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = found.where("rank = 1").withColumnsRenamed({"category": "_local", "p": "_p"}).join(root, keys)
    for part in (held, sure, seen):
        rows = rows.join(part, keys, "left")
    family = detect.specific_category({c: zero(c) for c in families})
    made = event_ops.overridden(F.col("_local"), F.col("_p"), family, zero("_sure"), F.col("entity"), zero("disk_io_pressure"), F.coalesce("_seen", F.lit(False)))
    return rows.select(*keys, F.col("_local").alias("local"), made["category"].alias("category"), made["confidence"].alias("confidence"), family.alias("family"), made["anchor"].alias("anchor"), zero("disk_io_pressure").alias("disk"))


def records(spark: SparkSession, events: DataFrame, top5: DataFrame, category: DataFrame, by: tuple[str, ...], prefix: str = "pred_", seconds: int = 60) -> DataFrame:
    """(by, prediction_id, start_time, end_time, root_cause_top5, fault_category): the sink's form.

    Ids count the events of a case in the order of their starts, after the case's own name. Steps count from 1970 and have that many seconds.
    """
    number = F.row_number().over(W.partitionBy(*by).orderBy("start"))
    place = F.concat(F.lit(prefix), *(F.concat(F.col(c).cast("string"), F.lit("_")) for c in by), F.lpad(number.cast("string"), 6, "0"))
    nodes = top5.groupBy(*by, "event").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("node").alias("network_element_id")))).alias("root_cause_top5"))
    pairs = F.broadcast(dims.taxonomy(spark).select(F.col("fault_name").alias("category"), F.struct(F.col("major").alias("major_category"), F.col("sub").alias("sub_category")).alias("fault_category")))
    time = lambda c: utc_text(F.timestamp_seconds(F.col(c) * seconds))
    rows = events.withColumn("prediction_id", place).join(nodes, [*by, "event"]).join(category.select(*by, "event", "category"), [*by, "event"]).join(pairs, "category")
    return rows.select(*by, "prediction_id", time("start").alias("start_time"), time("end").alias("end_time"), "root_cause_top5", "fault_category")


class Diagnosis:
    """The whole way from cells to records, each step made when it is first asked for.

    Without columns in by, all cells are one case. What several steps read is written once to the shared folder
    (sources.staging), so lost executors cost no more than their own tasks.
    """

    def __init__(self, spark: SparkSession, cells: DataFrame, rules: DataFrame, by: tuple[str, ...] = (), decoder: segment.Decoder = segment.Decoder()):
        self.spark, self.rules, self.decoder = spark, rules, decoder
        self.by, self.cells = (by, cells) if by else (("case",), cells.withColumn("case", F.lit(0)))

    @functools.cached_property
    def lines(self) -> dict[str, DataFrame]:
        """The timelines of all detectors."""
        return timelines(self.cells, self.rules, self.by, staged)

    @functools.cached_property
    def line(self) -> DataFrame:
        return staged(decoder_line(self.cells, self.lines, self.by), "line")

    @functools.cached_property
    def events(self) -> DataFrame:
        return staged(decoded(self.line, self.by, self.decoder), "events")

    @functools.cached_property
    def parts(self) -> DataFrame:
        return staged(candidate_parts(self.events, self.lines["node"], self.lines["edge"], self.lines["log"], by=self.by), "parts")

    @functools.cached_property
    def top5(self) -> DataFrame:
        return staged(roots(self.parts, by=self.by), "roots")

    @functools.cached_property
    def signals(self) -> DataFrame:
        return candidate_signals(self.events, self.cells, self.by)

    @functools.cached_property
    def city_signals(self) -> DataFrame:
        return city_signals(self.events, self.cells, self.by)

    def _signals_of_cities(self, named: DataFrame) -> DataFrame:
        """The city signals of the named events alone, which are few."""
        return city_signals(self.events.join(named, [*self.by, "event"], "left_semi"), self.cells, self.by)

    @functools.cached_property
    def categories(self) -> DataFrame:
        return categories(self.spark, self.top5, self.signals, by=self.by, city=self._signals_of_cities, keep=staged)

    @functools.cached_property
    def final(self) -> DataFrame:
        """Categories after the root's direct evidence."""
        return staged(overridden(self.events, self.lines, self.cells, self.top5, self.categories, self.by), "final")

    def records(self, prefix: str = "pred_", seconds: int = 60) -> DataFrame:
        return records(self.spark, self.events, self.top5, self.final, self.by, prefix, seconds)

    def audit(self) -> DataFrame:
        return audit(self.events, self.lines["minutes"], self.lines["direct"], self.top5.where("rank = 1"), self.final, self.by)


def audit(events: DataFrame, minutes: DataFrame, direct: DataFrame, first: DataFrame, best: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, event, driver, root, category, anchor, city_conflict) of events with their first node and best category.

    The driver is what the event's strongest minute (the earliest of these) stands on; a conflict is a node that
    drives it from another city than the root's. The anchor says whether the root's own direct strength backs the category.
    """
    keys, at = [*by, "event"], [*by, "minute"]
    spread = events.select(*keys, F.explode(F.expr("sequence(start, end - 1)")).alias("minute"))
    top = spread.join(minutes, at).groupBy(*keys).agg(F.max_by(F.struct("minute", "node", "service"), F.struct("probability", -F.col("minute"))).alias("at"))
    peak = top.select(*keys, F.col("at.minute").alias("minute"), F.col("at.node").alias("node_p"), F.col("at.service").alias("service_p"))
    nodes = detect.node_probability(direct, by).select(*at, "entity", "probability")
    tops = peak.join(nodes, at).where(F.abs(F.col("probability") - F.col("node_p")) <= 1e-6).groupBy(*keys).agg(F.count("*").alias("ties"), F.min("entity").alias("driver_node"))
    kind = F.when((F.greatest("node_p", "service_p") <= 0), "undetermined").when((F.abs(F.col("node_p") - F.col("service_p")) <= 1e-6), "ambiguous")
    kind = kind.when(F.col("service_p") > F.col("node_p"), "service").when(F.col("ties") != 1, "ambiguous").otherwise("node")
    table = F.broadcast(spark_table(events.sparkSession))
    held = spread.join(direct, at)
    strong = held.groupBy(*keys, F.col("entity").alias("root"), F.col("category").alias("family")).agg(F.max("strength").alias("strength"))
    seen = held.select(*keys, F.col("entity").alias("root"), F.col("feature").alias("metric")).distinct().withColumn("seen", F.lit(True))
    out = peak.join(tops, keys, "left").withColumn("driver", kind)
    out = out.join(first.select(*keys, F.col("node").alias("root")), keys).join(best.select(*keys, "category"), keys).join(table, "category", "left")
    out = out.join(strong, [*keys, "root", "family"], "left").join(seen, [*keys, "root", "metric"], "left")
    status = F.when(F.col("metric").isNull(), "not_evaluated").when(F.col("seen").isNull(), "undetermined").when(F.col("strength") >= F.col("least"), "supported").otherwise("unsupported")
    conflict = F.coalesce((F.col("driver") == "node") & (city_of(F.col("driver_node")) != city_of(F.col("root"))), F.lit(False))
    return out.select(*keys, "driver", "root", "category", status.alias("anchor"), conflict.alias("city_conflict"))
def spark_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANCHORS, "category string, family string, metric string, least double")


def audit_counts(audited: DataFrame) -> DataFrame:
    """(kind, value, n): how often each driver, category and anchor status occurs, and the conflicts."""
    flags = {"unsupported_disk": (F.col("category") == "resource_disk_io_pressure") & (F.col("anchor") == "unsupported"), "city_conflict": F.col("city_conflict")}
    pairs = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("driver", "category", "anchor")]
    pairs += [F.struct(F.lit("flag").alias("kind"), F.when(v, k).alias("value")) for k, v in flags.items()]
    return audited.select(F.inline(F.array(*pairs))).where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))
