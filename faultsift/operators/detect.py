"""Detectors: rules on robust strengths, service symptoms, log and flow support, five sigma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultsift.functions.scalars import probability
from faultsift.operators.robust import neighbour_support, reference

LEAST_COUNT = 3
MOST_STRENGTH = 16.0
MOST_WEAK_STRENGTH = 2.0


def strengths(cells: DataFrame, rules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, minute, entity, feature, category, strength, immediate) of the cells (by, minute, entity, feature, value) with a rule.

    The strength is the directed distance from the robust reference in scales, zero outside the
    rule's bounds or with fewer than three values, weighted and capped.
    """
    held = cells.where(F.col("value").isNotNull() & ~F.isnan("value")).join(F.broadcast(rules), "feature").where(F.abs("value") < float("inf"))
    ref = reference(held, [*by, "entity", "feature", "floor"], "value", F.col("floor")).drop("floor")
    rows = held.join(ref, [*by, "entity", "feature"])
    inside = (F.col("least").isNull() | (F.col("value") >= F.col("least"))) & (F.col("most").isNull() | (F.col("value") <= F.col("most")))
    raw = F.greatest(F.lit(0.0), F.col("direction") * (F.col("value") - F.col("center")) / F.col("scale")) * F.col("weight")
    cap = F.when(F.col("weight") >= 1, MOST_STRENGTH).otherwise(MOST_WEAK_STRENGTH)
    strength = F.when(inside & (F.col("n") >= LEAST_COUNT), F.least(cap, raw)).otherwise(0.0)
    return rows.select(*by, "minute", "entity", "feature", "category", strength.alias("strength"), (F.col("immediate") & (strength >= 3)).alias("immediate"))


def log_faults(logs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Strength rows of log cells whose feature names a severe line."""
    severe = F.col("feature").rlike("err|crit|alert|warning") & (F.col("value") > 0)
    return logs.where(severe).select(*by, "minute", "entity", "feature", F.lit("routing_fault").alias("category"), F.lit(5.0).alias("strength"), F.lit(True).alias("immediate"))


def node_probability(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, minute, entity, strongest, sustained, immediate, probability); single minutes count less."""
    top = found.groupBy(*by, "minute", "entity").agg(F.max("strength").alias("strongest"), F.bool_or("immediate").alias("immediate"))
    top = neighbour_support(top, [*by, "entity"], "minute", F.col("strongest") >= 2.5, "sustained")
    p = probability(F.col("strongest"))
    return top.withColumn("probability", F.when(F.col("sustained") | F.col("immediate"), p).otherwise(p * 0.55))


def specific_category(scores: dict[str, Column]) -> Column:
    """The category of a minute: disk and memory pressure before all others, else the strongest from 3 up, else null."""
    first = {"disk_io_pressure": 5.0, "memory_pressure": 4.0, "disk_space_pressure": 4.0}
    special = [F.struct(F.when(scores[c] >= t, scores[c]).alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, t) in enumerate(first.items()) if c in scores]
    plain = [F.struct(F.when(s >= 3, s).alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, s) in enumerate(scores.items())]
    best = lambda xs: F.array_max(F.filter(F.array(*xs), lambda x: x["s"].isNotNull()))["c"]
    return F.coalesce(best(special), best(plain)) if special else best(plain)


def failure_symptom(failures: Column, requests: Column) -> Column:
    """Strength of failed requests, clipped to 0..requests; null without requests or where failures are not known."""
    f = F.greatest(F.lit(0.0), F.least(failures, requests))
    return F.when((requests > 0) & failures.isNotNull(), F.least(F.lit(MOST_STRENGTH), f * 15 / (requests + 30)))


def service_symptoms(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, minute, entity, symptom) of traffic edges: failed requests, latency and loss, the strongest."""
    name = F.element_at(F.split("feature", r"\."), -1)
    wide = cells.withColumn("k", name).groupBy(*by, "minute", "entity").agg(
        *(F.max(F.when(F.col("k") == n, F.col("value"))).alias(n) for n in ("requests_rate", "error_rate", "success_rate"))
    )
    failed = wide.select(
        *by, "minute", "entity",
        F.greatest(failure_symptom(F.col("error_rate"), F.col("requests_rate")), failure_symptom(F.col("requests_rate") - F.col("success_rate"), F.col("requests_rate"))).alias("symptom"),
    )
    slow = cells.withColumn("k", name).where("k in ('latency_p95_seconds', 'loss_rate')")
    floor = F.when(F.col("k") == "latency_p95_seconds", 0.25).otherwise(0.03)
    ref = reference(slow.withColumn("floor", floor), [*by, "entity", "feature", "floor"], "value", F.col("floor")).drop("floor")
    least = F.when(F.col("k") == "latency_p95_seconds", 0.5).otherwise(0.05)
    z = F.greatest(F.lit(0.0), F.least(F.lit(MOST_STRENGTH), (F.col("value") - F.col("center")) / F.col("scale")))
    scored = slow.join(ref, [*by, "entity", "feature"]).where(F.col("n") >= LEAST_COUNT).select(*by, "minute", "entity", F.when(F.col("value") >= least, z).otherwise(0.0).alias("symptom"))
    return failed.where("symptom is not null").union(scored).groupBy(*by, "minute", "entity").agg(F.max("symptom").alias("symptom"))


def service_probability(symptoms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, minute, probability) of the strongest symptom of each minute; minutes without a like neighbour count less.

    Neighbours are found by equality with the listed minutes beside active ones, so no task holds the whole timeline.
    """
    top = symptoms.groupBy(*by, "minute").agg(F.max("symptom").alias("symptom"))
    beside = top.where("symptom >= 2.5").select(*by, F.explode(F.array(F.col("minute") - 1, F.col("minute") + 1)).alias("minute")).distinct()
    rows = top.join(beside.withColumn("_near", F.lit(True)), [*by, "minute"], "left")
    sustained = F.coalesce((F.col("symptom") >= 2.5) & F.col("_near"), F.lit(False))
    return rows.select(*by, "minute", (probability(F.col("symptom")) * F.when(sustained, 0.9).otherwise(0.4)).alias("probability"))


def log_support(count: Column, severity: Column) -> Column:
    weight = F.when(severity.isin("err", "crit", "alert", "emerg"), 4.0).when(severity == "warning", 2.0).otherwise(0.0)
    return F.least(F.lit(8.0), F.log1p(count) * weight)


def shift_support(df: DataFrame, by: list[str], step: str, value: str, least_count: int = 20, floor: float = 0.05) -> DataFrame:
    """df with z and support (0 to 4) of a share's distance from its reference, for rows with a like neighbour."""
    rows = df.join(reference(df, by, value, floor), by).where(F.col("n") >= least_count)
    rows = rows.withColumn("z", F.abs((F.col(value) - F.col("center")) / F.col("scale")))
    rows = rows.withColumn("raw", F.greatest(F.lit(0.0), F.least(F.lit(4.0), (F.col("z") - 2.5) / 2)))
    rows = neighbour_support(rows, by, step, F.col("raw") > 0)
    return rows.withColumn("support", F.when(F.col("supported"), F.col("raw")).otherwise(0.0)).drop("raw", "supported")


def five_sigma(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The points beyond five standard deviations of their series' first fifth (three points at least), with their magnitude."""
    w = W.partitionBy(*by)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w)).where("_n >= 4")
    head = F.when(F.col("_i") <= F.greatest(F.lit(3), F.floor(F.col("_n") * 0.2)), F.col(value))
    rows = rows.withColumn("_mean", F.avg(head).over(w)).withColumn("_dev", F.stddev_pop(head).over(w))
    off = F.abs(F.col(value) - F.col("_mean"))
    hit = rows.where((off > F.col("_dev") * 5) | ((F.col("_dev") == 0) & (off > 0)))
    return hit.withColumn("magnitude", off / F.greatest(F.col("_dev"), F.lit(1e-12))).drop("_i", "_n", "_mean", "_dev")


def minute_energy(evidence: DataFrame, weights: dict[str, float], top: int = 3, most: float = 25.0, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(by, minute, energy) of evidence (by, minute, source, score): each source's best scores, then the best source with a quarter of the others' mean."""
    ranked = evidence.withColumn("_r", F.row_number().over(W.partitionBy(*by, "minute", "source").orderBy(F.col("score").desc()))).where(F.col("_r") <= top)
    weight = F.lit(1.0)
    for s, w in weights.items():
        weight = F.when(F.col("source") == s, w).otherwise(weight)
    rest = lambda best, total, n: F.when(n > 1, (total - best) / (n - 1)).otherwise(0.0) * 0.25
    of = ranked.groupBy(*by, "minute", "source").agg(F.max("score").alias("b"), F.sum("score").alias("s"), F.count("*").alias("n"))
    of = of.withColumn("e", F.least(F.lit(most), (F.col("b") + rest(F.col("b"), F.col("s"), F.col("n"))) * weight))
    total = of.groupBy(*by, "minute").agg(F.max("e").alias("b"), F.sum("e").alias("s"), F.count("*").alias("n"))
    return total.select(*by, "minute", F.least(F.lit(most), F.col("b") + rest(F.col("b"), F.col("s"), F.col("n"))).alias("energy"))
