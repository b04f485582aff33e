"""Events from point evidence: energies, windows, cuts of long ones, trims where recovery begins, nested evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultsift.operators import detect, segment
from faultsift.operators.events import recovery
from faultsift.sources.staging import staged


def detected(
    points: DataFrame, by: list[str], weights: dict[str, float], opens: float = 7.0, keeps: float = 3.0, gap: int = 1, longest: int = 30, least: int = 1,
    turn: float = 5.0, initial: int = 3,
) -> DataFrame:
    """(by, start, end, peak_minute, confidence, evidence, sources): the events of each case; end is exclusive.

    points: (by, minute, source, node, metric, direction, score). A window that is too long is cut at its quietest inner
    minutes before anything else; then it ends where series that had run one way turn (recovery), and its peak, confidence
    and evidence are those of what is left. evidence: its points, the strongest first, then the earliest, then by metric,
    source and node; sources: how many of them each source has. An event of which nothing is left isn't one.
    """
    energy = staged(detect.minute_energy(points, weights, by=by), "energy")
    windows = segment.hysteresis(energy, by, "minute", "energy", opens, keeps, gap).select(*by, "start", "end")
    parts = segment.split_long(windows, energy, by, "minute", "energy", longest).where(F.col("end") - F.col("start") >= least)
    spread = staged(parts.select(*by, F.col("start").alias("_w"), "start", "end", F.explode(F.expr("sequence(start, end - 1)")).alias("minute")), "windows")
    keys = [*by, "_w"]
    held = spread.join(points, [*by, "minute"])
    turns = recovery(held, keys, ["source", "node", "metric"], turn, max(2, initial))
    last = F.coalesce("recovery", "end")
    kept = held.join(turns, keys, "left").withColumn("end", last).where(F.col("minute") < last)
    point = F.struct((-F.col("score")).alias("_s"), "minute", "metric", "source", "node", "direction", "score")
    whole = F.transform(F.sort_array(F.collect_list(point)), lambda p: p.dropFields("_s"))
    events = kept.groupBy(*keys, "end").agg(whole.alias("evidence"))
    counts = kept.groupBy(*keys, "source").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"))
    inner = spread.drop("end").join(events.select(*keys, "end"), keys).where(F.col("minute") < F.col("end")).join(energy, [*by, "minute"])
    peak = inner.groupBy(*keys).agg(F.max_by("minute", F.struct("energy", -F.col("minute"))).alias("peak_minute"), F.max("energy").alias("_e"))
    confidence = F.least(F.lit(1.0), F.col("_e") / max(opens, 1e-9) / 1.5)
    out = events.join(counts, keys).join(peak, keys)
    return out.select(*by, F.col("_w").alias("start"), "end", "peak_minute", confidence.alias("confidence"), "evidence", "sources")
