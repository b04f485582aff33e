"""From scores in time to fault intervals."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def islands(df: DataFrame, by: list[str], step: str, gap: float, name: str = "island") -> DataFrame:
    """df with a number for each run of rows in which no step is more than gap after the one before."""
    w = W.partitionBy(*by).orderBy(step)
    fresh = F.when(F.col(step) - F.lag(step).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(w.rangeBetween(W.unboundedPreceding, 0))).drop("_fresh")


def sessions(points: DataFrame, by: list[str], ts: str, gap: str = "120 seconds") -> DataFrame:
    """(by, start_time, end_time, points): points at most gap apart; the end is a minute after the last."""
    got = points.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("start_time"), F.max(ts).alias("last"), F.count("*").alias("points"))
    return got.select(*by, "start_time", (F.col("last") + F.expr("interval 1 minute")).alias("end_time"), "points")


def hysteresis(df: DataFrame, by: list[str], step: str, energy: str, opens: float = 7.0, keeps: float = 3.0, gap: int = 1) -> DataFrame:
    """(by, start, end, peak): opened by a step with energy opens, kept while steps with keeps are at most gap missing apart; end is exclusive."""
    rows = islands(df.where(F.col(energy) >= keeps), by, step, gap + 1)
    got = rows.groupBy(*by, "island").agg(
        F.min(F.when(F.col(energy) >= opens, F.col(step))).alias("start"), (F.max(step) + 1).alias("end"), F.max(energy).alias("peak")
    )
    return got.where("start is not null").drop("island")


def split_long(windows: DataFrame, scores: DataFrame, by: list[str], step: str, energy: str, longest: int = 30) -> DataFrame:
    """(by, start, end) with windows longer than longest cut at the inner step of least energy, again and again.

    windows is (by, start, end), scores (by, step, energy); a step without a row has no energy. Windows that are
    short enough pass as they are; the steps of the others are listed, so this is an equality join.
    """
    fits = F.col("end") - F.col("start") <= longest
    short = windows.where(fits).select(*by, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    spread = windows.where(~fits).select(*by, F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.expr("sequence(start, end - 1)")).alias(step))
    lows = spread.join(scores.select(*by, step, energy), [*by, step], "left").na.fill(0.0, [energy])
    packed = lows.groupBy(*by, "_s", "_e").agg(F.map_from_entries(F.collect_list(F.struct(step, energy))).alias("energy"))
    fields = windows.select(*by).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def cut(batches):
        for frame in batches:
            out = []
            for row in frame.to_dict("records"):
                held = dict(row["energy"])
                todo = [(int(row["_s"]), int(row["_e"]))]
                while todo:
                    a, b = todo.pop()
                    if b - a <= longest:
                        out.append([row[c] for c in by] + [a, b])
                    else:
                        at = min(range(a + 1, b), key=lambda m: (held.get(m, 0.0), m))
                        todo += [(a, at), (at, b)]
            yield pd.DataFrame(out, columns=[*by, "start", "end"])

    return short.unionByName(packed.mapInPandas(cut, f"{fields}, start long, end long"))


@dataclass(frozen=True)
class Decoder:
    """Weights of the interval decoder."""

    opens: float = 0.80
    keeps: float = 0.40
    event_penalty: float = 0.55
    peak_bonus: float = 0.50
    boundary_bonus: float = 0.50
    change: float = 0.20
    longest: int = 30
    gap: int = 20
    close_penalty: float = 0.50
    duration: float = 0.08
    recovery: float = 0.30
    evidence: float = 0.20
    z: float = 3.0


def candidates(timeline: DataFrame, by: list[str], d: Decoder = Decoder()) -> DataFrame:
    """(by, start, end, score, confidence) of the intervals worth taking; end is inclusive.

    timeline is (by, i, p, support): a probability for every step from 0, and the part of the
    observed families that stand out there (null where fewer than two are observed). Each start is
    joined with the steps after it, as many as the longest interval has.
    """
    w = W.partitionBy(*by).orderBy("i")
    rows = timeline.withColumn("before", F.lag("p").over(w)).withColumn("after", F.lead("p").over(w))
    p, was = F.col("p"), F.col("before")
    jump = p - was >= d.change
    starts = rows.where((p >= d.keeps) & (((p >= d.opens) & (was.isNull() | (was < d.opens) | jump)) | ((was < d.keeps) & jump)))
    starts = starts.select(*by, F.col("i").alias("start"), F.col("p").alias("p_start"), F.col("before").alias("p_before"))
    spread = starts.withColumn("i", F.explode(F.sequence(F.col("start"), F.col("start") + d.longest - 1)))
    pairs = spread.join(rows, [*by, "i"])
    run = W.partitionBy(*by, "start").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    length = (F.col("i") - F.col("start") + 1).cast("double")
    drop = F.when(F.col("after").isNotNull(), F.greatest(F.lit(0.0), F.col("p") - F.col("after"))).otherwise(0.0)
    onset = F.when(F.col("p_before").isNotNull() & (F.col("p_start") >= d.opens), F.greatest(F.lit(0.0), F.col("p_start") - F.col("p_before"))).otherwise(0.0)
    leave = F.when(F.col("p") >= d.opens, drop).otherwise(0.0)
    score = (
        F.avg(F.greatest(F.lit(0.0), F.col("p") - d.keeps)).over(run) * F.sqrt(length)
        + F.least(F.log(length), F.lit(math.log(d.longest))) * d.duration
        + F.greatest(F.lit(0.0), F.max("p").over(run) - d.opens) * d.peak_bonus
        + (onset + leave) * d.boundary_bonus
        + drop * d.recovery
        + F.coalesce(F.avg("support").over(run), F.lit(0.0)) * d.evidence
        - d.event_penalty
    )
    out = pairs.select(*by, "start", F.col("i").alias("end"), score.alias("score"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("p").over(run))).alias("confidence"))
    return out.where("score > 0")


def chosen(offers: list[tuple[int, int, float, float]], d: Decoder = Decoder()) -> list[tuple[int, int, float]]:
    """The best set of candidates (start, end, score, confidence; in the order of start and end) that do not overlap.

    One soon after another costs a fee that falls with the steps between them, to nothing at the gap. For each end the
    best chain up to it is kept, with the end before it; of equal chains the one with the later end stands.
    """
    best: dict[int, tuple[float, int, float, int | None]] = {}
    far: tuple[float, int | None] = (0.0, None)  # the best chain whose end is a gap away, or none at all
    seen = offers[0][0] if offers else 0
    last = None
    for s, e, v, c in offers:
        if s != last:
            last = s
            while seen < s - d.gap:
                if seen in best and best[seen][0] >= far[0]:
                    far = (best[seen][0], seen)
                seen += 1
            base = far
            for free in range(min(d.gap, s - seen) - 1, -1, -1):
                before = s - 1 - free
                if before in best:
                    value = best[before][0] - d.close_penalty * (d.gap - free) / d.gap
                    if value >= base[0]:
                        base = (value, before)
        if e not in best or base[0] + v > best[e][0]:
            best[e] = (base[0] + v, s, c, base[1])
    top = max(best.items(), key=lambda x: (x[1][0], x[0]), default=(None, (0.0, 0, 0.0, None)))
    out, at = [], top[0] if top[1][0] > 0 else None
    while at is not None:
        _, s, c, before = best[at]
        out.append((s, at + 1, c))
        at = before
    return out[::-1]


def decode(timeline: DataFrame, by: list[str], d: Decoder = Decoder()) -> DataFrame:
    """(by, start, end, confidence): the best set of intervals that do not overlap; end is exclusive.

    Only the choice among the candidates is sequential. An interval soon after another costs more, the sooner
    the more; beyond the gap it costs nothing, so candidates that lie further apart than that are chosen from
    independently. Such stretches are dealt to tasks, which go through them one by one.
    """
    w = W.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("start") - reach - 1 < d.gap, 0).otherwise(1)
    found = candidates(timeline, by, d).withColumn("_fresh", fresh).withColumn("_stretch", F.sum("_fresh").over(w)).drop("_fresh")
    keys = [f"_k{i}" for i in range(len(by))]
    rows = found.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), "_stretch", "start", "end", "score", "confidence")
    fields = ", ".join(f"{k} {f.dataType.simpleString()}" for k, f in zip(keys, timeline.select(*by).schema.fields, strict=True))

    def run(batches):
        now, offers, out = None, [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                name = row[: len(keys) + 1]
                if name != now:
                    out += [(*now[:-1], *x) for x in chosen(offers, d)] if offers else []
                    now, offers = name, []
                offers.append(row[len(keys) + 1 :])
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema)
                out = []
        out += [(*now[:-1], *x) for x in chosen(offers, d)] if offers else []
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema)

    names = [*keys, "start", "end", "confidence"]
    kinds = T.StructType.fromDDL(f"{fields}, start long, end long, confidence double")
    schema = to_arrow_schema(kinds)
    dealt = rows.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "start", "end")
    return dealt.mapInArrow(run, kinds).select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), "start", "end", "confidence")
