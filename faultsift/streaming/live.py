"""Streaming forms: minute cells, sessions and counter rates with watermarks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def minute_cells(rows: DataFrame, by: list[str], ts: str, value: str, late: str = "10 minutes") -> DataFrame:
    """Per minute and series the sum, count, min, max and last value of a stream; last is that of the latest time."""
    got = rows.withWatermark(ts, late).groupBy(F.window(ts, "1 minute"), *by)
    got = got.agg(F.sum(value).alias("sum"), F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.max_by(value, ts).alias("last"))
    return got.select(F.col("window.start").alias("minute"), *by, "sum", "count", "min", "max", "last")


def sessions(points: DataFrame, by: list[str], ts: str, gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    got = points.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by)
    return got.agg(F.min(ts).alias("start_time"), F.max(ts).alias("last"), F.count("*").alias("points")).drop("w")


def strengths(cells: DataFrame, references: DataFrame, by: list[str]) -> DataFrame:
    """Cells of a stream against a batch table of references (by, center, scale): medians can't be kept up exactly."""
    return cells.join(references, by).withColumn("strength", F.greatest(F.lit(0.0), (F.col("last") - F.col("center")) / F.col("scale")))


def counter_rates(rows: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, ts, rate, reset) per minute of a stream of counters, each series' last reading kept as state.

    Readings at or before the last one's time give no rate.
    """
    out = f"{key} string, {ts} timestamp, rate double, reset boolean"

    def advance(name: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        made = []
        for row in pd.concat(frames).sort_values(ts).itertuples(index=False):
            at, now = getattr(row, ts), float(getattr(row, value))
            micros = int(at.value // 1000)
            if last is not None and micros > last[0]:
                reset = now < last[1]
                made.append((name[0], at, (now if reset else now - last[1]) / ((micros - last[0]) / 60e6), reset))
            if last is None or micros >= last[0]:
                last = (micros, now)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(made, columns=[key, ts, "rate", "reset"])

    return rows.groupBy(key).applyInPandasWithState(advance, out, "at long, value double", "append", GroupStateTimeout.NoTimeout)
