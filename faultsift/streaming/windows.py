"""Windows of a stream: open ones are state, and each is emitted when its gap has passed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds of a step.
STEP = 60


class _Hysteresis(StatefulProcessor):
    """The steps of a key that windows are kept by, until the watermark has passed the gap after the last of a run."""

    def __init__(self, opens: float, keeps: float, gap: int):
        self.opens, self.keeps, self.gap = opens, keeps, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getMapState("kept", "step long", "energy double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            high = frame[frame["energy"] >= self.keeps]
            for step, energy in zip(high["step"].tolist(), high["energy"].tolist(), strict=True):
                known = self.kept.getValue((step,)) if self.kept.containsKey((step,)) else (energy,)
                self.kept.updateValue((step,), (max(energy, known[0]),))
                self.handle.registerTimer((step + self.gap + 2) * STEP * 1000)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The run whose last step the timer belongs to, if no later step goes on with it."""
        last = expiredTimerInfo.getExpiryTimeInMs() // (STEP * 1000) - self.gap - 2
        held = dict(sorted((k[0], v[0]) for k, v in self.kept.iterator()))
        made = []
        if last in held and not any(last + i in held for i in range(1, self.gap + 2)):
            run, before = [], last
            for step in reversed([s for s in held if s <= last]):
                if before - step > self.gap + 1:
                    break
                run.append(step)
                before = step
            opened = [s for s in run if held[s] >= self.opens]
            if opened:
                made.append((min(opened), last + 1, max(held[s] for s in run)))
            for step in run:
                self.kept.removeKey((step,))
        frame = pd.DataFrame(made, columns=["start", "end", "peak"])
        for i, v in enumerate(key):
            frame.insert(i, f"k{i}", v)
        yield frame

    def close(self) -> None:
        pass


def hysteresis(df: DataFrame, by: list[str], ts: str, energy: str, opens: float = 7.0, keeps: float = 3.0, gap: int = 1, late: str = "10 minutes") -> DataFrame:
    """(by, start, end, peak) of a stream, as segment.hysteresis gives them of a table; steps are minutes since 1970, end is exclusive.

    A window is emitted once the watermark is past the gap after its last step, so rows may come late and out of order
    within the watermark's delay; later ones have no part. Keys are text columns. The session's state store must be RocksDB.
    """
    step = F.floor(F.unix_seconds(ts) / STEP).cast("long")
    rows = df.withWatermark(ts, late).select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), ts, step.alias("step"), F.col(energy).cast("double").alias("energy"))
    keys = [f"k{i}" for i in range(len(by))]
    out = ", ".join(f"{k} string" for k in keys) + ", start long, end long, peak double"
    got = rows.groupBy(*keys).transformWithStateInPandas(_Hysteresis(opens, keeps, gap), out, "Append", "EventTime")
    return got.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), "start", "end", "peak")
