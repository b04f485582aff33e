"""The level channel: how far cells lie from their features' usual values, by family, averaged over overlapping windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultsift.operators import robust, windows
from faultsift.sources.staging import staged

# Fixed value: no cell counts for more scales than these.
MOST = 25.0


def level_scores(cells: DataFrame, by: list[str], width: int = 120, stride: int = 30, pool: int = 3) -> DataFrame:
    """(by, minute, family, score, windows): the level of each family (modality) in each minute that has cells of it.

    A cell's level is its distance from its feature's median in quartile ranges; an entity's is the mean of its cells', a
    family's the mean of the pool entities with the largest. The timeline of a case (from its first to its last cell) is cut
    into overlapping windows, and a minute's score is the mean over the windows that cover it, whose number is windows.
    """
    scaler = robust.quartile_scaler(cells, ["modality", "feature"], "value")
    z = cells.join(scaler, ["modality", "feature"]).withColumn("z", F.least(F.lit(MOST), F.abs((F.col("value") - F.col("center")) / F.col("scale"))))
    entity = z.groupBy(*by, "modality", "minute", "entity").agg(F.avg("z").alias("level"))
    place = F.row_number().over(W.partitionBy(*by, "modality", "minute").orderBy(F.col("level").desc(), "entity"))
    family = entity.withColumn("_r", place).where(F.col("_r") <= pool).groupBy(*by, F.col("modality").alias("family"), "minute").agg(F.avg("level").alias("score"))
    ends = cells.groupBy(*by).agg(F.min("minute").alias("first"), (F.max("minute") - F.min("minute") + 1).alias("length"))
    # a minute's score is the same in all its windows, so these are counted instead of listed: their steps would be many times the cells
    covered = windows.covering(F.col("minute") - F.col("first"), F.col("length"), width, stride)
    return family.join(ends, by).select(*by, "minute", "family", "score", covered.alias("windows")).where("windows > 0")


def level_probability(cells: DataFrame, by: list[str], width: int = 120, stride: int = 30, pool: int = 3) -> DataFrame:
    """(by, minute, probability) of the two families whose levels stand out most from the quiet part of their case."""
    scores = staged(level_scores(cells, by, width, stride, pool), "levels")
    fitted = robust.timeline_calibration(scores, [*by, "family"], "minute", "score")
    return robust.calibrated_probability(scores, fitted, [*by, "family"], "minute", "score")
