"""Overlapping windows over a timeline and the average of their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts(length: Column, width: int, stride: int) -> Column:
    """The windows' starts: every stride from 0, and one that ends with the timeline; a short timeline has one window."""
    last = F.greatest(F.lit(0).cast("long"), length - width)
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last))))


def enumerate_windows(lengths: DataFrame, width: int, stride: int) -> DataFrame:
    """lengths with window (its number from 0) and start."""
    got = lengths.select("*", F.posexplode(starts(F.col("length"), width, stride)).alias("window", "start"))
    return got


def steps(windows: DataFrame, width: int) -> DataFrame:
    """windows with a row per step that lies in the timeline."""
    last = F.least(F.col("length"), F.col("start") + width) - 1
    return windows.where("length > 0").select("*", F.explode(F.sequence(F.col("start"), last)).alias("step"))


def covering(step: Column, length: Column, width: int, stride: int) -> Column:
    """How many windows of a timeline cover a step (from 0), without listing them."""
    last = F.greatest(F.lit(0).cast("long"), length - width)
    first = F.greatest(F.lit(0).cast("long"), step - width + 1)
    regular = F.greatest(F.lit(0).cast("long"), F.floor(F.least(step, last) / stride) - F.ceil(first / stride) + 1)
    return regular + F.when((last % stride != 0) & (last >= first) & (last <= step), 1).otherwise(0)


def average(scores: DataFrame, by: list[str], score: str) -> DataFrame:
    """(by, score, windows): the mean over the windows that cover a step."""
    return scores.groupBy(*by).agg(F.avg(score).alias(score), F.count("*").alias("windows"))
