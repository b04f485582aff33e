"""The level channel: numbers of covering windows, and no listing of windows' steps."""

import pytest
from pyspark.sql import functions as F

from faultsift.operators import level, windows


@pytest.mark.parametrize(("width", "stride"), [(120, 30), (7, 3), (5, 5), (3, 8), (1, 1), (10, 4)])
def test_covering_counts_the_listed_windows(spark, width, stride):
    lengths = spark.range(1, 60).select(F.col("id").alias("length"))
    listed = windows.steps(windows.enumerate_windows(lengths, width, stride), width).groupBy("length", "step").agg(F.count("*").alias("n"))
    steps = lengths.select("length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("step"))
    got = steps.select("length", "step", windows.covering(F.col("step"), F.col("length"), width, stride).alias("n"))
    assert sorted(map(tuple, got.where("n > 0").collect())) == sorted(map(tuple, listed.collect()))


def test_no_step_of_a_window_is_listed(spark):
    """One case of a million minutes with three cells: what is joined with them grows with the cells, not with the timeline."""
    cells = spark.createDataFrame([("a", "node", m, "n", "f", float(m % 7)) for m in (0, 500_000, 1_000_000)], "case string, modality string, minute long, entity string, feature string, value double")
    got = level.level_scores(cells, ["case"])
    assert [(r["minute"], r["windows"]) for r in got.orderBy("minute").collect()] == [(0, 1), (500_000, 4), (1_000_000, 1)]
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
