"""The calibration of many timelines in one run."""

from faultsift.operators import quantiles, robust


def test_ends_of_many_timelines_are_not_broadcast(spark, monkeypatch):
    hinted = []
    monkeypatch.setattr(robust.F, "broadcast", lambda df: hinted.append(df.columns) or df)
    rows = spark.createDataFrame([(c, "node", m, float(m % 5)) for c in "ab" for m in range(12)], "case string, family string, minute long, score double")
    assert robust.timeline_calibration(rows, ["case", "family"], "minute", "score").count() == 2
    assert hinted == []


def test_quiet_rows_need_no_union(spark):
    """Parts of a union may be dealt to unequal numbers of partitions, and a plan of all steps has too many sorts for a task."""
    rows = spark.createDataFrame([(c, float(i % 9), i) for c in "ab" for i in range(50)], "g string, v double, i long")
    assert "Union" not in quantiles.lowest(rows, ["g"], "v", "i", 0.6)._jdf.queryExecution().executedPlan().toString()
    lines = spark.createDataFrame([(c, "node", m, float(m % 5)) for c in "ab" for m in range(12)], "case string, family string, minute long, score double")
    plan = robust.timeline_calibration(lines, ["case", "family"], "minute", "score")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
