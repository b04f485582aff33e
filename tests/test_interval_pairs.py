"""Pairs of intervals by bins of time and length against all pairs; one large user over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from faultsift.operators import evaluate


@pytest.mark.parametrize("least", [0.0, 0.05, 0.5, 0.9, 1.0])
def test_equal_to_all_pairs(spark, least):
    rng = random.Random(7)
    made = lambda name, n: [(rng.choice("ab"), f"{name}{i}", s, s + rng.choice([0, 1, 2, 3, 7, 20, 64, 500])) for i in range(n) for s in [rng.randint(-200, 400)]]
    t, p = made("t", 120), made("p", 150)
    p += [(u, f"same-{i}", a, b) for u, i, a, b in t[:20]]
    want = {}
    for u, i, a, b in t:
        for v, j, c, d in p:
            if u == v and a < d and c < b:
                x = 2.0 * max(0, min(b, d) - max(a, c)) / ((b - a) + (d - c))
                if x >= least:
                    want[u, i, j] = pytest.approx(x)
    df = lambda rows, name: spark.createDataFrame(rows, f"user string, {name} string, start long, end long")
    got = evaluate.dice_pairs(df(t, "truth_id"), df(p, "prediction_id"), ["user"], least).collect()
    assert len(got) == len({tuple(r)[:3] for r in got})
    assert {tuple(r)[:3]: r["dice"] for r in got} == want


def test_one_user_is_spread(spark):
    """A user with all rows: the join's keys are many, and none has more than a few of them."""
    rows = spark.range(4000).select(F.lit("u").alias("user"), F.col("id").cast("string").alias("truth_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 8).alias("end"))
    spread = evaluate._bins(rows, "start", "end", [0]).groupBy("user", "_class", "_bin").count()
    assert spread.count() > 3000 and spread.agg(F.max("count")).first()[0] <= 3
    got = evaluate.dice_pairs(rows, rows.withColumnRenamed("truth_id", "prediction_id"), ["user"])
    assert got.count() == 4000 and got.where("truth_id <> prediction_id").count() == 0
