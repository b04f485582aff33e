"""Exact quantiles of groups of any size against percentile and sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from faultsift.operators import quantiles

PARTS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def frame(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.random(), float(rng.randint(0, 5)), -(10 ** rng.uniform(-300, 300))])) for _ in range(6000)]
    rows += [("same", 7.0)] * 3000 + [("two", float(i % 2)) for i in range(11)] + [("one", -3.5), ("none", None), ("mixed", None), ("mixed", 2.0), ("inf", math.inf), ("inf", -math.inf), ("inf", 0.0)]
    return spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("least", [3, 50, 10_000])
def test_equal_to_percentile(spark, least):
    df = frame(spark)
    want = df.where("v is not null").groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", PARTS).alias("q"))
    got = quantiles.quantiles(df, ["g"], "v", PARTS, least)
    plain = lambda d: {r["g"]: (r["n"], [str(x) for x in r["q"]]) for r in d.collect()}
    assert plain(got) == plain(want)


def test_no_task_holds_the_hot_group(spark):
    """Six thousand different values of one group: no partition of the cut values comes near them all."""
    df = spark.range(6000).select(F.lit("hot").alias("g"), F.sqrt("id").alias("v"))
    ranks = spark.createDataFrame([("hot", "a", 10), ("hot", "b", 5999), ("hot", "beyond", 6000), ("cold", "a", 0)], "g string, name string, k long")
    sizes, largest = [], quantiles._largest
    file = lambda v: v.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    quantiles._largest = lambda v, keys: sizes.append((largest(v, keys), file(v))) or sizes[-1][0]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["name"]: r["x"] for r in quantiles.ranked_values(df, ["g"], "v", ranks, 100).collect()}
    finally:
        quantiles._largest = largest
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {"a": math.sqrt(10), "b": math.sqrt(5999)}
    assert sizes[0][0] == 6000 and sizes[0][1] < 3000 and sizes[-1][0] <= 100


def test_lowest_takes_ties_in_order(spark):
    rng = random.Random(2)
    rows = [(g, float(rng.randint(0, 4)), i) for g in "ab" for i in range(500)] + [("c", 1.0, 3)] + [("d", 0.5, i) for i in range(9)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double, i long").withColumn("note", F.lit("x"))
    for least in (5, 10_000):
        got = sorted(tuple(r)[:3] for r in quantiles.lowest(df, ["g"], "v", "i", 0.6, least).select("g", "v", "i").collect())
        want = []
        for g in "abcd":
            own = sorted((v, i) for h, v, i in rows if h == g)
            want += [(g, *x) for x in own[: math.ceil(len(own) * 0.6)]]
        assert got == sorted(want)
    assert quantiles.lowest(df, ["g"], "v", "i", 0.6).columns == ["g", "v", "i", "note"]


def test_cuts_are_made_once(spark, monkeypatch):
    """Approximate quantiles that come out different whenever they are computed: values and ranks must go by the same ones."""
    rng = random.Random(3)
    df = spark.createDataFrame([("a", rng.random()) for _ in range(4000)], "g string, v double")
    noise, approx = F.udf(lambda xs: [x + random.random() / 20 for x in xs], "array<double>").asNondeterministic(), F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: noise(approx(*a)))
    want = df.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", PARTS).alias("q")).collect()
    assert quantiles.quantiles(df, ["g"], "v", PARTS, 50).collect() == want


def test_lowest_with_cuts_made_once(spark, monkeypatch):
    """The quietest rows are as many as asked for, whatever approximate quantiles say."""
    rng = random.Random(4)
    rows = [("a", round(rng.expovariate(0.02), 2), i) for i in range(4000)]
    noise, approx = F.udf(lambda xs: [x + random.random() * 5 for x in xs], "array<double>").asNondeterministic(), F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: noise(approx(*a)))
    got = quantiles.lowest(spark.createDataFrame(rows, "g string, v double, i long"), ["g"], "v", "i", 0.6, 50).select("g", "v", "i").collect()
    assert sorted(map(tuple, got)) == sorted(sorted(rows, key=lambda r: r[1:])[:2400])


def test_empty(spark):
    assert quantiles.quantiles(frame(spark).limit(0), ["g"], "v", PARTS).collect() == []
