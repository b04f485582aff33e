"""Segmentation, detection and evaluation on series with known results."""

import itertools
import random

import numpy as np
import pytest

from faultsift.operators import detect, evaluate, rank, robust, segment
from faultsift.plans import dims
from faultsift.streaming import live
from pyspark.sql import functions as F


def decode(spark, p, **kw):
    rows = [("a", i, float(v), None) for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "g string, i long, p double, support double")
    got = segment.decode(df, ["g"], segment.Decoder(**kw)).collect()
    return sorted((r["start"], r["end"] - 1) for r in got)


def best_total(offered, gap, fee):
    """The largest total over all sets of intervals that do not overlap, by trying every one of them."""
    offered = sorted(offered)

    def go(at, end):
        top = 0.0
        for i in range(at, len(offered)):
            s, e, v = offered[i]
            if end is not None and s <= end:
                continue
            free = gap if end is None else min(gap, s - end - 1)
            top = max(top, v - fee * (gap - free) / gap + go(i + 1, e))
        return top

    return go(0, None)


@pytest.mark.parametrize("seed", range(6))
def test_decoder_takes_the_best_set(spark, seed):
    rng = random.Random(seed)
    p = []
    while len(p) < 70:
        p += [rng.choice([0.02, 0.1, 0.3, 0.5, 0.7, 0.85, 0.93, 0.99])] * rng.randint(1, 6)
    d = segment.Decoder(longest=5, gap=6, close_penalty=rng.choice([0.05, 0.3, 0.6]))
    rows = [("a", i, v, rng.choice([None, 0.0, 0.5, 1.0])) for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "g string, i long, p double, support double")
    offered = [(r["start"], r["end"], r["score"]) for r in segment.candidates(df, ["g"], d).collect()]
    value = {(s, e): v for s, e, v in offered}
    got = sorted((r["start"], r["end"] - 1) for r in segment.decode(df, ["g"], d).collect())
    assert all(a[1] < b[0] for a, b in itertools.pairwise(got))
    total, last = 0.0, None
    for s, e in got:
        free = d.gap if last is None else min(d.gap, s - last - 1)
        total += value[s, e] - d.close_penalty * (d.gap - free) / d.gap
        last = e
    assert offered and total == pytest.approx(best_total(offered, d.gap, d.close_penalty))


def test_decoder_without_candidates_and_at_the_ends(spark):
    assert decode(spark, [0.1, 0.2] * 12) == []
    assert decode(spark, [0.97, 0.97, 0.1] + [0.1] * 60 + [0.1, 0.96, 0.96]) == [(0, 1), (64, 65)]


def test_hysteresis_and_split(spark):
    rows = [("a", m, 7.5) for m in (11, 12, 14, 52, 54, 55)] + [("b", 1, 4.0), ("b", 2, 6.9)]
    df = spark.createDataFrame(rows, "g string, m long, e double")
    got = segment.hysteresis(df, ["g"], "m", "e")
    assert sorted((r["start"], r["end"]) for r in got.collect()) == [(11, 15), (52, 56)]
    long = spark.createDataFrame([("a", m, 3.5 if m in (22, 40) else 8.0) for m in range(5, 60)] + [("b", 3, 9.0)], "g string, m long, e double")
    win = segment.hysteresis(long, ["g"], "m", "e").drop("peak")
    assert sorted(tuple(r) for r in segment.split_long(win, long, ["g"], "m", "e").collect()) == [("a", 5, 22), ("a", 22, 40), ("a", 40, 60), ("b", 3, 4)]


def test_direct_strengths(spark):
    rows = [(m, "n", "node.cpu_usage", 95.0 if 10 <= m < 13 else 10.0) for m in range(90)] + [(m, "n", "scrape.scrape_up", 0.0) for m in range(90)]
    df = spark.createDataFrame(rows, "minute long, entity string, feature string, value double")
    got = {r["minute"]: r["probability"] for r in detect.node_probability(detect.strengths(df, dims.direct_rules(spark))).collect()}
    assert got[11] > 0.8 and got[40] < 0.1
    few = df.where("minute < 2")
    assert detect.strengths(few, dims.direct_rules(spark)).agg(F.max("strength")).first()[0] == 0


def test_match_is_the_best():
    rng = random.Random(3)
    for _ in range(300):
        rows, columns = rng.randint(1, 4), rng.randint(1, 5)
        w = np.array([[rng.choice([0, 0.5, rng.random()]) for _ in range(columns)] for _ in range(rows)])
        got = sum(w[i, j] for i, j in evaluate._assignment(w))
        n, m = w.shape
        small, large = min(n, m), max(n, m)
        best = max(sum((w[i, p[i]] if n <= m else w[p[i], i]) for i in range(small)) for p in itertools.permutations(range(large), small))
        assert got == pytest.approx(best)


def test_interval_match(spark):
    t = spark.createDataFrame([(1, "t1", 0, 100), (1, "t2", 100, 200)], "c int, truth_id string, start long, end long")
    p = spark.createDataFrame([(1, "p1", 10, 110), (1, "p2", 120, 200), (1, "p3", 190, 400), (2, "p4", 0, 100)], "c int, prediction_id string, start long, end long")
    got = {(r["truth_id"], r["prediction_id"]) for r in evaluate.match(t, p, ["c"]).collect()}
    assert got == {("t1", "p1"), ("t2", "p2")}


def test_quiet_and_empty(spark):
    empty = spark.createDataFrame([], "g string, m long, e double")
    assert segment.hysteresis(empty, ["g"], "m", "e").count() == 0
    assert robust.reference(empty, ["g"], "e", 1.0).count() == 0
    assert rank.top(empty, ["g"], "e", ["m"]).count() == 0


def test_stream_cells(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = live.minute_cells(stream, ["event_type"], "ts", "value").writeStream.outputMode("complete").format("memory").queryName("cells").trigger(availableNow=True)
    q.start().awaitTermination()
    got = spark.table("cells").agg(F.sum("count"), F.round(F.sum("sum"), 3)).first()
    want = e.agg(F.count("value"), F.round(F.sum("value"), 3)).first()
    assert tuple(got) == tuple(want)


def test_stream_rates(spark, tmp_path):
    rows = [("a", 0, 10.0), ("a", 60, 40.0), ("a", 120, 5.0), ("b", 0, 1.0), ("a", 120, 9.0)]
    df = spark.createDataFrame(rows, "k string, s long, v double").select("k", F.timestamp_seconds("s").alias("t"), "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    live.counter_rates(stream, "k", "t", "v").writeStream.format("memory").queryName("rates").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["k"], r["rate"], r["reset"]) for r in spark.table("rates").collect())
    assert got == [("a", 5.0, True), ("a", 30.0, False)]
