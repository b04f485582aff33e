from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultsift.llm import mixing

WEIGHTS = {"a": 5, "b": 3, "c": 1, "*": 2}


@pytest.mark.parametrize("weights", [WEIGHTS, {"a": 1}, {"a": 7, "b": 7}, {"x": 1, "y": 30, "z": 2}, {"a": 9, "b": 4, "c": 4, "d": 2, "e": 1}])
def test_schedule_deviates_by_less_than_a_block(spark, weights):
    rows = sorted(mixing.schedule(spark, weights).collect(), key=lambda r: r["slot"])
    total, done = sum(weights.values()), Counter()
    assert [r["slot"] for r in rows] == list(range(total))
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"] and r["k"] == done[r["stream"]]
        done[r["stream"]] += 1
        assert all(abs(done[s] - w * (r["slot"] + 1) / total) < 1 for s, w in weights.items())
    assert done == weights


def docs(spark):
    rows = [(i, "ab"[i % 2] if i % 5 else None, "x" * (i % 37)) for i in range(400)]
    rows += [(None, "a", "t"), (None, "a", "t"), (7, "c", None), (8, "zzz", ""), (9, "b", "y" * 500)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"block": F.lit("clash"), "n": F.lit(1), "_s": F.lit(2)})


def test_mix_keeps_every_row_and_the_shares(spark):
    df = docs(spark)
    got = mixing.mix(df, WEIGHTS, block_units=100, bucket_rows=16)
    rows = got.collect()
    assert got.columns[: len(df.columns)] == df.columns and len(rows) == df.count()
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in rows) == Counter((r["doc_id"], r["source"], r["text"]) for r in df.collect())
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in rows)
    streams = {}
    for r in sorted(rows, key=lambda r: (r["mix_slot"], r["mix_at"])):
        streams.setdefault(r["mix_stream"], []).append((r["mix_block"], r["mix_at"], r["mix_units"]))
    for parts in streams.values():  # each stream's characters follow each other without gap or overlap
        at = 0
        for block, place, units in parts:
            assert block * 100 + place == at
            at += units
    # while all streams last, each has its share to within a block
    last = min(max(r["mix_slot"] for r in rows if r["mix_stream"] == s) for s in WEIGHTS)
    for t in range(1, last):
        for s, w in WEIGHTS.items():
            blocks = {r["mix_block"] for r in rows if r["mix_stream"] == s and r["mix_slot"] < t}
            upto = max(blocks, default=-1) + 1
            assert upto <= w * t / 11 + 1


def test_bucket_size_does_not_matter(spark):
    df = docs(spark).select("doc_id", "source", "text")
    a, b = (sorted(map(str, mixing.mix(df, WEIGHTS, block_units=64, bucket_rows=n).collect())) for n in (8, 10_000))
    assert a == b


def test_mix_empty_and_bad_weights(spark):
    assert mixing.mix(docs(spark).limit(0), WEIGHTS).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(spark, {"a": 0})


def test_rows_of_one_id_spread(spark):
    rows = [(None if i % 3 else i, "a" if i % 2 else "z", f"text {i}") for i in range(3000)] + [(9, "a", "t")] * 5
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, WEIGHTS, block_units=1000, bucket_rows=32).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, _, t in rows)
    for s in ("a", "*"):
        at = 0
        for b, p, u in sorted((r["mix_block"], r["mix_at"], r["mix_units"]) for r in got if r["mix_stream"] == s):
            assert b * 1000 + p == at
            at += u
    plan = mixing.mix(df, WEIGHTS, bucket_rows=32)._jdf.queryExecution().toString()
    assert "mix_part" in plan and not any(k in plan for k in ("Python", "Arrow"))
