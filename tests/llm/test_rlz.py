import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultsift.llm import rlz


def brute(rows, n):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((-1 if i is None else i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = "a b c d é f".split()
    passages = [[rng.choice(words) for _ in range(rng.randint(3, 30))] for _ in range(8)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 12))]
        rows.append((rng.choice([i, i, i, 3, None]), rng.choice([" ", "\n", " \t "]).join(w)))
    return rows + [(70, None), (71, ""), (72, " "), (2, rows[5][1]), (90, rows[5][1])]


# with few bits, windows of different words share a hash: the result is the same
@pytest.mark.parametrize("seed, task, block, bits", [(1, 10**6, 10**6, 64), (2, 40, 100, 64), (3, 200, 30, 64), (1, 60, 100, 4), (2, 10**6, 50, 10), (3, 200, 30, 0)])
def test_against_brute_force(spark, monkeypatch, seed, task, block, bits):
    monkeypatch.setattr(rlz, "TASK_WORDS", task)
    monkeypatch.setattr(rlz, "BLOCK_WINDOWS", block)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"id": F.lit("clash"), "row": F.lit(1), "kept": F.lit(2), "start": F.lit(0), "_start": F.lit(0), "_packed": F.lit(0), "_rlz_id": F.lit(4), "ref": F.lit(0)})
    got = rlz.remove(df, n=5, bits=bits)
    assert set(got.columns) >= {"id", "row", "start", "spans"}
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == brute(rows, 5)


def test_spans_name_a_reference(spark):
    a = [f"w{i}" for i in range(50)]
    b = ["x"] + a[10:30] + ["y"] + a[:13]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in rlz.remove(df).collect()}
    assert spans[1] == [] and [tuple(s) for s in spans[2]] == [(1, 21, 1, 10), (22, 35, 1, 0)]


def test_factors_join_greedily():
    start, size, ref, at = rlz.runs(np.array([0, 1, 2, 3, 2]), np.array([7, 7, 7, 8, 9]), np.array([5, 6, 7, 0, 0]), np.array([1, 1, 1, 1, 6]))
    assert [tuple(map(int, x)) for x in zip(start, size, ref, at)] == [(0, 3, 7, 5), (2, 6, 9, 0)]


def test_empty(spark):
    assert rlz.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_factors_over_many_segments(spark):
    a = [f"w{i}" for i in range(1000)]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(["x"] * 5 + a[7:900])), (3, " ".join(a[:3] + ["y"] + a[500:]))], "doc_id long, text string")
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in rlz.remove(df).collect()}
    assert spans == {1: [], 2: [(5, 898, 1, 7)], 3: [(4, 504, 1, 500)]}


def test_one_very_long_text(spark):
    a = " ".join(f"w{i % 70_001}" for i in range(300_000))
    got = {r["doc_id"]: r["n_removed"] for r in rlz.remove(spark.createDataFrame([(1, "x"), (2, a), (4, a)], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 4: 300_000}
