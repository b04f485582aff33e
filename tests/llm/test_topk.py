import numpy as np
import pytest
from pyspark.sql import functions as F

from faultsift.llm import topk


def brute(ids, x, names, queries, k):
    out = {}
    for q, v in zip(names, queries, strict=True):
        s = x @ v
        rows = sorted((-int(a), int(i)) for a, i in zip(s, ids, strict=True) if i != q)[:k]
        out[int(q)] = [(i, -a) for a, i in rows]
    return out


@pytest.mark.parametrize("kind", ["dense", "clustered", "copies", "tiny", "zero"])
def test_shard(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 40, (700, 16)).round().astype(np.int64)
    if kind == "clustered":
        x = (x[rng.integers(0, 5, 700)] + rng.normal(0, 3, (700, 16))).round().astype(np.int64)
    if kind == "copies":
        x[100:500] = x[0]
    if kind == "tiny":
        x = x[:3]
    if kind == "zero":
        x[:] = 0
    ids = rng.permutation(len(x))
    names, queries = np.append(ids[: len(x) // 2], -1), np.vstack([x[: len(x) // 2], x[:1]])
    got = {q: [(int(i), int(s)) for s, i in zip(score, found, strict=True)] for q, score, found in topk.Shard(ids, x).search(names, queries, 5)}
    assert got == brute(ids, x, names, queries, 5)


@pytest.mark.parametrize("top", [10**8, 10**10, 3 * 10**14, 2**63 - 1])
def test_components_of_any_size(top):
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (300, 6))
    x[40], x[41], x[250] = [top, -3, 0, 7, 1, 2], [top, -3, 0, 7, 1, 3], [-top, top // 3, 5, 5, 5, 5]
    ids = rng.permutation(300)
    least, most = -(2**63), 2**63 - 1
    want = {}
    for at in (40, 41, 250, 3):
        scores = [max(least, min(most, sum(int(a) * int(b) for a, b in zip(v, x[at], strict=True)))) for v in x]
        want[int(ids[at])] = sorted((-s, int(i)) for s, i in zip(scores, ids, strict=True) if i != ids[at])[:5]
    at = [40, 41, 250, 3]
    got = {q: [(-int(s), int(i)) for s, i in zip(score, found, strict=True)] for q, score, found in topk.Shard(ids, x).search(ids[at], x[at], 5)}
    assert got == want


def test_top_k(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 0.3, (500, 8))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1050, [None] + [0.0] * 7), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [1.0] * 8), (50, rows[7][1]), (1200, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("clash"), "x": F.lit(1), "shard": F.lit(2)})
    v = topk.integer_vectors(df)
    got = topk.top_k(v, v.where("id % 50 = 0"), 5, shard_rows=90, query_rows=4).collect()
    held = [(r["id"], np.array(r["x"])) for r in v.collect()]
    assert len(held) == 502
    whole = [h for h in held if len(h[1]) == 8]
    asked = {}
    for i, c in whole:
        if i % 50 == 0 and i != 50:
            asked[i] = c
    want = brute(np.array([h[0] for h in whole]), np.stack([h[1] for h in whole]), list(asked), list(asked.values()), 5)
    mine = {}
    for r in sorted(got, key=lambda r: (r["query"], r["rank"])):
        mine.setdefault(r["query"], []).append((r["id"], r["score"]))
    assert {q: mine[q] for q in want} == want
    assert len(mine[50]) == 5 and 1200 not in mine
    assert topk.top_k(v.limit(0), v.where("id = 0")).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0
