"""SimHash fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from faultsift.llm import components, near, simhash


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "one two", "A b C d", "é ß É x y z", " ".join(rng.choice("abcdefg") for _ in range(2000))]
    for t in texts:
        assert simhash.fingerprint(t) & (2**64 - 1) == plain_fingerprint(t), t


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_links_connect_what_is_near(spark, crowd):
    rng = random.Random(crowd)
    fps = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(12):
            x = center
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {0, 1, 3, 2**63, 2**64 - 1}
    nodes = [x - 2**64 if x >= 2**63 else x for x in fps]
    near = [(a, b) for a in nodes for b in nodes if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    df = spark.createDataFrame([(n,) for n in nodes], "fp long")
    got = [(r["a"], r["b"]) for r in simhash.links(df, crowd).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in got)
    assert plain_components(got, nodes) == plain_components(near, nodes)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)] + [(200, 200), (-5, 7), (7, -5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    want = plain_components([e for e in edges if e[0] != e[1]], {x for e in edges if e[0] != e[1] for x in e})
    assert got == want
    assert components.components(df.limit(0)).count() == 0


def test_near_duplicates_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base), (9, None), (8, " \n"), (7, "only"), (None, base), (5, base), (1, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "component_id": F.lit(1), "id": F.lit(0)})
    got = sorted((r["id"] is None, r["id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(False, 1, 1), (False, 3, 3), (False, 5, 3), (False, 5, 3), (False, 7, 7), (False, 8, 8), (False, 9, 8), (True, 0, 3)]
    kept = sorted(r["doc_id"] or 0 for r in near.keep_one(df, shingle=3).collect())
    assert kept == [0, 1, 3, 7, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_many_copies_stay_linear(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same few words in each").alias("text"))
    got = simhash.near_duplicates(df)
    assert got.select("component_id").distinct().collect() == [(0,)] and got.count() == 3000


def test_near_copies_meet(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 5000, 4000)]
    other = list(words)
    other[100] = "changed"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    bits = (simhash.fingerprint(" ".join(words)) ^ simhash.fingerprint(" ".join(other))) & (2**64 - 1)
    linked = simhash.near_duplicates(df).select("component_id").distinct().count() == 1
    assert linked == (bits.bit_count() <= 2)
