"""Near-duplicates at a Jaccard similarity of 0.8 against brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from faultsift.llm import common, near


def test_no_pair_of_the_similarity_stays(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        rows.append(base)
        for edits in (1, 1, 2, 3, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
    rows += [["short", "text"], ["short", "text"], [], [], ["one", "other"]]
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    sets = [set(near.shingles(" ".join(r), 5).tolist()) for r in rows]
    same = lambda a, b: a == b or bool(a and b) and len(a & b) * 5 >= len(a | b) * 4
    near_pairs = [(a, b) for a in range(len(rows)) for b in range(a) if same(sets[a], sets[b])]
    assert len(near_pairs) > 60
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near_pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    stay = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert not [p for p in near_pairs if set(p) <= stay]
    # of each connected group at least one stays, and nothing else goes
    assert all(stay & set(g) for g in groups.values()) and all(g[0] in stay for g in groups.values() if len(g) == 1)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for i in range(1500):
        copy = list(base)
        for _ in range(i % 3):
            copy[rng.randrange(200)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(5000 + i, " ".join(rng.choice(words) for _ in range(50))) for i in range(50)] + [(None, " ".join(base)), (7, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"set": F.lit(1), "rep": F.lit(2), "_near_gone": F.lit(3)})
    docs = docs.drop("_near_gone")
    stay = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in near.keep_one(docs).collect())
    assert stay == [-1, 0, *range(5000, 5050)]


def test_empty(spark):
    assert near.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_stage_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    docs = spark.createDataFrame([(i, f"some words of text number {i // 2}") for i in range(20)], "doc_id long, text string")
    got = near.keep_one(docs)
    assert got.count() == 10 and [p.name.split("-")[:2] for p in tmp_path.iterdir() if p.is_dir()] == [["near", "gone"]]


def test_no_link_is_lost_through_a_text_that_goes(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(30):
        text = [rng.choice(words) for _ in range(rng.randint(60, 120))]
        for _ in range(8):  # each is near the one before, the first and last are not
            rows.append(list(text))
            at = rng.randrange(len(text) - 8)
            text[at] = rng.choice(words)
    rng.shuffle(rows)
    sets = [set(near.shingles(" ".join(r), 5).tolist()) for r in rows]
    left = {}
    for i, mine in enumerate(sets):
        met = {left[j] for j in range(i) if len(mine & sets[j]) * 5 >= len(mine | sets[j]) * 4}
        left = {j: i if r in met else r for j, r in left.items()} | {i: i}
    want = sorted(min(i for i in left if left[i] == r) for r in set(left.values()))
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near.keep_one(docs).collect()) == want
