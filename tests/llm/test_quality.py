import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultsift.llm import quality


def plain(t):
    t = t or ""
    w = [x.decode() for x in t.encode().split()]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(9)
    out = [None, "", " \n\n", "one", "a b", "a b c", "a b c a b c", "x\nx\n\n x\nx", "#*$ %&| <>é 😀", "A\x0bB\x0cC\rD\tE", "nbsp\xa0stays one"]
    for _ in range(40):
        out.append(rng.choice([" ", "\n", "  "]).join(rng.choice("abcdef") for _ in range(rng.randint(1, 80))))
    big = [f"w{rng.randrange(60)}" for _ in range(4000)]
    return out + [" ".join(big), " ".join(f"u{i}" for i in range(500)) + " " + " ".join(f"u{i}" for i in range(500)), "spam " * 300]


@pytest.mark.parametrize("few", [0, 64])
def test_counts(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW", few)
    rows = [(i, t, ["en", "de", "xx", None][i % 4]) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n_words": F.lit("clash"), "_t": F.lit(0), "kept": F.lit(1)}).drop("_t")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(t), t
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 5.0]), ([2.0, 2.0], [1.0, 1.0]), ([1.0, 3.0], [3.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(quality.js_distance(F.col("a"), F.col("b"))).collect()]
    half = math.sqrt(0.25 * math.log2(0.5) + 0.75 * math.log2(1.5))
    assert got[:2] == [1.0, 0.0] and got[2] == pytest.approx(half) and got[3] is None


def test_junk_goes_and_clean_stays(spark):
    rng = random.Random(1)
    common = "the of and to in a is that it for was with".split()
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("etaoinshr") for _ in range(5))
    rows = [(i, ". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(15)) + ".", "en") for i in range(60)]
    rows += [(100, " ".join(w + "%%%" for w in rows[0][1].split()), "en"), (101, " ".join(w.upper() + "!!" for w in rows[1][1].split()), "en")]
    rows += [(102, " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(200)), "en")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in (100, 101, 102))


def test_no_python(spark):
    df = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    plan = quality.features(df)._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))


def test_empty(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
