import random
import re

import pytest
from pyspark.sql import functions as F

from faultsift.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICE = "Licensed under the Apache License, Version 2.0."
MIT = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 100)
GPL2 = next(t for label, t in licenses.TEMPLATES if label == "gpl-2.0" and len(t) > 100)


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def plain(text, templates=licenses.TEMPLATES, base=licenses.BASE):
    """All pairs of places are compared, and all chains tried."""
    ws = split(text)
    places = [(name, i) for name, phrase in base for i in range(len(ws)) if ws[i : i + len(split(phrase))] == split(phrase)]
    spans = []
    for t, (_, template) in enumerate(templates):
        ts, found = split(template), []
        for i in range(len(ws)):
            for j in range(len(ts)):
                if ws[i] == ts[j] and not (i + 1 < len(ws) and j + 1 < len(ts) and ws[i + 1] == ts[j + 1]):
                    n = 0
                    while n <= min(i, j) and ws[i - n] == ts[j - n]:
                        n += 1
                    if n >= licenses.LEAST_MATCH:
                        found.append((i, j, n))
        best, top = {}, {}
        for i, j, n in sorted(found):
            ways = [(n, i - n + 1)]
            for (i_, j_), (covered, start) in best.items():
                if i_ < i and j_ < j and i - n + 1 - i_ <= licenses.GAP + 1:
                    ways.append((covered + min(n, i - i_, j - j_), start))
            best[i, j] = max(ways)
            if best[i, j][0] >= licenses.COVER * len(ts):
                covered, start = best[i, j]
                top[start] = max(top.get(start, (0, 0)), (covered, -i))
        spans += [(start, -neg, covered, t) for start, (covered, neg) in top.items()]
    kept = [s for s in spans if not any(o[0] <= s[0] and o[1] >= s[1] and o[2] > s[2] for o in spans)]
    out = [(templates[t][0], a, b, k / len(split(templates[t][1]))) for a, b, k, t in kept]
    starts, named = [i for _, i in places], {n for n, _ in places}
    score = min(1.0, max([1.0] * bool(places) + [s[3] for s in out], default=0.0))
    labels = ",".join(sorted(named | {s[0] for s in out}))
    return (len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)), labels, score, sorted(out))


def found(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"labels": F.lit(1), "spans": F.lit("clash")})
    got = sorted(licenses.scan(df, keep=["doc_id"], **more).collect())
    return [(*tuple(r)[1:8], sorted((s["label"], s["first"], s["last"], s["covered"]) for s in r["spans"])) for r in got]


TEXTS = [
    None, "", " .,; ", "CC BY", "cc-by by cc by.", "All Rights Reserved. all rights\nreserved", "GNU General  Public-License v3 ÜBER general public license",
    NOTICE, f"intro {NOTICE} outro", "Licensed under the MIT License. " + MIT, MIT[:200], MIT.replace("free of charge", "gratis"), "x " * 5000 + GPL2 + " y" * 5000,
    GPL2.replace("version 2", "version 3"), "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    " ".join(t for _, t in licenses.TEMPLATES), "\n".join(t[: len(t) * 2 // 3] for _, t in licenses.TEMPLATES), NOTICE * 3, "cafécc by 日本 cc by",
]


def test_against_all_pairs(spark):
    got, want = found(spark, TEXTS), [plain(t or "") for t in TEXTS]
    for text, a, b in zip(TEXTS, got, want, strict=True):
        assert a == b, text


def test_labels(spark):
    got = {t: r for t, r in zip(TEXTS, found(spark, TEXTS), strict=True)}
    assert got[NOTICE][5] == "apache-2.0" and got[NOTICE][6] == 1.0
    assert got["This work is licensed under the GNU General Public License, version 3."][5] == "gpl,gpl-3.0"
    assert got["Licensed under CC BY-NC 4.0."][5] == "cc-by,cc-by-nc-4.0"
    assert got[MIT.replace("free of charge", "gratis")][5] == "mit"
    assert got[MIT[:200]][5:7] == ("", 0.0)
    assert got[None] == (0, 0, None, None, "", "", 0.0, [])


@pytest.mark.parametrize("seed", range(8))
def test_random_words(spark, seed):
    rng = random.Random(seed)
    signs = "ab" if seed % 2 else "abcd"
    templates = tuple((f"t{i}", " ".join(rng.choice(signs) for _ in range(rng.randint(3, 14)))) for i in range(6))
    base = (("p", "a b"), ("q", "b a b"))
    texts = [" ".join(rng.choice(signs + "x") for _ in range(rng.randint(0, 80))) for _ in range(30)]
    texts += [" x ".join(t for _, t in rng.sample(templates, 3)) for _ in range(5)]
    assert found(spark, texts, templates=templates, base=base) == [plain(t, templates, base) for t in texts]


def test_statistics_are_longest_stretches():
    rng = random.Random(9)
    for _ in range(50):
        seqs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 12))] for _ in range(4)]
        auto = licenses.Automaton(seqs)
        text = [rng.randint(1, 4) for _ in range(40)]
        stretches = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        want = [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in stretches), default=0) for i in range(40)]
        got = {i: n for i, _, n in auto.statistics(text)}
        assert [got.get(i, 0) for i in range(40)] == [n if n > 1 else 0 for n in want]


def test_spans_as_rows_and_empty(spark):
    df = spark.createDataFrame([(1, f"{NOTICE} and {NOTICE}"), (1, f"{NOTICE} and {NOTICE}")], "doc_id long, text string")
    rows = licenses.flat_spans(licenses.scan(df), "doc_id").collect()
    assert sorted((r["first"], r["last"]) for r in rows) == [(0, 7), (0, 7), (9, 16), (9, 16)]
    assert licenses.scan(df.limit(0)).count() == 0
