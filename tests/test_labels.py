"""Pairs of a label against Python's own patterns; a label is searched once, however many pairs it has."""

import random
import re

from pyspark.sql import functions as F

from faultsift.functions import scalars as S

PAIR = re.compile(r'([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"([^"]*)"', re.ASCII)


def test_equal_to_python(spark):
    rng = random.Random(1)
    words = ["a", "b1", "1c", "_d", "x=", '="', '"', " ", "\t", "\n", "=", "abc_1", "9", "é", " = ", '"q"', "w" * 300]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", S.label_dimensions(F.col("t")).alias("m")).collect()
    for r in rows:
        text = texts[r["i"]]
        want = dict(PAIR.findall(text)) or ({"label": text.strip(" ")} if text.strip(" ") else {})
        assert r["m"] == want, text


def test_each_group_is_searched_once(spark):
    plan = spark.range(1).select(S.label_dimensions(F.col("id").cast("string")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 2
