import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultsift.llm import langid

WORDS = {"en": "the of and to in is that it for was".split(), "de": "der die und das nicht zu ein mit auf für".split(), "fr": "le la les des est une dans pour que sur".split()}
LANGS = ("de", "en", "fr")


def docs(spark, n=300):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = LANGS[i % 3]
        text = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 40)))
        rows.append((i, text, lang if i % 4 else None, lang, f"www.{lang}.example.com"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string, host string")


def test_held_out_accuracy(spark):
    got = langid.identify(docs(spark), host=F.col("host"), languages=LANGS).where("lang is null").collect()
    assert len(got) == 75 and sum(r["language"] == r["truth"] for r in got) / len(got) > 0.97


def test_host_and_suffix_decide_where_the_text_does_not(spark):
    df = docs(spark)
    extra = spark.createDataFrame([(1000, "12 34", None, "fr", "www.fr.example.com"), (1001, None, None, "de", "www.de.example.com")], df.schema)
    got = langid.identify(df.union(extra), host=F.col("host"), suffix=F.regexp_extract("host", r"\.(\w+)\.", 1), languages=LANGS)
    rows = {r["doc_id"]: r for r in got.where("doc_id >= 1000").collect()}
    assert rows[1000]["language"] == "fr" and rows[1001]["language"] == "de"
    assert not rows[1000]["accepted"] and not rows[1001]["accepted"] and rows[1001]["text_language"] is None


def test_declared_language_counts_as_far_as_it_is_true(spark):
    df = docs(spark).withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("truth")))
    liar = df.withColumn("lang", F.lit("de"))
    model = langid.fit(df, "text", "lang", LANGS)
    got = langid.identify(liar, languages=LANGS, model=model).collect()
    assert sum(r["language"] == r["truth"] for r in got) / len(got) > 0.97


def test_edge_cases(spark):
    df = docs(spark, 30).withColumns({"language": F.lit("clash"), "_n": F.lit(0), "confidence": F.lit("x")}).drop("_n")
    nulls = df.withColumn("text", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string")).withColumn("host", F.lit(None).cast("string"))
    got = langid.identify(df.union(df).union(nulls), host=F.col("host"), languages=LANGS)
    assert got.count() == 90 and got.where("accepted").count() == 60 and got.where("language is null").count() == 0
    assert langid.identify(df.limit(0), languages=LANGS).count() == 0


def test_texts_of_no_language_are_rejected(spark):
    df = docs(spark)
    strange = ["Это предложение написано совсем на другом языке", "这是用另一种语言写的一个句子 没有人会读它", "xkcdq zzvbn wqrtp kjhgf bvcxz lkjhg", "φράση σε άλλη γλώσσα εδώ"]
    extra = spark.createDataFrame([(1000 + i, t, None, "de", "www.de.example.com") for i, t in enumerate(strange)], df.schema)
    got = langid.identify(df.union(extra), host=F.col("host"), languages=LANGS)
    assert got.where("doc_id >= 1000 and accepted").count() == 0
    assert got.where("doc_id < 1000 and not accepted").count() == 0


def test_columns_of_any_name_pass_through(spark):
    names = ["h", "of_host", "e_declared", "k_declared", "d", "n", "posterior", "_domain"]
    df = docs(spark, 30).withColumns({c: F.lit(1) for c in names})
    got = langid.identify(df, host=F.col("host"), languages=LANGS, keep=["doc_id", *names[:-1]])
    assert got.count() == 30 and set(names[:-1]) <= set(got.columns)


def test_posteriors_against_plain_bayes(spark):
    df = docs(spark, 60).withColumn("host", F.when(F.col("doc_id") % 7 != 0, F.col("host"))).withColumn("sfx", F.when(F.col("doc_id") % 2 == 0, F.lit("com")).otherwise(F.lit("org")))
    model = langid.fit(df, "text", "lang", LANGS)
    rows = df.collect()
    got = {r["doc_id"]: r for r in langid.identify(df, host=F.col("host"), suffix=F.col("sfx"), languages=LANGS, model=model).collect()}
    table, n = model.astype(np.float32), len(LANGS)

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    score = {r["doc_id"]: table[:, c].mean(axis=1, dtype=np.float64) * min(len(c), langid.MOST_TRIGRAMS) for r in rows for c in [langid.trigrams(r["text"])]}
    post = {i: softmax(s) for i, s in score.items()}
    share = (sum(post.values()) + 1) / (len(rows) + n)

    def groups(key):
        out = {}
        for r in rows:
            if key(r) is not None:
                out.setdefault(key(r), []).append(post[r["doc_id"]])
        return out

    w = langid.PRIOR_WEIGHT
    smooth = lambda ps, above: (sum(ps) + w * above) / (len(ps) + w)
    domain_of = lambda h: h and ".".join(h.split(".")[-2:])
    domains = {d: smooth(ps, share) for d, ps in groups(lambda r: domain_of(r["host"])).items()}
    hosts = {h: smooth(ps, domains[domain_of(h)]) for h, ps in groups(lambda r: r["host"]).items()}
    told = lambda key: {v: np.log((sum(ps) + share) / (len(ps) + 1) / share) for v, ps in groups(key).items()}
    declared, suffix = told(lambda r: r["lang"]), told(lambda r: r["sfx"])
    for r in rows:
        x = score[r["doc_id"]] + np.log(hosts.get(r["host"], share)) + declared.get(r["lang"], 0) + suffix[r["sfx"]]
        p = softmax(x)
        assert got[r["doc_id"]]["confidence"] == pytest.approx(p.max(), abs=1e-6)
        assert got[r["doc_id"]]["language"] == LANGS[int(p.argmax())]
