"""The pipeline, stage by stage, and the registered queries of the corpus operators on the smallest tables."""

import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultsift.llm import bpe
from faultsift.llm.queries import ORACLE, QUERIES

SF = Path("/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    words = {"en": "the of and to in is that it for was".split(), "de": "der die und das nicht zu ein mit auf von".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "er", "ing", "on"]) for _ in range(n))
    shared = text("en", 60)
    rows = [(i, text("de" if i % 4 == 0 else "en", 150), "de" if i % 4 == 0 else "en", f"src{i % 6}") for i in range(60)]
    rows += [(100, rows[1][1], "en", "src1"), (101, rows[2][1] + " " + shared, "en", "src0"), (102, text("en", 80) + " " + shared, "en", None)]
    rows += [(103, "%%% 123 ###", None, "src2"), (104, None, None, None), (105, "Ein kurzer Satz der und die", "de", "src3")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").select(COLUMNS)


def test_stages(spark, docs):
    a = corpus_pipeline.identify_language(spark, docs, "").cache()
    assert a.columns == COLUMNS and {r[0] for r in docs.select("doc_id").collect()} - {r[0] for r in a.select("doc_id").collect()} == {103, 104}
    b = corpus_pipeline.drop_near_duplicates(spark, a, "").cache()
    assert b.columns == COLUMNS and {r[0] for r in a.select("doc_id").collect()} - {r[0] for r in b.select("doc_id").collect()} == {100}
    c = corpus_pipeline.drop_substrings(spark, b, "").cache()
    left = {r["doc_id"]: r["text"] for r in c.collect()}
    assert c.columns == COLUMNS and dict(c.dtypes) == dict(docs.dtypes) and len(left) == b.count()
    before = {r["doc_id"]: r["text"] for r in b.collect()}
    assert left[101] != before[101] and len(left[102].split()) == 80 and all(left[i] == before[i] for i in range(60))
    assert all(r["n_chars"] == len(r["text"]) for r in c.collect())
    d = corpus_pipeline.mix_sources(spark, c, "")
    assert d.columns == COLUMNS and Counter(map(str, d.collect())) == Counter(map(str, c.collect()))
    e = corpus_pipeline.tokenize(spark, d, "")
    assert e.where("round_trip").count() == e.count() == c.count()


def test_tokens_and_their_text_take_one_worker(spark, docs):
    made = corpus_pipeline.tokenize(spark, docs, "")
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    path = corpus_pipeline.tokenizer_path()
    two = bpe.decode(bpe.encode(docs, path), path).select("doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
    assert made.dtypes == two.dtypes and Counter(map(str, made.collect())) == Counter(map(str, two.collect()))


def test_empty(spark, docs):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else v


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", [*sorted(QUERIES), "pipeline"])
def test_query(spark, name):
    got = corpus_pipeline.run(spark, str(SF)) if name == "pipeline" else QUERIES[name](spark, str(SF))
    rows = got.collect()
    assert rows
    if name in ORACLE:
        c = duckdb.connect()
        for f in SF.glob("*.parquet"):
            c.execute(f"create view {f.stem} as select * from '{f}'")
        want = c.execute(ORACLE[name])
        names = [x[0] for x in want.description]
        assert sorted(names) == sorted(got.columns)
        mine = sorted(str([plain(r[n]) for n in names]) for r in rows)
        assert mine == sorted(str([plain(x) for x in r]) for r in want.fetchall())
    elif name != "pipeline" and "doc_id" in got.columns:
        ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
        assert sorted(r["doc_id"] for r in rows) == ids


def test_native_operators_run_no_python(spark):
    for name in ("op2_mix", "op7_divergence"):
        plan = QUERIES[name](spark, str(SF))._jdf.queryExecution().toString()
        assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))
