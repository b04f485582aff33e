import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultsift.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Bpe(PATH), tokenizers.Tokenizer.from_file(PATH)


def same(both, text):
    mine, theirs = both
    ids = theirs.encode(text, add_special_tokens=False).ids
    packed = mine.encode([text])[0]
    assert np.frombuffer(packed, "<u4").tolist() == ids, text
    assert mine.decode(packed) == theirs.decode(ids, skip_special_tokens=False)


def test_random_texts(both):
    rng = random.Random(2)
    letters = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　abcZé'st'll 12½²٣ßñ漢字😀👍🏽.,!?-_\x00\x7f") + ["  ", "\n ", "<|endoftext|>", " the", "'re", "aaaa", "====="]
    for _ in range(3000):
        same(both, "".join(rng.choice(letters) for _ in range(rng.randint(0, 16))))


@pytest.mark.parametrize("n", [1023, 1025, 6000])
def test_long_words(both, n):
    rng = random.Random(n)
    for letters in ("a", "ab", "abcdefgh", "=-"):
        same(both, "".join(rng.choice(letters) for _ in range(n)))


def test_cache_is_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3000)
    for i in range(20):
        same(both, f"word{i} other{i} third{i} and so on")
        assert both[0].held < 6000


def test_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello  world\n"), (3, "Hello  world\n")], "doc_id long, text string")
    df = df.withColumns({"ids": F.lit("clash"), "n_tokens": F.lit("clash")})
    got = bpe.decode(bpe.encode(df, PATH), PATH).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_tokens"], r["decoded"]) for r in got] == [(1, 0, ""), (2, 0, ""), (3, 4, "Hello  world\n"), (3, 4, "Hello  world\n")]
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_pieces_that_are_met_again_stay(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3000)
    learnt, learn = [], bpe.Bpe._learn
    mine = bpe.Bpe(PATH)
    monkeypatch.setattr(bpe.Bpe, "_learn", lambda self, cache, pieces, prefix: (learnt.extend(pieces), learn(self, cache, pieces, prefix)))
    for i in range(60):
        text = f"the usual Wörter, here: new{i}"
        assert np.frombuffer(mine.encode([text])[0], "<u4").tolist() == both[1].encode(text, add_special_tokens=False).ids
        assert mine.held + mine.held_older < 6000
    assert learnt.count("usual") == learnt.count("Wörter,") == 1
