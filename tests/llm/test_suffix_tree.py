import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultsift.llm import suffix_tree as st


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "ré"]) for _ in range(rng.randint(2, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(300)]
    return rows + [(500, None), (501, ""), (502, "Unseen WORDS\tthe\nEND"), (3, rows[3][1]), (None, "an on")]


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").withColumns({"score": F.lit("clash"), "id": F.lit(0), "key": F.lit("x")})
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return st.score(df, out, least_count=10, heavy_share=1e-2).toPandas()


def test_base_score(scored):
    rows = [(i, (t or "").encode().lower().split()) for i, t in corpus()]
    c, ends = Counter(), 0
    for i, w in rows:
        if not held(i):
            c.update(w)
            ends += 1
    total, kinds = sum(c.values()) + ends, len(c) + 1
    want = Counter()
    for i, w in rows:
        base = sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w) + math.log10((ends + 1) / (total + kinds + 1))
        want[(-1 if i is None else i, held(i), len(w) + 1, 1 + sum(x in c for x in w), total, round(base, 6))] += 1
    got = Counter(
        (-1 if pd.isna(r.id) else int(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored.itertuples()
    )
    assert got == want


def brute(rows, least, divergence):
    """log10 probabilities by a model of plain dictionaries that learns from the rows not held out."""
    grams = Counter()
    for i, t in rows:
        if not held(i):
            s = b"\n" + st._stream(t)
            for at in range(1, len(s)):
                for k in range(min(7, at) + 1):
                    grams[(s[at - k : at], s[at])] += 1
    nexts = {}
    for (c, x), n in grams.items():
        nexts.setdefault(c, {})[x] = n
    of = {c: sum(d.values()) for c, d in nexts.items()}
    kept = {b""} & nexts.keys()
    for c, d in nexts.items():
        if c and of[c] >= least:
            up, n = nexts[c[1:]], of[c]
            gain = sum(v / n * math.log(v / n / (up[x] / of[c[1:]])) for x, v in d.items())
            if gain - (len(d) - 1) / (2 * n) >= divergence:
                kept.add(c)

    def log10(t):
        s, out = b"\n" + st._stream(t), 0.0
        for at in range(1, len(s)):
            p = 1 / 256
            for k in range(min(7, at) + 1):
                c = s[at - k : at]
                if c in kept:
                    more = len(nexts[c]) if c else 256
                    p = (nexts[c].get(s[at], 0) + more * p) / (of[c] + more)
            out += math.log10(p)
        return out

    return log10, kept


@pytest.mark.parametrize("divergence, least, batch, block", [(0.0, 20, 4000, 10**9), (0.01, 12, 10**9, 3000), (0.05, 8, 2000, 1500), (0.3, 5, 3000, 700)])
def test_against_brute_force(spark, divergence, least, batch, block):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    got = st.score(df, out, least_divergence=divergence, least_count=least, batch_bytes=batch, block_bytes=block).where("id is not null").toPandas()
    log10, kept = brute(corpus(), least, divergence)
    lengths = Counter(map(len, kept))
    assert lengths[0] == 1 and sum(lengths.values()) > 20
    # prefixes and suffixes of states need not be states
    assert divergence < 0.05 or any(c[:-1] not in kept for c in kept if c) and any(c[1:] not in kept for c in kept if c)
    texts = dict(corpus())
    assert len(got) == len(corpus()) - 1
    for r in got.itertuples():
        assert r.score == pytest.approx(log10(texts[int(r.id)]), rel=1e-6)


def test_longer_contexts_help_on_held_out_texts(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(120)], "doc_id long, text string")
    total = [st.score(df, F.col("doc_id") % 5 == 0, least_count=n).where("held_out").agg(F.sum("score")).first()[0] for n in (10**9, 3000, 40)]
    assert total[0] < total[1] < total[2] < 0 and total[2] > 0.5 * total[0]


def model_of(spark, texts, **kw):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    starts = st.limits(df, sum(map(len, texts)), kw.pop("block", 10**9))
    rows = st.states(st.counted_blocks(df, starts), starts, **kw).collect()
    return st.Model.of([r["states"] for r in rows])


def test_distributions_sum_to_one(spark):
    model = model_of(spark, [t or "" for _, t in corpus()], least_count=10)
    for start in (b"", b"th", b"eronth r", b"zzz"):
        before = model.log10([start])[0] if start else 0.0
        assert sum(10 ** (x - before) for x in model.log10([start + bytes([b]) for b in range(256)])) == pytest.approx(1, abs=1e-9)


def test_states_grow_with_the_corpus_and_are_longer_than_five_bytes(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(100)) for _ in range(400)]
    sizes = []
    for n in (200, 400):
        model = model_of(spark, texts[:n], least_divergence=0.0)
        assert model.total[1:].min() >= st.LEAST_COUNT and (model.key >> np.uint64(56)).max() == st.DEPTH
        sizes.append(len(model.key))
    # a word comes about 50 times in half of the corpus and 100 times in all of it
    assert sizes[1] > 2 * sizes[0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert st.score(df, F.lit(False)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert st.score(one, F.lit(True)).first()["n_known"] == 0


def test_contexts_are_asked_for_one_length_at_a_time():
    codes = np.unique(np.random.default_rng(5).integers(1 << 62, 1 << 63, 300_000).astype(np.uint64))
    few = np.zeros(1 << 10, np.int64)
    few[::64] = -1
    tracemalloc.start()
    keys = st.context_keys(codes, few)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * len(codes) and (keys[1:] > keys[:-1]).all()
    every = np.concatenate([st._key(np.unique(st._prefix(codes, k)), k) for k in range(8)])
    assert np.array_equal(keys, every[st.in_bitmap(every.view(np.int64), few)])


def test_keys_of_states_take_one_worker(spark, monkeypatch):
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 1 << 60, 500).astype(np.uint64))
    packed = st._pack_states(key, np.ones(len(key), np.int64), np.zeros(len(key), np.uint8), np.full(len(key), 70))
    assert st._unpack_keys(packed).tolist() == st._unpack_states(packed)[0].tolist() == key.tolist()
    plans, bitmap = [], st.bitmap
    monkeypatch.setattr(st, "bitmap", lambda keys, **more: (plans.append(keys._jdf.queryExecution().executedPlan().toString()), bitmap(keys, **more))[1])
    df = spark.createDataFrame([(i, "the end of the line " * 9) for i in range(40)], "doc_id long, text string")
    assert st.score(df, F.col("doc_id") % 7 == 2, least_count=10).count() == 40
    assert plans and "MapInArrow" not in plans[0]


def test_normal_texts():
    for t in (None, "", " ", "\n\t", "A", " Ab\t\r\n\x0b\x0cÇ  d   e     f\u00a0\x1c\x85G ", "x" + " " * 9 + "Y\0z\n"):
        assert st._stream(t) == b" ".join(st.normal(t)) + b"\n"
    want = [int.from_bytes(bytes([*(b"\0" * 6 + b"\nab cdefghi\n")[i : i + 7][::-1], b"ab cdefghi\n"[i]])) for i in range(11)]
    assert st._codes(b"ab cdefghi\n").tolist() == want


def bitmap_of(keys, bits=1 << 20):
    from faultsift.llm.common import bit_of

    out = np.zeros(bits >> 6, np.int64)
    at = bit_of(keys, bits)
    np.bitwise_or.at(out, at >> 6, np.left_shift(np.int64(1), at & 63))
    return out


def test_blocks_answer_shortened_codes_as_whole_ones(spark, monkeypatch):
    texts = [st._stream(t) for _, t in corpus()] + [b"\0\0an\0 on\n", b"\n"]
    df = spark.createDataFrame([(t,) for _, t in corpus()], "text string")
    starts = st.limits(df, sum(map(len, texts)), 1500)
    blocks = st.states(st.counted_blocks(df, starts), starts, least_count=10).toPandas()
    assert len(starts) > 3 and len(blocks) == len(starts) + 1
    whole = model_of(spark, [t or "" for _, t in corpus()], least_count=10)
    known = bitmap_of(whole.key)
    codes = np.unique(np.concatenate([st._codes(t) for t in texts]))
    short = st.shortened(codes, known)
    asked = np.unique(short)
    # that is less to send, and no answer differs from that of the whole model
    assert len(asked) < 0.7 * len(codes)
    cut = [0, *np.searchsorted(asked, starts), len(asked)]
    of = dict(zip(blocks["block"], blocks["states"], strict=True))
    values = np.concatenate([st.Model.of([of[b]]).of_codes(asked[i:j]) for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False))])
    assert values[np.searchsorted(asked, short)] == pytest.approx(whole.of_codes(codes), rel=1e-12)
    # sums by hash and, where hashes collide, by place
    want = whole.log10(texts)
    assert st.log10_of(texts, known, values) == pytest.approx(want, rel=1e-12)
    monkeypatch.setattr(st, "PIECE_BYTES", 1000)
    assert st.hashed_sums(texts, codes, whole.of_codes(codes)) == pytest.approx(want, rel=1e-12)
    monkeypatch.setattr(st, "MIXERS", (np.uint64(0),))
    assert st.hashed_sums(texts, codes, codes) is None
    assert st.log10_of(texts, known, values) == pytest.approx(want, rel=1e-12)
    with pytest.raises(ValueError):
        st.log10_of(texts, known, values[1:])


def test_words_without_a_count_stay_as_often_as_they_stand():
    n_words, n_met, base, rare = st.word_counts([b"a b a\n", b"\n", b"\xc3\xa9 x \xc3\xa9 b\n"], pa.array([b"a", b"b"]), np.array([9, 99]))
    assert n_words.tolist() == [3, 0, 4] and n_met.tolist() == [3, 0, 1]
    assert base.tolist() == pytest.approx([4, 0, 2]) and rare.to_pylist() == [[], [], ["é", "x", "é"]]
    assert st.word_counts([b"\n"], pa.array([], pa.binary()), np.zeros(0, np.int64))[3].to_pylist() == [[]]


def test_a_batch_is_summed_in_little_memory():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(9000)]
    texts = [st._stream(" ".join(rng.choice(words) for _ in range(300))) for _ in range(1200)]
    codes = st.different_codes(texts)
    tracemalloc.start()
    sums = st.hashed_sums(texts, codes, np.ones(len(codes)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sums.tolist() == [len(t) for t in texts]
    assert peak < 10 * sum(map(len, texts)) + 70 * len(codes) + 40 * st.PIECE_BYTES
