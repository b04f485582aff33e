import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from faultsift.llm import align  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "Hello world.", "naïve café über straße", "日本語のテキスト and 中文", "👩‍👩‍👧 family 👍🏽", "line\nline\n\n end \n", "\n a\t b",
    "<|endoftext|> plain", "x▁y", "a ▁ b", "<0x41> <s> </s>", "nul\0byte", "it's we'll I'M", "   three", "　wide space", "é ​", "$1,234.56 100%",
    "Hello world.", "Hello Hello world.", "word " * 200, "qzx" * 3000, "x" * 5000, "ab" * 4000, " " * 300 + "end", "1" * 3000, "é" * 999, "\u0085a  b", "a \x1cb \x1f c", "zq́" * 500,
]


def plain(texts):
    """Groups and links by walking through the ends of the tokens of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    tok.no_padding()
    tok.no_truncation()
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    from faultsift.llm.bpe import _byte_letters

    back = {c: b for b, c in _byte_letters().items()}
    vocab = {i: w for w, i in tok.get_vocab().items()}
    out = []
    for t in texts:
        ids_a, ids_b = tok.encode(" " + (t or ""), add_special_tokens=False).ids, sp.encode(t or "")
        bytes_a = [bytes(back[c] for c in vocab[i]) if i != 50256 else vocab[i].encode() for i in ids_a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            out.append((0, 0, [], Counter()))
            continue
        ends_b = set(np.cumsum([len(x) for x in bytes_b]).tolist())
        cuts = sorted(ends_b & set(np.cumsum([len(x) for x in bytes_a]).tolist()))
        groups, pos = [[[], []] for _ in cuts], 0
        for side, ids, parts in ((0, ids_a, bytes_a), (1, ids_b, bytes_b)):
            pos, g = 0, 0
            for i, x in zip(ids, parts, strict=True):
                pos += len(x)
                groups[g][side].append(i)
                g += pos == cuts[g]
        out.append((len(ids_a), len(ids_b), groups, Counter((a, b) for g in groups for a in g[0] for b in g[1])))
    docs = Counter(p for *_, links in out for p in links)
    best = Counter()
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    rows = []
    for n_a, n_b, groups, links in out:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        n_best = sum(n for p, n in links.items() if docs[p] == best[p[0]])
        rows.append((n_a, n_b, len(groups), sum(links.values()), n_best, sum(n * docs[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return rows


def found(spark, texts, head=align.HEAD_PAIRS):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"groups": F.lit("clash"), "docs": F.lit(1), "pair": F.lit(2)})
    made = align.align(df, A, B, keep=["doc_id", "docs", "pair"])
    path = align.staged(made.withColumn("sha", F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")).drop("groups"), "aligned")
    got = sorted(align.score(path, align.pieces(B), head).collect())
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha")) for r in got]


@pytest.mark.parametrize("head", [align.HEAD_PAIRS, 40, 0])
def test_against_whole_texts(spark, head):
    assert found(spark, TEXTS, head) == plain(TEXTS)


def test_random_texts(spark):
    rng = random.Random(4)
    signs = list("aabcdeehilnorst  ,.'\n\t") + ["é", "ß", "漢", "😀", " ", "▁", "́", "Ж", "the ", "ing ", "1"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    assert found(spark, texts) == plain(texts)


def test_pointer_jumping():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 60)
        a = np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}))
        b = np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}))
        cuts = np.intersect1d(a, b)
        got = align.group_labels(a, b)
        assert got[0].tolist() == np.searchsorted(cuts, a).tolist()
        assert got[1].tolist() == np.searchsorted(cuts, b).tolist()


def test_memory_of_stretches_starts_anew(monkeypatch):
    texts = [t or "" for t in TEXTS]
    whole = align.Aligner(A, B)
    want = whole.align(texts)
    monkeypatch.setattr(align, "CACHE_BYTES", 0)
    small = align.Aligner(A, B)
    for i, t in enumerate(texts):
        got = small.align([t])
        assert {k: v[0] for k, v in got.items()} == {k: v[i] for k, v in want.items()}


def test_stretches_that_are_met_again_stay(monkeypatch):
    monkeypatch.setattr(align, "CACHE_BYTES", 6000)
    learnt, learn = [], align.Aligner._learn
    monkeypatch.setattr(align.Aligner, "_learn", lambda self, new: (learnt.extend(new), learn(self, new)))
    small, whole = align.Aligner(A, B), align.Aligner(A, B)
    texts = [f"the usual straße 漢字, the usual here: new{i} and\n other{i}" for i in range(60)]
    want = whole.align(texts)
    learnt.clear()
    for i, t in enumerate(texts):
        assert {k: v[0] for k, v in small.align([t]).items()} == {k: v[i] for k, v in want.items()}
        assert small.cost.sum() < 12_000
    assert learnt.count("usual") == learnt.count("straße") == 1 and len(small.at) < 40


def test_empty(spark):
    assert found(spark, []) == []
