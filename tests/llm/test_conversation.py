import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from faultsift.llm import conversation

WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if f == 1 else "".join(c for c in text if c not in ".!?") if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    return out


def plain_repair(rows):
    """Faults and the cheapest edits by keeping the best audit of every state, row by row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, codes = set(), []
    for _, _, role, text in rows:
        codes.append("blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(4):
            for q, (c, a, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if (to := step.get((q, role[0]))) and (c + 5, a + "I") < best.get(to, (1e9, ""))[:2]:
                        best[to] = (c + 5, a + "I", [*lines, f"{role}:"])
        return best

    best = inserted({"0": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, codes, strict=True):
        now = {}

        def put(q, c, a, lines, now=now):
            if q and (c, a) < now.get(q, (1e9, ""))[:2]:
                now[q] = (c, a, lines)

        for q, (c, a, lines) in best.items():
            put(q, c + 2, a + "D", lines)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                put(step.get((q, role[:1])), c + more, a + "K", [*lines, f"{role}:{text}"])
                for to in ("user", "assistant"):
                    put(step.get((q, to[0])), c + 1 + more, a + "R", [*lines, f"{to}:{text}"])
        best = inserted(now)
    cost, audit, lines = min(best[q] for q in "0a" if q in best)
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *(codes.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows):
    convs = {r[0] for r in rows}
    after = plain_damage(rows)
    return {c: plain_repair([r for r in after if r[0] == c]) for c in convs}


def found(spark, rows, stretch=256):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({"conv": F.lit("clash"), "n": F.lit(9), "same": F.lit(1)})
    got = conversation.repair(conversation.damaged(df), stretch).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r[0]: tuple(r)[1:] for r in got}


def random_rows(rng, convs, most):
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t", None, "Good. ", "Ünder.", "x\n", "Go on…", "a.\nb"]
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "system", "tool", "", None]
    rows = []
    for c in convs:
        n = rng.randint(1, most)
        turns = [rng.choice([i, i, i, None]) if rng.random() < 0.2 else i + 3 * (rng.random() < 0.1) for i in range(n)]
        roles_ = [("user", "assistant")[i % 2] if rng.random() < 0.6 else rng.choice(roles) for i in range(n)]
        rows += [(c, t, r, rng.choice(texts) if rng.random() < 0.5 else f"Text {i} of {c}.") for i, (t, r) in enumerate(zip(turns, roles_, strict=True))]
    return rows


def test_against_all_states(spark):
    rng = random.Random(5)
    rows = random_rows(rng, [None, *range(300)], 12)
    rng.shuffle(rows)
    assert found(spark, rows) == plain(rows)


def test_search_finds_the_least_audit():
    rng = random.Random(6)
    for _ in range(2000):
        code = "".join(rng.choice("uuaasoxUAS") for _ in range(rng.randint(0, 9)))
        got = conversation.cheapest(code, 0, (0, 3))
        rows = [(0, i, {"u": "user", "a": "assistant", "s": "system", "o": "other", "x": "user"}[c.lower()], "" if c == "x" else f"{i}" + ("" if c.isupper() else ".")) for i, c in enumerate(code)]
        assert got == plain_repair(rows)[5:7], code


@pytest.mark.parametrize("stretch", [1, 3, 256])
def test_one_conversation_over_many_tasks(spark, stretch):
    rng = random.Random(stretch)
    rows = [r for r in random_rows(rng, [7], 400)] + random_rows(rng, [6, 8], 3)
    rows += [(7, 1000 + i, "user", "Again.") for i in range(40)] + [(7, 2000, "assistant", "Same.")] * 30
    want = plain(rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert found(spark, rows, stretch) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_long_stretches_compose():
    rng = random.Random(3)
    for size in (1, 2, 5, 17):
        code = "".join(rng.choice("uuaasoxUAS") for _ in range(200))
        tables = [conversation._between(code[i : i + size]) for i in range(0, 200, size)]
        path = conversation._best(conversation._all(tables))
        assert (path[0], conversation._audit(path)) == conversation.cheapest(code, 0, (0, 3))


def test_nothing_left_and_empty(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = found(spark, [(dropped, 0, "user", "x" * 100_000 + ".")])
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(spark, []) == {}
