"""Which answers of a review count, and when a case stops asking."""

import json

import pytest
from pyspark.sql import functions as F

from faultsift.operators import classify, review

ROOTS = ["xian-fw", "xian-br-1"]
GOOD = {"event_opinion": "supports", "root_cause_top5": ROOTS[::-1], "fault_category": {"major_category": "link", "sub_category": "loss"}, "evidence_ids": ["root:xian-fw"], "confidence": 0.9, "rationale": "so it is"}


def outcome(spark, answers, allowed=None):
    rows = [("c", f"e{i:02}", i, ROOTS, "link_delay", True) for i in range(len(answers))]
    found = spark.createDataFrame(rows, "case string, event string, start long, roots array<string>, category string, needs boolean")
    texts = [("c", f"e{i:02}", a if isinstance(a, str) else json.dumps(a)) for i, a in enumerate(answers) if a is not None]
    said = spark.createDataFrame(texts, "case string, event string, answer string")
    got = review.reviewed(found, ["case"], said, allowed).orderBy("event").collect()
    return [(r["status"], r["roots"] == ROOTS[::-1], r["category"]) for r in got]


BAD = [
    None, "", "[]", "no {json", GOOD | {"more": 1}, {k: v for k, v in GOOD.items() if k != "rationale"}, GOOD | {"event_opinion": "yes"}, GOOD | {"root_cause_top5": ROOTS[:1]},
    GOOD | {"root_cause_top5": [ROOTS[0]] * 2}, GOOD | {"root_cause_top5": "xian-fw"}, GOOD | {"fault_category": {"major_category": "link", "sub_category": "dns_down"}},
    GOOD | {"fault_category": GOOD["fault_category"] | {"x": 1}}, GOOD | {"fault_category": "link"}, GOOD | {"evidence_ids": []}, GOOD | {"evidence_ids": ["root:xian-fw"] * 2}, GOOD | {"evidence_ids": ["root:a"]},
    GOOD | {"confidence": True}, GOOD | {"confidence": "0.9"}, GOOD | {"confidence": 1.5}, GOOD | {"confidence": None}, GOOD | {"rationale": 5}, GOOD | {"rationale": "x" * 501},
]


def test_illegal_answers_keep_the_local_result(spark):
    rows = [(f"c{i}", "e", 0, ROOTS, "link_delay", True) for i in range(len(BAD))]
    found = spark.createDataFrame(rows, "case string, event string, start long, roots array<string>, category string, needs boolean")
    texts = [(f"c{i}", "e", a if isinstance(a, str) else json.dumps(a)) for i, a in enumerate(BAD) if a is not None]
    got = review.reviewed(found, ["case"], spark.createDataFrame(texts, "case string, event string, answer string")).collect()
    wrong = [(r["case"], BAD[int(r["case"][1:])]) for r in got if (r["status"], r["roots"], r["category"]) != ("fallback", ROOTS, "link_delay")]
    assert wrong == [] and len(got) == len(BAD)


def test_a_failure_ends_the_asking(spark):
    unsure, weak, edge = GOOD | {"event_opinion": "uncertain"}, GOOD | {"confidence": 0.64}, GOOD | {"confidence": 0.65, "event_opinion": "contradicts"}
    got = outcome(spark, [GOOD, unsure, weak, edge, GOOD | {"confidence": 1}, "broken", GOOD])
    assert [g[0] for g in got] == ["accepted", "not_applied", "not_applied", "accepted", "accepted", "fallback", "fallback"]
    assert [g[1:] for g in got] == [(s == "accepted", "link_loss" if s == "accepted" else "link_delay") for s, *_ in got]


def test_other_evidence_may_be_allowed(spark):
    allowed = spark.createDataFrame([("c", "e00", ["signal:cpu"])], "case string, event string, ids array<string>")
    assert outcome(spark, [GOOD | {"evidence_ids": ["signal:cpu", "root:xian-fw"]}], allowed)[0][0] == "accepted"
    assert outcome(spark, [GOOD | {"evidence_ids": ["signal:cpu", "root:xian-fw"]}])[0][0] == "fallback"


def test_off_by_default_and_margins(spark):
    events = spark.createDataFrame([("c", "a", 0, 0.9), ("c", "b", 5, 0.7), ("c", "d", 9, 0.9)], "case string, event string, start long, confidence double")
    category = spark.createDataFrame([("c", e, "link_loss", 0.8) for e in "abd"], "case string, event string, category string, confidence double")
    top5 = spark.createDataFrame([("c", "a", "x", 2.0, 1), ("c", "a", "y", 1.0, 2), ("c", "b", "x", 2.0, 1), ("c", "d", "x", 1.0, 1), ("c", "d", "y", 0.9, 2)], "case string, event string, node string, score double, rank int")
    found = review.needed(events, category, top5, ["case"])
    assert {r["event"]: (r["needs"], round(r["margin"], 6), r["roots"]) for r in found.collect()} == {"a": (False, 0.5, ["x", "y"]), "b": (True, 1.0, ["x"]), "d": (True, 0.1, ["x", "y"])}
    assert {r["status"] for r in review.reviewed(found, ["case"]).collect()} == {"disabled"}
    none = spark.createDataFrame([], "case string, event string, answer string")
    assert {r["event"]: r["status"] for r in review.reviewed(found, ["case"], none).collect()} == {"a": "skipped_confident", "b": "fallback", "d": "fallback"}


def test_blend(spark):
    scores = spark.createDataFrame([("e", "a", 3.0), ("e", "b", 0.0), ("e", "c", -9.0)], "event string, node string, score double")
    learned = spark.createDataFrame([("e", "a", 1000.0), ("e", "b", 1000.0)], "event string, node string, logit double")
    got = {r["node"]: (r["rule"], r["learned"], r["score"]) for r in review.blended(scores, learned, ["event"]).collect()}
    assert got == {"a": pytest.approx((4 / 6, 0.5, 0.625)), "b": pytest.approx((1 / 6, 0.5, 0.25)), "c": pytest.approx((1 / 6, 0.0, 0.125))}
    assert review.blended(scores, learned.where(F.lit(False)), ["event"]).where("learned <> 0").count() == 0


def test_votes_outside_the_taxonomy_do_not_count(spark):
    rows = [("e", "link", "loss", 0.5), ("e", "link", "loss", 1.0), ("e", "link", "delay", 0.0), ("e", "link", "delay", 0.1), ("e", "link", "web_5xx", 0.9), ("e", "routing", "blackhole", 1.1), ("e", None, None, 0.5), ("f", "x", "y", 0.5), ("f", "link", "loss", float("nan")), ("f", "link", "loss", None)]
    votes = spark.createDataFrame(rows, "event string, major_category string, sub_category string, confidence double")
    got = {r["event"]: tuple(r)[1:] for r in classify.consensus(spark, votes, ["event"]).collect()}
    assert got == {"e": ("link", "delay", 2, 3), "f": (None, None, 0, 3)}
