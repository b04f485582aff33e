"""Events built from point evidence: cuts, trims at recovery, nested evidence in order."""

from faultsift.operators import build

POINT = "case string, minute long, source string, node string, metric string, direction string, score double"


def test_trimmed_and_ordered(spark):
    rows = [("a", m, "node", "n1", "cpu", "high", 10.0 + m) for m in range(5)] + [("a", m, "node", "n1", "cpu", "low", 9.0) for m in range(5, 8)]
    rows += [("a", 2, "traffic", "n2", "loss", "high", 12.0), ("a", 2, "node", "n2", "b", "high", 12.0), ("a", 6, "frr", "n3", "x", "high", 25.0)]
    rows += [("b", 0, "node", "n1", "cpu", "high", 6.0), ("b", 1, "node", "n1", "cpu", "high", 8.0), ("b", 5, "node", "n1", "cpu", "high", 2.0)]
    got = {r["case"]: r for r in build.detected(spark.createDataFrame(rows, POINT), ["case"], {"frr": 1.0}).collect()}
    a = got["a"]
    assert (a["start"], a["end"], a["confidence"]) == (0, 5, 1.0)  # the series turns at 5, which is recovery
    assert [(p["score"], p["minute"], p["metric"]) for p in a["evidence"]] == [(14.0, 4, "cpu"), (13.0, 3, "cpu"), (12.0, 2, "b"), (12.0, 2, "cpu"), (12.0, 2, "loss"), (11.0, 1, "cpu"), (10.0, 0, "cpu")]
    assert [tuple(s) for s in a["sources"]] == [("node", 6), ("traffic", 1)]
    assert a["peak_minute"] == 2  # two sources stand out there
    b = got["b"]
    assert (b["start"], b["end"], b["peak_minute"], b["confidence"]) == (1, 2, 1, 8.0 / 7 / 1.5)


def test_long_windows_are_cut_at_their_quietest_minute(spark):
    rows = [("a", m, "node", "n", "m", "high", 8.0 if m != 7 else 4.0) for m in range(14)]
    got = sorted((r["start"], r["end"], len(r["evidence"])) for r in build.detected(spark.createDataFrame(rows, POINT), ["case"], {}, longest=8).collect())
    assert got == [(0, 7, 7), (7, 14, 7)]
    assert build.detected(spark.createDataFrame([], POINT), ["case"], {}).collect() == []
