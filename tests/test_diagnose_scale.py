"""What grows with events in the diagnosis: nodes without evidence are not shuffled, cities are asked about few events."""

from faultsift.operators import diagnose
from faultsift.plans import dims

CELL = "case string, modality string, minute long, entity string, feature string, value double"


def made(spark):
    rows = [(c, "node", m, "wuhan-fw", "node.cpu_usage", 90.0 if 60 <= m < 70 else 10.0 + m % 3 / 10) for c in "ab" for m in range(120)]
    return diagnose.Diagnosis(spark, spark.createDataFrame(rows, CELL), dims.direct_rules(spark), ("case",))


def test_nodes_without_evidence_are_not_shuffled(spark):
    d = made(spark)
    scores = [d.lines[k] for k in ("node", "edge", "log")]
    parts = diagnose.candidate_parts(d.events, *scores, by=d.by)
    assert sorted((r["event"], r["n"]) for r in parts.groupBy("event").agg(diagnose.F.count("*").alias("n")).collect()) == [("a:60", 80), ("b:60", 80)]
    plan = parts._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("explode") < plan.index("Join") and "explode" not in plan[plan.index("Join") :].split("phase")[0]
    assert {(r["node"], r["observed"]) for r in parts.where("direct > 0").collect()} == {("wuhan-fw", True)}
    more = scores[0].unionByName(scores[0].withColumn("entity", diagnose.F.lit(None).cast("string")))
    assert sorted(diagnose.candidate_parts(d.events, more, *scores[1:], by=d.by).collect()) == sorted(parts.collect())


def test_cities_are_asked_about_events_without_signals(spark, monkeypatch):
    asked, of = [], diagnose.city_signals
    monkeypatch.setattr(diagnose, "city_signals", lambda events, *a: asked.append(events.count()) or of(events, *a))
    assert {(r["event"], r["category"]) for r in made(spark).categories.where("rank = 1").collect()} == {("a:60", "firewall_cpu_pressure"), ("b:60", "firewall_cpu_pressure")}
    assert asked == [0]
