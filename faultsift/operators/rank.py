"""Root-cause ranking: temporal strengths around events, root scores, graph support, shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultsift.functions.scalars import has

BEFORE, AFTER = 10, 15
# Weights of the root score's parts.
ROOT_WEIGHTS = {"direct": 0.50, "early": 0.20, "pre": 0.15, "recovery": 0.15, "log": 1.10, "traffic_target": 0.15, "traffic_observer": 1.0}
# Weights of the fused rank's parts.
FUSION_WEIGHTS = {
    "severity": 0.28, "persistence": 0.15, "precedence": 0.16, "diversity": 0.14, "directness": 0.16,
    "relational": 0.07, "topology": 0.08, "penalty": -0.04,
}


def phases(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, event, phase, step, length): the steps of each event (event, start, end) before, during, early and in recovery; end is exclusive."""
    s, e = F.col("start"), F.col("end")
    early = F.greatest(F.lit(1), F.floor((e - s) / 3)).cast("long")
    spans = F.array(
        F.struct(F.lit("before").alias("phase"), (s - BEFORE).alias("a"), s.alias("b")),
        F.struct(F.lit("during").alias("phase"), s.alias("a"), e.alias("b")),
        F.struct(F.lit("early").alias("phase"), s.alias("a"), (s + early).alias("b")),
        F.struct(F.lit("recovery").alias("phase"), e.alias("a"), (e + AFTER).alias("b")),
    )
    rows = events.select(*by, "event", F.inline(spans)).withColumn("a", F.greatest(F.lit(0).cast("long"), "a")).where("b > a")
    return rows.select(*by, "event", "phase", (F.col("b") - F.col("a")).alias("length"), F.explode(F.expr("sequence(a, b - 1)")).alias("step"))


def phase_strength(events: DataFrame, scores: DataFrame) -> DataFrame:
    """(event, phase, entity, strength): 0.7 of the largest and 0.3 of the mean score (entity, step, score), unobserved steps as zeros.

    The steps of the phases are listed, so this is an equality join.
    """
    met = phases(events).join(scores, "step")
    return met.groupBy("event", "phase", "entity").agg((F.max("score") * 0.7 + F.sum("score") / F.max("length") * 0.3).alias("strength"))


def root_score(c: dict[str, Column]) -> Column:
    """The weighted parts, and NetFlow as far as the node's own evidence backs it."""
    part = lambda k: F.coalesce(c[k], F.lit(0.0))
    total = sum((part(k) * w for k, w in ROOT_WEIGHTS.items()), F.lit(0.0))
    return total + F.least(part("netflow"), F.greatest(part("direct"), part("log")) * 0.20)


def top(df: DataFrame, by: list[str], score: str, ties: list[str], k: int = 5) -> DataFrame:
    """The k rows of each group with the largest score, with their rank; ties by the given columns, rising."""
    w = W.partitionBy(*by).orderBy(F.col(score).desc(), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def distances(edges: DataFrame, most: int) -> DataFrame:
    """(a, b, hops) of all pairs of nodes at most that many undirected edges (source, target) apart."""
    links = edges.select(F.col("source").alias("x"), F.col("target").alias("y"))
    links = links.union(links.select("y", "x")).distinct()
    known = links.select(F.col("x").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0).alias("hops"))
    for hop in range(1, most + 1):
        step = known.where(F.col("hops") == hop - 1).join(links, F.col("b") == F.col("x")).select("a", F.col("y").alias("b"), F.lit(hop).alias("hops"))
        known = known.union(step).groupBy("a", "b").agg(F.min("hops").alias("hops"))
    return known


def topology_support(severity: DataFrame, hops: DataFrame, by: list[str] | None = None, most: int = 5) -> DataFrame:
    """(by, node, support): what other nodes' severity (by, node, severity) a node explains, nearer ones more.

    The largest contributions are summed and divided by the number of all, three at most; never over 1.
    """
    by = by or []
    near = severity.join(hops, F.col("node") == F.col("b")).where("a <> b").select(*by, "a", (F.col("severity") / (1 + F.col("hops"))).alias("part"), "b")
    w = W.partitionBy(*by, "a").orderBy(F.col("part").desc(), "b")
    ranked = near.withColumn("_r", F.row_number().over(w)).groupBy(*by, F.col("a").alias("node"))
    got = ranked.agg(F.sum(F.when(F.col("_r") <= most, F.col("part"))).alias("s"), F.count("*").alias("n"))
    return got.select(*by, "node", F.least(F.lit(1.0), F.col("s") / F.least(F.lit(3), F.col("n"))).alias("support"))


def directness(source: Column, metric: Column) -> Column:
    """How directly a source tells of its node, some metrics more than others."""
    base = {"node": 1.0, "routing": 1.0, "frr": 1.0, "interface": 0.82, "netflow": 0.48, "traffic": 0.35, "scrape": 0.18}
    m = F.lower(metric)
    strong = (source == "interface") & has(m, "drop", "error", "carrier")
    return F.when(strong, 0.9).otherwise(F.coalesce(*(F.when(source == k, v) for k, v in base.items()), F.lit(0.3)))


def severity(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, severity): 0.8 of the largest score (of 25) and 0.2 of the mean of the next two."""
    w = W.partitionBy(*by).orderBy(F.col("score").desc())
    top3 = points.withColumn("_r", F.row_number().over(w)).where("_r <= 3").groupBy(*by).agg((F.max("score") / 25).alias("a"), (F.sum("score") / 25).alias("s"), F.count("*").alias("n"))
    rest = F.when(F.col("n") > 1, (F.col("s") - F.col("a")) / (F.col("n") - 1)).otherwise(0.0)
    return top3.select(*by, F.least(F.lit(1.0), F.col("a") * 0.8 + rest * 0.2).alias("severity"))


def fusion_parts(events: DataFrame, points: DataFrame, hops: DataFrame, nodes: list[str]) -> DataFrame:
    """(event, node, and the parts of FUSION_WEIGHTS), a row for every node and event.

    events is (event, start, end); points is (event, node, related, source, metric, minute, score) with related
    nodes as an array. Points of other nodes count for their own node only as long as they are in nodes.
    """
    legal = points.where(F.col("node").isin(nodes))
    about = points.select("event", F.col("node").alias("own"), F.explode("related").alias("node"), "score").where(F.col("node").isin(nodes) & ~F.col("node").eqNullSafe(F.col("own")))
    length = F.greatest(F.lit(1), F.col("end") - F.col("start"))
    own = legal.join(events, "event").groupBy("event", "node").agg(
        F.least(F.lit(1.0), F.countDistinct("minute") / F.max(length)).alias("persistence"),
        F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), F.min("minute") - F.max("start")) / F.max(length)).alias("precedence"),
        F.least(F.lit(1.0), F.countDistinct("source") / 3).alias("diversity"),
        F.coalesce(F.try_divide(F.sum(directness(F.col("source"), F.col("metric")) * F.col("score")), F.sum("score")), F.lit(0.0)).alias("directness"),
    )
    direct = severity(legal, ["event", "node"])
    related = severity(about, ["event", "node"]).select("event", "node", F.least(F.lit(1.0), F.col("severity") * 0.8).alias("relational"))
    topology = topology_support(direct, hops, ["event"]).withColumnRenamed("support", "topology")
    out = events.select("event", F.explode(F.array(*map(F.lit, nodes))).alias("node"))
    for part in (direct, own, related, topology):
        out = out.join(part, ["event", "node"], "left")
    penalty = F.when(F.col("severity").isNull() & F.col("relational").isNotNull(), 0.8).when(F.col("severity").isNotNull() & (F.col("directness") < 0.5), 0.35).otherwise(0.0)
    return out.withColumn("penalty", penalty).na.fill(0.0).select("event", "node", *FUSION_WEIGHTS)


def fused(df: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """df with score and rank from the parts severity, persistence, and so on (missing ones count as zero)."""
    have = [k for k in FUSION_WEIGHTS if k in df.columns]
    score = sum((F.coalesce(F.col(k), F.lit(0.0)) * FUSION_WEIGHTS[k] for k in have), F.lit(0.0))
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("directness").desc(), F.col("precedence").desc(), "node")
    return df.withColumn("score", F.greatest(F.lit(0.0), score)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def normalised(df: DataFrame, by: list[str], score: str, name: str = "share") -> DataFrame:
    """df with each score's part of its group's sum; equal parts if the sum is not positive."""
    w = W.partitionBy(*by)
    total = F.sum(score).over(w)
    return df.withColumn(name, F.when(total > 0, F.col(score) / total).otherwise(F.lit(1.0) / F.count("*").over(w)))


def shortlist(df: DataFrame, by: list[str], share: str, ties: list[str], top_p: float = 0.85, least: int = 5, most: int = 5) -> DataFrame:
    """The first rows whose shares before them sum to less than top_p, at least and at most so many."""
    w = W.partitionBy(*by).orderBy(F.col(share).desc(), *ties)
    before = F.coalesce(F.sum(share).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rows = df.withColumn("rank", F.row_number().over(w)).withColumn("_before", before)
    return rows.where((F.col("rank") <= most) & ((F.col("rank") <= least) | (F.col("_before") < top_p))).drop("_before")


def rank_of_ranks(df: DataFrame, by: list[str], round_: str, item: str, score: str) -> DataFrame:
    """(by, item, rank_sum, share): each round ranks the items; shares are the inverse rank sums, normalised."""
    w = W.partitionBy(*by, round_).orderBy(F.col(score).desc(), item)
    sums = df.withColumn("_r", F.row_number().over(w)).groupBy(*by, item).agg(F.sum("_r").alias("rank_sum"))
    inverse = 1 / F.col("rank_sum")
    total = F.sum(inverse).over(W.partitionBy(*by)) if by else F.sum(inverse).over(W.partitionBy(F.lit(0)))
    return sums.withColumn("share", inverse / total)


def majority(df: DataFrame, by: list[str], vote: str) -> DataFrame:
    """(by, vote, votes): the vote given most often, ties to the first in order."""
    counts = df.groupBy(*by, vote).agg(F.count("*").alias("votes"))
    return counts.groupBy(*by).agg(F.max("votes").alias("votes"), F.min_by(vote, F.struct(-F.col("votes"), F.col(vote))).alias(vote))
