"""Validation, matching and scores of predicted intervals, and their audit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultsift.functions.scalars import dice, parse_utc
from faultsift.plans.dims import CITIES, ROLES, TAXONOMY

LEAST_DICE = 0.4
# The part of a root-cause score by rank.
RANK_SCORE = [1.0, 0.8, 0.6, 0.4, 0.2]
PREDICTION = (
    "prediction_id string, start_time string, end_time string, "
    "root_cause_top5 array<struct<rank:int,network_element_id:string>>, fault_category struct<major_category:string,sub_category:string>"
)


def prediction_flags(df: DataFrame) -> DataFrame:
    """df with core_valid, rca_valid, major_valid, sub_valid and the list of errors."""
    start, end = parse_utc(F.col("start_time")), parse_utc(F.col("end_time"))
    named = F.length(F.trim(F.coalesce("prediction_id", F.lit("")))) > 0
    core = F.coalesce(named & (end > start), F.lit(False))
    top5 = F.col("root_cause_top5")
    names = F.transform(top5, lambda x: x["network_element_id"])
    legal = [f"{c}-{r}" for c in CITIES for r in ROLES]
    ranks = F.transform(top5, lambda x: x["rank"])
    n = F.size(top5)
    rca = top5.isNotNull() & (n <= 5) & (F.size(F.array_distinct(names)) == n) & F.forall(names, lambda x: F.coalesce(x.isin(legal), F.lit(False)))
    rca = F.coalesce(rca & ((n == 0) | (ranks == F.sequence(F.lit(1), F.greatest(n, F.lit(1))))), F.lit(False))
    major, sub = F.col("fault_category.major_category"), F.col("fault_category.sub_category")
    major_ok = F.coalesce(major.isin(sorted({t[1] for t in TAXONOMY})), F.lit(False))
    sub_ok = F.coalesce(F.concat_ws("/", major, sub).isin([f"{t[1]}/{t[2]}" for t in TAXONOMY]), F.lit(False))
    flags = {"core": core, "root_cause_top5": rca, "major_category": major_ok, "sub_category": sub_ok}
    errors = F.array_compact(F.array(*(F.when(~v, F.lit(k)) for k, v in flags.items())))
    return df.select("*", core.alias("core_valid"), rca.alias("rca_valid"), major_ok.alias("major_valid"), sub_ok.alias("sub_valid"), errors.alias("errors"))


def truth_flags(df: DataFrame) -> DataFrame:
    """df with the list of errors of each ground truth: id, interval, root cause or category."""
    start, end = parse_utc(F.col("start_time")), parse_utc(F.col("end_time"))
    legal = [f"{c}-{r}" for c in CITIES for r in ROLES]
    pairs = [f"{t[1]}/{t[2]}" for t in TAXONOMY]
    flags = {
        "ground_truth_id": F.length(F.coalesce("ground_truth_id", F.lit(""))) > 0,
        "interval": F.coalesce(end > start, F.lit(False)),
        "root_cause": F.coalesce(F.col("root_cause.network_element_id").isin(legal), F.lit(False)),
        "fault_category": F.coalesce(F.concat_ws("/", "fault_category.major_category", "fault_category.sub_category").isin(pairs), F.lit(False)),
    }
    return df.withColumn("errors", F.array_compact(F.array(*(F.when(~v, F.lit(k)) for k, v in flags.items()))))


def repeated(df: DataFrame, column: str) -> DataFrame:
    """(column, n) of the values that occur more than once."""
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def not_single(df: DataFrame, case: str, cases: DataFrame) -> DataFrame:
    """(case, n) of the cases (case) that do not have exactly one row in df, those without any included."""
    counts = df.groupBy(case).agg(F.count("*").alias("n"))
    return cases.select(case).distinct().join(counts, case, "left").na.fill(0, ["n"]).where("n <> 1")


def _bins(df: DataFrame, start: str, end: str, classes: list[int]) -> DataFrame:
    """df with a row for each class of lengths near its own (as many steps away as listed), and each bin of that width that it meets."""
    own = F.floor(F.log2((F.col(end) - F.col(start)).cast("double")))
    wide = df.withColumn("_class", F.explode(F.array(*((own + F.lit(k)).cast("int") for k in classes))))
    width = F.pow(F.lit(2.0), F.col("_class"))
    first, last = (F.floor(F.col(start) / width).cast("long"), (F.ceil(F.col(end) / width) - 1).cast("long"))
    return wide.withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, last))))


def dice_pairs(truths: DataFrame, predictions: DataFrame, by: list[str], least: float = LEAST_DICE, spread: bool = True) -> DataFrame:
    """(by, truth_id, prediction_id, dice) of overlapping intervals (start, end) of the same group with at least that coefficient.

    Lengths of such a pair differ by a bounded factor, so it meets in a bin of the truth's class of lengths: the join is one
    of equality on group, class and bin, and a group of any size is spread over its times. A pair counts in the bin in which
    its overlap begins. With least 0 or less, lengths may differ at will, and all overlapping pairs of a group are
    compared, as without spread, which is for groups that are short stretches of time anyway.
    """
    t = truths.select(*by, "truth_id", F.col("start").alias("ts"), F.col("end").alias("te"))
    p = predictions.select(*by, "prediction_id", F.col("start").alias("ps"), F.col("end").alias("pe"))
    on = [t[c] == p[c] for c in by] + [F.col("ts") < F.col("pe"), F.col("ps") < F.col("te")]
    if spread and least > 0:
        far = math.ceil(math.log2((2 - least) / least)) + 1 if least < 1 else 1
        t = _bins(t.where("te > ts"), "ts", "te", [0])
        p = _bins(p.where("pe > ps"), "ps", "pe", list(range(-far, far + 1)))
        begins = F.floor(F.greatest("ts", "ps") / F.pow(F.lit(2.0), t["_class"])).cast("long")
        on = [t[c] == p[c] for c in (*by, "_class", "_bin")] + [F.col("ts") < F.col("pe"), F.col("ps") < F.col("te"), t["_bin"] == begins]
    pairs = t.join(p, on)
    d = dice(F.col("ts"), F.col("te"), F.col("ps"), F.col("pe"))
    return pairs.select(*(t[c] for c in by), "truth_id", "prediction_id", d.alias("dice")).where(F.col("dice") >= least)


def _assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a one-to-one assignment of the largest total weight, by successive shortest paths."""
    n, m = weight.shape
    if n > m:
        return [(i, j) for j, i in _assignment(weight.T)]
    cost = weight.max(initial=0.0) - weight
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        reach, from_ = cost[i] - u[i] - v, np.full(m, -1)
        done, low = np.zeros(m, bool), 0.0
        while True:
            j = int(np.where(done, np.inf, reach).argmin())
            low = reach[j]
            done[j] = True
            if row_of[j] < 0:
                break
            k = row_of[j]
            other = low + cost[k] - u[k] - v
            better = ~done & (other < reach)
            reach[better], from_[better] = other[better], j
        for c in np.flatnonzero(done):
            v[c] -= low - reach[c]
            if row_of[c] >= 0:
                u[row_of[c]] += low - reach[c]
        u[i] += low
        while j >= 0:
            before = from_[j]
            row_of[j] = row_of[before] if before >= 0 else i
            j = before
    return [(int(i), j) for j, i in enumerate(row_of) if i >= 0]


def _runs(df: DataFrame, by: list[str]) -> DataFrame:
    """df (by, start, end, ...) with run: a number for each stretch of intervals that overlap one another."""
    w = W.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("start") < reach, 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(w)).drop("_fresh")


def match(truths: DataFrame, predictions: DataFrame, by: list[str], least: float = LEAST_DICE) -> DataFrame:
    """(by, truth_id, prediction_id, dice): the one-to-one matching of the largest total coefficient in each group.

    Intervals that do not hang together over overlaps can't compete, so each stretch of overlapping intervals of a
    group is matched on its own, and only intervals of one stretch are compared.
    """
    both = truths.select(*by, "start", "end", F.col("truth_id").alias("_t"), F.lit(None).cast("string").alias("_p")).unionByName(
        predictions.select(*by, "start", "end", F.lit(None).cast("string").alias("_t"), F.col("prediction_id").alias("_p"))
    )
    numbered = _runs(both, by)
    t = numbered.where("_t is not null").select(*by, "run", "start", "end", F.col("_t").alias("truth_id"))
    p = numbered.where("_p is not null").select(*by, "run", "start", "end", F.col("_p").alias("prediction_id"))
    pairs = dice_pairs(t, p, [*by, "run"], least, spread=False)
    schema = pairs.schema

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        t, p = sorted(frame["truth_id"].unique()), sorted(frame["prediction_id"].unique())
        place, where = {x: i for i, x in enumerate(t)}, {x: i for i, x in enumerate(p)}
        w = np.zeros((len(t), len(p)))
        w[frame["truth_id"].map(place), frame["prediction_id"].map(where)] = frame["dice"]
        taken = {(t[i], p[j]) for i, j in _assignment(w) if w[i, j] > 0}
        keep = [(a, b) in taken for a, b in zip(frame["truth_id"], frame["prediction_id"], strict=True)]
        return frame[keep]

    return pairs.groupBy(*by, "run").applyInPandas(best, schema).drop("run")


def detection_score(start_off: Column, end_off: Column) -> Column:
    """Of a matched interval whose ends are so many seconds off."""
    return F.greatest(F.lit(0.0), 1 - (F.abs(start_off) + F.abs(end_off)) / 360.0) * 0.3 + 0.7


def rank_score(top5: Column, truth: Column) -> Column:
    at = F.array_position(top5, truth).cast("int")
    return F.coalesce(F.get(F.array(*map(F.lit, RANK_SCORE)), at - 1), F.lit(0.0))


def challenge(matched: DataFrame, n_truths: Column, n_predictions: Column) -> DataFrame:
    """One row of total, ad, rca, major, minor, tp, fp, fn and precision.

    matched is (detection, rca, major_ok, minor_ok) per matched truth; a minor category needs its major.
    """
    tp = F.count("*")
    precision = F.coalesce(F.try_divide(tp.cast("double"), n_predictions), F.lit(0.0))
    per = lambda c, w: F.coalesce(F.sum(c), F.lit(0.0)) / n_truths * w
    got = matched.agg(
        (per("detection", 40.0) * (precision * 0.3 + 0.7)).alias("ad"),
        per("rca", 40.0).alias("rca"),
        per(F.col("major_ok").cast("int"), 10.0).alias("major"),
        per((F.col("major_ok") & F.col("minor_ok")).cast("int"), 10.0).alias("minor"),
        tp.alias("tp"), (n_predictions - tp).alias("fp"), (n_truths - tp).alias("fn"), precision.alias("precision"),
    )
    return got.withColumn("total", F.col("ad") + F.col("rca") + F.col("major") + F.col("minor"))


def peak_driver(node: Column, service: Column) -> Column:
    """Which of two probabilities drives a peak; ambiguous within a millionth, undetermined without both."""
    a, b = F.coalesce(node, F.lit(0.0)), F.coalesce(service, F.lit(0.0))
    return (
        F.when((a <= 0) & (b <= 0), "undetermined").when(F.abs(a - b) <= 1e-6, "ambiguous").when(a > b, "node").otherwise("service")
    )


def anchor_status(claimed: Column, found: Column, evaluated: Column) -> Column:
    """Whether the category of the strongest direct evidence backs the one claimed."""
    return (
        F.when(~evaluated, "not_evaluated").when(found.isNull(), "undetermined").when(claimed == found, "supported").otherwise("unsupported")
    )


def id_differences(a: DataFrame, b: DataFrame, id_a: str, id_b: str) -> DataFrame:
    """(id, missing_in) of the ids that only one side has."""
    both = a.select(F.col(id_a).alias("id")).distinct().withColumn("_a", F.lit(True)).join(
        b.select(F.col(id_b).alias("id")).distinct().withColumn("_b", F.lit(True)), "id", "full"
    )
    return both.where("_a is null or _b is null").select("id", F.when(F.col("_a").isNull(), "left").otherwise("right").alias("missing_in"))
