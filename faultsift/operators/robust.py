"""Robust references, scores and neighbour support of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultsift.operators.quantiles import lowest, quantiles
from faultsift.sources.staging import staged

#: Fixed value: median absolute deviation to standard deviation of a normal distribution.
MAD_SCALE = 1.4826


def reference(df: DataFrame, by: list[str], value: str, floor: Column | float = 0.0) -> DataFrame:
    """(by, center, scale, n): median, MAD times 1.4826 but at least the floor, and the number of values."""
    center = df.groupBy(*by).agg(F.percentile(value, 0.5).alias("center"), F.count(value).alias("n"))
    spread = df.join(center, by).groupBy(*by, "center", "n").agg(F.percentile(F.abs(F.col(value) - F.col("center")), 0.5).alias("mad"))
    return spread.select(*by, "center", F.greatest(F.col("mad") * MAD_SCALE, F.lit(floor) if isinstance(floor, float) else floor).alias("scale"), "n")


def quartile_scaler(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, center, scale): median and interquartile range; a flat series gets a hundredth of its median, but at least 1."""
    q = quantiles(df, by, value, [0.25, 0.5, 0.75])
    spread = F.col("q")[2] - F.col("q")[0]
    return q.select(
        *by,
        F.col("q")[1].alias("center"),
        F.when(spread < 1e-6, F.greatest(F.abs(F.col("q")[1]) * 0.01, F.lit(1.0))).otherwise(spread).alias("scale"),
    )


def calibration(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, center, scale) of ln(1 + value), the scale bounded from below four ways. Groups may be of any size."""
    logs = df.select(*by, F.log1p(F.col(value)).alias("x"))
    q = staged(quantiles(logs, by, "x", [0.25, 0.5, 0.75]), "quartiles")
    off = logs.join(q.select(*by, "q"), by).select(*by, F.abs(F.col("x") - F.col("q")[1]).alias("off"))
    mad = quantiles(off, by, "off", [0.5]).select(*by, F.col("q")[0].alias("mad"))
    return q.join(mad, by).select(
        *by,
        F.col("q")[1].alias("center"),
        F.greatest(F.col("mad") * MAD_SCALE, (F.col("q")[2] - F.col("q")[0]) * 0.5, F.abs(F.col("q")[1]) * 0.01, F.lit(0.15)).alias("scale"),
    )


def quiet(df: DataFrame, by: list[str], score: str, order: str, part: float = 0.6) -> DataFrame:
    """The rows of the lowest scores of each group: the given part of them, rounded up; of equal scores those of lower order."""
    return lowest(df, by, score, order, part)


def timeline_calibration(df: DataFrame, by: list[str], step: str, value: str, part: float = 0.6) -> DataFrame:
    """(by, center, scale) fitted on the quietest part of each family's steps.

    A first fit on both ends of the timeline (a quarter of it, 3 to 60 steps) standardises the values; the lowest
    of these (of those equal to nine digits the earlier steps) are the reference of the second. by ends with the family; what stands before it
    names the timeline, whose ends are those of all its families.
    """
    whole = by[:-1]
    ends = df.groupBy(*whole).agg(F.min(step).alias("_a"), F.max(step).alias("_b"))
    # timelines may be as many as there are cases, so only the ends of a single one are broadcast
    rows = (df.join(ends, whole) if whole else df.select("*").join(F.broadcast(ends))).withColumn("_t", F.col("_b") - F.col("_a") + 1)
    r = F.least(F.lit(60), F.greatest(F.lit(3), F.floor(F.col("_t") / 4)))
    edge = (F.col("_t") <= 2 * r) | (F.col(step) < F.col("_a") + r) | (F.col(step) > F.col("_b") - r)
    # each step is stored: quantiles read it several times, and one plan of them all has more sorts than a task has memory for
    first = staged(calibration(staged(rows.where(edge).select(*by, value), "edge"), by, value), "first")
    z = F.round(standardised(F.col(value), F.col("center"), F.col("scale")), 9)
    scored = staged(df.join(first, by).select(*by, step, value, z.alias("_z")), "scored")
    return staged(calibration(staged(quiet(scored, by, "_z", step, part).select(*by, value), "quiet"), by, value), "fitted")


def standardised(value: Column, center: Column, scale: Column) -> Column:
    """How far ln(1 + value) lies above the center, in scales."""
    return F.greatest(F.lit(0.0), (F.log1p(F.greatest(value, F.lit(0.0))) - center) / scale)


def calibrated_probability(df: DataFrame, fitted: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    """(by without the family, step, probability) from the two largest standardised families of each step."""
    z = df.join(fitted, by).withColumn("_z", standardised(F.col(value), F.col("center"), F.col("scale")))
    two = z.groupBy(*by[:-1], step).agg(F.slice(F.sort_array(F.collect_list("_z"), asc=False), 1, 2).alias("_two"))
    return two.select(*by[:-1], step, combined_probability(F.get("_two", 0), F.get("_two", 1)).alias("probability"))


def combined_probability(first: Column, second: Column) -> Column:
    """Probability of the two largest standardised scores; the second may be missing, without a first it is 0."""
    g = F.when(second.isNull(), first).otherwise(first * 0.75 + second * 0.25)
    return F.when(first.isNull(), F.lit(0.0)).otherwise(1 / (1 + F.exp(-(g - 4) / 1.5)))


def rolling_score(
    df: DataFrame, by: list[str], order: list[str], value: str, lookback: int = 60, short_history: int = 4, long_history: int = 15,
    long_series: int = 60, absolute_floor: float = 0.01, relative_floor: float = 0.02, most: float = 25.0, direction: str = "both",
) -> DataFrame:
    """df with center, scale, score and history against the rows before it; score is null with too little history."""
    w = W.partitionBy(*by).orderBy(*order)
    past = w.rowsBetween(-lookback, -1)
    out = df.withColumn("_past", F.collect_list(value).over(past)).withColumn("_all", F.count("*").over(W.partitionBy(*by)))
    middle = lambda a: F.when(
        F.size(a) > 0, (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    )
    out = out.withColumn("history", F.size("_past")).withColumn("_sorted", F.sort_array("_past")).withColumn("center", middle(F.col("_sorted")))
    out = out.withColumn("_off", F.sort_array(F.transform("_past", lambda x: F.abs(x - F.col("center"))))).withColumn("_mad", middle(F.col("_off")))
    scale = F.greatest(F.col("_mad") * MAD_SCALE, F.lit(absolute_floor), F.greatest(F.lit(1.0), F.abs("center")) * relative_floor)
    diff = F.col(value) - F.col("center")
    if direction != "both":
        diff = F.greatest(F.lit(0.0), diff if direction == "high" else -diff)
    need = F.when(F.col("_all") >= long_series, long_history).otherwise(short_history)
    out = out.withColumn("scale", scale).withColumn("score", F.when(F.col("history") >= need, F.least(F.lit(most), F.abs(diff) / F.col("scale"))))
    return out.drop("_past", "_all", "_sorted", "_off", "_mad")


def neighbour_support(df: DataFrame, by: list[str], step: str, active: Column, name: str = "supported") -> DataFrame:
    """df with name: whether a row is active and so is its series one step before or after."""
    w = W.partitionBy(*by).orderBy(step)
    flag = F.when(active, 1).otherwise(0)
    near = F.greatest(F.coalesce(F.max(flag).over(w.rangeBetween(-1, -1)), F.lit(0)), F.coalesce(F.max(flag).over(w.rangeBetween(1, 1)), F.lit(0)))
    return df.withColumn(name, (flag == 1) & (near == 1))
