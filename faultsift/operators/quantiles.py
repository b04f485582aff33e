"""Exact order statistics and quantiles of groups of any size.

Equal values of a group are counted first, where they lie. A group with many different values is cut by approximate
quantiles of these into ranges; the histogram of the ranges (which partial sums merge) tells which of them hold the
wanted ranks, and only those are kept and cut again. What is left of a group for a rank fits one window. So no task ever
holds a group: the work on its values is spread by value, and a histogram has as many rows as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultsift.sources.staging import staged

#: Ranges that a group is cut into at a time.
RANGES = 64
#: Different values of which a window picks the wanted ones.
LEAST = 10_000


def ranked_values(df: DataFrame, by: list[str], value: str, ranks: DataFrame, least: int = LEAST) -> DataFrame:
    """ranks (by, name, k) with x: the value (as double) at place k (from 0) in the order of the group's values.

    Nulls are no values; NaN is the largest, as everywhere in Spark. Ranks beyond the group, and groups with a null key,
    have no row.
    """
    cell = "_cell"
    values = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n")).withColumn(cell, F.lit(""))
    wanted = ranks.select(*by, "name", F.col("k").cast("long").alias("k"), F.lit("").alias(cell))
    keys = [*by, cell]
    about = df.groupBy(*by).agg(F.approx_count_distinct(value).alias("n")).agg(F.max("n")).first()[0] or 0
    if about > least / 2:  # else all groups fit a window
        values, wanted = staged(values, "values"), staged(wanted, "ranks")
    while about > least / 2 and _largest(values, keys) > least:
        cuts = F.percentile_approx("_x", [i / RANGES for i in range(1, RANGES)], 10_000)
        # stored, as approximate quantiles depend on the order in which parts are merged: all that reads them must see the same
        cut = staged(values.groupBy(*keys).agg(F.array_distinct(cuts).alias("_cuts")), "cuts")
        placed = values.join(cut, keys).withColumn("_at", F.aggregate("_cuts", F.lit(0), lambda n, c: n + F.when(c < F.col("_x"), 1).otherwise(0))).drop("_cuts")
        w = W.partitionBy(*keys).orderBy("_at")
        ranges = placed.groupBy(*keys, "_at").agg(F.sum("_n").alias("_size")).withColumn("_end", F.sum("_size").over(w))
        met = wanted.join(ranges, keys).where((F.col("k") < F.col("_end")) & (F.col("k") >= F.col("_end") - F.col("_size")))
        deeper = F.concat_ws(".", cell, "_at")
        found = met.select(*by, "name", (F.col("k") - F.col("_end") + F.col("_size")).alias("k"), deeper.alias(cell))
        held = met.select(*keys, "_at").distinct()
        values = staged(placed.join(held, [*keys, "_at"]).select(*by, "_x", "_n", deeper.alias(cell)), "values")
        wanted = staged(found, "ranks")
    w = W.partitionBy(*keys).orderBy("_x")
    placed = values.withColumn("_end", F.sum("_n").over(w))
    hit = (F.col("k") < F.col("_end")) & (F.col("k") >= F.col("_end") - F.col("_n"))
    # a row for each rank: stored, as callers join it with the rows it came from
    return staged(wanted.join(placed, keys).where(hit).select(*by, "name", F.col("_x").alias("x")), "ranked")


def _largest(values: DataFrame, keys: list[str]) -> int:
    return values.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def quantiles(df: DataFrame, by: list[str], value: str, parts: list[float], least: int = LEAST) -> DataFrame:
    """(by, n, q): number of values and their quantiles (between two values in proportion), as percentile gives them."""
    sizes = df.groupBy(*by).agg(F.count(value).alias("n")).where("n > 0")
    at = [(i, p) for i, p in enumerate(parts)]
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    wanted = F.array_distinct(F.concat(*(F.array(F.floor(place(p)), F.ceil(place(p))) for _, p in at)))
    ranks = sizes.select(*by, F.explode(wanted).alias("k")).withColumn("name", F.col("k"))
    found = ranked_values(df, by, value, ranks, least).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("name", "x"))).alias("_v"))
    low = lambda p: F.col("_v")[F.floor(place(p))]
    high = lambda p: F.col("_v")[F.ceil(place(p))]
    # the same sum as percentile's, so that both round alike
    mid = lambda p: (F.ceil(place(p)) - place(p)) * low(p) + (place(p) - F.floor(place(p))) * high(p)
    each = [F.when(F.floor(place(p)) == F.ceil(place(p)), low(p)).when(low(p) == high(p), low(p)).otherwise(mid(p)) for _, p in at]
    return sizes.join(found, by).select(*by, "n", F.array(*each).alias("q"))


def lowest(df: DataFrame, by: list[str], score: str, order: str, part: float, least: int = LEAST) -> DataFrame:
    """The rows with the lowest scores of each group, the given part of them, rounded up; of equal scores those of lower order.

    order is a number that no two rows of a group with the same score share.
    """
    share = F.ceil(F.col("n") * part).cast("long")
    ranks = df.where(F.col(score).isNotNull()).groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit("cut").alias("name"), (share - 1).alias("k"))
    cut = ranked_values(df, by, score, ranks, least).select(*by, F.col("x").alias("_cut"))
    rows = df.join(cut, by)
    below = rows.where(F.col(score) < F.col("_cut"))
    ties = rows.where(F.col(score) == F.col("_cut"))
    taken = below.groupBy(*by).agg(F.count("*").alias("_below"))
    left = ranks.join(taken, by, "left").select(*by, "name", (F.col("k") - F.coalesce("_below", F.lit(0))).alias("k"))
    last = ranked_values(ties, by, order, left, least).select(*by, F.col("x").alias("_last"))
    # one scan of the rows; no union, whose parts may be dealt to unequal numbers of partitions where a join was skewed
    kept = (F.col(score) < F.col("_cut")) | ((F.col(score) == F.col("_cut")) & (F.col(order) <= F.col("_last")))
    return rows.join(last, by).where(kept).drop("_cut", "_last")
