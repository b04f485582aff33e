"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in a fixed pseudo-random order, are cut into blocks of equal size. Block j of a
source with weight w of a total of P is released at slot floor(j P / w) and due before slot
ceil((j + 1) P / w). Earliest deadline first gives each slot one released block; as the weights add
up to P, every block runs within its window, so after any number of slots each source has had its
share to within one block. The schedule repeats every P slots, so it is computed once, from the
weights alone, and is P rows long. Slots of a source that has run out stay empty.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters in a block.
BLOCK_UNITS = 100_000
#: Rows that are ordered together, on average.
BUCKET_ROWS = 128
#: An id with more rows than this many buckets, and than this share of all rows, is ordered in parts.
HOT_ROWS, HOT_SHARE = 4, 1e-4
#: Buckets whose sizes are summed up together, before the sums of these groups are.
GROUP = 1024
#: The stream of all sources that the weights do not name.
REST = "*"


def schedule(spark: SparkSession, weights: Mapping[str, int]) -> DataFrame:
    """(stream, k, slot, release, deadline) of one period: earliest deadline first, ties to the first stream named."""
    names, w = list(weights), [int(v) for v in weights.values()]
    if not names or min(w) < 1:
        raise ValueError("each weight must be a whole number of at least 1")
    period, n = sum(w), len(w)
    due = f"cast(ceil((s.next[i] + 1) * {period} / ws[i]) as int)"
    pick = (
        f"array_min(transform(filter(sequence(0, {n - 1}), i -> s.next[i] < ws[i] "
        f"and s.next[i] * {period} div ws[i] <= t), i -> struct({due} as deadline, i as stream)))"
    )
    step = (
        f"(s, t) -> named_struct('next', transform(s.next, (x, i) -> if(i = ({pick}).stream, x + 1, x)), "
        f"'out', concat(s.out, array(named_struct('slot', t, 'stream', ({pick}).stream, "
        f"'k', s.next[({pick}).stream], 'deadline', ({pick}).deadline))))"
    )
    start = (
        f"named_struct('next', array_repeat(0, {n}), "
        "'out', cast(array() as array<struct<slot:int,stream:int,k:int,deadline:int>>))"
    )
    arrays = spark.range(1).select(
        F.array(*map(F.lit, w)).alias("ws"), F.array(*map(F.lit, names)).alias("names")
    )
    ran = arrays.select("ws", "names", F.expr(f"aggregate(sequence(0, {period - 1}), {start}, {step}).out").alias("out"))
    rows = ran.select("ws", "names", F.explode("out").alias("o"))
    return rows.select(
        F.expr("names[o.stream]").alias("stream"),
        F.expr("ws[o.stream]").alias("weight"),
        F.col("o.k").alias("k"),
        F.col("o.slot").alias("slot"),
        F.expr(f"o.k * {period} div ws[o.stream]").cast("int").alias("release"),
        F.col("o.deadline").alias("deadline"),
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str, int],
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    block_units: int = BLOCK_UNITS,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = 0,
    prefix: str = "mix_",
) -> DataFrame:
    """docs with the columns stream, block, slot, release, deadline and at (place in the block), prefixed.

    Every row stays; slot and at give the order. A row counts its text's characters, one at least,
    and belongs to the block in which it starts, so a row longer than a block leaves slots empty.
    Sources without a weight, null among them, share the stream "*"; its weight is 1 if not given.
    Rows come in the order of a hash of their ids; rows with equal ids are ordered by their text's length
    and hash, and equal rows, null ids included, follow each other. An id of more rows than HOT_ROWS
    buckets and HOT_SHARE of the table comes at the end of its bucket, in parts by the hash of the text, each ordered on its
    own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    weights = dict(weights) if REST in weights else {**weights, REST: 1}
    period = sum(weights.values())
    p = lambda c: prefix + c
    named = [s for s in weights if s != REST]
    total = docs.count()
    buckets = max(1, math.ceil(total / bucket_rows))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(
        "*",
        F.when(F.col(source).isin(named), F.col(source)).otherwise(REST).alias(p("stream")),
        F.greatest(F.length(F.coalesce(F.col(text), F.lit(""))), F.lit(1)).cast("long").alias(p("units")),
        key.alias(p("key")),
        F.xxhash64(text).alias(p("hash")),
    ).withColumn(
        p("bucket"),
        F.expr(f"cast(conv(substr(`{p('key')}`, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296").cast("int"),
    )
    # 1 / HOT_SHARE ids at most; of an id's rows, hot is its key and part a share by the text's hash, if it has so many
    most = max(HOT_ROWS * bucket_rows, math.ceil(HOT_SHARE * total))
    many = docs.groupBy(F.col(id_col).alias(p("hot_id"))).agg(F.count("*").alias(p("rows"))).where(F.col(p("rows")) > most)
    rows = rows.join(F.broadcast(many), F.col(id_col).eqNullSafe(F.col(p("hot_id"))) & F.col(p("rows")).isNotNull(), "left")
    is_hot = F.col(p("rows")).isNotNull()
    rows = rows.withColumn(p("hot"), F.when(is_hot, F.col(p("key"))).otherwise("")).withColumn(
        p("part"), F.when(is_hot, F.pmod(F.col(p("hash")), F.ceil(F.col(p("rows")) / bucket_rows))).otherwise(F.lit(0).cast("long"))
    )
    place = ["bucket", "hot", "part"]
    part = rows.groupBy(p("stream"), *map(p, place)).agg(F.sum(p("units")).alias(p("n"))).withColumn(p("group"), F.expr(f"`{p('bucket')}` div {GROUP}"))
    groups = part.groupBy(F.col(p("stream")).alias(p("gs")), F.col(p("group")).alias(p("gg"))).agg(F.sum(p("n")).alias(p("gn")))
    before = lambda c, w: F.coalesce(F.sum(p(c)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    groups = groups.select(p("gs"), p("gg"), before("gn", W.partitionBy(p("gs")).orderBy(p("gg"))).alias(p("g_offset")))
    near = before("n", W.partitionBy(p("stream"), p("group")).orderBy(*map(p, place)))
    part = part.withColumn(p("offset"), near).join(groups, (F.col(p("stream")) == F.col(p("gs"))) & (F.col(p("group")) == F.col(p("gg"))))
    offsets = part.select(*(F.col(p(c)).alias(p(f"o_{c}")) for c in ("stream", *place)), (F.col(p("offset")) + F.col(p("g_offset"))).alias(p("offset")))
    order = [p("key"), F.col(id_col), p("units"), p("hash")]
    inside = W.partitionBy(p("stream"), *map(p, place)).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn(p("before"), F.sum(p("units")).over(inside) - F.col(p("units")))
    same = F.lit(True)
    for c in ("stream", *place):
        same = same & (F.col(p(c)) == F.col(p(f"o_{c}")))
    rows = rows.join(offsets, same)
    start = F.col(p("offset")) + F.col(p("before"))
    rows = rows.withColumn(p("block"), F.floor(start / block_units)).withColumn(p("at"), start % block_units)
    # P rows, from the weights alone
    plan = F.broadcast(schedule(spark, weights).select(*(F.col(c).alias(p(f"of_{c}")) for c in ("stream", "weight", "k", "slot", "release", "deadline"))))
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    cycle = F.expr(f"`{p('block')}` div `{p('of_weight')}`") * period
    rows = rows.withColumn(p("k"), F.pmod(F.col(p("block")), weight[F.col(p("stream"))]).cast("int"))
    rows = rows.join(plan, (F.col(p("stream")) == F.col(p("of_stream"))) & (F.col(p("k")) == F.col(p("of_k"))))
    for c in ("slot", "release", "deadline"):
        rows = rows.withColumn(p(c), (F.col(p(f"of_{c}")) + cycle).cast("long"))
    return rows.select(*docs.columns, *(p(c) for c in ("stream", "block", "slot", "release", "deadline", "at", "units")))
