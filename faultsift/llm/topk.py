"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Each component is a term and each vector a document with a signed integer impact per term. A shard
keeps the postings of its vectors in segments of falling quantised impact. Queries process the
segments in that order and keep for each vector the score so far; what is left of a vector's norm
bounds what it can still gain or lose, by the Cauchy-Schwarz inequality. Processing stops only when
this proves that few vectors can be members; they are scored in full, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bands of quantised impact.
LEVELS = 4
SHARD_ROWS = 8192
QUERY_ROWS = 512
#: Queries that a shard scores at once.
AT_ONCE = 64
#: Scoring a member in full costs less than another segment once so small a part of a shard remains.
RESCORE_PART = 0.1
#: Scores beyond the range of a long count as its ends.
RANGE = 2.0**63


class Shard:
    """The index of one block of vectors: their postings cut into segments by quantised impact.

    A segment holds the postings of all dimensions in one band of absolute impacts, as a matrix that
    is zero elsewhere; bands are chosen so that each holds about as much of the vectors' norms.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS):
        self.ids, self.whole, self.x = ids, x, x.astype(np.float64)
        size = np.abs(self.x)
        falling = np.sort(size, axis=None)[::-1]
        mass = np.cumsum(falling**2)
        # impacts are whole numbers, so a band that begins at 1 holds all that is left
        cuts = [float(falling[np.searchsorted(mass, mass[-1] * (i + 1) / levels)]) for i in range(levels - 1)] + [1.0] if mass[-1] > 0 else [1.0]
        self.segments: list[np.ndarray] = []
        self.rest: list[np.ndarray] = []
        above, left = np.inf, (size**2).sum(axis=1)
        self.longest = float(np.sqrt(left.max()))
        for low in dict.fromkeys(max(1.0, c) for c in cuts):
            band = np.where((size >= low) & (size < above), self.x, 0.0)
            above, left = low, left - (band**2).sum(axis=1)
            self.segments.append(np.ascontiguousarray(band.T))
            self.rest.append(np.sqrt(np.maximum(left, 0.0)))

    def search(self, names: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its name and the (scores, ids) of its k best vectors of another id, ties to the smaller id."""
        asked, queries = queries, queries.astype(np.float64)
        norm = np.sqrt((queries**2).sum(axis=1))
        size = norm * self.longest  # no partial sum is larger
        slack = 1e-6 + 1e-12 * size[:, None]
        own = names[:, None] == self.ids[None, :]
        score = np.where(own, -np.inf, 0.0)
        k = min(k, len(self.ids))
        member = ~own
        for segment, rest in zip(self.segments, self.rest, strict=True):
            score += queries @ segment
            reach = norm[:, None] * rest[None, :]
            sure = np.partition(score - reach, len(self.ids) - k, axis=1)[:, len(self.ids) - k]
            member = ~own & (score + reach >= np.clip(sure, -RANGE, RANGE)[:, None] - slack)
            if member.sum() <= RESCORE_PART * member.size:
                break
        for i, name in enumerate(names):
            at = np.flatnonzero(member[i])
            if size[i] < 2**52:  # doubles hold the sums exactly
                exact = (self.x[at] @ queries[i]).astype(np.int64)
            elif size[i] < 2**62:
                exact = self.whole[at] @ asked[i]
            else:
                sums = self.whole[at].astype(object) @ asked[i].astype(object)
                exact = np.array([max(-(2**63), min(2**63 - 1, int(v))) for v in sums], np.int64)
            best = np.lexsort((self.ids[at], ~exact))[:k]  # ~: no sign change of the least long
            yield int(name), exact[best], self.ids[at][best]


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, x): floor(scale * component) as integers; without null ids and vectors that are null or hold null, NaN or infinity."""
    v = F.transform(F.col(vec), lambda c: c.cast("double"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (
        df.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull())
        .where(F.coalesce(finite, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda c: F.floor(c * scale).cast("long")).alias("x"))
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query, rank, id, score): each query's k best of all vectors but those of its own id.

    vectors and queries are (id, x) with integer x. Vectors are dealt to shards and queries to
    blocks of bounded size; each shard meets each block once, and only its k best go on. Vectors of
    other lengths than a query's do not match it. Repeated ids are separate candidates; repeated
    query ids are asked once. Empty tables and queries without candidates give no rows. Components of
    any size are taken; scores beyond the range of a long count as its ends.
    """
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    asked = queries.dropDuplicates(["id"])
    blocks = max(1, math.ceil(asked.count() / query_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    # every shard gets a copy of every query block: the stated query set against all rows, in blocks
    sent = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    sent = sent.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        by_length = {n: g for n, g in rows.groupby(rows["x"].map(len)) if n} if len(rows) else {}
        for n, group in by_length.items():
            same = asks[asks["x"].map(len) == n]
            if not len(same):
                continue
            shard = Shard(group["id"].to_numpy(np.int64), np.stack(group["x"].to_numpy()))
            names, x = same["id"].to_numpy(np.int64), np.stack(same["x"].to_numpy())
            for at in range(0, len(names), AT_ONCE):
                for q, score, ids in shard.search(names[at : at + AT_ONCE], x[at : at + AT_ONCE], k):
                    out += [(q, int(i), int(s)) for s, i in zip(score, ids, strict=True)]
        return pd.DataFrame(out, columns=["query", "id", "score"], dtype="int64")

    schema = "query long, id long, score long"
    found = dealt.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInPandas(meet, schema)
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")
