"""SimHash near-duplicates with deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most two bits differ in at most one bit of their
upper or of their lower half. Each half is therefore indexed whole and with each one of its bits
left out (a wildcard); fingerprints that share an index key are compared in full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.common import Scratch, join_skewed, staged, with_arrow
from faultsift.llm.components import components

SEED = 42
MAX_BITS = 2
#: Index keys with more fingerprints than this are linked by neighbour values instead of pairs.
CROWD = 32
#: Fingerprints with this share of all rows need no shuffle to meet their component.
HOT_SHARE = 1e-4


def _sum_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first.

    Eight counters share a machine word, so at most 255 rows are added up before they are widened.
    """
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = bits.view(np.uint64)
    whole = len(lanes) // 255 * 255
    total = np.zeros(64, np.int64)
    if whole:
        sums = np.ascontiguousarray(lanes[:whole].reshape(-1, 255, 8).sum(axis=1))
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    if whole < len(lanes):
        total += np.ascontiguousarray(lanes[whole:].sum(axis=0)).view(np.uint8)
    return total


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of shingle hashes: a bit is set if it is in over half of them; zero without any."""
    bits = (2 * _sum_bits(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles; zero without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest, ends, at = xxhash.xxh64_intdigest, [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0] + [e + 1 for e in ends[: -shingle]]
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)]
    return fingerprint_of(np.array(hashes, np.uint64))


def add_fingerprint(df: DataFrame, text: str = "text", name: str = "fp", shingle: int = 3, keep=None) -> DataFrame:
    """df with the SimHash of each text as a long. Null and blank texts get zero."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        values = batch.column(text)
        return [pa.array([fingerprint(v.as_py(), shingle) for v in values], pa.int64())]

    return with_arrow(df, [text], [T.StructField(name, T.LongType())], compute, keep)


def _index(fps: DataFrame) -> DataFrame:
    """(fp, key, bit): key names the half, the wildcard (32: none) and what is left of the half."""
    slots = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("slot"))
    pos = F.expr("cast(slot % 33 as int)")
    value = F.expr("shiftrightunsigned(fp, cast(32 * (slot div 33) as int)) & 4294967295L")
    wild = F.when(pos < 32, F.expr("shiftleft(1L, cast(slot % 33 as int))")).otherwise(F.lit(0).cast("long"))
    return slots.select(
        "fp",
        (F.expr("shiftleft(cast(slot as long), 32)") + value.bitwiseAND(F.bitwise_not(wild))).alias("key"),
        F.when(pos < 32, value.bitwiseAND(wild) != 0).alias("bit"),
    )


def links(fps: DataFrame, crowd: int = CROWD, stage: Callable[[DataFrame, str], DataFrame] = staged) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints which differ in two bits at most.

    Index keys that few fingerprints share are joined with themselves and the pairs verified. Where
    a key is crowded, pairs would grow with its square; there each fingerprint is sent to itself and
    its 64 neighbours at one bit. Fingerprints that meet at a value are within two bits of each
    other, and any two within two bits meet, so a star at each value keeps every component whole.
    """
    by_key = W.partitionBy("key")
    index = (
        _index(fps)
        .withColumn("n", F.count("*").over(by_key))
        .where("n > 1")
        .withColumn("lo", F.min("bit").over(by_key))
        .withColumn("hi", F.max("bit").over(by_key))
        .where("bit is null or lo <> hi")
        .select("fp", "key", "bit", "n")
    )
    index = stage(index, "simhash-index")
    few = index.where(F.col("n") <= crowd)
    left = few.select("key", F.col("fp").alias("a"), F.col("bit").alias("abit"))
    right = few.select("key", F.col("fp").alias("b"), F.col("bit").alias("bbit"))
    pairs = (
        left.join(right, "key")
        .where("a < b and (abit is null or abit <> bbit)")
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
        .select("a", "b")
    )
    crowded = index.where(F.col("n") > crowd).select("fp").distinct()
    near = crowded.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")).select(
        "fp",
        F.when(F.col("i") == 64, F.col("fp"))
        .otherwise(F.expr("fp ^ shiftleft(1L, cast(i as int))"))
        .alias("value"),
    )
    star = (
        near.withColumn("a", F.min("fp").over(W.partitionBy("value")))
        .select("a", F.col("fp").alias("b"))
        .where("a <> b")
    )
    return pairs.union(star).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id) per row of df; component_id is the least id reachable over links.

    Rows without words share fingerprint zero. Copies share one fingerprint and are never paired
    with each other. Repeated ids and rows come back as often as they went in; a null id stays null
    and takes part in its component, whose id is the least that is not null. An empty table gives
    an empty result. Columns other than id and text are ignored, whatever their names.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    scratch = Scratch(df.sparkSession)
    hashed = staged(add_fingerprint(rows, "text", "fp", shingle, keep=["id"]), "simhash")
    reps = scratch.staged(hashed.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "simhash-reps")
    roots = scratch.staged(components(links(reps.select("fp"), stage=scratch.staged), stage=scratch.staged), "simhash-roots")
    least = (
        roots.join(reps, roots.node == reps.fp)
        .groupBy("root")
        .agg(F.min("rep").alias("component_id"))
    )
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    known = staged(
        reps.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "rep").alias("component_id")),
        "simhash-components",
    )
    # fingerprints of many rows meet their component in a broadcast table of 1 / HOT_SHARE rows at most
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scratch.clear()
    return join_skewed(hashed, known, "fp", "n", total, HOT_SHARE).select("id", "fp", "component_id")
