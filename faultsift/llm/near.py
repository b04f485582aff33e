"""Near-duplicates by the Jaccard similarity of word shingles: SimHash first, and a search for what it can't see.

Fingerprints of 64 bits that differ in two bits at most stand for texts that are nearly equal; texts of
a similarity of 0.8 lie some ten bits apart, where one-wildcard segments would have to be so short that
all texts meet. So SimHash (fingerprint, one-wildcard index) proposes the closest pairs, and the others
are found exactly: each text is the set of its shingles' hashes, in one order for all texts, in which
hashes that a sample holds often come last. Two sets of at least the similarity share a hash among
their first n - ceil(s * n) + 1 (prefix filter), so these are index keys. Pairs that are linked already,
through whatever texts, need no search; all others that share an index key are candidates. A sketch says
at least how far two sets differ; pairs that it leaves are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultsift.llm.common import Scratch, bitmap, in_bitmap, join_skewed, lean, staged, text_batches
from faultsift.llm.components import components
from faultsift.llm.simhash import SEED, fingerprint_of, links

#: The similarity from which texts are near-duplicates: NUM / DEN.
NUM, DEN = 4, 5
#: One text in so many is sampled for the order, and a hash in so many sampled texts comes last.
SAMPLE, OFTEN = 32, 3
#: Rounds in which texts are compared with the first of those that share their least hash, by a new hash each round.
ROUNDS = 2
#: Longs of a set's sketch: whether each of so many times 64 ranges of hashes holds an odd number of its own.
SKETCH = 8
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_SET = "id long, set long, fp long, n int, keys array<long>, least array<long>, sketch array<long>"


def all_shingles(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest, ends, at = b" ".join(words), xxhash.xxh64_intdigest, [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    first = min(shingle, len(words))
    starts = ([0] + [e + 1 for e in ends])[: len(words) - first + 1]
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[first - 1 :], strict=True)], np.uint64)


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The different hashes of a text's word shingles, rising."""
    return np.unique(all_shingles(text, shingle).view(np.int64))


def _name(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """Ranges of hashes with an odd number, as bits: two sets differ in as many hashes at least as their sketches in bits."""
    place = (hashes.view(np.uint64) >> np.uint64(64 - (64 * SKETCH - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=64 * SKETCH) & 1).astype(np.uint8), bitorder="little").view("<i8")


def _often(texts: DataFrame, shingle: int) -> np.ndarray:
    """A bitmap of the hashes that many sampled texts hold; texts is (id, text)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), shingle))], names=["h"])

    some = texts.withColumn("_by", F.xxhash64("text")).where(F.pmod("_by", F.lit(SAMPLE)) == 0).dropDuplicates(["_by"]).select("text")
    return bitmap(some.mapInArrow(lean(hashes), "h long").groupBy("h").count().where(F.col("count") >= OFTEN).select("h"))


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, set, fp, n, keys, least, sketch) of texts (id, text): the set's name, SimHash and size, its index keys, its least hashes for the rounds."""
    shared = texts.sparkSession.sparkContext.broadcast(_often(texts, shingle))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for t in batch.column("text"):
                every = all_shingles(t.as_py(), shingle)
                h = np.unique(every.view(np.int64))
                n = len(h)
                last = in_bitmap(h, shared.value)
                k = n - -(-NUM * n // DEN) + 1 if n else 0
                least = [h[np.argmin(h.view(np.uint64) * turn)] for turn in _TURNS[:ROUNDS]] if n else []
                for column, v in zip(out, (_name(h), fingerprint_of(every), n, h[np.lexsort((h, last))[:k]], least, _sketch(h)), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), *(pa.list_(pa.int64()) for _ in range(3)))
            arrays = [batch.column("id"), *(pa.array(c, kind) for c, kind in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "set", "fp", "n", "keys", "least", "sketch"])

    return texts.mapInArrow(lean(made), _SET)


def _enough(both: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m hashes with so many in common are near-duplicates."""
    return both * (NUM + DEN) >= (n + m) * NUM


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """(a, set): the pairs (a, b) whose sets are near-duplicates, b as set."""
    of = lambda c: sets.select(F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    apart = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH)), F.lit(0))
    maybe = pairs.join(of("a"), "a").join(of("b"), "b").where(apart * (NUM + DEN) <= (F.col("na") + F.col("nb")) * (DEN - NUM))
    pairs = scratch.staged(maybe.select("a", "b"), "near-maybe")
    met = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    reps = texts.sparkSession.sparkContext.broadcast(bitmap(met.join(sets, "set").select("rep")))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(batch.column("id").fill_null(0).to_numpy(zero_copy_only=False), reps.value)
            mine = batch.filter(pa.array(hit & batch.column("id").is_valid().to_numpy(zero_copy_only=False)))
            names = [_name(shingles(t.as_py(), shingle)) for t in mine.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), mine.column("text")], names=["set", "text"])

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            hit = []
            for name, a, b in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                if name != last:
                    last, x = name, shingles(a.as_py(), shingle)
                y = shingles(b.as_py(), shingle)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(both * (NUM + DEN) >= (len(x) + len(y)) * NUM)
            yield batch.select(["a", "set"]).filter(pa.array(hit, pa.bool_()))

    held = texts.mapInArrow(lean(named), "set long, text string").dropDuplicates(["set"])
    left = held.select(F.col("set").alias("a"), F.col("text").alias("x"))
    right = held.select(F.col("set").alias("b"), F.col("text").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    return both.select("a", F.col("b").alias("set"), "x", "y").mapInArrow(lean(same), "a long, set long")


def _components_of(sets: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """sets with comp, the component that the edges (a, set) give each: its own name without any."""
    roots = scratch.staged(components(edges.select("a", F.col("set").alias("b")), stage=scratch.staged), "near-roots")
    return sets.join(roots, sets["set"] == roots["node"], "left").select(*sets.columns, F.coalesce("root", "set").alias("comp"))


def _met_keys(known: DataFrame) -> DataFrame:
    """(key, set, rep, n, comp, i): the index keys, i their place, that two components may share, from sets with their comp."""
    every = known.select("comp", F.explode("keys").alias("key"))
    shared = every.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    met = known.sparkSession.sparkContext.broadcast(bitmap(shared))

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            flat, size = keys.flatten(), np.diff(keys.offsets.to_numpy())
            hit = np.flatnonzero(in_bitmap(flat.to_numpy(zero_copy_only=False), met.value)) if len(flat) else np.zeros(0, np.int64)
            whose = np.repeat(np.arange(len(size)), size)[hit]
            place = hit - (np.cumsum(size) - size)[whose]
            own = [batch.column(c).take(pa.array(whose)) for c in ("set", "rep", "n", "comp")]
            yield pa.RecordBatch.from_arrays([flat.take(pa.array(hit)), *own, pa.array(place, pa.int32())], names=["key", "set", "rep", "n", "comp", "i"])

    return known.select("set", "rep", "n", "comp", "keys").mapInArrow(lean(few), "key long, set long, rep long, n int, comp long, i int")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """docs without near-duplicates: of texts that are linked by pairs as similar as NUM / DEN, the least id stays.

    No link is lost: two texts are linked as well if only a third that is similar to both joins them.
    Texts with equal sets are one, those without words among them; where rows repeat an id, all of them
    stay or go; null ids stay. Other columns pass through. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    rows = scratch.staged(sets_of(texts, shingle), "near-rows")
    sets = rows.groupBy("set").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("fp", "n", "keys", "least", "sketch")))
    sets = scratch.staged(sets.where("rep is not null"), "near-sets")
    some, order = sets.where("n > 0"), F.struct("rep", "set")
    # fingerprints that are equal or two bits apart; b is always the later text
    lead = scratch.staged(some.groupBy("fp").agg(F.min(order).alias("lead")), "near-fingerprints")
    equal = some.join(lead, "fp").where(order != F.col("lead")).select(F.col("lead.set").alias("a"), F.col("set").alias("b"))
    of = lambda c: lead.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_lead"))
    apart = links(lead.select("fp"), stage=scratch.staged).join(of("a"), "a").join(of("b"), "b").select(F.least("a_lead", "b_lead").alias("x"), F.greatest("a_lead", "b_lead").alias("y"))
    pairs = scratch.staged(equal.union(apart.select("x.set", "y.set")), "near-pairs")
    linked = scratch.staged(_verified(pairs, sets, texts, shingle, scratch), "near-found")
    total = some.count()
    for k in range(ROUNDS):
        # large groups of copies: each is compared with the least id that shares its least hash
        left = some.join(linked.select("set"), "set", "left_anti").select("set", "rep", F.col("least")[k].alias("key"))
        first = left.groupBy("key").agg(F.min(order).alias("lead"), F.count("*").alias("m")).where("m > 1")
        pairs = join_skewed(left, first, "key", "m", total).where(order != F.col("lead")).select(F.col("lead.set").alias("a"), F.col("set").alias("b"))
        found = _verified(scratch.staged(pairs, "near-pairs"), sets, texts, shingle, scratch)
        linked = linked.union(scratch.staged(found, "near-found"))
    # sets that are linked already need no pair; in large groups only those outside a key's largest component look for partners
    keyed = scratch.staged(_met_keys(_components_of(some, linked, scratch)), "near-keys")
    parts = keyed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    tops = parts.groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("m", "comp")).alias("top")).where("kinds > 1")
    held = scratch.staged(keyed.join(tops.select("key", F.col("top.comp").alias("most")), "key"), "near-held")
    x = held.select("key", F.struct("rep", "set").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("comp").alias("ca"), (F.col("comp") == F.col("most")).alias("top"))
    y = held.where("comp <> most").select("key", F.struct("rep", "set").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("comp").alias("cb"))
    most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    pairs = x.join(y, "key").where("ca <> cb and (top or a < b)").where(_enough(most, F.col("na"), F.col("nb")))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).select(F.col("a.set").alias("a"), F.col("b.set").alias("b")).distinct()
    edges = linked.union(_verified(scratch.staged(pairs, "near-pairs"), sets, texts, shingle, scratch))
    roots = scratch.staged(components(edges.select("a", F.col("set").alias("b")), stage=scratch.staged), "near-roots")
    least = roots.join(sets, roots["node"] == sets["set"]).groupBy("root").agg(F.min("rep").alias("stays"))
    group = sets.select("set", "rep").join(roots, sets["set"] == roots["node"], "left").join(least, "root", "left")
    group = group.select("set", F.coalesce("stays", "rep").alias("stays"))
    gone = rows.select("id", "set").join(group, "set").where("id <> stays").select(F.col("id").alias("_near_gone")).distinct()
    gone = staged(gone, "near-gone")
    scratch.clear()
    return docs.join(gone, F.col(id_col) == F.col("_near_gone"), "left_anti")
