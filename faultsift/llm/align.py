"""Alignment of the tokens of two tokenizers by their bytes, and how usual each linked pair of ids is.

Tokenizer A (byte-level BPE) and B (sentencepiece BPE) cut the same bytes, a space and the text. Every token
points to the farthest-right token of the other side that it overlaps; pointers are doubled until all reach
the token at which both sides end, and that terminal labels the group. Tokens of a group are linked, A with B.

Neither tokenizer has a token across a single space before a word, so no group crosses one either: texts are
cut there, each different stretch is encoded and aligned once (many at a time, in numpy) and remembered.

The number of documents that hold a pair linked is a sum over all documents. The most usual pairs, a million
at most, are broadcast to score the documents; rarer ones, none of which can be frequent, are joined.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.bpe import LONG_WORD, Bpe
from faultsift.llm.common import staged, text_batches

#: Pairs whose counts are broadcast (16 bytes each).
HEAD_PAIRS = 1_000_000
#: Characters of texts that are aligned at a time; a longer text is aligned alone.
BATCH_CHARS = 1_000_000
#: Bytes of stretches that a worker remembers; beyond that only those met most often stay, in half the room.
CACHE_BYTES = 128_000_000
#: Words of A that a worker remembers beside them.
CACHE_WORDS = 200_000
#: Bytes that a stretch takes beside its text, groups and pairs.
_ENTRY = 300
#: Groups with more pairs are counted by their different ids instead of being listed.
_LISTED = 4096
#: Pairs that a task counts before it passes them on.
_PENDING = 4_000_000
_MARK = "▁"
_ODD = re.compile(r"^ | $| \s")


def stretches(text: str) -> list[str]:
    """The text cut before each space between a character that is no space and one that is no white space.

    The space before each stretch (also before the first) is left out.
    """
    parts = text.split(" ")
    if not _ODD.search(text):
        return parts
    out = parts[:1]
    for before, p in zip(parts, parts[1:], strict=False):
        if p and before and not p[0].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    return out


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all the ranges, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def group_labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and B, from 0, by pointer jumping; the ends of both sides end alike."""
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)  # the token of B over the last byte of each of A
    over_b = np.searchsorted(ends_a, ends_b)
    own = np.arange(len(ends_b))
    to = np.append(n + over_a, np.where(ends_a[over_b] == ends_b, n + own, over_b))
    terminal = to[n:] == n + own
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    number = np.cumsum(terminal) - 1
    label = number[to - n]
    return label[:n], label[n:]


class Aligner:
    """Two vocabularies, and the stretches that a worker has met."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Bpe(path_a)
        self.a.split_special = None  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("pieces must not go on after a space")
        token = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length_b = np.array([len(t) for t in token], np.int64)
        self.blob_b, self.start_b = np.frombuffer(b"".join(token), np.uint8), np.cumsum(self.length_b) - self.length_b
        self.n_b = len(pieces)
        self.space = self.b.piece_to_id(_MARK)
        self.words_a: dict[str, bytes] = {}
        self.written = [f"{i}{end}".encode() for i in range(max(len(self.a.length), self.n_b)) for end in (",", "|", ";", "")]
        self.at: dict[str, int] = {}
        self.groups: list[bytes] = []
        #: Per stretch: tokens of A, of B, groups, links, 1 if its bytes agree; number of pairs, and where they begin; its bytes here, and how often it was met.
        self.counts, self.n_pairs, self.first = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.cost, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.codes, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the stretches that were met most often, twice at least, in half the room; the longer ago they were met, the less it counts."""
        stay = np.argsort(-self.met, kind="stable")
        stay = stay[self.met[stay] > 1]
        stay = np.sort(stay[np.cumsum(self.cost[stay]) <= CACHE_BYTES // 2])
        place = _gather(self.first[stay], self.n_pairs[stay])
        self.codes, self.times = self.codes[place], self.times[place]
        self.counts, self.n_pairs, self.cost, self.met = self.counts[stay], self.n_pairs[stay], self.cost[stay], self.met[stay] // 2
        self.first = np.cumsum(self.n_pairs) - self.n_pairs
        names = list(self.at)  # in the order of their numbers
        self.groups = [self.groups[i] for i in stay.tolist()]
        self.at = {names[i]: k for k, i in enumerate(stay.tolist())}

    def _encode_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text; the library adds the space itself, but not to an empty text."""
        return [ids or [self.space] for ids in self.b.encode(texts, num_threads=1)]

    def _encode_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each text, one after the other, and their numbers.

        Texts are split into words as one string, as no word goes on over a space before one; those that end
        in white space, which could, are split alone and stand for one word.
        """
        joined = [not t[-1:].isspace() and t != "" for t in texts]
        words = self.a.pattern.findall("".join([" " + t for t, ok in zip(texts, joined, strict=True) if ok]))
        if len(self.words_a) > CACHE_WORDS:
            self.words_a = {}
        known = self.words_a
        new = [w for w in dict.fromkeys(words) if w not in known]
        short = [w for w in new if len(w) <= LONG_WORD // 4]
        known.update(zip(short, self.a.words([w.encode() for w in short]), strict=True))
        known.update((w, self.a.encode([w])[0]) for w in new if len(w) > LONG_WORD // 4)
        packed = [known[w] for w in words]
        sizes, chars = np.array([len(p) // 4 for p in packed], np.int64), np.cumsum(np.array([len(w) for w in words], np.int64))
        ends = np.cumsum([len(t) + 1 for t, ok in zip(texts, joined, strict=True) if ok])
        last = np.searchsorted(chars, ends, "right")
        before = np.append(0, np.cumsum(sizes))
        n = np.zeros(len(texts), np.int64)
        n[np.flatnonzero(joined)] = np.diff(np.append(0, before[last]))
        if not all(joined):
            alone = self.a.encode([" " + t for t, ok in zip(texts, joined, strict=True) if not ok])
            n[~np.array(joined)] = [len(p) // 4 for p in alone]
            whole, rest, at, of = b"".join(packed), iter(alone), 0, []
            for ok, k in zip(joined, n.tolist(), strict=True):
                of.append(whole[4 * at : 4 * (at + k)] if ok else next(rest))
                at += k * ok
            packed = of
        return np.frombuffer(b"".join(packed), "<u4").astype(np.int64), n

    def _learn(self, new: list[str]) -> None:
        a, n_a = self._encode_a(new)
        ids_b = self._encode_b(new)
        b, n_b = np.array([i for ids in ids_b for i in ids], np.int64), np.array([len(i) for i in ids_b])
        size_a, size_b = self.a.length[a], self.length_b[b]
        unit_a, unit_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        want = [(" " + t).encode() for t in new]
        n_bytes = np.array([len(w) for w in want])
        agree = (np.bincount(unit_a, size_a, len(new)) == n_bytes) & (np.bincount(unit_b, size_b, len(new)) == n_bytes)
        bytes_b = self.blob_b[_gather(self.start_b[b], size_b)]
        if not agree.all():  # those have no groups
            stay_a, stay_b = agree[unit_a], agree[unit_b]
            bytes_b = bytes_b[np.repeat(stay_b, size_b)]
            a, size_a, unit_a, b, size_b, unit_b = a[stay_a], size_a[stay_a], unit_a[stay_a], b[stay_b], size_b[stay_b], unit_b[stay_b]
            n_a, n_b = n_a * agree, n_b * agree
        same = bytes_b == np.frombuffer(b"".join(w for w, ok in zip(want, agree, strict=True) if ok), np.uint8)
        counts = np.zeros((len(new), 5), np.int64)
        counts[:, 0], counts[:, 1] = n_a, n_b
        of_byte = np.repeat(np.flatnonzero(agree), n_bytes[agree])
        counts[:, 4] = agree & (np.bincount(of_byte, ~same, len(new)) == 0)
        group_a, group_b = group_labels(np.cumsum(size_a), np.cumsum(size_b)) if len(a) else (a, b)
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        unit = unit_b[np.cumsum(in_b) - 1]
        counts[:, 2] = np.bincount(unit, minlength=len(new))
        counts[:, 3] = np.bincount(unit, in_a * in_b, len(new)).astype(np.int64)
        self.groups += self._written(a, b, group_a, group_b, in_a, in_b, n_a, n_b)
        codes, times, of = self._pairs(a, b, group_a, in_a, in_b, unit)
        n_pairs = np.bincount(of, minlength=len(new))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.first = np.append(self.first, len(self.codes) + np.cumsum(n_pairs) - n_pairs)
        self.counts, self.n_pairs = np.concatenate([self.counts, counts]), np.append(self.n_pairs, n_pairs)
        self.codes, self.times = np.append(self.codes, codes), np.append(self.times, times)
        self.cost = np.append(self.cost, _ENTRY + n_bytes + 16 * n_pairs + np.array([len(g) for g in self.groups[-len(new) :]]))
        self.met = np.append(self.met, np.zeros(len(new), np.int64))

    def _written(self, a, b, group_a, group_b, in_a, in_b, n_a, n_b) -> list[bytes]:
        """The groups of each stretch as text."""
        end_a, end_b = np.cumsum(in_a), np.cumsum(in_b)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[end_a - 1], mark_b[end_b - 1] = 1, 2
        mark_b[np.cumsum(n_b)[n_b > 0] - 1] = 3
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + (end_b - in_b)[group_a]] = 4 * a + mark_a
        out[np.arange(len(b)) + end_a[group_b]] = 4 * b + mark_b
        words, to = [self.written[i] for i in out.tolist()], np.cumsum(n_a + n_b).tolist()
        return [b"".join(words[i:j]) for i, j in zip([0, *to], to, strict=False)]

    def _pairs(self, a, b, group_a, in_a, in_b, unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs of each stretch as a * n_b + b, how often each is linked, and the stretch."""
        start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        listed = in_a * in_b <= _LISTED
        reps = np.where(listed, in_b, 0)[group_a]
        code = np.repeat(a, reps) * self.n_b + b[_gather(start_b[group_a], reps)]
        owner = np.repeat(unit[group_a], reps)
        weight = np.ones(len(code), np.int64)
        for g in np.flatnonzero(~listed).tolist():
            ids_a, k_a = np.unique(a[start_a[g] : start_a[g] + in_a[g]], return_counts=True)
            ids_b, k_b = np.unique(b[start_b[g] : start_b[g] + in_b[g]], return_counts=True)
            code = np.append(code, (ids_a[:, None] * self.n_b + ids_b).ravel())
            weight = np.append(weight, (k_a[:, None] * k_b).ravel())
            owner = np.append(owner, np.full(len(code) - len(owner), unit[g]))
        return _summed(owner, code, weight)

    def align(self, texts: list[str]) -> dict[str, list]:
        """The columns of each text."""
        if self.cost.sum() > CACHE_BYTES:
            self.forget()
        cut = [stretches(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        if new := [u for u in dict.fromkeys(flat) if u not in self.at]:
            self._learn(new)
        size = np.array([len(us) for us in cut])
        where = list(map(self.at.__getitem__, flat))
        at = np.array(where, np.int64)
        self.met += np.bincount(at, minlength=len(self.met))
        doc = np.repeat(np.arange(len(texts)), size)
        whole = (size > 0) & (np.bincount(doc, 1 - self.counts[at, 4], len(texts)) == 0)
        stay = whole[doc]
        sums = np.stack([np.bincount(doc[stay], self.counts[at[stay], k], len(texts)) for k in range(4)]).astype(np.int64)
        written, ends = list(map(self.groups.__getitem__, where)), np.cumsum(size).tolist()
        groups = [b";".join(written[i:j]).decode() if ok else "" for i, j, ok in zip([0, *ends], ends, whole.tolist(), strict=False)]
        # the stretches of each text, then their pairs
        of, seen = np.unique(doc[stay] * len(self.at) + at[stay], return_counts=True)
        owner, at = of // max(1, len(self.at)), of % max(1, len(self.at))
        place = _gather(self.first[at], self.n_pairs[at])
        codes, times, owner = _summed(np.repeat(owner, self.n_pairs[at]), self.codes[place], self.times[place] * np.repeat(seen, self.n_pairs[at]))
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        pack = lambda v: [v[i:j].astype("<i8").tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
        return dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums.tolist(), strict=True)) | {"groups": groups, "pairs": pack(codes), "times": pack(times)}


def _summed(owner: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different codes of each owner, in order, with the sums of their weights and their owner."""
    if not len(code):
        return code, weight, owner
    span = int(code.max()) + 1
    fits = span * (int(owner.max()) + 1) < 1 << 62
    order = np.argsort(owner * span + code) if fits else np.lexsort((code, owner))
    owner, code, weight = owner[order], code[order], weight[order]
    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])))
    return code[first], np.add.reduceat(weight, first), owner[first]


@functools.lru_cache(maxsize=1)
def load(path_a: str, path_b: str) -> Aligner:
    """One pair of vocabularies per worker."""
    return Aligner(path_a, path_b)


def pieces(path_b: str) -> int:
    """The size of B's vocabulary, which pairs are numbered by."""
    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with tokens, groups and links of each text.

    groups: per group A's ids, a bar, B's ids, groups apart by semicolons. pairs and times: the different linked
    pairs of ids (a * |B| + b) and how often each is linked, as packed 64-bit integers in the order of pairs.
    A null or empty text, and one whose tokens' bytes are not a space and the text (as one with U+2581), has no tokens:
    zeros and empty groups. Repeated rows pass through; a column named like an output is replaced.
    B's file must not normalise texts, and none of its pieces may hold a space after another character.
    """
    added = T.StructType.fromDDL(_FIELDS).fields
    names = {f.name for f in added}
    kept = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    kept_names = [f.name for f in kept]
    text_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(path_a, path_b)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            start, chars = 0, 0
            for i, t in enumerate(texts):
                chars += len(t)
                if chars >= BATCH_CHARS or i + 1 == len(texts):
                    made = aligner.align(texts[start : i + 1])
                    arrays = [batch.column(n).slice(start, i + 1 - start) for n in kept_names]
                    arrays += [pa.array(made[f.name], {"string": pa.string(), "binary": pa.binary()}.get(f.dataType.typeName(), pa.int64())) for f in added]
                    yield pa.RecordBatch.from_arrays(arrays, names=kept_names + [f.name for f in added])
                    start, chars = i + 1, 0
        pa.default_memory_pool().release_unused()

    return df.select(*dict.fromkeys([*kept_names, text])).mapInArrow(run, T.StructType(kept + added))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of the task hold each pair, added up before they are passed on."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        codes, n = np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held])
        return _summed(np.zeros(len(codes), np.int64), codes, n)[:2]

    def batch_of(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["pair", "docs"])

    for batch in batches:
        codes, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8"), return_counts=True)
        held.append((codes.astype(np.int64), n.astype(np.int64)))
        size += len(codes)
        if size > _PENDING:
            held = [added()]
            size = len(held[0][0])
            if 2 * size > _PENDING:
                yield from batch_of(*held[0])
                held, size = [], 0
    if held:
        yield from batch_of(*added())


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """pair, docs (documents that hold it linked) and best (no pair of its A id has more)."""
    counts = staged(aligned.select("pairs").mapInArrow(_counted, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")), "pair-counts")
    a = F.expr(f"pair div {n_b}").alias("a")
    top = counts.groupBy(a).agg(F.max("docs").alias("_most"))
    # one row for each id of A: bounded by its vocabulary
    return counts.select("*", a).join(F.broadcast(top), "a").select("pair", "docs", (F.col("docs") == F.col("_most")).alias("best"))


def score(aligned: DataFrame, n_b: int, head: int = HEAD_PAIRS) -> DataFrame:
    """aligned (a stored table, as it is read several times) with n_best and count_sum instead of pairs and times."""
    spark = aligned.sparkSession
    counts = staged(pair_counts(aligned, n_b), "pairs")
    step = F.floor(4 * F.log2("docs")).cast("int")
    sizes = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)  # at most 256 rows
    least, total = None, 0
    for row in sizes:
        total += row["count"]
        if total > head:
            break
        least = row["step"]
    usual = counts.where(step >= least) if least is not None else counts.limit(0)
    table = usual.orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "docs", "best")))
    kept = [f for f in aligned.schema.fields if f.name not in ("pairs", "times")]
    names = [f.name for f in kept]
    added = "n_best long, count_sum long, _pairs array<long>, _times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best = shared.value
        for batch in batches:
            packed = [batch.column(c).to_pylist() for c in ("pairs", "times")]
            code, times = (np.frombuffer(b"".join(p), "<i8") for p in packed)
            doc = np.repeat(np.arange(len(batch)), [len(p) // 8 for p in packed[0]])
            at = np.searchsorted(pairs, code)
            known = np.zeros(len(code), bool)
            inside = at < len(pairs)
            known[inside] = pairs[at[inside]] == code[inside]
            hit, of = at[known], doc[known]
            total, n_best = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(total, of, times[known] * docs[hit])
            np.add.at(n_best, of, times[known] * best[hit])
            ends = np.searchsorted(doc[~known], np.arange(len(batch) + 1)).astype(np.int32)
            rare = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[~known].astype(np.int64))) for v in (code, times)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(n_best), pa.array(total), *rare], names=[*names, "n_best", "count_sum", "_pairs", "_times"]
            )

    schema = T.StructType(kept + T.StructType.fromDDL(added).fields)
    scored = aligned.mapInArrow(run, schema)
    if total <= head:
        return scored.drop("_pairs", "_times")
    # the other pairs are in fewer documents than a broadcast one, so no key of this join is frequent
    scored = staged(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("_row", F.inline(F.arrays_zip("_pairs", "_times")))
    found = rare.join(counts.where(step < least) if least is not None else counts, F.col("_pairs") == F.col("pair"))
    more = found.groupBy("_row").agg(F.sum(F.col("_times") * F.col("best").cast("long")).alias("_best"), F.sum(F.col("_times") * F.col("docs")).alias("_sum"))
    out = scored.join(more, "_row", "left")
    return out.select(*names, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))
