"""Language-model scoring with a probabilistic suffix tree.

The model reads a text as the bytes of its lower-cased words, one space between them, and an end
mark. A context (a suffix of what came before) becomes a state if it is frequent enough and if its
next-byte distribution diverges from that of the next shorter context by more than chance would. Each
state's distribution is smoothed with that of the longest state among its own suffixes. A text is
scored by always taking the longest suffix that is a state. A context needs an absolute count, so the
states grow with the corpus; they stay in Spark.

A context and its next byte are one number, the newest byte of the context highest, so that all
contexts that share a suffix are neighbours in order. Tasks send the numbers that they have counted,
sorted and packed, to blocks, which are ranges of numbers. A block holds whole the contexts within its
range; the few that reach over its ends are summed up over blocks first, and each block that they reach
into holds their states. So a block scores any number in its range alone. Texts are scored in batches:
each sends the blocks its different numbers, without the bytes that no state reaches, packed in the same
way, and gets their log10 probabilities back in that order.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.common import TEXT_BATCH_ROWS, Scratch, bitmap, in_bitmap, lean, release, staged, text_batches, text_of, with_arrow
from faultsift.llm.rlz import _packed, _unpacked, _unplanes

#: The longest context, in bytes: with the next byte it fills a 64-bit number.
DEPTH = 7
#: A context needs this many training positions, whatever the corpus.
LEAST_COUNT = 64
#: And this divergence (nats a symbol) of its next-byte distribution from that of the next shorter one, beyond what chance gives.
LEAST_DIVERGENCE = 0.01
#: Words with this share of the training tokens are counted in a broadcast table of 1 / share words at most.
HEAVY_SHARE = 2e-6
END = 10
#: Bytes of text that are counted at a time, and different numbers that a task holds before it sends them.
PIECE_BYTES, HELD = 1_500_000, 3_000_000
#: Training bytes that a block counts, on average, and numbers that are sampled for the blocks' limits.
BLOCK_BYTES, SAMPLED = 12_000_000, 200_000
#: Bytes of text that are scored against one slice of the states.
BATCH_BYTES = 8_000_000
#: So many of a slice's states, the shortest, have their counts in a matrix (2 KB each).
DENSE = 8192
#: Log10 probabilities are sent in units of 2 ** -32, which the sum over a text doesn't show in its first nine digits.
UNIT = 2.0**-32
_BYTE = np.uint64(8)
#: White space as spaces, A-Z in lower case.
_PLAIN = bytes.maketrans(b"\t\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"     abcdefghijklmnopqrstuvwxyz")
#: What stands before a text.
_BEFORE = b"\0" * (DEPTH - 1) + bytes([END])
#: Odd factors of hashes, tried in turn until no two codes of a batch collide.
MIXERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def normal(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or "").encode("utf-8").lower().split()


def _stream(text: str | None) -> bytes:
    plain = (text or "").encode("utf-8").translate(_PLAIN).strip(b" ")
    while b"  " in plain:
        plain = plain.replace(b"  ", b" ")
    return plain + bytes([END])


def _codes(text: bytes) -> np.ndarray:
    """The number of each position: the seven bytes before it, newest highest, and its own; an end mark stands before the text."""
    codes = np.ndarray((len(text),), "<u8", _BEFORE + text, strides=(1,)).copy()  # the position's own byte is the highest
    own = codes >> np.uint64(56)
    codes <<= _BYTE
    codes |= own
    return codes


def _counted(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, rising, and the sums of their counts (one each by default)."""
    if n is None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
        return codes[first], np.diff(first, append=len(codes))
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n[:0]


def _prefix(codes: np.ndarray, k: int) -> np.ndarray:
    """The context of k bytes of each code."""
    return codes >> np.uint64(64 - 8 * k) if k else np.zeros_like(codes)


def _gram(codes: np.ndarray, k: int) -> np.ndarray:
    """The context of k bytes and the next byte of each code."""
    return (_prefix(codes, k) << _BYTE) | (codes & np.uint64(255))


def _key(prefix: np.ndarray, k: int) -> np.ndarray:
    return prefix | np.uint64(k << 56)


def _pack_grams(codes: np.ndarray, n: np.ndarray) -> bytes:
    return _packed(np.diff(codes, prepend=np.uint64(0)), n.astype(np.uint64))


def _unpack_grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    d, n = _unpacked(data, "uu")
    return np.cumsum(d, dtype=np.uint64), n.astype(np.int64)


def limits(texts: DataFrame, size: int, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """The least codes of the blocks but the first, from a sample; where they lie has no influence on the result."""
    blocks = 1 + size // block_bytes
    if blocks == 1:
        return np.zeros(0, np.uint64)
    share = min(1.0, 16 * SAMPLED / size)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_codes(_stream(t.as_py()))[::16].view(np.int64))], names=["code"])

    some = texts.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    got = np.sort(some.mapInArrow(sample, "code long").toPandas()["code"].to_numpy(np.int64).view(np.uint64))
    starts = np.unique(got[np.arange(1, blocks) * len(got) // blocks]) if len(got) >= blocks else np.zeros(0, np.uint64)
    return starts[starts > got[0]] if len(starts) else starts  # so that each block holds a code


def _edges(block: int, starts: np.ndarray) -> list[tuple[int, int]]:
    """The contexts (length, prefix) that may reach over an end of the block: those of its first code and of the next block's."""
    at = [starts[i - 1] for i in (block, block + 1) if 0 < i <= len(starts)]
    return sorted({(k, int(c) >> (64 - 8 * k) if k else 0) for c in at for k in range(DEPTH + 1)} | ({(0, 0)} if not at else set()))


def _levels(codes: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, counts) of each length of context, the longest first; codes rise."""
    yield codes, n
    for _ in range(DEPTH):
        codes, n = _counted(codes >> np.uint64(16) << _BYTE | (codes & np.uint64(255)), n)  # without the oldest byte of the context
        yield codes, n


def counted_blocks(texts: DataFrame, starts: np.ndarray) -> DataFrame:
    """(block, grams, len, ctx, syms, counts): each block's packed codes, and its part of the contexts that reach over its ends."""
    text_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        parts: list[np.ndarray] = []
        size = 0

        def piece() -> None:
            nonlocal size
            held.append(_counted(np.concatenate(parts)))
            parts.clear()
            size = 0

        def made() -> pa.RecordBatch:
            codes, n = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            cut = [0, *np.searchsorted(codes, starts).tolist(), len(codes)]
            sent = [(b, _pack_grams(codes[i:j], n[i:j])) for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if i < j]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in sent], pa.int32()), pa.array([x[1] for x in sent], pa.binary())], names=["block", "grams"])

        for batch in batches:
            for t in batch.column(0):
                parts.append(_codes(_stream(t.as_py())))
                size += len(parts[-1])
                if size > PIECE_BYTES:
                    piece()
                    if sum(len(c) for c, _ in held) > HELD:
                        yield made()
        if parts:
            piece()
        if held:
            yield made()

    kind = pa.schema([("block", pa.int32()), ("grams", pa.binary()), ("len", pa.int32()), ("ctx", pa.int64()), ("syms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def merge(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        codes, n = _counted(*(np.concatenate(x) for x in zip(*(_unpack_grams(g.as_py()) for g in group.column("grams")), strict=True)))
        rows = [(block, _pack_grams(codes, n), None, None, None, None)]
        edges = _edges(block, starts)
        levels = _levels(codes, n)
        del codes, n
        for k in range(DEPTH, -1, -1):
            gram, count = next(levels)
            for prefix in (p for at, p in edges if at == k):
                i = int(np.searchsorted(gram, np.uint64(prefix << 8), side="left"))
                j = int(np.searchsorted(gram, np.uint64((prefix << 8) + 255), side="right"))
                rows.append((block, None, k, prefix, (gram[i:j] & np.uint64(255)).astype(np.int32), count[i:j].copy()))
        del levels, gram, count
        release()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return texts.mapInArrow(lean(count), "block int, grams binary").groupBy("block").applyInArrow(merge, "block int, grams binary, len int, ctx long, syms array<int>, counts array<long>")


def states(blocks: DataFrame, starts: np.ndarray, least_count: int = LEAST_COUNT, least_divergence: float = LEAST_DIVERGENCE) -> DataFrame:
    """(block, states): the packed states of each block, with those that reach over its ends; blocks as from counted_blocks."""
    edges = blocks.where("grams is null")
    sums = edges.select("len", "ctx", F.explode(F.arrays_zip("syms", "counts")).alias("x")).groupBy("len", "ctx", F.col("x.syms").alias("sym")).agg(F.sum("x.counts").alias("n"))
    whole = sums.groupBy("len", "ctx").agg(F.collect_list("sym").alias("syms"), F.collect_list("n").alias("counts"))
    mine = edges.select("block", "len", "ctx").join(whole, ["len", "ctx"])

    def keep(group: pa.Table, edge: pa.Table) -> pa.Table:
        if not len(group):
            return pa.Table.from_arrays([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["block", "states"])
        block = group.column("of")[0].as_py()
        levels = [(gram, _small(n)) for gram, n in _levels(*_unpack_grams(group.column("grams")[0].as_py()))]
        over: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(DEPTH + 1)]
        for e in edge.to_pylist():
            s = np.argsort(e["syms"])
            over[e["len"]][e["ctx"]] = (np.array(e["syms"], np.uint64)[s], np.array(e["counts"], np.int64)[s])
        out: list[list[np.ndarray]] = [[], [], [], []]
        up: tuple[np.ndarray, ...] | None = None
        for k in range(DEPTH + 1):
            gram, n = levels.pop()
            n = n.astype(np.int64)
            for prefix, (sym, count) in over[k].items():  # what the other blocks hold of it, too
                rest = (gram >> _BYTE) != np.uint64(prefix)
                gram, n = np.append(gram[rest], sym | np.uint64(prefix << 8)), np.append(n[rest], count)
            if over[k]:
                order = np.argsort(gram, kind="stable")
                gram, n = gram[order], n[order]
                del order
            prefix = gram >> _BYTE
            first = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
            kinds = np.diff(first, append=len(prefix))
            ctx = prefix[first]
            del prefix
            total = np.add.reduceat(n, first)
            share = n / np.repeat(total, kinds)
            if k == 0:
                stay = np.ones(len(first), bool)
            else:
                was_gram, was_share = up
                parent = (ctx >> _BYTE) if k > 1 else np.zeros_like(ctx)
                at = np.searchsorted(was_gram, np.repeat(parent, kinds) << _BYTE | (gram & np.uint64(255)))
                above = was_share[np.minimum(at, len(was_gram) - 1, out=at)]
                del at, was_gram, was_share
                gain = np.add.reduceat(share * (np.log(share) - np.log(above)), first)
                del above
                # a sample of so many positions diverges by (kinds - 1) / (2 total) by chance
                stay = (total >= least_count) & (gain - (kinds - 1) / (2 * total) >= least_divergence)
                stay &= (ctx & np.uint64(255)) != 0  # zero bytes stand before a text's first end mark
            up = (gram, share)
            pick = np.repeat(stay, kinds)
            for column, v in zip(out, (_key(ctx[stay], k), kinds[stay], (gram[pick] & np.uint64(255)).astype(np.uint8), n[pick]), strict=True):
                column.append(v)
            del gram, n, share, pick, first, kinds, total, ctx, stay
        up = None
        made = pa.Table.from_arrays([pa.array([block], pa.int32()), pa.array([_pack_states(*(np.concatenate(c) for c in out))], pa.binary())], names=["block", "states"])
        out.clear()
        release()
        return made

    own = blocks.where("grams is not null").select(F.col("block").alias("of"), F.col("grams").alias("grams"))
    return own.groupBy("of").cogroup(mine.groupBy("block")).applyInArrow(keep, "block int, states binary")


def _pack_states(key: np.ndarray, kinds: np.ndarray, sym: np.ndarray, n: np.ndarray) -> bytes:
    """States in the order of their keys."""
    order = np.argsort(key, kind="stable")
    moved = _rows(kinds, order)
    key, kinds = key[order], kinds[order]
    return _packed(np.diff(key, prepend=np.uint64(0)), kinds.astype(np.uint32), sym[moved].astype(np.uint32), n[moved].astype(np.uint64))


def _unpack_states(data: bytes) -> tuple[np.ndarray, ...]:
    key, kinds, sym, n = _unpacked(data, "uwwu")
    return np.cumsum(key, dtype=np.uint64), kinds.astype(np.int64), sym.astype(np.uint8), _small(n)


def _unpack_keys(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")  # of the first of the four arrays
    return np.cumsum(_unplanes(data[16 : 16 + size], np.uint64), dtype=np.uint64)


def _small(n: np.ndarray) -> np.ndarray:
    """Counts in 32 bits if they fit."""
    return n.astype(np.uint32 if not len(n) or n.max() < 1 << 32 else np.int64)


def _rows(kinds: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Where the next bytes of the picked states lie, in their order."""
    start = np.cumsum(kinds) - kinds
    size = kinds[pick]
    kind = np.int32 if int(kinds.sum()) < 1 << 31 else np.int64
    out = np.repeat((start[pick] - (np.cumsum(size) - size)).astype(kind), size)
    out += np.arange(len(out), dtype=kind)
    return out


class Model:
    """States (key, kinds, sym, n), keys and each state's next bytes rising, ready to score texts whose contexts they cover."""

    def __init__(self, key: np.ndarray, kinds: np.ndarray, sym: np.ndarray, n: np.ndarray):
        self.key, self.kinds = key, kinds
        self.total = np.add.reduceat(n, np.cumsum(kinds) - kinds, dtype=np.float64) if len(kinds) else np.zeros(0)
        kind = np.uint32 if len(key) < 1 << 24 else np.int64
        self.pair, self.count = np.repeat(np.arange(len(key), dtype=kind) << kind(8), kinds) | sym.astype(kind), _small(n)
        self.dense = np.zeros(256 * min(DENSE, len(key)))
        low = int(np.searchsorted(self.pair, kind(len(self.dense))))
        self.dense[self.pair[:low]] = self.count[:low]

    @classmethod
    def of(cls, slices: list[bytes]) -> Model:
        """The states of several packed slices; no state is in two of them."""
        parts = [_unpack_states(s) for s in slices]
        key = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)])
        kinds, sym, n = (np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]) for i, t in ((1, np.int64), (2, np.uint8), (3, np.uint32)))
        del parts
        order = np.argsort(key, kind="stable")
        moved = _rows(kinds, order)
        sym, n = sym[moved], n[moved]
        del moved
        return cls(key[order], kinds[order], sym, n)

    def log10(self, texts: Iterable[bytes]) -> np.ndarray:
        """The log10 probability of each text, its end mark included."""
        return np.concatenate([np.zeros(0), *(self._log10(part) for part in pieces(texts))])

    def _seen(self, pair: np.ndarray) -> np.ndarray:
        """How often each state (times 256) had each next byte."""
        if len(self.dense) == 256 * len(self.key):
            return self.dense[pair]
        out, rare = np.zeros(len(pair)), pair >= len(self.dense)
        out[~rare] = self.dense[pair[~rare]]
        rest = pair[rare].astype(self.pair.dtype)
        at = np.minimum(np.searchsorted(self.pair, rest), len(self.pair) - 1)
        out[rare] = np.where(self.pair[at] == rest, self.count[at], 0.0)
        return out

    def _log10(self, texts: list[bytes]) -> np.ndarray:
        codes, place = _places(texts)
        return _sums(self.of_codes(codes)[place], texts)

    def of_codes(self, every: np.ndarray) -> np.ndarray:
        """The log10 probability of each code's next byte after its context; codes rise."""
        nexts = (every & np.uint64(255)).astype(np.int64)
        share = np.full(len(every), 1 / 256)
        # the codes rise, so those of one context are neighbours and look for it once
        for k, (first, prefix) in enumerate([*_contexts(every)][::-1] if len(self.key) else ()):
            want = _key(prefix, k)
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            met = self.key[at] == want
            if not met.any():
                continue
            size = np.diff(first, append=len(every))
            here, at = np.flatnonzero(np.repeat(met, size)), np.repeat(at[met], size[met])
            # without a context, each of the 256 bytes is given one count
            more = np.full(len(at), 256.0) if k == 0 else self.kinds[at].astype(np.float64)
            share[here] = (self._seen(at << 8 | nexts[here]) + more * share[here]) / (self.total[at] + more)
        return np.log10(share)


def _places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The different codes of the texts, rising, and which of them each position has."""
    codes = np.concatenate([_codes(t) for t in texts])
    order = np.argsort(codes)
    codes = codes[order]
    new = np.append(True, codes[1:] != codes[:-1])
    place = np.empty(len(codes), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return codes[new], place


def _sums(values: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The sum of each text's values, one for each byte."""
    size = np.array([len(t) for t in texts])
    return np.add.reduceat(values, np.cumsum(size) - size)


def _contexts(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the longest first, the places where a context begins in rising codes, and the contexts; a shorter one begins where a longer one does."""
    first, prefix = np.arange(len(codes), dtype=np.int32 if len(codes) < 1 << 31 else np.int64), codes
    for k in range(DEPTH, -1, -1):
        prefix = prefix >> _BYTE if k else np.zeros_like(prefix)
        new = np.append(True, prefix[1:] != prefix[:-1])[: len(prefix)]
        first, prefix = first[new], prefix[new]
        yield first, prefix


def context_keys(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The different keys, rising, of all contexts of the codes (rising, too) that the bitmap may hold."""
    met = []
    for k, (_, prefix) in zip(range(DEPTH, -1, -1), _contexts(codes), strict=True):
        key = _key(prefix, k)
        met.append(key[in_bitmap(key.view(np.int64), known)])
    return np.concatenate(met[::-1])


def shortened(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Codes (rising) with zeros for the bytes before the longest context that the bitmap may hold.

    A state's oldest byte is never zero, so such a code meets the same states as the whole one.
    """
    out = codes & np.uint64(255)
    left, rest = np.arange(len(codes), dtype=np.int32 if len(codes) < 1 << 31 else np.int64), codes
    for k in range(DEPTH, 0, -1):
        prefix = _prefix(rest, k)
        first = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])[: len(prefix)])
        met = in_bitmap(_key(prefix[first], k).view(np.int64), known)
        met = np.repeat(met, np.diff(first, append=len(prefix)))
        out[left[met]] |= prefix[met] << np.uint64(64 - 8 * k)
        left, rest = left[~met], rest[~met]
    return out


def pieces(texts: Iterable[bytes], most: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The texts in lists of about so many bytes."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _different(codes: np.ndarray) -> np.ndarray:
    """The different codes, rising; it sorts codes in place."""
    codes.sort()
    new = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    return codes[new]


def _codes_of(part: list[bytes]) -> np.ndarray:
    """The codes of several texts."""
    codes, at = np.empty(sum(map(len, part)), np.uint64), 0
    for t in part:
        codes[at : (at := at + len(t))] = _codes(t)
    return codes


def different_codes(texts: Iterable[bytes]) -> np.ndarray:
    """The different codes of the texts, rising."""
    return _different(np.concatenate([_different(_codes_of(part)) for part in pieces(texts)]))


def hashed_sums(texts: list[bytes], every: np.ndarray, values: np.ndarray) -> np.ndarray | None:
    """The sum of the values of each text's codes; every has the different codes, in the order of the values.

    Sorting hashes with the number of the text in their low bits takes a fraction of sorting places by code. None if
    different codes collide with each factor.
    """
    low = np.uint64(max(1, (len(texts) - 1).bit_length()))
    for factor in MIXERS:
        hashed = every * factor >> low
        order = np.argsort(hashed)
        hashed = hashed[order]
        if not (hashed[1:] == hashed[:-1]).any():
            break
    else:
        return None
    values = values[order]
    del hashed, order
    both, at = np.empty(sum(map(len, texts)), np.uint64), 0
    for i, t in enumerate(texts):
        code = _codes(t)
        code *= factor
        code >>= low
        code <<= low
        code |= np.uint64(i)
        both[at : (at := at + len(t))] = code
    both.sort()
    new = np.ones(len(both), bool)
    for i in range(1, len(both), PIECE_BYTES):
        j = min(i + PIECE_BYTES, len(both))
        new[i:j] = (both[i:j] ^ both[i - 1 : j - 1]) >> low != 0
    first = np.append(np.flatnonzero(new).astype(np.int32 if len(both) < 1 << 31 else np.int64), len(both))
    del new
    both &= (np.uint64(1) << low) - np.uint64(1)
    out = np.zeros(len(texts))
    cut = [*range(0, len(values), PIECE_BYTES // 4), len(values)]
    for a, b in zip(cut, cut[1:], strict=False):
        out += np.bincount(both[first[a] : first[b]].view(np.int64), np.repeat(values[a:b], np.diff(first[a : b + 1])), len(texts))
    return out


def log10_of(texts: list[bytes], known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The log10 probability of each text of a batch, from the values of all shortened codes of the batch, in their order."""
    every = different_codes(texts)
    short = shortened(every, known)
    asked = _different(short.copy())
    if len(asked) != len(values):
        raise ValueError(f"{len(asked)} codes were asked for, {len(values)} answered")
    value = values[np.searchsorted(asked, short)]
    del short, asked
    sums = hashed_sums(texts, every, value)
    if sums is None:
        parts = ((part, *_places(part)) for part in pieces(texts))
        sums = np.concatenate([_sums(value[np.searchsorted(every, c)][place], part) for part, c, place in parts])
    return sums


def answers(texts: DataFrame, modelled: DataFrame, starts: np.ndarray, known: Broadcast, scratch: Scratch) -> DataFrame:
    """(batch, block, values): what each block says of the shortened codes in its range that a batch of texts (batch, packed) meets; it reads a table of scratch."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, codes, part, size = None, [], [], 0
        unpack = zstandard.ZstdDecompressor().decompress

        def piece() -> None:
            nonlocal part, size
            if part:
                codes.append(_different(_codes_of(part)))
            part, size = [], 0

        def made() -> pa.RecordBatch:
            piece()
            asked = _different(shortened(_different(np.concatenate(codes)), known.value))
            codes.clear()
            cut = [0, *np.searchsorted(asked, starts).tolist(), len(asked)]
            sent = [(b, name, _packed(np.diff(asked[i:j], prepend=np.uint64(0)))) for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if i < j]
            del asked
            release()
            kinds = (pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in sent], t) for i, t in enumerate(kinds)], names=["block", "batch", "codes"])

        for batch in batches:
            for b, t in zip(batch.column("batch").to_pylist(), batch.column("packed"), strict=True):
                if b != name:
                    if name is not None:
                        yield made()
                    name = b
                part.append(unpack(t.as_py()))
                size += len(part[-1])
                if size > PIECE_BYTES:
                    piece()
        if name is not None:
            yield made()

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if len(asked):
            wants = [np.cumsum(_unpacked(c.as_py(), "u")[0], dtype=np.uint64) for c in asked.column("codes")]
            codes = _different(np.concatenate(wants))
            values = np.rint(Model.of([s.as_py() for s in held.column("states")]).of_codes(codes) / -UNIT).astype(np.uint64)
            block = asked.column("block")[0].as_py()
            out = [(b, block, _packed(values[np.searchsorted(codes, w)])) for b, w in zip(asked.column("batch").to_pylist(), wants, strict=True)]
            del wants, codes, values
        release()
        kinds = (pa.int64(), pa.int32(), pa.binary())
        return pa.Table.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["batch", "block", "values"])

    asked = texts.select("batch", "packed").repartition("batch").sortWithinPartitions("batch").mapInArrow(lean(ask), "block int, batch long, codes binary")
    asked = scratch.staged(asked, "pst-asked")  # else the texts' shuffle stays as long as the answers'
    return asked.groupBy("block").cogroup(modelled.groupBy("block")).applyInArrow(answer, "batch long, block int, values binary")


def words_of(texts: list[bytes]) -> pa.DictionaryArray:
    """All words of the texts (as from _stream) in their order."""
    joined = b" ".join(t[:-1] for t in texts if len(t) > 1)
    words = pc.list_flatten(pc.split_pattern(pa.array([joined], pa.binary()), " ")) if joined else pa.array([], pa.binary())
    return words.dictionary_encode()


def word_counts(texts: list[bytes], often: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
    """Of each text: its words, those that are among the often ones, the sum of log10(count + 1) over them, and the others, as often as they stand in it."""
    size = np.array([t.count(b" ") + (len(t) > 1) for t in texts])
    doc = np.repeat(np.arange(len(texts)), size)
    words = words_of(texts)
    at = words.indices.to_numpy()
    c = np.append(counts, 0)[pc.index_in(words.dictionary, often).fill_null(len(counts)).to_numpy()]
    known = c[at] > 0
    base = np.bincount(doc, np.log10(c + 1.0)[at], len(texts))
    rare = np.flatnonzero(~known)
    ends = np.cumsum(np.bincount(doc[rare], minlength=len(texts)))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), words.dictionary.take(pa.array(at[rare])).cast(pa.string()))
    return size, np.bincount(doc, known, len(texts)).astype(np.int64), base, lists


def score(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text: str = "text",
    least_divergence: float = LEAST_DIVERGENCE,
    heavy_share: float = HEAVY_SHARE,
    least_count: int = LEAST_COUNT,
    batch_bytes: int = BATCH_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; learns from the rows not held out.

    base_score is that of an add-one model of single words. Null texts are empty: one token, the end.
    Rows that repeat an id and its text come back as often as they went in. Without training rows,
    both models know nothing. Words too rare for the broadcast table meet their counts in a join, a
    row per document and word, of which no word has more than heavy_share of the tokens. Columns of
    docs other than id and text are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), text_of(text).alias("text"))
    learn = rows.where(~F.col("held_out")).select("text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    starts = limits(learn, size, block_bytes)
    blocks = scratch.staged(counted_blocks(learn, starts), "pst-grams")
    model = Scratch(spark)
    modelled = model.staged(states(blocks, starts, least_count, least_divergence), "pst-states")
    scratch.clear()
    n_batches = 1 + size // batch_bytes

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        texts = (_stream(t.as_py()) for batch in batches for t in batch.column(0))

        def made() -> Iterator[pa.RecordBatch]:
            got = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
            held.clear()
            yield from pa.table({"word": got["word"].cast(pa.string()), "c": got["c_sum"]}).to_batches(max_chunksize=100_000)

        for part in pieces(texts, BATCH_BYTES // 2):
            found = words_of(part)
            held.append(pa.table({"word": found.dictionary, "c": np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))}))
            if sum(map(len, held)) > 1_000_000:
                yield from made()
        if held:
            yield from made()

    vocabulary = staged(learn.mapInArrow(lean(words), "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "pst-words")
    ends = learn.count()
    tokens, kinds = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    whole = float(tokens + kinds + 1)
    least = max(1, math.ceil(heavy_share * tokens))
    heavy = vocabulary.where(F.col("c") >= least).toPandas()  # at most 1 / heavy_share words
    known = spark.sparkContext.broadcast((pa.array(heavy["word"], pa.string()).cast(pa.binary()), heavy["c"].to_numpy(np.int64)))
    fields = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_words", pa.int64()), ("n_met", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.string()))])

    def rate(mine: pa.Table, met: pa.Table) -> pa.Table:
        if not len(mine):
            return fields.empty_table()
        values = np.concatenate([_unpacked(v.as_py(), "u")[0] for v in met.sort_by("block")["values"]]) * -UNIT
        del met
        unpack = zstandard.ZstdDecompressor().decompress
        texts = [unpack(t.as_py()) for t in mine["packed"]]
        scores = log10_of(texts, states_met.value, values)
        del values
        release()
        # rows of one batch are numbered, so that also those of one id and text have keys of their own
        keys = np.arange(len(mine)) + (mine["batch"][0].as_py() << 32)
        made, i = [], 0
        for part in pieces(texts, BATCH_BYTES // 2):
            here = slice(i, i := i + len(part))
            n_words, n_met, base, words = word_counts(part, *known.value)
            names = (mine[c].combine_chunks()[here] for c in ("id", "held_out"))
            columns = [pa.array(keys[here]), *names, pa.array(n_words), pa.array(n_met), pa.array(base), pa.array(scores[here]), words]
            made += pa.Table.from_arrays(columns, schema=fields).to_batches(max_chunksize=TEXT_BATCH_ROWS)
        del texts
        release()
        return pa.Table.from_batches(made, fields)

    dealt = rows.withColumn("id", F.col("id").cast("long")).withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(n_batches)))
    kept = [T.StructField("id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("batch", T.LongType())]

    def squeeze(batch: pa.RecordBatch) -> list[pa.Array]:
        pack = zstandard.ZstdCompressor(3).compress
        return [pa.array([pack(_stream(t.as_py())) for t in batch.column("text")], pa.binary())]

    dealt = with_arrow(dealt, ["text"], [T.StructField("packed", T.BinaryType())], squeeze, [f.name for f in kept])

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(_unpack_keys(s.as_py()).view(np.int64) for s in batch.column("states"))])

    states_met = spark.sparkContext.broadcast(bitmap(modelled.select("states"), of=keys))
    found = answers(dealt, modelled, starts, states_met, model)
    rated = dealt.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(rate, "key long, id long, held_out boolean, n_words long, n_met long, base double, score double, words array<string>")
    # texts and states are gone before words meet their counts
    rated = staged(rated, "pst-rated")
    model.clear()
    # a word without a count adds log10(0 + 1); a partition's rare words, each once, are far fewer than the places where they stand
    rare = vocabulary.where(F.col("c") < least).select("word", F.log10(F.col("c") + 1).alias("more"))
    met = rated.select("key", F.explode("words").alias("word")).join(rare.hint("shuffle_hash"), "word").groupBy("key").agg(F.sum("more").alias("more"), F.count("*").alias("n"))
    n_tokens = F.col("n_words") + 1
    return rated.drop("words").join(met, "key", "left").select(
        "id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("n_met") + F.coalesce("n", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(math.log10(ends + 1)) - n_tokens * F.lit(math.log10(whole))).alias("base_score"),
        "score",
    )
