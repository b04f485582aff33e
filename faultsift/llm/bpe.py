"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into pieces at single spaces; a piece that a task has met before comes from its
cache, which has an older and a newer half: what is met again moves to the newer one, and the older
one goes when that is full. The new pieces of a batch are split by the tokenizer's pattern, and the
symbols of all their unknown words lie in one flat array. In each round every unfinished word merges its
lowest-ranked pair; pairs of bytes lie in a table, and only pairs beside a merge are looked up again, by
binary search over the sorted pair keys. Ids are packed as little-endian unsigned 32-bit
integers, the usual form of token shards.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import string

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultsift.llm.common import with_arrow

#: The pre-tokenization pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes are merged one by one from a heap: whole rounds would cost rounds times length.
LONG_WORD = 1024
#: Bytes of pieces and their ids that a worker remembers; when one half is full, the older half goes.
CACHE_BYTES = 16_000_000
#: Bytes that an entry of the cache takes beside its text and ids.
_ENTRY = 150
_SHIFT = 20
_NONE = np.iinfo(np.int32).max
#: A space that is no cut: white space or the end of the text follows.
_NO_CUT = re.compile(r" (?:\s|\Z)")
#: Below this letter, str.isalpha and the pattern's letters are the same (Latin).
_BEYOND = "\u0250"


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    spare = 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return letters


class Bpe:
    """A vocabulary and its merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = _byte_letters()
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([(vocab[a] << _SHIFT) | vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.into = key[order], order.astype(np.int64), into[order].astype(np.int32)
        self.rank_at = np.append(self.rank, _NONE).astype(np.int32)  # no pair is at -1
        self.bytes_at = self._at(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))
        back = {c: b for b, c in letters.items()}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        token = [b""] * size
        for word, i in vocab.items():
            token[i] = bytes(back[c] for c in word)
        self.special = {}
        for t in spec["added_tokens"]:
            token[t["id"]] = t["content"].encode("utf-8")
            self.special[t["content"]] = np.array([t["id"]], "<u4").tobytes()
        self.blob = np.frombuffer(b"".join(token), np.uint8)
        self.length = np.array([len(t) for t in token], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.merges: dict[int, tuple[int, int]] | None = None
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.held = self.held_older = 0

    def _at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pairs lie among the keys; -1 if they are no merge."""
        pair = left.astype(np.int64) << _SHIFT | right
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, at, -1).astype(np.int32)

    def words(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word; no word is empty."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, at = self.byte_id[raw], self.bytes_at[raw.astype(np.int64) << 8 | np.append(raw[1:], 0)[: len(raw)]]
        name = np.arange(len(words))
        while len(sym):
            starts = np.cumsum(sizes) - sizes
            last = starts + sizes - 1
            at[last] = -1
            rank = self.rank_at[at]
            best = np.minimum.reduceat(rank, starts)
            done = best == _NONE
            if done.any():
                packed, ends = sym.astype("<u4").tobytes(), last + 1
                for i in np.flatnonzero(done).tolist():
                    out[name[i]] = packed[4 * starts[i] : 4 * ends[i]]
                if done.all():
                    break
                stay = np.repeat(~done, sizes)
                sym, rank, at = sym[stay], rank[stay], at[stay]
                sizes, best, name = sizes[~done], best[~done], name[~done]
            hit = rank == np.repeat(best, sizes)
            place = np.arange(len(hit))
            opens = hit & ~np.append(False, hit[:-1])
            run = np.maximum.accumulate(np.where(opens, place, 0))
            hit &= (place - run) % 2 == 0
            sym = np.where(hit, self.into[at], sym)
            stay = ~np.append(False, hit[:-1])
            merged = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            hit, sym, at, sizes = hit[stay], sym[stay], at[stay], sizes - merged
            anew = np.flatnonzero(hit | np.append(hit[1:], False))
            at[anew] = self._at(sym[anew], sym[np.minimum(anew + 1, len(sym) - 1)])
        return out

    def long_word(self, word: bytes) -> bytes:
        """The packed ids of one word, in time that grows as n log n."""
        sym = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        if self.merges is None:
            keys = self.key.tolist()
            self.merges = dict(zip(keys, zip(self.rank.tolist(), self.into.tolist(), strict=True), strict=True))

        def pair(i: int) -> tuple[int, int, int, int] | None:
            j = after[i]
            if i < 0 or j >= len(sym):
                return None
            got = self.merges.get((sym[i] << _SHIFT) | sym[j])
            return got and (got[0], i, sym[i], sym[j])

        heap = [p for p in map(pair, range(len(sym))) if p]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j] = self.merges[(a << _SHIFT) | b][1], -1
            after[i] = after[j]
            if after[i] < len(sym):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        return np.array([s for s in sym if s >= 0], "<u4").tobytes()

    def _learn(self, cache: dict[str, bytes], pieces: set[str], prefix: str) -> None:
        known, size = self.later.get, 0
        found = [(p, self._split(p, prefix)) for p in pieces]
        # a word after a space is as the piece behind the space
        words = {w: known(w[1:]) if w[:1] == " " else None for _, ws in found for w in ws}
        fresh = [w for w, i in words.items() if i is None]
        coded = [w.encode("utf-8") for w in fresh]
        short = [w for w in coded if len(w) <= LONG_WORD]
        ids = iter(self.words(short))
        words.update([(w, next(ids) if len(c) <= LONG_WORD else self.long_word(c)) for w, c in zip(fresh, coded, strict=True)])
        for p, ws in found:
            cache[p] = i = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
            size += len(p) + len(i)
        self.held += size + _ENTRY * len(found)

    def _split(self, piece: str, prefix: str) -> list[str]:
        """The words of prefix and piece; most pieces are Latin letters and maybe punctuation behind them, which need no pattern."""
        core = piece.rstrip(string.punctuation)
        if core.isalpha() and max(core) < _BEYOND:
            return [prefix + core, piece[len(core) :]] if len(core) < len(piece) else [prefix + piece]
        return self.pattern.findall(prefix + piece)

    def _unknown(self, cache: dict[str, bytes], older: dict[str, bytes], pieces: set[str]) -> set[str]:
        """The pieces that neither half of the cache has; what the older has moves to the newer."""
        pieces = {p for p in pieces if p not in cache}
        again = older.keys() & pieces
        for p in again:
            cache[p] = i = older.pop(p)
            self.held_older -= _ENTRY + len(p) + len(i)
            self.held += _ENTRY + len(p) + len(i)
        return pieces - again

    @staticmethod
    def _pieces(text: str) -> list[str]:
        """text cut before each space that a character other than white space follows."""
        pieces = text.split(" ")
        if not _NO_CUT.search(text):
            return pieces
        joined = [pieces[0]]
        for p in pieces[1:]:
            if p and not p[0].isspace():
                joined.append(p)
            else:
                joined[-1] += " " + p
        return joined

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; special tokens in a text become their ids."""
        parts = [self.split_special.split(t) if self.split_special else [t] for t in texts]
        cut = [[p if i % 2 else self._pieces(p) for i, p in enumerate(ps)] for ps in parts]
        if 2 * self.held > CACHE_BYTES:
            self.older, self.held_older = (self.first, self.later), self.held
            self.first, self.later, self.held = {}, {}, 0
        first: set[str] = set()
        later: set[str] = set()
        for ps in cut:
            for p in ps[::2]:
                first.add(p[0])
                later.update(p[1:])
        if later := self._unknown(self.later, self.older[1], later):
            self._learn(self.later, later, " ")
        if first := self._unknown(self.first, self.older[0], first):
            self._learn(self.first, first, "")
        get = self.later.__getitem__
        return [
            b"".join([self.special[p] if i % 2 else self.first[p[0]] + b"".join(map(get, p[1:])) for i, p in enumerate(ps)])
            for ps in cut
        ]

    def decode(self, packed: bytes | None) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed or b"", "<u4").astype(np.int64)
        size = self.length[ids]
        before = np.cumsum(size) - size
        at = np.repeat(self.start[ids] - before, size) + np.arange(int(size.sum()))
        return self.blob[at].tobytes().decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One vocabulary per worker and path."""
    return Bpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """df with packed token ids (binary) and their number (n_tokens).

    A null text is the empty text, which has no ids. Repeated rows and other columns pass through;
    a column named like an output is replaced. path names a byte-level BPE file on every machine.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        packed = load(path).encode([v or "" for v in batch.column(text).to_pylist()])
        return [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]

    fields = [T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    return with_arrow(df, [text], fields, compute, keep)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", name: str = "round_trip", keep: list[str] | None = None) -> DataFrame:
    """encode's columns, and whether the ids decode to the text; a task needs one worker for both."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe, texts = load(path), [v or "" for v in batch.column(text).to_pylist()]
        packed = bpe.encode(texts)
        same = [bpe.decode(p) == t for p, t in zip(packed, texts, strict=True)]
        return [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(same, pa.bool_())]

    fields = [T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField(name, T.BooleanType())]
    return with_arrow(df, [text], fields, compute, keep)


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df with the text of its packed ids; null ids decode to the empty text."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = load(path)
        return [pa.array([bpe.decode(v) for v in batch.column(ids).to_pylist()], pa.string())]

    return with_arrow(df, [ids], [T.StructField(name, T.StringType())], compute, keep)
