"""Exact duplicate passages by relative Lempel-Ziv factoring.

Every window of n words is a reference position. The windows' hashes are dealt to reference blocks
by range, packed per task; a block finds for each window its first occurrence. Before that, each
task keeps of equal windows only those of its smallest document and settles the others itself, so a
passage that a third of all documents share reaches its block once per task. A document is then
factored greedily: a factor runs on while consecutive windows continue at consecutive reference
positions. Each window was looked up on its own, also where one factor ends and the next begins, so
windows across a boundary are found as well.

A factor counts only as far as it is proved. The blocks compare 64-bit hashes; the reference documents
then send a second, independent hash of the windows that factors point at, and a factor keeps the
windows where both agree (128 bits). Windows whose first hash led to another text are compared by
their words. The proved factors are the duplicate spans.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.common import bitmap, in_bitmap, lean, release, staged, text_batches

WINDOW = 13
#: Words that a task holds at once; a longer text is held whole.
TASK_WORDS = 500_000
#: Windows of a reference block, on average.
BLOCK_WINDOWS = 500_000
#: Windows of a reference document whose proofs travel together.
SEGMENT = 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

_FOUND = "id long, row long, start array<int>, size array<int>, ref array<long>, ref_start array<int>"
_FOUND_ARROW = pa.schema(
    [("id", pa.int64()), ("row", pa.int64()), ("start", pa.list_(pa.int32())), ("size", pa.list_(pa.int32())), ("ref", pa.list_(pa.int64())), ("ref_start", pa.list_(pa.int32()))]
)
# a task's windows go to their block, and what it has found itself through that to a bucket of documents
_SENT = "block int, windows binary, bucket int, found binary"
_SENT_ARROW = pa.schema([("block", pa.int32()), ("windows", pa.binary()), ("bucket", pa.int32()), ("found", pa.binary())])
_REPLY = "bucket int, found binary"
_REPLY_ARROW = pa.schema([("bucket", pa.int32()), ("found", pa.binary())])


def window_hashes(words: list[bytes], n: int, bits: int = 64, second: bool = False) -> np.ndarray:
    """A hash of each n consecutive words: its highest bits, or the second hash, which is independent of it."""
    size = len(words) - n + 1
    if size < 1:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest if second else xxhash.xxh64_intdigest, words), np.uint64, len(words))
    total, factor = np.zeros(size, np.uint64), _SECOND if second else _MULTIPLIER
    for i in range(n):
        total = total * factor + word[i : i + size]
    total ^= total >> np.uint64(31)
    total *= _MIX
    total ^= total >> np.uint64(29)
    return total if bits == 64 else total >> np.uint64(64 - bits) << np.uint64(64 - bits)


def _planes(a: np.ndarray) -> bytes:
    """The array's bytes by place value, each place compressed on its own: the high ones of small numbers vanish."""
    raw = a.view(np.uint8).reshape(len(a), a.itemsize)
    parts = [zstandard.compress(raw[:, i].tobytes(), 1) for i in range(raw.shape[1])]
    return b"".join([len(x).to_bytes(4, "little") for x in parts] + parts)


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    ends = np.cumsum([4 * width] + [int.from_bytes(data[4 * i : 4 * i + 4], "little") for i in range(width)]).tolist()
    places = [np.frombuffer(zstandard.decompress(data[a:b]), np.uint8) for a, b in zip(ends, ends[1:], strict=False)]
    return np.ascontiguousarray(np.stack(places, axis=1)).reshape(-1).view(kind)


def runs(start: np.ndarray, ref: np.ndarray, ref_start: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Factors (start, size, ref, ref_start), greedily joined: start rises, and a factor goes on while its reference does.

    size counts windows. Of several references at a start, the one that continues the factor is
    taken, or else the longest.
    """
    size = np.ones(len(start), np.int64) if size is None else size.astype(np.int64)
    if not len(start):
        return start, size, ref, ref_start
    order = np.lexsort((-size, ref_start - start, ref, start))
    start, size, ref, ref_start = start[order], size[order], ref[order], ref_start[order]
    # chains: same reference document and diagonal, without a gap
    by = np.lexsort((start, ref_start - start, ref))
    s, z, r, d = start[by], size[by], ref[by], (ref_start - start)[by]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (d[1:] != d[:-1]) | (s[1:] > (s + z)[:-1])
    first = np.flatnonzero(fresh)
    end = np.maximum.reduceat(s + z, first)
    s, r, d = s[first], r[first], d[first]
    by = np.lexsort((-end, s))
    s, end, r, d = s[by], end[by], r[by], d[by]
    keep, reach = [], -1
    for i, e in enumerate(end.tolist()):
        if e > reach:
            keep.append(i)
            reach = e
    s, end, r, d = s[keep], end[keep], r[keep], d[keep]
    return s, end - s, r, s + d


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 8 or 4 bytes a value in one message."""
    parts = [_planes(x) for x in arrays]
    return b"".join([len(x).to_bytes(4, "little") for x in parts] + parts)


def _unpacked(data: bytes, kinds: str) -> list[np.ndarray]:
    """The arrays of a message; kinds has i or u (8 bytes) or w (4 bytes) for each."""
    sizes = [int.from_bytes(data[4 * i : 4 * i + 4], "little") for i in range(len(kinds))]
    ends = np.cumsum([4 * len(kinds), *sizes]).tolist()
    types = {"i": np.int64, "u": np.uint64, "w": np.uint32}
    return [_unplanes(data[a:b], types[k]) for a, b, k in zip(ends[:-1], ends[1:], kinds, strict=True)]


def _windows(hs: np.ndarray, doc: np.ndarray, place: np.ndarray, name: np.ndarray, row: np.ndarray) -> bytes:
    """The windows of one block: the ids and rows of their documents, then their hashes, documents and places."""
    used, number = np.unique(doc, return_inverse=True)
    return _packed(name[used], row[used], np.diff(hs, prepend=np.uint64(0)), number.astype(np.uint32), place.astype(np.uint32))


def _unwindowed(data: bytes) -> tuple[np.ndarray, ...]:
    """(hash, id, row, place) of the windows in a message."""
    name, row, h, number, place = _unpacked(data, "iiuww")
    return np.cumsum(h, dtype=np.uint64), name[number], row[number], place.astype(np.int64)


def _bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    return ((name.astype(np.uint64) * _MULTIPLIER) >> np.uint64(33)).astype(np.int64) % buckets


def _replies(name: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray, ref: np.ndarray, ref_start: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """What was found about documents, in a message for each bucket of documents."""
    to = _bucket(name, buckets)
    by = np.lexsort((start, row, name, to))
    to, name, row, start, size, ref, ref_start = (x[by] for x in (to, name, row, start, size, ref, ref_start))
    cut = np.flatnonzero(np.diff(to)) + 1
    marks, messages = [], []
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(to)], strict=True):
        if a < b:
            fresh = np.append(True, (np.diff(name[a:b]) != 0) | (np.diff(row[a:b]) != 0))
            number = np.cumsum(fresh) - 1
            w = lambda x, a=a, b=b: x[a:b].astype(np.uint32)
            marks.append(int(to[a]))
            messages.append(_packed(name[a:b][fresh], row[a:b][fresh], number.astype(np.uint32), w(start), w(size), ref[a:b], w(ref_start)))
    return marks, messages


def _pack(ids: list[int], rows: list[int], hashes: list[np.ndarray], blocks: int) -> Iterator[pa.RecordBatch]:
    """What a task sends for its documents: windows for each block, and the duplicates that it settles."""
    count = np.array([len(h) for h in hashes], np.int64)
    base = np.cumsum(count) - count
    h = np.concatenate(hashes)
    name, row = np.array(ids, np.int64), np.array(rows, np.int64)
    # in the order of hash, then document, then place
    by_doc = np.concatenate([np.arange(base[i], base[i] + count[i]) for i in np.argsort(name, kind="stable")])
    at = by_doc[np.argsort(h[by_doc], kind="stable")]
    del by_doc
    hs, ds = h[at], np.repeat(np.arange(len(ids), dtype=np.int32), count)[at]
    place = (at - base[ds]).astype(np.int32)
    fresh = np.append(True, hs[1:] != hs[:-1])
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    mine = name[ds] == name[ds[lead]]
    # settled here: a smaller document of this task has the window
    other = np.flatnonzero(~mine)
    if len(other):
        d, first = ds[other], lead[other]
        by = np.argsort(d, kind="stable")
        d, pos, ref, ref_pos = d[by], place[other][by], name[ds[first]][by], place[first][by]
        cut = np.flatnonzero(np.diff(d)) + 1
        parts = [(int(d[a]), *runs(pos[a:b], ref[a:b], ref_pos[a:b])) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(d)], strict=True)]
        whose = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        marks, found = _replies(name[whose], row[whose], *(np.concatenate([p[i] for p in parts]) for i in range(1, 5)), blocks)
        arrays = [pa.array([m % blocks for m in marks], pa.int32()), pa.nulls(len(marks), pa.binary()), pa.array(marks, pa.int32()), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, schema=_SENT_ARROW)
    hs, ds, place = hs[mine], ds[mine], place[mine]
    width = (1 << 64) // blocks + 1
    edges = np.searchsorted(hs, np.array([i * width for i in range(1, blocks)], np.uint64)).tolist()
    cuts = [(block, a, b) for block, (a, b) in enumerate(zip([0, *edges], [*edges, len(hs)], strict=True)) if a < b]
    sent = [_windows(hs[a:b], ds[a:b], place[a:b], name, row) for _, a, b in cuts]
    arrays = [pa.array([c[0] for c in cuts], pa.int32()), pa.array(sent, pa.binary()), pa.nulls(len(sent), pa.int32()), pa.nulls(len(sent), pa.binary())]
    yield pa.RecordBatch.from_arrays(arrays, schema=_SENT_ARROW)


def _first_occurrences(group: pa.Table, buckets: int) -> pa.Table:
    """For the windows of a block: those with an earlier document; settled ones pass through."""
    settled = group.filter(pc.is_valid(group.column("found"))).select(_REPLY_ARROW.names).cast(_REPLY_ARROW)
    packed = [v.as_buffer() for v in group.column("windows") if v.is_valid]
    if not packed:
        return settled
    parts = [list(x) for x in zip(*map(_unwindowed, map(memoryview, packed)), strict=True)]
    del packed, group
    h, name, row, pos = (np.concatenate(parts.pop(0)) for _ in range(4))
    at = np.lexsort((pos, name, h))
    h, name, row, pos = h[at], name[at], row[at], pos[at]
    del at
    fresh = np.append(True, h[1:] != h[:-1])
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    late = np.flatnonzero(name > name[lead])
    first = lead[late]
    marks, found = _replies(name[late], row[late], pos[late], np.ones(len(late), np.int64), name[first], pos[first], buckets)
    made = pa.Table.from_arrays([pa.array(marks, pa.int32()), pa.array(found, pa.binary())], schema=_REPLY_ARROW)
    del h, name, row, pos, fresh, lead, late, first
    release()
    return pa.concat_tables([settled, made])


def _per_document(group: pa.Table) -> pa.Table:
    """The factors of each document in a bucket."""
    parts = [_unpacked(v.as_py(), "iiwwwiw") for v in group.column("found")]
    name, row = (np.concatenate([p[i][p[2]] for p in parts]) for i in (0, 1))
    start, size, ref, ref_start = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (3, 4, 5, 6))
    by = np.lexsort((row, name))
    name, row, start, size, ref, ref_start = (x[by] for x in (name, row, start, size, ref, ref_start))
    cut = (np.flatnonzero((np.diff(name) != 0) | (np.diff(row) != 0)) + 1).tolist()
    out: list[list] = [[] for _ in _FOUND_ARROW]
    for a, b in zip([0, *cut], [*cut, len(name)], strict=True):
        for column, v in zip(out, (int(name[a]), int(row[a]), *runs(start[a:b], ref[a:b], ref_start[a:b], size[a:b])), strict=True):
            column.append(v)
    made = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)
    del parts, out, name, row, start, size, ref, ref_start, by
    release()
    return made


def _slim(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, row, text) of the rows that can give or get factors; row is the hash of the text."""
    return docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text")
    )


def _claims(slim: DataFrame, n: int, bits: int) -> DataFrame:
    """(id, row, start, size, ref, ref_start): each document's factors by the windows' hashes alone."""
    length = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(length / 6 / BLOCK_WINDOWS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[int] = []
        hashes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for i, r, t in zip(*(batch.column(c) for c in ("id", "row", "text")), strict=True):
                words = t.as_py().encode("utf-8").split()
                if len(words) < n:
                    continue
                if ids and held + len(words) > TASK_WORDS:
                    yield from _pack(ids, rows, hashes, blocks)
                    ids, rows, hashes, held = [], [], [], 0
                ids.append(i.as_py())
                rows.append(r.as_py())
                hashes.append(window_hashes(words, n, bits))
                held += len(words)
        if ids:
            yield from _pack(ids, rows, hashes, blocks)

    def first_occurrences(group: pa.Table) -> pa.Table:
        return _first_occurrences(group, blocks)

    replies = slim.mapInArrow(lean(send), _SENT).groupBy("block").applyInArrow(first_occurrences, _REPLY)
    return replies.groupBy("bucket").applyInArrow(_per_document, _FOUND)


def _proofs(slim: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(ref, seg, proof): the second hashes of the windows in the wanted segments (ref, segs) of reference documents."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs, segs, proofs = [], [], []
            for i, t, wanted_segs in zip(*(batch.column(c) for c in ("ref", "text", "segs")), strict=True):
                h = window_hashes(t.as_py().encode("utf-8").split(), n, second=True)
                for s in wanted_segs.as_py():
                    refs.append(i.as_py())
                    segs.append(s)
                    proofs.append(h[s * SEGMENT : (s + 1) * SEGMENT].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(segs, pa.int32()), pa.array(proofs, pa.binary())], names=["ref", "seg", "proof"])

    return slim.join(wanted, slim["id"] == wanted["ref"]).select("ref", "text", "segs").mapInArrow(lean(prove), "ref long, seg int, proof binary")


def _kept(told: list[dict], h: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, ref, ref_start) of the windows of a document, with second hashes h, that a proof bears out, and which were claimed."""
    claimed, parts = np.zeros(len(h), bool), []
    for f in told:
        a, b = max(f["ref_start"], f["seg"] * SEGMENT), min(f["ref_start"] + f["size"], (f["seg"] + 1) * SEGMENT)
        at = f["start"] + np.arange(a, b) - f["ref_start"]
        claimed[at] = True
        proof = np.frombuffer(f["proof"], np.uint64)[a - f["seg"] * SEGMENT : b - f["seg"] * SEGMENT]
        good = at[: len(proof)][h[at[: len(proof)]] == proof]
        parts.append((good, np.full(len(good), f["ref"]), good - f["start"] + f["ref_start"]))
    return *(np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3)), claimed


def factors(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = WINDOW, bits: int = 64) -> DataFrame:
    """(id, row, start, size, ref, ref_start): each document's proved factors as parallel arrays, if it has any.

    row is the hash of the text, so that rows that repeat an id keep their own factors. size counts
    the windows of n words that begin in the factor at start; ref is a document with a smaller id
    that holds them from ref_start on. Rows with a null id neither give nor get factors. With fewer
    bits of the hash more windows are compared by their words; the result is the same.
    """
    slim = _slim(docs, id_col, text)
    text_batches(docs.sparkSession)
    claims = staged(_claims(slim, n, bits), "rlz-claims")
    one = F.explode(F.arrays_zip("start", "size", "ref", "ref_start"))
    flat = claims.select("id", "row", one.alias("f")).select("id", "row", "f.*")
    at = lambda c: F.expr(f"cast({c} div {SEGMENT} as int)")
    segs = flat.withColumn("seg", F.explode(F.sequence(at("ref_start"), at("(ref_start + size - 1)"))))
    # a reference document has no more segments than its length gives, however many documents point at it
    wanted = segs.select("ref", "seg").distinct().groupBy("ref").agg(F.collect_list("seg").alias("segs"))
    told = segs.join(_proofs(slim, wanted, n), ["ref", "seg"])
    told = told.groupBy("id", "row").agg(F.collect_list(F.struct("start", "size", "ref", "ref_start", "seg", "proof")).alias("told"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([*_FOUND_ARROW, ("doubt", pa.list_(pa.int64()))])
        for batch in batches:
            out: list[list] = [[] for _ in kind]
            for i, r, t, said in zip(*(batch.column(c) for c in ("id", "row", "text", "told")), strict=True):
                words = t.as_py().encode("utf-8").split()
                start, ref, ref_start, claimed = _kept(said.as_py(), window_hashes(words, n, second=True))
                claimed[start] = False
                doubt = np.unique(window_hashes(words, n, bits)[claimed]).view(np.int64) if claimed.any() else []
                for column, v in zip(out, (i.as_py(), r.as_py(), *runs(start, ref, ref_start), doubt), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind, strict=True)], schema=kind)

    proved = slim.join(told, ["id", "row"]).select("id", "row", "text", "told").mapInArrow(lean(verify), f"{_FOUND}, doubt array<long>")
    proved = staged(proved.dropDuplicates(["id", "row"]), "rlz-proved")
    doubts = proved.select(F.explode("doubt").alias("h")).distinct()
    found = proved.drop("doubt")
    if not doubts.isEmpty():
        found = found.union(_by_words(slim, doubts, n, bits))
        lists = ["start", "size", "ref", "ref_start"]
        found = found.groupBy("id", "row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in lists))
    return found.where(F.size("start") > 0)


def _by_words(slim: DataFrame, doubts: DataFrame, n: int, bits: int) -> DataFrame:
    """Factors of single windows, compared by their words, where the hash is one of the doubtful ones."""
    shared = slim.sparkSession.sparkContext.broadcast(bitmap(doubts))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for i, r, t in zip(*(batch.column(c) for c in ("id", "row", "text")), strict=True):
                words = t.as_py().encode("utf-8").split()
                h = window_hashes(words, n, bits)
                for k in np.flatnonzero(in_bitmap(h.view(np.int64), shared.value)).tolist() if len(h) else ():
                    for column, v in zip(out, (b" ".join(words[k : k + n]).decode("utf-8"), i.as_py(), r.as_py(), k), strict=True):
                        column.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["words", "id", "row", "start"])

    met = slim.mapInArrow(emit, "words string, id long, row long, start int")
    first = met.groupBy("words").agg(F.min(F.struct("id", "start")).alias("first"))
    late = met.join(first, "words").where(F.col("id") > F.col("first.id"))
    return late.select("id", "row", "start", F.col("first.id").alias("ref"), F.col("first.start").alias("ref_start")).distinct().groupBy("id", "row").agg(
        F.collect_list("start").alias("start"), F.collect_list(F.lit(1)).alias("size"), F.collect_list("ref").alias("ref"), F.collect_list("ref_start").alias("ref_start")
    )


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def remove(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = WINDOW, keep: list[str] | None = None, bits: int = 64) -> DataFrame:
    """docs with kept (the words left, joined by one space), n_words, n_removed and spans.

    A word goes if a window of n words that covers it also starts in a document with a smaller id;
    windows are judged on the texts as they came. spans lists the removed factors as (start, end,
    ref, ref_start) in words. Words are runs of bytes other than ASCII white space. Null texts have
    no words; rows with a null id lose none. Rows that repeat an id do not count against each other.
    Columns named like the four are replaced, all others pass through, whatever their names. An empty
    table gives an empty result.
    """
    found = staged(factors(docs, id_col, text, n, bits), "rlz-factors")
    # documents without factors need not travel to meet any
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(found.select("id")))
    out = docs if keep is None else docs.select(*dict.fromkeys([*keep, id_col, text]))
    span = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end", "ref", "ref_start")]))
    made = [T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span)]
    lists = ["start", "size", "ref", "ref_start"]
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("kept", "n_words", "n_removed", "spans")]
    schema = T.StructType([docs.schema[c] for c in names] + made)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "ref", "ref_start")]))
    p = "_rlz_"
    while any(c.startswith(p) for c in docs.columns):
        p = f"_{p}"
    rest = [c for c in names if c != text]
    sent = T.StructType([docs.schema[c] for c in rest] + [T.StructField(f"{p}id", T.LongType()), T.StructField(f"{p}row", T.LongType()), T.StructField(f"{p}text", T.BinaryType())])
    out = out.withColumn(f"{p}id", F.col(id_col).cast("long")).withColumn(f"{p}row", F.xxhash64(text))

    def cut(own: list[pa.Array], texts: list[str | None], parts: list[list[pa.Scalar]] | None) -> pa.RecordBatch:
        kept, n_words, n_removed, spans = [], [], [], []
        for k, t in enumerate(texts):
            words = (t or "").encode("utf-8").split()
            gone, removed = np.zeros(len(words), bool), []
            if parts is not None and parts[0][k].is_valid:
                s, z, r, rs = (x[k].values.to_numpy(zero_copy_only=False).astype(np.int64).tolist() for x in parts)
                for a, size, b, c in zip(s, z, r, rs, strict=True):
                    gone[a : a + size + n - 1] = True
                    removed.append({"start": a, "end": a + size + n - 1, "ref": b, "ref_start": c})
                n_gone = int(gone.sum())
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8"))
            else:
                n_gone = 0
                kept.append(b" ".join(words).decode("utf-8"))
            n_words.append(len(words))
            n_removed.append(n_gone)
            spans.append(removed)
        arrays = [pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind)]
        by = dict(zip(rest, own, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else by[c] for c in names] + arrays, names=schema.names)

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(f"{p}id")
            mine = batch.filter(pa.array(~in_bitmap(_ids(ids), shared.value) | ids.is_null().to_numpy(zero_copy_only=False)))
            yield cut([mine.column(c) for c in rest], mine.column(text).to_pylist(), None)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            ids = batch.column(f"{p}id")
            mine = batch.filter(pa.array(in_bitmap(_ids(ids), shared.value) & ids.is_valid().to_numpy(zero_copy_only=False)))
            packed = [t and pack(t.encode("utf-8")) for t in mine.column(text).to_pylist()]
            own = [mine.column(c) for c in [*rest, f"{p}id", f"{p}row"]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(packed, pa.binary())], names=sent.names)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else (zstandard.decompress(t).decode("utf-8") if t else "") for t in batch.column(f"{p}text").to_pylist()]
            yield cut([batch.column(c) for c in rest], texts, [batch.column(f"{p}f_{c}") for c in lists])

    scan = out.select(*dict.fromkeys([*rest, text, f"{p}id", f"{p}row"]))
    of = found.select(F.col("id").alias(f"{p}f_id"), F.col("row").alias(f"{p}f_row"), *(F.col(c).alias(f"{p}f_{c}") for c in lists))
    joined = scan.mapInArrow(lean(send), sent).join(of, (F.col(f"{p}id") == F.col(f"{p}f_id")) & (F.col(f"{p}row") == F.col(f"{p}f_row")), "left")
    return scan.mapInArrow(lean(stay), schema).union(joined.select(*rest, f"{p}text", *(f"{p}f_{c}" for c in lists)).mapInArrow(lean(met), schema))
