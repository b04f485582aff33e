"""Repair of the turn structure of conversations by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, state of the pattern); an edge keeps, re-roles or deletes the next
row, or inserts an empty one. A forward and a reverse heap meet, every crossing of the least cost is
finished, and the audit that is least as a string wins. Audits of equal cost between the same two states
are never prefixes of each other (the longer one would hold an insertion more), so the best path of a
stretch of rows is the same whatever stands around it, and the paths of neighbouring stretches compose.

Rows are ordered by conversation over range partitions. A task repairs the conversations that it holds
whole; of one that its partition may hold only in part it returns the best path between any two states.
Those are composed by conversation, so a conversation may be longer than any task's share.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.common import staged, text_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a conversation that are searched at a time; longer ones are composed of such stretches.
STRETCH = 256
#: States: nothing yet, after system, after user, after assistant. A conversation may end in the first and the last.
_STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What an inserted or re-roled row leads to; system rows are never made.
_MADE = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_ENDS = (0, 3)
_LEGAL = {"su", "ua", "au"}
#: A cost, and for each stretch the state before it and its audit.
Path = tuple[int, tuple[tuple[int, str], ...]]


def _moves(code: str, q: int) -> Iterator[tuple[str, int, int]]:
    """The edits of one row in a state: letter, cost, next state. code: role's initial, upper case if truncated, x if it must go."""
    yield "D", DELETE, q
    if code != "x":
        extra = TRUNCATED if code.isupper() else 0
        yield "R", REROLE + extra, _MADE[q]
        if (to := _STEP[q].get(code.lower())) is not None:
            yield "K", KEEP + extra, to


def _ahead(rows: str, i: int, q: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
    yield "I", INSERT, (i, _MADE[q])
    if i < len(rows):
        for letter, cost, to in _moves(rows[i], q):
            yield letter, cost, (i + 1, to)


def _behind(rows: str, i: int, q: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
    for p in range(4):
        if _MADE[p] == q:
            yield "I", INSERT, (i, p)
        if i:
            for letter, cost, to in _moves(rows[i - 1], p):
                if to == q:
                    yield letter, cost, (i - 1, p)


@functools.lru_cache(maxsize=50_000)
def cheapest(rows: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Least cost of leading rows from a state to one of ends, and the least audit of that cost; None if there is none."""
    n = len(rows)
    fore, back = {(0, start): (0, "")}, {(n, q): (0, "") for q in ends}
    # of equal costs the row nearer to the heap's own end comes first: only keeping is free, and it reads a row
    heap_f, heap_b = [(0, 0, start)], [(0, 0, q) for q in ends]
    heapq.heapify(heap_b)
    done_f: set[tuple[int, int]] = set()
    done_b: set[tuple[int, int]] = set()
    least = float("inf")
    while heap_f and heap_b and heap_f[0][0] + heap_b[0][0] <= least:
        forward = heap_f[0][0] <= heap_b[0][0]
        heap, done, label, other = (heap_f, done_f, fore, back) if forward else (heap_b, done_b, back, fore)
        _, k, q = heapq.heappop(heap)
        node = (k, q) if forward else (n - k, q)
        if node in done:
            continue
        done.add(node)
        cost, audit = label[node]
        if node in other:
            least = min(least, cost + other[node][0])
        for letter, more, to in (_ahead if forward else _behind)(rows, *node):
            found = (cost + more, audit + letter if forward else letter + audit)
            if to not in done and (to not in label or found < label[to]):
                label[to] = found
                heapq.heappush(heap, (found[0], to[0] if forward else n - to[0], to[1]))
                if to in other:
                    least = min(least, found[0] + other[to][0])
    audits = [fore[u][1] + back[u][1] for u in fore.keys() & back.keys() if fore[u][0] + back[u][0] == least]
    for u in done_f:
        for letter, more, v in _ahead(rows, *u):
            if v in done_b and fore[u][0] + more + back[v][0] == least:
                audits.append(fore[u][1] + letter + back[v][1])
    return (int(least), min(audits)) if audits else None


def _audit(path: Path) -> str:
    return "".join(a for _, a in path[1])


def _composed(a: dict[tuple[int, int], Path], b: dict[tuple[int, int], Path]) -> dict[tuple[int, int], Path]:
    out: dict[tuple[int, int], Path] = {}
    for (s, m), (cost, audits) in a.items():
        for d in range(4):
            if (m, d) in b:
                found = (cost + b[m, d][0], audits + b[m, d][1])
                known = out.get((s, d))
                if known is None or found[0] < known[0] or found[0] == known[0] and _audit(found) < _audit(known):
                    out[s, d] = found
    return out


def _all(tables: list[dict[tuple[int, int], Path]]) -> dict[tuple[int, int], Path]:
    """The composition of tables in order, by halves: audits are copied once a level."""
    while len(tables) > 1:
        tables = [_composed(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


def _between(rows: str) -> dict[tuple[int, int], Path]:
    """The best paths through rows between any two states."""
    found = {(s, d): cheapest(rows, s, (d,)) for s in range(4) for d in range(4)}
    return {(s, d): (v[0], ((s, v[1]),)) for (s, d), v in found.items() if v}


def _best(table: dict[tuple[int, int], Path]) -> Path:
    """The path of a whole conversation."""
    return min((table[0, q] for q in _ENDS if (0, q) in table), key=lambda x: (x[0], _audit(x)))


def _repaired(audit: str, q: int, roles: list[str], texts: list[str]) -> list[str]:
    """The lines that an audit leaves of rows, read from a state."""
    lines, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        if letter == "K":
            q = _STEP[q][roles[at][:1]]
            lines.append(f"{roles[at]}:{texts[at]}")
        else:
            q = _MADE[q]
            lines.append(f"{_ROLE[q]}:{texts[at] if letter == 'R' else ''}")
        at += letter != "I"
    return lines


class _Stretch:
    """The rows of one conversation that a task has seen."""

    def __init__(self, conv, size: int) -> None:
        self.size = size
        self.conv, self.codes, self.roles, self.texts = conv, [], [], []
        self.turns: list[int] = []  # least, largest, number of different ones
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.ends = ("", "")

    def add(self, turn: int | None, role: str, text: str, n: int, again: bool, blank: bool, open_end: bool) -> None:
        """n equal rows; again: such a row stood at an earlier turn."""
        if not n:
            return
        if turn is not None:
            self.turns = [self.turns[0], turn, self.turns[2] + (turn != self.turns[1])] if self.turns else [turn, turn, 1]
        first = role[:1]
        self.illegal += n - 1 + bool(self.codes and self.ends[1] + first not in _LEGAL)
        self.ends = (self.ends[0] if self.codes else first, first)
        if blank:
            self.blank += n
        else:
            self.duplicate += n - (not again)
            self.truncated += open_end and not again
        known = first if first and first in "sua" else "o"
        self.codes += ["x" if blank or again else known.upper() if open_end else known] + ["x"] * (n - 1)
        self.roles += [role] * n
        self.texts += [text] * n

    def cut(self) -> list[slice]:
        return [slice(i, i + self.size) for i in range(0, max(1, len(self.codes)), self.size)]

    def tables(self) -> list[dict[tuple[int, int], Path]]:
        return [_between("".join(self.codes[c])) for c in self.cut()]

    def counts(self) -> dict:
        low, high, different = self.turns or (None, None, 0)
        return {
            "conv": self.conv, "low": low, "high": high, "turns": different, "blank": self.blank, "duplicate": self.duplicate,
            "truncated": self.truncated, "illegal": self.illegal, "rows": len(self.codes), "first": self.ends[0], "last": self.ends[1],
        }

    def whole(self) -> dict:
        if len(self.codes) <= self.size:
            cost, audit = cheapest("".join(self.codes), 0, _ENDS)
        else:
            path = _best(_all(self.tables()))
            cost, audit = path[0], _audit(path)
        lines = _repaired(audit, 0, self.roles, self.texts)
        return self.counts() | {"cost": cost, "audit": audit, "sha": hashlib.sha256("\n".join(lines).encode()).hexdigest()}

    def part(self, part: int) -> Iterator[dict]:
        """Its best paths, and its texts by stretches."""
        paths = [{"src": s, "dst": d, "cost": c, "steps": [{"state": q, "audit": x} for q, x in a]} for (s, d), (c, a) in _all(self.tables()).items()]
        yield self.counts() | {"part": part, "paths": paths}
        for i, c in enumerate(self.cut()):
            yield {"conv": self.conv, "part": part, "seq": i, "roles": self.roles[c], "texts": self.texts[c]}


_PATHS = "array<struct<src int, dst int, cost long, steps array<struct<state int, audit string>>>>"
_COUNTS = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, rows long, first string, last string"
_PIECES = f"{_COUNTS}, cost long, audit string, sha string, part long, paths {_PATHS}, seq int, roles array<string>, texts array<string>"


def _schema(conv: T.StructField, fields: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv.dataType), *T.StructType.fromDDL(fields)])


def damaged(df: DataFrame) -> DataFrame:
    """The rows of conversations with seeded faults: conv, turn, role, text and how often each stands (0 if dropped)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = filled("text")
    return df.select(
        F.col("conv_id").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(filled("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _digest() -> Column:
    conv = F.coalesce(F.col("conv").cast("string"), F.lit(""))
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    return F.unhex(F.sha2(F.concat(F.col("conv").isNull().cast("string"), sized(conv), sized(F.col("role")), F.col("text")), 256))


def _marked(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number; again: an equal row (but for the turn) stands at an earlier turn."""
    counted = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("same", _digest())
    seen = rows.where("n > 0").select(_digest().alias("_same"), "turn").groupBy("_same").agg(
        F.max(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_least"), F.max("turn").alias("_most")
    )
    seen = seen.where("_least < _most OR (_null AND _most IS NOT NULL)")
    first = F.when(F.col("_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("_least"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return counted.join(seen, F.col("same") == F.col("_same"), "left").select(
        "conv", "turn", "role", "text", "n", F.coalesce(~first, F.lit(False)).alias("again"),
        blank.alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open_end"),
    )


def _streams(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Stretch]:
    """The conversations of sorted rows."""
    now: _Stretch | None = None
    for batch in batches:
        for conv, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    yield now
                now = _Stretch(conv, size)
            now.add(*row)
    if now is not None:
        yield now


def _search(schema: pa.Schema, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, k, out = 2 * TaskContext.get().partitionId(), None, 0, []
        for stretch in _streams(batches, size):
            if before is not None:  # the first and the last may go on in the neighbouring partitions
                out += before.part(part) if k == 1 else [before.whole()]
            before, k = stretch, k + 1
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if before is not None:
            out += before.part(part + (k > 1))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _join(schema: pa.Schema, size: int):
    """Composes the parts of each conversation; rows: conv and its parts in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = row["parts"]
                tables = [{(p["src"], p["dst"]): (p["cost"], tuple((e["state"], e["audit"]) for e in p["steps"])) for p in x["paths"]} for x in parts]
                path = _best(_all(tables))
                whole = {k: sum(x[k] for x in parts) for k in ("turns", "blank", "duplicate", "truncated", "illegal", "rows")}
                timed = [x for x in parts if x["low"] is not None]
                whole["turns"] -= sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:], strict=False))
                filled = [x for x in parts if x["rows"]]
                whole["illegal"] += sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(filled, filled[1:], strict=False))
                whole |= {"low": timed[0]["low"], "high": timed[-1]["high"]} if timed else {}
                places = [(x["part"], seq) for x in parts for seq in range(max(1, -(-x["rows"] // size)))]
                edits = [{"part": p, "seq": i, "state": q, "edit": a} for (p, i), (q, a) in zip(places, path[1], strict=True)]
                out.append({"conv": row["conv"], "cost": path[0], "audit": _audit(path), "edits": edits} | whole)
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _hashed(schema: pa.Schema):
    """The hash of each conversation's repaired text; rows: its stretches in order with their edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, sha, empty = [], None, None, True
        for batch in batches:
            for row in batch.to_pylist():
                if sha is None or row["conv"] != conv:
                    if sha is not None:
                        out.append({"conv": conv, "sha": sha.hexdigest()})
                    conv, sha, empty = row["conv"], hashlib.sha256(), True
                if lines := _repaired(row["edit"], row["state"], row["roles"], row["texts"]):
                    sha.update(("" if empty else "\n").encode() + "\n".join(lines).encode())
                    empty = False
        if sha is not None:
            out.append({"conv": conv, "sha": sha.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repair(df: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row for each conversation of counted rows: its faults, the least cost of its edits, their audit, the repaired text's hash.

    df: conv, turn, role, text and n (how often a row stands; 0: the conversation is there, the row is not), as
    damaged() gives them; role and text hold no null. Rows stand by turn, nulls first; rows of one turn by role and
    text. Null conversations are one conversation. One without rows has zeros, an empty audit and the hash of the empty text.
    """
    spark = df.sparkSession
    text_batches(spark)
    conv = df.schema["conv"]
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]
    ranged = _marked(df).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = _schema(conv, _PIECES)
    found = staged(ranged.mapInArrow(_search(_arrow(pieces), stretch), pieces), "conversations")
    cols = ["conv", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = found.where("sha IS NOT NULL").select(*cols, "sha")

    # at most two conversations of a partition are held in part
    fields = ["part", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "rows", "first", "last", "paths"]
    parts = found.where("paths IS NOT NULL").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("parts"))
    joined = _schema(conv, _COUNTS + ", cost long, audit string, edits array<struct<part long, seq int, state int, edit string>>")
    composed = staged(parts.mapInArrow(_join(_arrow(joined), stretch), joined), "composed")
    edits = composed.select(F.inline("edits"))
    texts = found.where("seq IS NOT NULL").select("conv", "part", "seq", "roles", "texts").join(edits, ["part", "seq"])
    hashes = _schema(conv, "sha string")
    texts = texts.select("conv", "part", "seq", "state", "edit", "roles", "texts").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    shas = texts.mapInArrow(_hashed(_arrow(hashes)), hashes).withColumnRenamed("conv", "_conv")
    split = composed.join(shas, F.col("conv").eqNullSafe(F.col("_conv"))).select(*cols, "sha")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return whole.unionByName(split).select(
        F.col("conv").alias("conv_id"), gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.col("sha").alias("repaired_sha256"),
    )
