"""Operator 12: the cheapest repair of conversations whose rows are damaged.

A repaired conversation has role initials (s?(ua)+)?. Rows are the layers of a graph, its nodes are what the initials so far amount to (nothing, s, an
open u, a closed pair), its arcs are edits with small integer costs: Keep 0, Rerole 3, Insert 3, Delete 4, and 3 more for a truncated row that stays.
Dial's bucket queue runs from the end over reversed arcs and records each node's distance to it. The audit is read off by a walk from the start along tight arcs,
always by the least letter.

A conversation that lies within one sorted partition, with few rows, is solved there. Any other one is cut into parts of bounded size, each with
the distances through it from every way in to every way out (one queue run per way out). Per conversation only these small matrices meet:
a fold from the last part to the first gives every part the distances beyond it, each part walks, a fold from the first to the last
tells which walk it was. So no task holds a long conversation; its text passes one task as a stream, in parts, because the digest is one SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 3, 3, 4, 3
FAR = 1 << 60
_BLANK = "\t\n\x0b\x0c\r "

#: Where a kept row's initial leads, and where the one role that may come next leads, from: nothing, s, open u, closed pair.
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
#: Cost of ending the conversation from each of these.
_END = (0, 2 * INSERT, INSERT, 0)

_OK, _TRUNCATED, _GONE = 0, 1, 2  # a row as it is, one cut short, one that must be deleted


def _row_arcs(initial: str, kind: int, q: int) -> list[tuple[str, int, int]]:
    """(letter, cost, to) of the arcs that use up a row, by letter."""
    out = [("D", DELETE, q)]
    if kind != _GONE:
        more = TRUNCATED * (kind == _TRUNCATED)
        if initial in _KEPT[q]:
            out.append(("K", KEEP + more, _KEPT[q][initial]))
        out.append(("R", REROLE + more, _NEXT[q][0]))
    return out


_ARCS = {(i, kind): [_row_arcs(i, kind, q) for q in range(4)] for i in ("s", "u", "a", "") for kind in (_OK, _TRUNCATED, _GONE)}


def arcs(initial: str, kind: int) -> list[list[tuple[str, int, int]]]:
    return _ARCS[initial if initial in ("s", "u", "a") else "", kind]


_BACK = {key: [(q, cost, to) for q in range(4) for _, cost, to in per[q]] for key, per in _ARCS.items()}
_BACK = {key: [[(q, cost) for q, cost, to in back if to == end] for end in range(4)] for key, back in _BACK.items()}
_INSERTED = [[q for q in range(4) if _NEXT[q][0] == end] for end in range(4)]


def distances(rows: list[tuple[str, int]], beyond: list[int]) -> list[list[int]]:
    """Dial's algorithm from the way out: for rows (initial, kind), the distance of each node of each layer to the end.

    beyond: the distances from the four nodes after the last row. Arcs cost at most the largest edit, so the queue is a ring of few buckets.
    """
    n = len(rows)
    back = [_BACK[i if i in ("s", "u", "a") else "", kind] for i, kind in rows]
    d = [[FAR] * 4 for _ in range(n)] + [list(beyond)]
    start = [(x, q) for q, x in enumerate(beyond) if x < FAR]
    if not start:
        return d
    now = min(start)[0]
    size = max(REROLE + TRUNCATED, DELETE, INSERT, max(start)[0] - now) + 1
    ring: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    for x, q in start:
        ring[x % size].append((n, q))
    left = len(start)
    while left:
        bucket = ring[now % size]
        while bucket:
            i, q = bucket.pop()
            left -= 1
            if d[i][q] != now:
                continue  # a shorter way was found meanwhile
            if i < n:
                for p in _INSERTED[q]:
                    if now + INSERT < d[i][p]:
                        d[i][p] = now + INSERT
                        ring[(now + INSERT) % size].append((i, p))
                        left += 1
            if i:
                before = d[i - 1]
                for p, cost in back[i - 1][q]:
                    if now + cost < before[p]:
                        before[p] = now + cost
                        ring[(now + cost) % size].append((i - 1, p))
                        left += 1
        now += 1
    return d


def walk(rows: list[tuple[str, int]], d: list[list[int]], q: int, last: bool) -> tuple[str, int]:
    """The least audit along tight arcs from node q before the first row, and the node where it comes out; last: end the conversation too."""
    out = []
    for k, (initial, kind) in enumerate(rows):
        while True:
            here = d[k][q]
            choices = [(letter, k + 1, to) for letter, cost, to in arcs(initial, kind)[q] if cost + d[k + 1][to] == here]
            if INSERT + d[k][_NEXT[q][0]] == here:
                choices.append(("I", k, _NEXT[q][0]))
            letter, to_row, q = min(choices)
            out.append(letter)
            if to_row > k:
                break
    while last and _END[q]:
        out.append("I")
        q = _NEXT[q][0]
    return "".join(out), q


def replay(audit: str, q: int, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired rows, as role:text, of an audit that begins at node q."""
    out, k = [], 0
    for letter in audit:
        if letter == "K":
            out.append(f"{roles[k]}:{texts[k]}")
            q = _KEPT[q][roles[k][:1]]
        elif letter != "D":
            to, role = _NEXT[q]
            out.append(f"{role}:{texts[k] if letter == 'R' else ''}")
            q = to
        k += letter != "I"
    return out


def kind_of(text: str, first: bool) -> tuple[int, str]:
    """What a row is in the graph, and its fault: the first of blank, duplicate, truncated that holds."""
    end = text.rstrip(_BLANK)[-1:]
    if not end:
        return _GONE, "blank"
    if not first:
        return _GONE, "duplicate"
    return (_OK, "") if end in ".!?" else (_TRUNCATED, "truncated")


def damaged(conversations: DataFrame, share: int = 20) -> DataFrame:
    """conv_id, turn, role, text and n (how many such rows), after damage by crc32 of conv_id:turn modulo share; nulls read as one space there.

    0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks away, 3 repeats it, 4 makes its role user.
    A dropped row stays as one of n = 0 without turn, role and text, so that no conversation is lost.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % share
    unless = lambda c: F.when(F.col("_fault") != 0, c)
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return conversations.select("conv_id", "turn", "role", "text", fault.alias("_fault")).select(
        "conv_id",
        unless(F.col("turn")).alias("turn"),
        unless(F.when(F.col("_fault") == 4, "user").otherwise(blank("role"))).alias("role"),
        unless(text).alias("text"),
        F.when(F.col("_fault") == 0, 0).when(F.col("_fault") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_RESULT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: A part: its place, how its turns and initials meet its neighbours', the distances through it, and its rows.
_PART = "pid int, seq int, low long, high long, turns long, head string, tail string, through array<long>, roles array<string>, texts array<string>, kinds array<int>"
_LEGAL = ("su", "ua", "au")


class _Part:
    """Consecutive rows of one conversation with their counts."""

    def __init__(self, conv: object):
        self.conv, self.roles, self.texts, self.kinds = conv, [], [], []
        self.low = self.high = None
        self.turns = self.size = 0
        self.counts = dict.fromkeys(_COUNTS, 0)

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        kind, fault = kind_of(text, first)
        if fault:
            self.counts[fault] += 1
        if self.roles and self.roles[-1][:1] + role[:1] not in _LEGAL:
            self.counts["illegal"] += 1
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.roles.append(role)
        self.texts.append(text)
        self.kinds.append(kind)
        self.size += len(role) + len(text)

    def steps(self) -> list[tuple[str, int]]:
        return [(r[:1], k) for r, k in zip(self.roles, self.kinds, strict=True)]

    def solved(self) -> dict:
        """The result for a conversation that is this part alone."""
        rows = self.steps()
        d = distances(rows, list(_END))
        audit, _ = walk(rows, d, 0, True)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        digest = hashlib.sha256("\n".join(replay(audit, 0, self.roles, self.texts)).encode()).hexdigest()
        return {"conv_id": self.conv, "gaps": gaps, **self.counts, "cost": d[0][0], "audit": audit, "repaired_sha256": digest}

    def open(self, pid: int, seq: int) -> dict:
        """The part as a row, to be joined with its neighbours."""
        rows = self.steps()
        through = [x for out in range(4) for x in distances(rows, [0 if q == out else FAR for q in range(4)])[0]]
        own = {"low": self.low, "high": self.high, "turns": self.turns, "head": self.roles[0][:1] if rows else None, "tail": self.roles[-1][:1] if rows else None}
        return {"conv_id": self.conv, **self.counts, "pid": pid, "seq": seq, **own, "through": through, "roles": self.roles, "texts": self.texts, "kinds": self.kinds}


def beyond_parts(through: list[list[int]]) -> list[list[int]]:
    """For parts of one conversation in order: the distances from the nodes after each one, folded from the last to the first, and before the first."""
    out = [list(_END)]
    for t in reversed(through):
        out.append([min(FAR, min(t[4 * e + q] + out[-1][e] for e in range(4))) for q in range(4)])
    return out[::-1]


def repair(rows: DataFrame, part_rows: int = 2048, part_chars: int = 1 << 20) -> DataFrame:
    """One row per conversation of `rows`: gaps, counts of faults, the cheapest repair's cost and audit, and the SHA-256 of the repaired rows.

    rows: conv_id (any type with an order), turn (a whole number), role and text (no nulls, but where n is 0), n (how many such rows; 0 for none, which
    only tells that the conversation exists). Rows go by turn, nulls first; those of one turn by role and text in binary order, so the result does not depend on the table's order.
    A null conv_id is a conversation of its own. Without rows counts and cost are 0, the audit is empty and the digest that of no text.
    part_rows and part_chars bound a part, hence memory; they change no result.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))  # copies of a row are one row with a count, summed before the shuffle
    same = cut(same.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "n", F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256).alias("digest")))
    place = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    firsts = same.where("n > 0").groupBy(F.col("conv_id").alias("fc"), F.col("digest").alias("fd")).agg(F.min(place).alias("at")).select("fc", "fd", F.col("at.turn").alias("ft"), F.lit(True).alias("first"))
    on: Column = F.col("conv_id").eqNullSafe(F.col("fc")) & F.col("turn").eqNullSafe(F.col("ft")) & (F.col("digest") == F.col("fd"))
    marked = same.join(firsts, on, "left").select("conv_id", "turn", "role", "text", "n", F.coalesce("first", F.lit(False)).alias("first"))
    ordered = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 200)).sortWithinPartitions("conv_id", "turn", "role", "text")

    columns = [c.strip().split()[0] for c in f"{_RESULT.format(id='x')}, {_PART}".split(", ")]
    schema = f"{_RESULT.format(id=kind)}, {_PART}"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, part, alone = TaskContext.get().partitionId(), 0, None, False
        out: list[dict] = []
        held, types = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], t) for c, t in zip(columns, types, strict=True)], columns)
                out.clear()
                held = 0

        for b in batches:
            if types is None:
                types = _types(b.schema.field(0).type)
            for conv, turn, role, text, n, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part is None or conv != part.conv:
                    if part is not None:
                        # the first conversation of a partition may have begun in the one before
                        out.append(part.solved() if alone else part.open(pid, seq))
                        seq += 1
                        alone = True
                    part = _Part(conv)
                for k in range(n):
                    if len(part.roles) >= part_rows or part.size >= part_chars:
                        out.append(part.open(pid, seq))
                        held += part.size
                        seq, alone, part = seq + 1, False, _Part(conv)
                        if held > part_chars:
                            yield from flush()
                    part.add(turn, role, text, first and not k)
                if len(out) >= 1024:
                    yield from flush()
        if part is not None:
            out.append(part.open(pid, seq))  # as may the last one go on in the next
        yield from flush()

    found = cut(ordered.mapInArrow(solve, schema))
    names = [c for c in columns if c not in ("pid", "seq", "low", "high", "turns", "head", "tail", "through", "roles", "texts", "kinds")]
    return found.where("pid IS NULL").select(*names).unionByName(_joined(found.where("pid IS NOT NULL"), kind))


def _types(conv: pa.DataType) -> list[pa.DataType]:
    long, text = pa.int64(), pa.string()
    return [conv, *[long] * 6, text, text, pa.int32(), pa.int32(), long, long, long, text, text, pa.list_(long), pa.list_(text), pa.list_(text), pa.list_(pa.int32())]


def _joined(parts: DataFrame, kind: str) -> DataFrame:
    """The results of conversations that lie in parts. A group here has one small row per part, without texts; an audit is one value, so a conversation has fewer than 2^31 rows."""

    def outlook(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pid", "ascending"), ("seq", "ascending")])
        ahead = beyond_parts(table.column("through").to_pylist())
        last = [False] * (table.num_rows - 1) + [True]
        return pa.table([table.column("pid"), table.column("seq"), pa.array(ahead[1:], pa.list_(pa.int64())), pa.array(last)], names=["pid", "seq", "beyond", "last"])

    small = parts.select("conv_id", "pid", "seq", "through")
    views = small.groupBy("conv_id").applyInArrow(outlook, "pid int, seq int, beyond array<long>, last boolean")

    def out_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = []
            for roles, kinds, beyond, last in zip(*(b.column(c).to_pylist() for c in ("roles", "kinds", "beyond", "last")), strict=True):
                rows = [(r[:1], k) for r, k in zip(roles, kinds, strict=True)]
                d = distances(rows, beyond)
                ends.append([walk(rows, d, q, last)[1] if d[0][q] < FAR else q for q in range(4)])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("pid"), b.column("seq"), pa.array(ends, pa.list_(pa.int32()))], ["conv_id", "pid", "seq", "ends"])

    seen = cut(parts.select("conv_id", "pid", "seq", "roles", "texts", "kinds").join(views, ["pid", "seq"]))
    walked = seen.select("conv_id", "pid", "seq", "roles", "kinds", "beyond", "last").mapInArrow(out_of, f"conv_id {kind}, pid int, seq int, ends array<int>")

    def entries(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pid", "ascending"), ("seq", "ascending")])
        at, q = [], 0
        for ends in table.column("ends").to_pylist():
            at.append(q)
            q = ends[q]
        return pa.table([table.column("pid"), table.column("seq"), pa.array(at, pa.int32())], names=["pid", "seq", "entry"])

    entered = walked.groupBy("conv_id").applyInArrow(entries, "pid int, seq int, entry int")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            audits, texts = [], []
            for roles, own, kinds, beyond, last, entry in zip(*(b.column(c).to_pylist() for c in ("roles", "texts", "kinds", "beyond", "last", "entry")), strict=True):
                rows = [(r[:1], k) for r, k in zip(roles, kinds, strict=True)]
                audit, _ = walk(rows, distances(rows, beyond), entry, last)
                kept = replay(audit, entry, roles, own)
                audits.append(audit)
                texts.append("\n".join(kept).encode() if kept else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "pid", "seq")), pa.array(audits), pa.array(texts, pa.binary())], ["conv_id", "pid", "seq", "audit", "repaired"])

    made = seen.join(entered, ["pid", "seq"]).mapInArrow(pieces, f"conv_id {kind}, pid int, seq int, audit string, repaired binary")
    stats = parts.select("conv_id", "pid", "seq", *_COUNTS, "low", "high", "turns", "head", "tail", "through")

    def totals(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pid", "ascending"), ("seq", "ascending")])
        sums = {c: sum(table.column(c).to_pylist()) for c in _COUNTS}
        gaps, high, low, tail, turns = 0, None, None, None, 0
        for a, z, n, first, end in zip(*(table.column(c).to_pylist() for c in ("low", "high", "turns", "head", "tail")), strict=True):
            if first is not None:
                sums["illegal"] += tail is not None and tail + first not in _LEGAL
                tail = end
            if a is not None:
                turns += n - (a == high)
                low, high = a if low is None else low, z
        if low is not None:
            gaps = high - low + 1 - turns
        cost = beyond_parts(table.column("through").to_pylist())[0][0]
        return pa.table([table.column("conv_id").slice(0, 1), *(pa.array([x], pa.int64()) for x in (gaps, *sums.values(), cost))], names=["conv_id", "gaps", *_COUNTS, "cost"])

    summed = stats.groupBy("conv_id").applyInArrow(totals, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(conv: object, kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])

        sha, audit, begun, any_text = None, [], None, False
        for b in batches:
            for conv, own, text in zip(b.column("conv_id").to_pylist(), b.column("audit").to_pylist(), b.column("repaired").to_pylist(), strict=True):
                if sha is None or conv != begun:
                    if sha is not None:
                        yield row(begun, b.schema.field(0).type)
                    sha, audit, begun, any_text = hashlib.sha256(), [], conv, False
                audit.append(own)
                if text is not None:
                    sha.update(b"\n" + text if any_text else text)
                    any_text = True
            kind = b.schema.field(0).type
        if sha is not None:
            yield row(begun, kind)

    streamed = made.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "seq").select("conv_id", "audit", "repaired").mapInArrow(digests, f"conv_id {kind}, audit string, repaired_sha256 string")
    streamed = streamed.withColumnRenamed("conv_id", "_conv")
    return summed.join(streamed, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
