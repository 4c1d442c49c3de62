"""Operator 2: sum-of-squares packing of tokenised documents into fixed-length sequences.

Documents longer than a sequence are cut into full pieces and a rest. Which lengths share a sequence is planned from
the histogram of lengths, which has fewer rows than a sequence has tokens, whatever the corpus. The plan places
lengths in falling order; each goes to the open sequence where the sum over residual gaps of the squared number of
open sequences becomes smallest, and a new one is opened only if none has room. Equal sequences are held as a number,
so the plan covers all pieces of a corpus of any size in one way, with a few times capacity ** 2 kinds of sequences at most. Pieces then take their places by their rank among
pieces of the same length, which is counted per task and summed over tasks, so no task holds all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_type
from .tokens import encoder

_FAR = 1 << 40


def squares_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Sequences as (how many such, lengths in each) for `counts` pieces of each length at or below capacity.

    Lengths fall. A piece goes to the open sequence where the squared numbers of open sequences per gap sum to the least (ties:
    the tightest fit); only if none has room a new one is opened. Pieces of one length are placed in runs: as many go at once as make the
    numbers of the two gaps equal (at least one, at most twice as many if that keeps equal sequences together). So for few
    sequences pieces go one by one, and a corpus of any size is planned as a whole in about as many steps.
    """
    held: list[list[list]] = [[] for _ in range(capacity + 1)]  # by gap: [how many, lengths]
    n = np.zeros(capacity + 1, dtype=np.int64)
    plan: list[tuple[int, list[int]]] = []

    def put(times: int, lengths: list[int], gap: int) -> None:
        if gap:
            held[gap].append([times, lengths])
            n[gap] += times
        else:
            plan.append((times, lengths))

    for s in sorted((s for s, c in counts.items() if c > 0), reverse=True):
        left = counts[s]
        while left:
            here = n[s:capacity]
            change = np.where(here > 0, 2 * (n[: capacity - s] - here) + 2, _FAR)
            if len(change) and here[0]:
                change[0] = 1 - 2 * here[0]  # a filled sequence is open no longer
            gap = int(change.argmin()) if len(change) else 0
            if len(change) and change[gap] < _FAR:
                k = int(min(left, here[gap], max(1, (here[gap] - n[gap]) // 2)))
                group = held[gap + s][-1]
                if not group[0] <= min(left, 2 * k):  # else the whole group, so that groups stay few
                    held[gap + s].append([min(k, group[0]), group[1]])
                    group[0] -= held[gap + s][-1][0]
                t, lengths = held[gap + s].pop()
                left -= t
                n[gap + s] -= t
                put(t, [*lengths, s], gap)
            else:
                each = capacity // s
                whole, rest = divmod(left, each)
                if whole:
                    put(whole, [s] * each, capacity - each * s)
                if rest:
                    put(1, [s] * rest, capacity - rest * s)
                left = 0
    return plan + [(t, x) for groups in held for t, x in groups]


class Slots:
    """For a length and a rank among pieces of that length: the sequence and the offset in it."""

    def __init__(self, plan: list[tuple[int, list[int]]]):
        ranks: dict[int, int] = {}
        rows, base = [], 0
        for times, lengths in plan:
            at = 0
            for s in lengths:
                rank = ranks.get(s, 0)
                rows.append((s << 40 | rank, rank, base, at))
                ranks[s] = rank + times
                at += s
            base += times
        found = np.array(rows, dtype=np.int64).reshape(-1, 4)
        self.key, self.rank, self.sequence, self.at = found[np.argsort(found[:, 0])].T.copy()

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, length.astype(np.int64) << 40 | rank, side="right") - 1
        return self.sequence[k] + rank - self.rank[k], self.at[k]


PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long, ids binary, _task long, _rank long"


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """One row per piece, with its rank among this task's pieces of the same length."""
    schema = (PIECE if with_ids else PIECE.replace("ids binary, ", "")).format(id=id_type(docs))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, size = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        task, ranks = TaskContext.get().partitionId(), {}
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for j in range(0, len(ids), size):
                        x = ids[j : j + size]
                        n = len(x) // 4
                        rank = ranks.get(n, 0)
                        ranks[n] = rank + 1
                        rows.append((doc, j // size, j // 4, n, zlib.crc32(x), *([x] if with_ids else []), task, rank))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [batch.schema.field(0).type, *types], strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "_task", "_rank"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else []), pa.int64(), pa.int64()]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(cut_up, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of at most `capacity` tokens: one row per piece with its place.

    docs: doc_id (of any type) and text; other columns are ignored. A null text counts as empty: its piece is the end id alone.
    Rows that repeat a doc_id are packed each for itself; a null doc_id stays null. An empty table gives no rows.
    Equal lengths are interchangeable, so which of them gets which place is free; it does not change if tasks are
    run again, because ranks are read back from the shared folder. with_ids adds the ids as little-endian uint32.
    """
    pieces = cut(tokenized_pieces(docs, tokenizer, capacity, end_id, with_ids))
    per_task = pieces.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    counts = {int(r[0]): int(r[1]) for r in per_task.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    slots = pieces.sparkSession.sparkContext.broadcast(Slots(squares_plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    fields = [f for f in pieces.schema.fieldNames() if f[0] != "_"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("_base").to_numpy() + b.column("_rank").to_numpy()
            sequence, at = slots.value.find(b.column("length").to_numpy(), rank)
            yield pa.RecordBatch.from_arrays([*(b.column(f) for f in fields), pa.array(sequence), pa.array(at)], [*fields, "sequence_id", "offset"])

    joined = pieces.join(base, ["length", "_task"])
    return joined.mapInArrow(place, ", ".join(f"{f} {pieces.schema[f].dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, doc_ids and ids (little-endian uint32), from rows packed with_ids.

    A group is one sequence, so it holds `capacity` tokens at most.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    got = packed.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x["ids"]))
    return got.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), F.col("p.doc_id").alias("doc_ids"), joined.alias("ids"))
