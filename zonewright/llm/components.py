"""Connected components of a graph given as an edge table, without collecting any of it."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a, b, and the smallest node of each one's component."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = code[: len(a)], code[len(a) :], np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    return nodes, nodes[root]


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rooted(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))], ["node", "to"])


def components(edges: DataFrame, few: int = 1 << 16) -> DataFrame:
    """edges: a, b (long, not null). One row per node that has an edge to another: node, root (one node of its component).

    Each round maps every node to the smallest of its neighbours and itself and contracts the edges, until none is
    left. "Smallest" is by number first, which is how simhash ties points to trees, then by an order that is shuffled for
    each round, so that paths shrink by a share per round instead of by one node. The rounds' maps are then composed from the last to the first, so that a join's key is a node of a
    round and how many rows share it depends on that round alone, never on the size of the whole component.
    Once at most `few` edges are left (a megabyte, whatever the graph's size), one task joins them: the last rounds have next to
    no rows, but cost the driver as many stages and tasks as the first.
    """
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while left := e.count():
        if left <= few:
            maps.append(cut(e.select("a", "b").coalesce(1).mapInArrow(_join_all, "node long, to long")))
            break
        draw = random.Random(len(maps))
        mask, turn = (draw.getrandbits(63), draw.randrange(1, 64)) if maps else (0, 0)

        def rank(c: Column, mask: int = mask, turn: int = turn) -> Column:
            x = c.bitwiseXOR(F.lit(mask))
            return F.shiftleft(x, turn).bitwiseOR(F.shiftrightunsigned(x, 64 - turn))

        def unrank(c: Column, mask: int = mask, turn: int = turn) -> Column:
            return F.shiftrightunsigned(c, turn).bitwiseOR(F.shiftleft(c, 64 - turn)).bitwiseXOR(F.lit(mask))

        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        step = cut(low.select(F.col("a").alias("node"), unrank(F.least("m", rank(F.col("a")))).alias("to")))
        maps.append(step)
        e = e.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        e = e.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        e = cut(e)
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        onward = out.select(F.col("node").alias("to"), "root")
        out = cut(step.join(onward, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    return out
