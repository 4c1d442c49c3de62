"""Operator 13: how far the sources of a language differ in their words.

Terms are counted per language and source, first inside tasks. The terms that a language keeps are dealt to blocks by hash, so
that a block has about 2,048 terms and 2^20 numbers in its dense matrix of groups by terms at most. In a block the smoothed frequencies of all groups
are one int64 tile; its absolute differences, all pairs of groups broadcast a few groups at a time, are summed to a partial matrix of pairs, and a
heap per group keeps the terms it has more often than its language. Spark sums the partial matrices and merges the heaps.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE, SMOOTH = 1_000_000_000, 5
_SPLIT = 32_000  # SCALE = _SPLIT * 31250: two divisions in place of one keep products in 64 bits
_HELD = 400_000  # different terms that a task counts before it hands its sums on

#: A-Z to a-z, a-z and all bytes of non-ASCII characters as they are, every other byte to a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and non-ASCII characters, with A-Z in lower case."""
    return text.translate(_TERMS).split()


def probability(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / total), exactly; total is at least count + 5."""
    if total < 1 << 48:
        whole, rest = np.divmod((count + SMOOTH) * (SCALE // _SPLIT), total)
        return 1 + whole * _SPLIT + rest * _SPLIT // total
    return np.array([1 + SCALE * (int(c) + SMOOTH) // total for c in count], dtype=np.int64)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (bytes), n (occurrences) and df (documents), summed inside tasks: a few rows per group and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in counts.items():
                keys = list(n)
                for k in range(0, len(keys), 65_536):
                    part = keys[k : k + 65_536]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()), pa.array([n[t] for t in part], pa.int64()), pa.array([df[t] for t in part], pa.int64())],
                        ["lang", "source", "term", "n", "df"],
                    )
            counts.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                n, df = counts[lang, source]
                before, words = len(n), terms(text.as_py())
                n.update(words)
                df.update(set(words))
                held += len(n) - before
                if held > _HELD:
                    yield from sums()
                    held = 0
        yield from sums()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(*_groups(docs), text).mapInArrow(run, "lang string, source string, term binary, n long, df long")


def _groups(docs: DataFrame) -> list:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, cells: int = 1 << 20, block_terms: int = 2048) -> DataFrame:
    """lang, source, part, item, value, rank: what tells each source of a language from the others, and from the language.

    docs: lang, source and text; nulls are empty texts, other columns are ignored. A language keeps the terms in at least min_docs
    of its documents (rows: repeated ones count each). Part `pair` has every other source of the language with the summed difference
    of the two, all ranks; part `term` the terms that the source has more often than its language, the first `top`. Ties go by the item's UTF-8 bytes. A
    language without kept terms has pairs of value 0; a language of one source has none; an empty table gives no rows. Arithmetic is exact. `cells` bounds a
    block's matrix, hence memory, and block_terms its terms, so that few sources still make many tasks; neither changes a result.
    """
    counted = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    same = Window.partitionBy("lang", "term")  # as many rows as the language has sources at most
    kept = counted.withColumn("_df", F.sum("df").over(same)).where(F.col("_df") >= min_docs)
    kept = cut(kept.select("lang", "source", "term", "n", (F.col("source") == F.min("source").over(same)).alias("first")))

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("first").cast("long")).alias("v"))
    groups = docs.select(*_groups(docs)).distinct().join(sums, ["lang", "source"], "left").fillna(0, ["n", "v"])
    groups = cut(groups)
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("v").alias("lang_v"), F.count("*").alias("g"))
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("lang_v") / block_terms), F.ceil(F.col("lang_v") * F.col("g") / cells)).cast("long"))
    tiles = kept.join(langs.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n")
    lists = groups.select("lang", "source", "n").join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "n", "lang_n", "lang_v")

    def tile(rows: pa.Table, group: pa.Table) -> pa.Table:
        group = group.sort_by("source")
        sources, totals = group.column("source").to_pylist(), group.column("n").to_pylist()
        lang, size = group.column("lang")[0].as_py(), SMOOTH * group.column("lang_v")[0].as_py()
        out: list[tuple] = []
        g = pc.index_in(rows.column("source"), value_set=group.column("source").combine_chunks()).to_numpy()
        words = rows.column("term").combine_chunks().dictionary_encode()
        names = words.dictionary.to_pylist()
        n = np.zeros((len(sources), len(names)), dtype=np.int64)
        n[g, words.indices.to_numpy()] = rows.column("n").to_numpy()
        p = np.stack([probability(row, total + size) for row, total in zip(n, totals, strict=True)]) if names else n
        step = max(1, cells // max(1, p.size))
        for k in range(0, len(sources), step):  # all pairs of these groups with the later ones, by broadcasting
            far = np.abs(p[k : k + step, None, :] - p[None, k:, :]).sum(axis=2)
            out += [("pair", sources[i], sources[j], int(far[i - k, j - k])) for i in range(k, min(k + step, len(sources))) for j in range(i + 1, len(sources))]
        if names:
            more = p - probability(n.sum(axis=0), group.column("lang_n")[0].as_py() + size)
            for source, extra, here in zip(sources, more, n, strict=True):
                at = np.flatnonzero((extra > 0) & (here > 0))
                if len(at) > top:  # all that tie with the last one stay for the heap
                    at = at[extra[at] >= np.partition(extra[at], -top)[-top]]
                out += [("term", source, t, -v) for v, t in heapq.nsmallest(top, ((-int(extra[k]), names[k]) for k in at))]
        part, source, item, value = zip(*out, strict=True) if out else ((), (), (), ())
        item = [x.encode() if isinstance(x, str) else x for x in item]
        return pa.table([pa.array([lang] * len(out), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.binary()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    found = tiles.groupBy("lang", "block").cogroup(lists.groupBy("lang", "block")).applyInArrow(tile, "lang string, source string, part string, item binary, value long")
    found = cut(found.withColumn("item", F.col("item").cast("string")))
    half = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = half.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order))
    heaps = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(heaps)
