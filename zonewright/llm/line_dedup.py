"""Operator 6: line deduplication by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines with text make a window; a window that occurs more than once in the corpus is
repeated. All its occurrences but the first lose the lines they cover. The first is the one in the smallest doc_id,
and there the one nearest to the text's start. Covered stretches that overlap or touch are merged before lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, unused

#: Columns that dedup_lines adds; with more underscores if docs has such columns.
COUNTS = ("_zw_n_lines", "_zw_n_removed")


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """One row per window: id, _rk, a and b (128 bits of its lines, trimmed), s and e (its lines, end exclusive)."""
    df = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    df = df.select("id", row_key("text").alias("_rk"), F.transform(F.split("text", "\n"), lambda x: F.trim(x)).alias("_l"))
    full = F.filter(F.transform("_l", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda x: x["x"] != "")
    df = df.select("id", "_rk", full.alias("_f")).where(F.size("_f") >= size)
    at = lambda i: F.get(F.col("_f"), i)
    lines = lambda i: [at(i + j)["x"] for j in range(size)]
    each = F.transform(F.sequence(F.lit(0), F.size("_f") - size), lambda i: F.struct(F.xxhash64(*lines(i)).alias("a"), F.xxhash64(F.lit(1), *lines(i)).alias("b"), at(i)["i"].alias("s"), (at(i + size - 1)["i"] + 1).alias("e")))
    return df.select("id", "_rk", F.inline(each))


def removed_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """Per distinct (doc_id, text) that loses lines: id, _rk and spans, the merged stretches of lines that go."""
    windows = _windows(docs, size)
    repeated = windows.groupBy("a", "b").agg(F.count("*").alias("_n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_rk")).alias("_first")).where("_n > 1")
    hit = windows.join(repeated, ["a", "b"]).select("id", "_rk", F.struct("a", "b", "s", "e", F.expr("id <=> _first.id AND _rk = _first._rk").alias("first")).alias("w"))
    per_doc = hit.groupBy("id", "_rk").agg(F.array_sort(F.collect_set("w")).alias("_w"))
    before = lambda i: F.get(F.col("_w"), i - 1)
    again = lambda x, i: (i > 0) & (before(i)["a"] == x["a"]) & (before(i)["b"] == x["b"])
    later = F.filter("_w", lambda x, i: ~x["first"] | F.coalesce(again(x, i), F.lit(False)))
    per_doc = per_doc.select("id", "_rk", F.array_sort(F.transform(later, lambda x: F.struct(x["s"], x["e"]))).alias("_s")).where(F.size("_s") > 0)
    return per_doc.select("id", "_rk", _merged("_s").alias("spans"))


def _merged(spans: str) -> Column:
    """Spans that overlap or touch as one. A text's windows begin and end in the same order, so a stretch begins where a window begins beyond the end of the one before."""
    at = lambda i: F.get(F.col(spans), i)
    begins = F.filter(F.col(spans), lambda x, i: (i == 0) | (x["s"] > at(i - 1)["e"]))
    ends = F.filter(F.col(spans), lambda x, i: (i == F.size(spans) - 1) | (at(i + 1)["s"] > x["e"]))
    return F.zip_with(begins, ends, lambda x, y: F.struct(x["s"].alias("s"), y["e"].alias("e")))


def dedup_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """The rows of docs with their columns; text without later occurrences of repeated windows. Adds COUNTS: lines, and lines removed.

    Lines are parted by newlines and compared without surrounding spaces; lines without text join no window and go
    only if they lie within a removed stretch. A text of fewer than three lines with text has no window and stays, as does a null.
    Rows that repeat doc_id and text count as one occurrence and get one result; a null doc_id comes after all
    others, and texts of one doc_id come in the order of their hashes. Ids may be of any type that has an order. An empty
    table gives no rows. Other columns stay as they are, whatever their names.
    """
    i, k, sp, *counts = unused(docs, "_zw_id", "_zw_rk", "_zw_spans", *COUNTS)
    spans = removed_lines(docs, size).select(F.col("id").alias(i), F.col("_rk").alias(k), F.col("spans").alias(sp))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col(i)) & row_key("text").eqNullSafe(F.col(k)), "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    n = F.size(lines)
    gap_start = lambda x: F.when(x == 0, F.lit(0)).otherwise(F.get(F.col(sp), x - 1)["e"])
    gap_end = lambda x: F.coalesce(F.get(F.col(sp), x)["s"], n)
    gaps = F.transform(F.sequence(F.lit(0), F.size(sp)), lambda x: F.struct(gap_start(x).alias("s"), gap_end(x).alias("e")))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["s"] + 1, g["e"] - g["s"])))
    gone = F.aggregate(sp, F.lit(0), lambda a, x: a + x["e"] - x["s"])
    text = F.when(F.col(sp).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns), F.coalesce(n, F.lit(0)).cast("long").alias(counts[0]), F.coalesce(gone, F.lit(0)).cast("long").alias(counts[1]))
