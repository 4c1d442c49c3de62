"""Operator 4: benchmark decontamination by winnowing, with DataFrame functions only.

Texts become word hashes, word hashes become k-gram hashes, and of every w successive k-grams the one with the
smallest hash is kept (the last of equals). Any span of k + w - 1 words that a document shares with an item then
has a kept k-gram at the same place in both, so joining kept k-grams finds every shared span of that length.
Around a k-gram that some item keeps, every window of the items' lengths that can have kept it is compared as a whole.

Items of ten words and more are cut into ten-word windows (k = 5, w = 6). Shorter items are one window each and
use smaller k and w, so the guarantee holds for them too; a tier of lengths runs only if the benchmark has such items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, unused

#: Fixed by the contract: what is between words before A-Z is lower-cased, and the window in words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: k, w, fewest and most words of a window. k + w - 1 is the fewest.
TIERS = ((5, 6, WINDOW, WINDOW), (3, 3, 5, WINDOW - 1), (1, 2, 2, 4), (1, 1, 1, 1))
_POSITION = (1 << 30) - 1  # a text has fewer words than that


def words_of(text: Column) -> Column:
    """Words in order, case kept. Splitting leaves an empty text at most at either end."""
    return F.array_remove(F.split(text.cast("string"), BETWEEN), "")


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case. Words that lower-casing leaves alone, which are most, are not gone through by character."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def with_word_hashes(df: DataFrame) -> DataFrame:
    """Adds _h, the hashes of text's words in order."""
    return df.withColumn("_h", F.transform(words_of(F.col("text")), lambda x: F.xxhash64(lower_ascii(x))))


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def with_kept(df: DataFrame, k: int, w: int) -> DataFrame:
    """Adds _n, _g (k-gram hashes) and _kept (for each window the kept k-gram's position), for texts of k + w - 1 words and more.

    A window's minimum is taken over one number per k-gram: the upper bits of its hash, then its position from the
    end, so that equals fall to the last.
    """
    df = df.withColumn("_n", F.size("_h")).where(F.col("_n") >= k + w - 1)
    df = df.withColumn("_g", F.transform(F.sequence(F.lit(0), F.col("_n") - k), lambda i: F.xxhash64(*(_at("_h", i + j) for j in range(k)))))
    order = F.transform("_g", lambda v, i: v.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(F.lit(_POSITION) - i.cast("long")))
    df = df.withColumn("_o", order)
    least = lambda i: F.least(*(_at("_o", i + j) for j in range(w))) if w > 1 else _at("_o", i)
    mins = F.transform(F.sequence(F.lit(0), F.col("_n") - (k + w - 1)), least)
    return df.withColumn("_kept", mins).drop("_o")


def _position(order: Column) -> Column:
    return (F.lit(_POSITION) - order.bitwiseAND(F.lit(_POSITION))).cast("int")


def item_windows(benchmark: DataFrame, tier: tuple[int, int, int, int]) -> DataFrame:
    """The windows of the tier's items, one row per item and window: item_id, v (its kept k-gram) and hs (its word hashes)."""
    k, w, low, high = tier
    rows = with_word_hashes(benchmark.select("item_id", "text"))
    if low < WINDOW:
        rows = rows.where(F.size("_h").between(low, high))
        last = F.lit(0)  # one window: the whole item
        length = F.size("_h")
    else:
        last = F.col("_n") - WINDOW
        length = F.lit(WINDOW)
    rows = with_kept(rows, k, w).withColumn("_m", length)
    at = lambda i: _position(_at("_kept", i))
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(_at("_g", at(i)).alias("v"), F.slice("_h", i + 1, F.col("_m")).alias("hs")))
    return rows.select("item_id", F.inline(each)).distinct()


def _kept_rows(docs: DataFrame, k: int, w: int, high: int, context: bool) -> DataFrame:
    """Kept k-grams of documents, one row each: id, _rk, p, v, and with context the word hashes around it (from_, ctx). docs: id, _rk, _h."""
    rows = with_kept(docs, k, w).withColumn("_p", F.transform(F.array_distinct("_kept"), _position))
    low = lambda p: F.greatest(p - (w - 1), F.lit(0))
    around = lambda p: (low(p).alias("from_"), F.slice("_h", low(p) + 1, F.lit(w - 1 + high)).alias("ctx"))
    return rows.select("id", "_rk", F.inline(F.transform("_p", lambda p: F.struct(p.alias("p"), _at("_g", p).alias("v"), *(around(p) if context else ())))))


def _window_rows(kept: DataFrame, tier: tuple[int, int, int, int]) -> DataFrame:
    """The windows around kept k-grams: id, _rk, s (first word), hs and their hash."""
    _, w, low, high = tier
    starts = F.sequence(F.col("from_"), F.col("p"))
    lengths = F.array(*(F.lit(m) for m in range(low, high + 1)))
    fits = lambda s, m: s - F.col("from_") + m <= F.size("ctx")
    each = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(lengths, lambda m: fits(s, m)), lambda m: F.struct(s.alias("s"), F.slice("ctx", s - F.col("from_") + 1, m).alias("hs")))))
    return kept.select("id", "_rk", F.inline(each)).withColumn("wid", F.xxhash64("hs"))


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = 100_000) -> DataFrame:
    """Per distinct (doc_id, text) with a hit: id, _rk, spans (of words, merged, end exclusive), n_hit and items (sorted ids as strings).

    What the benchmark has of kept k-grams, windows, and links of windows to items is counted; each is broadcast only if it has
    broadcast_windows rows at most. With more k-grams texts are first met with these alone, by shuffle, and looked up again
    for documents with a hit. No row holds all windows of a k-gram or all items of a window.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_rk", row_key("text"))
    empty = rows.limit(0).select("id", "_rk", F.expr("CAST(NULL AS ARRAY<STRUCT<s: INT, e: INT>>)").alias("spans"), F.lit(0).cast("long").alias("n_hit"), F.expr("CAST(NULL AS ARRAY<STRING>)").alias("items"))
    hashed = with_word_hashes(rows).drop("text")
    found, linked = [], []
    for tier in TIERS:
        k, w, _, high = tier
        windows = cut(item_windows(benchmark, tier))
        n = windows.count()
        if not n:
            continue
        small = (lambda df: F.broadcast(df)) if n <= broadcast_windows else (lambda df: df)
        grams = windows.select("v").distinct()
        if n <= broadcast_windows:
            kept = _kept_rows(hashed, k, w, high, True)
        else:
            hit = _kept_rows(hashed, k, w, high, False).join(grams, "v", "left_semi").select("id", "_rk").distinct()
            again = rows.alias("a").join(hit.alias("b"), F.expr("a.id <=> b.id AND a._rk <=> b._rk"), "left_semi")
            kept = _kept_rows(with_word_hashes(again).drop("text"), k, w, high, True)
        near = _window_rows(kept.join(small(grams), "v", "left_semi"), tier)
        known = windows.select(F.xxhash64("hs").alias("wid"), F.col("hs").alias("_hs")).distinct()
        same = near.join(small(known), "wid").where(F.col("hs") == F.col("_hs"))
        found.append(same.select("id", "_rk", "wid", "s", (F.col("s") + F.size("hs")).alias("e")))
        linked.append(windows.where("item_id IS NOT NULL").select(F.xxhash64("hs").alias("wid"), F.col("item_id").cast("string").alias("item")).distinct())
    if not found:
        return empty
    hits = cut(reduce(DataFrame.unionByName, found).distinct())
    links = reduce(DataFrame.unionByName, linked)
    links = F.broadcast(links) if links.count() <= broadcast_windows else links
    per_doc = hits.groupBy("id", "_rk").agg(F.collect_set(F.struct("s", "e")).alias("_s"))
    words = F.array_sort(F.array_distinct(F.flatten(F.transform("_s", lambda x: F.sequence(x["s"], x["e"] - 1)))))
    per_doc = per_doc.select("id", "_rk", words.alias("_p"))
    listed = hits.select("id", "_rk", "wid").distinct().join(links, "wid").groupBy("id", "_rk").agg(F.array_sort(F.collect_set("item")).alias("items"))
    got = per_doc.alias("p").join(listed.alias("l"), F.expr("p.id <=> l.id AND p._rk = l._rk"), "left")
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    return got.select("p.id", "p._rk", _stretches("_p").alias("spans"), F.size("_p").cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def _stretches(words: str) -> Column:
    """Sorted positions as stretches of successive ones."""
    at = lambda i: F.get(F.col(words), i)
    begins = F.filter(F.col(words), lambda x, i: (i == 0) | (x > at(i - 1) + 1))
    ends = F.filter(F.col(words), lambda x, i: (i == F.size(words) - 1) | (at(i + 1) > x + 1))
    return F.zip_with(begins, ends, lambda x, y: F.struct(x.alias("s"), (y + 1).alias("e")))


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = 100_000) -> DataFrame:
    """Every row of docs with its contamination: doc_id, n_words, n_hit, items (sorted as strings), spans.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. A null or empty text has no words. Rows
    with the same doc_id and text get the same answer; a null doc_id is a key like any other. An item without words
    has no window; items that share an id count once, items without an id cause hits but are not listed. Empty tables
    give no rows or no hits.
    """
    words = docs.select("doc_id", F.coalesce(F.size(words_of(F.col("text"))), F.lit(0)).cast("long").alias("n_words"), row_key("text").alias("_k"))
    hits = contamination(docs, benchmark, broadcast_windows)
    got = words.join(hits, F.expr("doc_id <=> id AND _k <=> _rk"), "left")
    return got.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.expr("CAST(array() AS ARRAY<STRING>)")).alias("items"), F.coalesce("spans", F.expr("CAST(array() AS ARRAY<STRUCT<s: INT, e: INT>>)")).alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = 100_000) -> DataFrame:
    """The rows of docs without any hit, with all their columns as they are, whatever their names."""
    i, k = unused(docs, "_zw_id", "_zw_rk")
    hits = contamination(docs, benchmark, broadcast_windows).select(F.col("id").alias(i), F.col("_rk").alias(k))
    return docs.join(hits, docs["doc_id"].eqNullSafe(F.col(i)) & row_key("text").eqNullSafe(F.col(k)), "left_anti")
