"""Divergence of sources against whole numbers without blocks."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewright.llm import divergence as div

from .helpers import prose

SCHEMA = "lang string, source string, text string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(rows, min_docs=30, top=50):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        words = [lower(x) for x in TERM.findall(text)]
        groups[lang].add(source)
        counts[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        each = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(each[s][t] for s in sources) for t in kept}

        def p(c, kept=kept):
            total = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        ps, q = {s: p(each[s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in sources if o != s]
            words = [(q[t] - ps[s][t], t) for t in kept if each[s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", words)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def corpus(n=400):
    rows = []
    for k in range(n):
        lang, source = ("en", "de", "")[k % 7 % 3], f"s{k % 5}" if k % 3 else "hot"
        rows.append((lang, source, prose(k, 30 + k % 50, 120) + (" Größe ÄÖ naïve's 12x" if k % 2 else " Größe x_y")))
    return rows + [(None, None, None), (None, "s1", "a b"), ("en", None, ""), ("en", "", "x"), ("fr", "one", "le la"), ("xx", "a", "b"), ("xx", "c", None), ("xx", "é", "d"), ("en", "s1", "word " * 300_000)]


def results(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize(("cells", "top"), [(1 << 20, 50), (300, 50), (7, 3)])
def test_equals_plain_version(spark, cells, top):
    rows = corpus()
    got = results(div.divergence(frame(spark, rows), top=top, cells=cells))
    assert got == plain(rows, top=top)
    assert {r[0] for r in got} == {"en", "de", "", "xx"}  # fr has one source and no kept term


def test_sums_inside_tasks_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(div, "_HELD", 50)
    rows = corpus(120)
    assert results(div.divergence(frame(spark, rows), min_docs=5)) == plain(rows, 5)


def test_ties_and_repeats(spark):
    rows = [("en", s, "aa bb cc dd") for s in "xyz" for _ in range(12)] + [("en", "x", "zz yy xx"), ("en", "y", "zz yy xx")] * 31
    assert results(div.divergence(frame(spark, rows))) == plain(rows)


def test_exact_beyond_64_bits():
    big = 10**15
    for total in (10, 10**6 + 3, (1 << 48) - 1, 1 << 48, 9 * 10**17):
        counts = [0, 1, min(total, big) // 3, total - 5]
        assert div.probability(np.array(counts), total).tolist() == [1 + 10**9 * (c + 5) // total for c in counts]


def test_empty_and_clashing_names(spark):
    assert div.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = corpus(100)
    extra = {c: F.lit(k) for k, c in enumerate(("term", "n", "df", "v", "g", "block", "item", "part", "value", "rank", "first", "blocks", "lang_n"))}
    assert results(div.divergence(frame(spark, rows).withColumns(extra), min_docs=3)) == plain(rows, 3)
