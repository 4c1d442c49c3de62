"""Small documents with every awkward row, and a random generator of texts with copies."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rk string, length int, id string, shard string, words long"


def rows(texts, lang="en"):
    """Rows (with extra columns whose names operators use inside) for texts or (doc_id, text) pairs."""
    out = []
    for k, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (k, t)
        out.append((i, t, lang, "s", len(t or ""), "x", 1, "y", "z", 2))
    return out


def frame(spark, texts, lang="en", parts=3):
    return spark.createDataFrame(rows(texts, lang), SCHEMA).repartition(parts, "doc_id")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed: int, n: int, vocabulary: int = 300) -> str:
    draw = random.Random(seed)
    words = ["".join(random.Random(v).choice("abcdefghilmnorstu") for _ in range(3 + v % 6)) for v in range(vocabulary)]
    out = []
    for k in range(n):
        out.append(draw.choice(words) + (".\n" if k % 13 == 12 else ""))
    return " ".join(out).replace("\n ", "\n")


def awkward():
    """Null, empty, blank, one word, repeats, ties, a null id, a long text, symbols, capitals, non-ASCII, a lone surrogate-free emoji."""
    long = prose(99, 30_000)
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "Word"),
        (5, prose(5, 120)),
        (5, prose(5, 120)),
        (6, prose(5, 120)),
        (7, prose(5, 119) + " changed"),
        (None, prose(8, 80)),
        (9, long),
        (10, "### $$$ %%% " * 40),
        (11, "LOUD WORDS HERE " * 30),
        (12, "Ünïcode ñandú ça été 😀 naïve " * 20),
        (13, "a b c a b c a b c " * 30),
        (14, prose(14, 60)),
        (15, prose(14, 60).upper()),
    ]
