"""Licence windows against all windows, notices inside sentences, long texts full of matches."""

import random
import time
from collections import Counter

from zonewright.llm import license_scan as ls

from .helpers import prose

TEXTS = (("A", "a b c d e f g h"), ("B", "c d x"), ("B", "d e f g y z"), ("C", "a a a b"), ("D", "h g f"))


def brute(words, templates, t):
    """The best window of every start and template among all windows, then without overlaps."""
    found = []
    for name, text in templates:
        other = Counter(zip(text.split(), text.split()[1:]))
        m = sum(other.values())
        for a in range(len(words) - 1):
            own, top = Counter(), None
            for b in range(a + 1, len(words)):
                own[words[b - 1], words[b]] += 1
                d = 2 * sum((own & other).values()) / (b - a + m)
                if d >= t and (top is None or d >= top[2]):
                    top = (a, b + 1, d, name)
            if top:
                found.append(top)
    out = []
    for x in sorted(found, key=lambda x: (-x[2], x[0] - x[1], x[0], x[3])):
        if all(x[1] <= y[0] or y[1] <= x[0] for y in out):
            out.append(x)
    return out


def test_windows_equal_all_windows():
    draw, hits = random.Random(1), 0
    for case in range(1000):
        t = (0.8, 0.6, 0.9)[case % 3]
        words = []
        while len(words) < draw.randrange(2, 60):
            words += draw.choice([x for _, x in TEXTS]).split() if draw.random() < 0.4 else draw.choices("abcdefghxyz", k=3)
            if words and draw.random() < 0.3:
                del words[draw.randrange(len(words))]
        got = ls.Templates(TEXTS, t).scan(draw.choice([" ", "\n", ". "]).join(words).encode())
        assert got == brute(words, TEXTS, t)
        hits += len(got) > 1
    assert hits > 300


def test_notices_inside_sentences():
    known = ls.compiled(ls.TEMPLATES, 0.8)
    names = lambda text: {x[3] for x in known.scan(text.encode())}
    assert names("This small tool is Released under the MIT License and you can find it on the web today") == {"MIT"}
    assert names("The code, which is licensed under the Apache License, Version 2.0, and its data are here") == {"Apache-2.0"}
    mit = max((t for n, t in ls.TEMPLATES if n == "MIT"), key=len).replace(".", "").replace("\n", " ")
    inside = " ".join(prose(1, 25).replace(".", "").split() + mit.split() + prose(2, 25).replace(".", "").split())
    ((first, end, dice, name),) = known.scan(inside.encode())
    assert (first, end, name) == (25, 25 + len([w for u in ls.units_of(mit.encode()) for w in u]), "MIT") and dice > 0.99
    assert names("the license of the state") == set() and names(prose(3, 5000)) == set()


def test_long_texts_full_of_matches():
    known = ls.compiled(ls.TEMPLATES, 0.8)
    text = b"Released under the MIT License.\nsome line of other prose\n"
    took = []
    for n in (8_000, 16_000, 32_000):
        began = time.process_time()
        assert len(known.scan(text * n)) == n
        took.append(time.process_time() - began)
    assert took[2] < 3 * took[1] + 0.2  # in proportion, not four times as long
    assert known.scan(b"word " * 2_000_000) == []  # ten megabytes
