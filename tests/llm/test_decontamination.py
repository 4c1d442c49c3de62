import hashlib
import random
import re

from zonewright.llm import decontamination as dc

from .helpers import awkward, empty, frame, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def truth(texts, items):
    windows = []
    for i, t in items:
        w = words(t)
        if w:
            m = min(10, len(w))
            windows += [(i, tuple(w[k : k + m])) for k in range(len(w) - m + 1)]
    out = []
    for d, t in texts:
        w, hit, found = words(t), set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(i)
        out.append((str(d), len(w), len(hit), ",".join(sorted(str(x) for x in found if x is not None))))
    return sorted(out)


def run(spark, texts, items, **kw):
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, v string")
    return sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"])) for r in dc.contaminated(frame(spark, texts), b, **kw).collect())


def corpus():
    draw = random.Random(4)
    items = [(k, prose(1000 + k, n)) for k, n in enumerate((40, 10, 11, 9, 7, 5, 4, 3, 2, 1, 25, 60))]
    items += [(20, items[0][1]), (20, items[0][1]), (21, None), (22, ""), (23, "..."), (24, "Und und UND und und und und und und und und und"), (25, "été Ça été ñ été ça")]
    texts = awkward() + [(30, "und " * 40), (31, "été ça été ñ été ÇA"), (32, "ÉTÉ ça été ñ été ça")]
    for k in range(60):
        w = prose(k, 80).split(" ")
        item = (draw.choice(items)[1] or "x").replace("\n", " ").split(" ")
        a = draw.randrange(max(1, len(item) - 8))
        at = draw.randrange(80)
        texts.append((100 + k, " ".join(w[:at] + item[a : a + draw.randrange(1, 16)] + w[at:]).upper() if k % 5 == 0 else " ".join(w[:at] + item[a : a + draw.randrange(1, 30)] + w[at:])))
    return texts, items


def test_equals_brute_force(spark):
    texts, items = corpus()
    assert run(spark, texts, items) == truth(texts, items)


def test_large_benchmark_path_gives_the_same(spark):
    texts, items = corpus()
    assert run(spark, texts, items[:12], broadcast_windows=0) == truth(texts, items[:12])


def test_spans_and_filter(spark):
    texts = [(1, "one two three four five six seven eight nine ten eleven"), (2, "nothing here"), (None, "one two three four five six seven eight nine ten"), (3, None)]
    b = spark.createDataFrame([(7, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    got = {r.doc_id: r for r in dc.contaminated(frame(spark, texts), b).collect()}
    assert [(s.s, s.e) for s in got[1].spans] == [(1, 11)] and got[2].n_hit == 0
    assert sorted(str(r.doc_id) for r in dc.decontaminate(frame(spark, texts), b).collect()) == ["2", "3", "None"]


def test_empty_tables(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(empty(spark), b).count() == 0
    assert {r.n_hit for r in dc.contaminated(frame(spark, awkward()), b).collect()} == {0}


def test_sha_of_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
