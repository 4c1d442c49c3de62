from zonewright.llm import line_dedup as ld

from .helpers import awkward, empty, frame


def truth(texts, size=3):
    """Texts after removal, for distinct (doc_id, text)."""
    distinct = list(dict.fromkeys(texts))
    windows = {}
    for d, t in distinct:
        lines = [(i, x.strip(" ")) for i, x in enumerate((t or "").split("\n"))]
        full = [(i, x) for i, x in lines if x]
        for k in range(len(full) - size + 1):
            windows.setdefault(tuple(x for _, x in full[k : k + size]), []).append(((d is None, d or 0), k, (d, t), full[k][0], full[k + size - 1][0] + 1))
    gone = {}
    for w in windows.values():
        first = min(x[0] for x in w)
        seen = {}
        for x in sorted(w, key=lambda x: x[:2]):
            mine = x[0] == first
            if not mine or seen.get(x[2]):
                gone.setdefault(x[2], set()).update(range(x[3], x[4]))
            seen[x[2]] = True
    out = []
    for d, t in texts:
        g = gone.get((d, t), set())
        out.append((str(d), None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g), len(g)))
    return sorted(out, key=str)


def run(spark, texts):
    return sorted(((str(r.doc_id), r.text, r._zw_n_removed) for r in ld.dedup_lines(frame(spark, texts)).collect()), key=str)


def test_equals_brute_force(spark):
    a = "l1\nl2\nl3\nl4\nl5"
    texts = [
        *awkward(),
        (20, a),
        (21, "x\n" + a + "\ny"),
        (22, "l1\nl2\nother\nl3"),
        (23, "l2\n\n l3 \n\nl4"),
        (24, "p\nq\nr\np\nq\nr\np\nq\nr"),
        (25, "same\nsame\nsame\nsame\nsame"),
        (26, "two\nlines"),
        (27, "two\nlines"),
        (None, a),
        (28, "l1\nl2\nl3\nnew\nl3\nl4\nl5"),
        (21, "x\n" + a + "\ny"),
    ]
    assert run(spark, texts) == truth(texts)


def test_columns_and_empty(spark):
    df = frame(spark, awkward())
    assert ld.dedup_lines(df).columns == [*df.columns, "_zw_n_lines", "_zw_n_removed"]
    assert ld.dedup_lines(empty(spark)).count() == 0


def test_texts_of_one_id_are_apart(spark):
    a = "l1\nl2\nl3"
    texts = [(7, a + "\nx"), (7, "y\n" + a), (None, "m1\nm2\nm3\nz"), (None, "q\nm1\nm2\nm3"), (8, "u\nl1\nl2\nl3")]
    got = run(spark, texts)
    assert sorted(n for d, _, n in got if d == "7") == [0, 3] and sorted(n for d, _, n in got if d == "None") == [0, 3]
    assert [n for d, _, n in got if d == "8"] == [3]
