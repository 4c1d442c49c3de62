import math
import os
import pickle
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from zonewright.llm import language_id as li
from zonewright.llm import license_scan as ls
from zonewright.llm import token_counts as tc
from zonewright.llm import tokens
from zonewright.llm.common import table

from .helpers import awkward, empty, frame, prose


class Plain:
    """PPM (method C, orders 3 to -1) by nested dictionaries: what a longer context has seen is left out of the shorter."""

    def __init__(self, texts):
        self.n = defaultdict(Counter)
        self.alphabet = set()
        for lang, t in texts:
            x = bytes(li.symbols(t))
            if not x:
                continue
            x = b"  " + x
            for k in range(3, len(x)):
                self.alphabet |= set(x[k - 3 : k + 1])
                for order in range(4):
                    self.n[lang, x[k - order : k]][x[k]] += 1

    def probability(self, lang, context, symbol):
        size = len(self.alphabet) + 1
        dist = {s: 1 / size for s in [*self.alphabet, None]}
        for order in range(4):
            c = self.n.get((lang, context[3 - order :]))
            if c:
                total, q = sum(c.values()), len(c)
                left = {s: p for s, p in dist.items() if s not in c}
                mass = sum(left.values())
                escape = q / (total + q) if mass > 0 else 0
                dist = {s: c[s] / total * (1 - escape) if s in c else left[s] / mass * escape for s in dist}
        return dist[symbol if symbol in self.alphabet else None]

    def bits(self, lang, text):
        x = b"  " + bytes(li.symbols(text))
        return sum(-math.log2(self.probability(lang, x[k - 3 : k], x[k])) for k in range(3, len(x)))


def test_code_lengths_equal_plain_ppm(spark):
    rows = [("en", "the cat sat on the mat and the hat"), ("en", "then that is it"), ("de", "der hund und die katze"), ("de", "über die straße"), ("fr", "l'été à la plage")]
    trees = li.learn(spark.createDataFrame(rows, "lang string, text string"))
    plain = Plain(rows)
    probes = ["the hund", "ça été", "zzz qqq", "x", "Straße 12 und"]
    got = trees.code_lengths(probes)
    for t, b in zip(probes, got, strict=True):
        assert np.allclose(b, [plain.bits(lang, t) for lang in trees.languages], rtol=1e-5), t
    whole = trees.code_lengths([prose(1, 900)])
    assert np.allclose(trees.code_lengths([prose(1, 900)], at_once=100), whole)


def test_tables_in_many_files(spark):
    """The lengths do not depend on how the tables are cut into files, and the files go when they are removed."""
    rows = [(lang, prose(k, 120)) for k, lang in enumerate(["en", "de", "fr", "en", "sw"])] + [("ru", "это просто текст")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    one, many = li.learn(docs), li.learn(docs, part_rows=60)
    assert all(len(t.files) == 1 for pair in one.orders for t in pair)
    assert sum(len(t.files) for pair in many.orders for t in pair) > 12
    probes = ["ein text", "this is the text", "просто", "", prose(9, 300)]
    assert np.allclose(many.code_lengths(probes), one.code_lengths(probes), rtol=1e-12)
    copy = pickle.loads(pickle.dumps(many))
    assert not any(t.parts for pair in copy.orders for t in pair)  # paths travel, tables do not
    folder = many.folder.removeprefix("file://")
    assert os.path.isdir(folder)
    many.remove()
    assert not os.path.exists(folder)


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in li.identify(docs).collect() if r.held_out]
    assert len(got) > 100 and sum(r.lang_pred == want[r.doc_id] for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_rare_language_beside_a_large_one(spark, monkeypatch):
    hot = [*range(97, 123), *range(128, 134)]  # 32 bytes: 1,048,576 grams and 32,768 contexts
    byte = lambda s: f"element_at(array({', '.join(map(str, hot))}), int(shiftright(id, {s}) % 32) + 1)"
    gram = " + ".join(f"{byte(s)} * {1 << k}L" for s, k in ((0, 0), (5, 8), (10, 16), (15, 24)))
    large = spark.range(32**4).selectExpr("'aa' AS lang", f"{gram} AS gram", "9L AS n")
    text = "ñandú vôle là-bas"
    rare = spark.createDataFrame([("zz", int(g), 1) for g in set(li.grams(text).tolist())], "lang string, gram long, n long")
    monkeypatch.setattr(li, "gram_counts", lambda docs: large.unionByName(rare))
    trees = li.learn(frame(spark, ["x"]))
    assert trees.languages == ["aa", "zz"]
    bits = trees.code_lengths([text])[0]
    assert bits[1] < bits[0] / 3


def test_language_awkward(spark):
    got = li.identify(frame(spark, awkward())).collect()
    assert len(got) == len(awkward())
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3, 10))
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 9)} == {"en"}
    assert li.identify(empty(spark)).count() == 0
    nolang = frame(spark, awkward()).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in li.identify(nolang).collect()} == {"und"}


def test_token_counts(spark, tmp_path):
    texts = awkward() + [(50, "<|endoftext|> is text"), (51, prose(51, 900))]
    tok = Tokenizer.from_file(tokens.word_bpe_path())
    tok.encode_special_tokens = True
    want = sorted((str(i), len(tok.encode(t, add_special_tokens=False).ids) if t else 0) for i, t in texts)
    for block in (1 << 20, 8192, 2):
        got = tc.document_token_counts(frame(spark, texts if block > 2 else texts[:4]), tokens.word_bpe_path(), 49407, block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == (want if block > 2 else sorted((str(i), len(tok.encode(t).ids) if t else 0) for i, t in texts[:4]))
    assert tc.document_token_counts(empty(spark), tokens.word_bpe_path(), 49407).count() == 0


def test_token_files_of_others(spark, tmp_path):
    files = {"a.bin": [5, 5, 9, 9, 7, 9], "b.bin": [1, 2, 3], "c.bin": [], "d.bin": [9], "e.bin": [4] * 1000 + [9] + [4] * 500}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u4").tobytes())
    for block in (4, 12, 1 << 20):
        got = sorted((r.file, r.ordinal, r.start, r.n_tokens, r.ended) for r in tc.count_tokens(spark, str(tmp_path), 9, width=4, block_bytes=block).collect())
        assert got == [("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 0, True), ("a.bin", 2, 4, 1, True), ("b.bin", 0, 0, 3, False), ("d.bin", 0, 0, 0, True), ("e.bin", 0, 0, 1000, True), ("e.bin", 1, 1001, 500, False)]


def brute_unit(words, threshold):
    out = []
    a = Counter(zip(words, words[1:]))
    for name, text in ls.TEMPLATES:
        w = [x for u in ls.units_of(text.encode()) for x in u]
        b = Counter(zip(w, w[1:]))
        d = 2 * sum((a & b).values()) / max(1, len(words) - 1 + len(w) - 1)
        if d >= threshold:
            out.append((d, name))
    return min(out, key=lambda x: (-x[0], x[1])) if out else None


def test_bounds_lose_no_template():
    known = ls.compiled(ls.TEMPLATES, 0.8)
    for name, text in ls.TEMPLATES:
        words = [w for u in ls.units_of(text.encode()) for w in u]
        for drop in range(0, len(words), max(1, len(words) // 7)):
            cut = words[:drop] + words[drop + 1 :]
            assert known.best(cut, set(range(len(known.items)))) == brute_unit(cut, 0.8)


def test_licence_scan(spark):
    mit = dict(ls.TEMPLATES[::-1])["MIT"]
    long_mit = next(t for n, t in ls.TEMPLATES if n == "MIT" and len(t) > 100)
    wrapped = "\n".join(long_mit[k : k + 70] for k in range(0, len(long_mit), 70))
    wrapped = "\n".join(" ".join(long_mit.split()[k : k + 9]) for k in range(0, len(long_mit.split()), 9))
    texts = awkward() + [(60, prose(1, 50) + "\nReleased under the MIT License.\n" + prose(2, 50)), (61, mit), (62, prose(3, 40) + "\n" + wrapped + "\n" + prose(4, 40)), (63, "Prose. This work is licensed under the GNU General Public License, version 3. More."), (64, "the license of the state"), (65, "Licensed under CC BY-NC 4.0. Released under the MIT License.")]
    got = {r.doc_id: r for r in ls.scan_licences(frame(spark, texts)).collect()}
    assert [got[k].licence for k in (60, 61, 62, 63, 64)] == ["MIT", "MIT", "MIT", "GPL-3.0", None]
    assert got[65].licences == ["CC-BY-NC-4.0", "MIT"] and got[62].dice > 0.95
    assert all(got[i].licence is None for i in (1, 2, 3, 4, 5, 9, 13))
    assert ls.scan_licences(empty(spark)).count() == 0


def test_licences_in_usual_layout(spark):
    bsd = next(t for n, t in ls.TEMPLATES if n == "BSD-2-Clause")
    mit = next(t for n, t in ls.TEMPLATES if n == "MIT" and len(t) > 100)
    listed = bsd.replace(" 1. ", "\n1. ").replace(" 2. ", "\n2. ")
    w = mit.split()
    ragged = "\n".join(x for k in range(0, len(w), 10) for x in (" ".join(w[k : k + 9]), *w[k + 9 : k + 10]))
    lines = "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))
    texts = [(1, prose(1, 60) + "\n" + listed + "\n" + prose(2, 60)), (2, prose(3, 60) + "\n" + ragged + "\n" + prose(4, 60)), (3, lines + "\n" + lines + "\n" + prose(5, 900))]
    got = {r.doc_id: r for r in ls.scan_licences(frame(spark, texts)).collect()}
    assert [got[k].licence for k in (1, 2, 3)] == ["BSD-2-Clause", "MIT", "MIT"]
    assert [len(got[k].blocks) for k in (1, 2, 3)] == [1, 1, 2] and all(got[k].dice > 0.95 for k in (1, 2, 3))
