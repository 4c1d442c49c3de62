import re
import sys
from collections import defaultdict
from pathlib import Path

import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from zonewright.llm.common import table  # noqa: E402

from . import test_decontamination, test_line_dedup, test_rules_and_classifier, test_simhash  # noqa: E402
from .helpers import empty  # noqa: E402


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen, name
        seen = set(ids)
    assert seen


def good(t):
    """The quality stage by regular expressions."""
    n, chars, symbols, dup, repeat = test_rules_and_classifier.base_truth(t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper, lower = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
    bare = sum(not re.search(r"[A-Za-z]|[^\x00-\x7f]", w) for w in re.findall(r"[^\x20\x09-\x0D]+", t))
    return n > 0 and not (2 * repeat > n or 10 * symbols > n or 10 * upper > 4 * (upper + lower) or 10 * dup > 6 * len(lines) or not 2 * n <= chars <= 12 * n or 10 * bare > 3 * n)


def test_chain_equals_a_version_without_spark(spark, sf):
    """Every stage's rows, each from what the stage before kept in the other version."""
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    docs = [(d, t) for d, t in docs if good(t)]
    docs = [(int(d), t) for d, t, n in test_line_dedup.truth(docs) if t.strip(" ") or not n]
    sets = [test_simhash.shingle_set(t) for _, t in docs]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    pairs = {(i, j) for ks in where.values() for i in ks for j in ks if i < j}
    order = sorted(range(len(docs)), key=lambda k: docs[k][0])
    root = test_simhash.roots(len(docs), [(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    first = {}
    for k in order:
        first.setdefault(root[k], k)
    docs = [docs[k] for k in first.values()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    hit = {d for d, _, n, _ in test_decontamination.truth(docs, items) if n}
    want = sorted((d, t) for d, t in docs if str(d) not in hit)
    got = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, sf)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == want
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in want}


def test_run_packs_what_is_left(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0


def test_clean_documents_stay(spark, sf):
    quality = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    docs = table(spark, sf, "documents")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect()}
    clean = [r.doc_id for r in docs.collect() if quality.get(r.doc_id) == 1]  # short ones too
    assert sum(d in kept for d in clean) >= 0.99 * len(clean)
    assert not [d for d in kept if quality.get(d) == 0]


def test_empty_table(spark, sf, tmp_path):
    e = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    e.write.parquet(str(tmp_path / "documents.parquet"))
    pq.write_table(pq.read_table(f"{sf}/benchmark.parquet"), tmp_path / "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
