import random

import numpy as np
import pytest
import xxhash

from zonewright.llm import simhash as sh
from zonewright.llm.components import components

from .helpers import awkward, empty, frame, prose


def fingerprint(t, k=3):
    w = [x for x in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    g = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_equals_brute_force(spark):
    draw = random.Random(3)
    texts = awkward()
    for k in range(150):
        t = prose(k % 40, 150).split(" ")
        for _ in range(draw.randrange(3)):
            t[draw.randrange(len(t))] = "edit"
        texts.append((100 + k, " ".join(t)))
    f = [fingerprint(t) for _, t in texts]
    r = roots(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2])
    smallest = {}
    for (d, _), x in zip(texts, r, strict=True):
        smallest[x] = min((v for v in (smallest.get(x), d) if v is not None), default=None)
    want = sorted((str(d), x, str(smallest[y])) for (d, _), x, y in zip(texts, f, r, strict=True))
    got = sh.simhash_components(frame(spark, texts), leaf_points=8, sample_rows=40).collect()
    assert sorted((str(g.doc_id), g.fingerprint % (1 << 64), str(g.component_id)) for g in got) == want


def points_near(n, seed, flips=3):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)
    p = np.repeat(base, 4)
    for _ in range(flips):
        p = p ^ (np.uint64(1) << rng.integers(0, 64, len(p)).astype(np.uint64))
    return np.unique(np.concatenate([p, base, base[:50] ^ np.uint64(1)])).reshape(-1, 1)


def close(p, radius):
    i, j = np.nonzero(np.bitwise_count(p[:, None, 0] ^ p[None, :, 0]) <= radius)
    return [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b]


def test_leaves_lose_no_link():
    p = points_near(4000, 1)
    for radius in (1, 2, 3):
        want = roots(len(p), close(p, radius))
        assert sh.linked(p, radius).tolist() == want
        slack = -(-radius // 2)
        tree = sh.VantageTree(p[::7], 20, slack)
        before = tree.leaves
        for again in (False, True):
            links = []
            for _, at in tree.deal(p):
                links += [(int(at[k]), int(at[r])) for k, r in enumerate(sh.linked(p[at], radius)) if r != k]
            assert tree.leaves > 8 and roots(len(p), links) == want
            if not again:
                tree.refine({leaf: (p[at][::2], 10) for leaf, at in tree.deal(p) if len(at) > 60})
        assert tree.leaves > before


def test_overfull_leaves_are_parted_again(spark):
    p = points_near(6000, 4)
    df = spark.createDataFrame([(int(x),) for x in p[:, 0].view(np.int64)], "node long").selectExpr("node", "node AS f0")
    few = sh.fitted_tree(df, len(p), 2, 64, 100, overfull=10**6).value
    more = sh.fitted_tree(df, len(p), 2, 64, 100, overfull=1).value
    assert more.leaves > 4 * few.leaves
    got = components(sh.near_edges(df, len(p), 2, 64, 100)).collect()
    want = roots(len(p), close(p, 2))
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    have = {}
    for k, r in enumerate(want):
        have.setdefault(r, set()).add(int(p[k, 0].view(np.int64)))
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in have.values() if len(g) > 1}


def test_confirm_decides_links():
    p = points_near(800, 2)
    ok = lambda i, j: (i + j) % 3 > 0
    want = roots(len(p), [(a, b) for a, b in close(p, 2) if ok(a, b)])
    assert sh.linked(p, 2, ok).tolist() == want


def test_sets_are_exact():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)] + [np.zeros(0, dtype=np.uint64)]
    known = sh.Sets(sets)
    for i in range(len(sets)):
        js = np.array([j for j in range(len(sets)) if j != i])
        want = [5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])) and len(sets[i]) and len(sets[j]) for j in js]
        assert known.alike(i, js, at_once=50).tolist() == [bool(x) for x in want]


def test_components_of_paths_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1300)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)] + [(-5, -6), (7777, 7777)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 50, 300, 301] and all(k in v for k, v in groups.items())


@pytest.mark.parametrize("few", [0, 40, 1 << 16])
def test_components_do_not_depend_on_where_one_task_takes_over(spark, few):
    draw = random.Random(few)
    edges = [(draw.randrange(-400, 400), draw.randrange(-400, 400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(4900, 5100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    held = {x: {x} for e in edges if e[0] != e[1] for x in e}
    for a, b in edges:
        if a != b and held[a] is not held[b]:
            held[a] |= held[b]
            for x in held[b]:
                held[x] = held[a]
    assert got.keys() == held.keys()
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(node)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in held.values()}
    assert all(root in g for root, g in groups.items())


def test_few_edges_cost_the_driver_few_stages(spark):
    """Every round is several stages, whose plans, tasks and events the driver holds, however few edges are left."""
    stages = spark.sparkContext._jsc.sc().dagScheduler().nextStageId
    before = stages()
    got = components(spark.createDataFrame([(k, k + 1) for k in range(2000)], "a long, b long"))
    assert got.count() == 2001 and stages() - before <= 16



def test_stage_keeps_one_of_each(spark):
    texts = awkward()
    for k in range(30):
        t = prose(500 + k, 400).split()
        texts.append((200 + 3 * k, " ".join(t)))
        for c in (1, 2):  # near copies: 6 of 400 words changed, 5-word shingles about 0.86 alike
            u = list(t)
            for x in random.Random(k * 9 + c).sample(range(len(u)), 6):
                u[x] = f"new{x}"
            texts.append((200 + 3 * k + c, " ".join(u)))
    got = sh.keep_one_of_each(frame(spark, texts))
    assert got.columns == frame(spark, texts).columns
    kept = [r.doc_id for r in got.collect()]
    assert len(kept) == len(set(kept)) and {5, 9, 14} <= set(kept) and 6 not in kept
    assert {200 + 3 * k for k in range(30)} <= set(kept) and sum(d is not None and d >= 200 for d in kept) <= 33
    assert sum(d in (1, 2, 3) for d in kept) == 1


def shingle_set(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near_pairs(seed, groups, changes):
    """Texts of 124 random words, each with copies in which so many successive words are new: Jaccard (120 - x) / (120 + x) for x = words + 4."""
    draw, texts = random.Random(seed), []
    for g in range(groups):
        t = [f"w{draw.randrange(100_000)}" for _ in range(124)]
        texts.append((g * 10, " ".join(t)))
        for c, n in enumerate(changes):
            at = draw.randrange(4, 120 - n)
            texts.append((g * 10 + 1 + c, " ".join([*t[:at], *(f"n{draw.randrange(100_000)}" for _ in range(n)), *t[at + n :]])))
    return texts


def brute_kept(texts):
    s = [shingle_set(t) for _, t in texts]
    links = [(i, j) for j in range(len(s)) for i in range(max(0, j - 9), j) if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]
    return {texts[k][0] for k, r in enumerate(roots(len(s), links)) if r == k}


def test_only_large_groups_are_given_their_size(spark):
    rows = [(1, k) for k in range(7)] + [(2, k) for k in range(3)] + [(3, 0)]
    members = spark.createDataFrame(rows, "group long, node long")
    for broadcast_groups in (100_000, 0):
        got = sh.sized(members, 3, broadcast_groups).collect()
        assert sorted((r.group, r.node) for r in got) == sorted(rows)
        assert {r.group: r.n for r in got} == {1: 7, 2: 1, 3: 1}
    assert sh.sized(members.limit(0), 3).count() == 0


def test_large_groups_are_compared_in_blocks(spark):
    t = [f"w{k}" for k in range(300)]
    texts = [(0, " ".join(t))] + [(k, " ".join([*t[:k], f"n{k}", *t[k + 1 :]])) for k in range(1, 200)] + [(1000 + k, prose(900 + k, 200, 2000)) for k in range(20)]
    for most in (16, 4096):
        assert {r.doc_id for r in sh.keep_one_of_each(frame(spark, texts), most).collect()} == {0} | {1000 + k for k in range(20)}


def test_stage_equals_jaccard_brute_force(spark):
    for most, changes in ((4096, (9,)), (4096, (10, 12)), (4096, (9, 9, 3)), (4, (9, 9, 3, 5, 8))):  # 0.80; below; copies that are alike to the first only
        texts = near_pairs(sum(changes), 150, changes)
        want = brute_kept(texts)
        kept = {r.doc_id for r in sh.keep_one_of_each(frame(spark, texts), most).collect()}
        assert want <= kept  # precision: nothing goes that brute force keeps
        assert len(kept - want) <= 0.02 * (len(texts) - len(want))  # recall of 98 % and more


def test_frequent_shingle_makes_no_copy(spark):
    texts = [(k, "spam " * 900 + prose(700 + k, 60)) for k in range(4)]
    assert {r.doc_id for r in sh.keep_one_of_each(frame(spark, texts)).collect()} == {0, 1, 2, 3}


def test_texts_of_one_id_are_apart(spark):
    a, b = prose(801, 200), prose(802, 200, 900)
    texts = [(1, b), (2, a), (2, b), (2, "quite another text of nine words in all here"), (None, prose(803, 90, 700)), (None, prose(804, 90, 800))]
    got = sh.keep_one_of_each(frame(spark, texts)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(d), t) for d, t in texts if (d, t) != (2, b))


def test_empty(spark):
    assert sh.simhash_components(empty(spark)).count() == 0 and sh.keep_one_of_each(empty(spark)).count() == 0
