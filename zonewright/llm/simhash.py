"""Operator 10: SimHash near-duplicates, with the close pairs found by vantage-point trees.

Every text gets a fingerprint: each bit is the majority of that bit over the hashes of its word shingles. Equal
fingerprints are one point. A vantage-point tree is fitted on a bounded sample of points: each node keeps a point and
the median distance to it, and parts the points into near and far. Points are dealt to the tree's leaves by the
triangle inequality: for links of r bits a point goes to both sides if it lies within ceil(r / 2) of the border, for
then two points of a link meet in the leaf of a point half way between them. Leaves that prove over-full when all
points are counted are parted again by a tree fitted on a sample of their own points. Inside a leaf a further tree of
the same kind parts the points until few are left, which are compared exactly. A leaf gives each point an edge to one
other of its component there, so a dense group of thousands gives as many edges as it has points; the components of
all leaves' edges are the result.

The pipeline's stage looks for texts alike by a Jaccard similarity of 0.8, which is far from "a few bits": there the
triangle inequality parts nothing in the space of all fingerprints (two such texts differ in 39 of 256 bits, any two in
128 give or take 8). The shards that overlap are therefore named by smallest shingle hashes; within a shard fingerprints
are searched by vantage-point trees as above and pairs confirmed by exact similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_type, row_key, unused
from .components import components

_LEAF = 384  # points that are compared pair by pair


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of space-joined words, A-Z in lower case; fewer words: of the whole sequence."""
    import xxhash

    w = text.lower().split()  # bytes: only A-Z and ASCII white space
    if not w:
        return np.zeros(0, dtype="<u8")
    digest, joined = xxhash.xxh64_intdigest, b" ".join(w)
    if len(w) <= words:
        return np.array([digest(joined, 42)], dtype="<u8")
    ends = list(accumulate(map((1).__add__, map(len, w)), initial=0))
    return np.array([digest(joined[a : b - 1], 42) for a, b in zip(ends, ends[words:], strict=False)], dtype="<u8")


def spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash (0: itself), by multiplication and shifts."""
    if not k:
        return h
    x = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype("<u8")


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number."""
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65536):
        part = h[k : k + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, _rk (of the text) and the text's bytes. A null text is empty, but keeps a key of its own."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", row_key("text").alias("_rk"), text.cast("binary").alias("text"))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and f0, the fingerprint, for each row of docs. A null text is empty: all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [majority(shingle_hashes(t.as_py() or b"", shingle)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.int64())], ["doc_id", "f0"])

    return _texts(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, f0 long")


# ---- vantage-point trees over points: arrays of as many rows as points and a column per 64 bits ----


def hamming(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ one).sum(axis=-1, dtype=np.int64)


class VantageTree:
    """Nodes as [vantage point, median distance, near child, far child]; a child below 0 is leaf -1 - child."""

    def __init__(self, points: np.ndarray, leaf: int, slack: int, seed: int = 0):
        self.slack, self.nodes, self.leaves = slack, [], 0
        self._rng = np.random.default_rng(seed)
        self.root = self._grow(points, leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        split = best_split(points, self.slack, self._rng) if len(points) > leaf else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        vantage, middle, d = split
        k = len(self.nodes)
        self.nodes.append(None)
        self.nodes[k] = [vantage, middle, self._grow(points[d <= middle], leaf), self._grow(points[d > middle], leaf)]
        return k

    def refine(self, samples: dict[int, tuple[np.ndarray, int]]) -> None:
        """Part leaves again: each leaf's own sample of points and how many of them a new leaf may have."""
        grown = {-1 - leaf: self._grow(points, size) for leaf, (points, size) in samples.items()}
        for node in self.nodes:
            node[2:] = [grown.get(c, c) for c in node[2:]]
        self.root = grown.get(self.root, self.root)

    def deal(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the positions of the points that belong there or lie near their border."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at
            else:
                vantage, middle, near, far = self.nodes[node]
                d = hamming(points[at], vantage)
                todo += [(near, at[d - self.slack <= middle]), (far, at[d + self.slack > middle])]


def best_split(points: np.ndarray, slack: int, rng: np.random.Generator, tries: int = 6) -> tuple[np.ndarray, int, np.ndarray] | None:
    """Of a few points of the set, the vantage point and median that put fewest points on both sides; None if nothing is parted."""
    best, least = None, 0.9
    for v in points[rng.integers(0, len(points), tries)]:
        d = hamming(points, v)
        for middle in {int(np.median(d)), int(np.median(d)) - 1}:
            near, far = (d - slack <= middle).sum(), (d + slack > middle).sum()
            if (worst := max(near, far) / len(points)) < least and (d <= middle).any() and (d > middle).any():
                best, least = (v, middle, d), worst
    return best


def linked(points: np.ndarray, radius: int, confirm: Callable[[int, np.ndarray], np.ndarray] | None = None, seed: int = 0) -> np.ndarray:
    """For each point the position of its component's first point, by links of at most `radius` bits.

    confirm(i, js): which of the points js does i link with indeed; it is asked only about pairs that no earlier link joins.
    """
    root = np.arange(len(points))
    if len(root) == 2:
        joined = int(hamming(points[0], points[1])) <= radius and (confirm is None or bool(confirm(0, root[1:])[0]))
        return np.zeros(2, dtype=root.dtype) if joined else root

    def roots(at: np.ndarray) -> np.ndarray:
        r = root[at]
        while not np.array_equal(r, up := root[r]):
            r = up
        root[at] = r
        return r

    rng, slack, todo = np.random.default_rng(seed), -(-radius // 2), [np.arange(len(points))]
    while todo:
        at = todo.pop()
        split = best_split(points[at], slack, rng) if len(at) > _LEAF else None
        if split is not None:
            _, middle, d = split
            todo += [at[d - slack <= middle], at[d + slack > middle]]
            continue
        for k in range(0, len(at), 256):  # rows of the comparison, so that memory stays bounded
            d = np.bitwise_count(points[at[k : k + 256], None, 0] ^ points[None, at[k:], 0]).astype(np.uint16)
            for w in range(1, points.shape[1]):
                d += np.bitwise_count(points[at[k : k + 256], None, w] ^ points[None, at[k:], w])
            i, j = np.nonzero(d <= radius)
            i, j = i[i < j], j[i < j]
            for x in np.unique(i):
                one, others = int(at[k + x]), at[k + j[np.searchsorted(i, x) : np.searchsorted(i, x, "right")]]
                mine, theirs = int(roots(np.array([one]))[0]), roots(others)
                others, theirs = others[theirs != mine], theirs[theirs != mine]
                if confirm is not None and len(others):
                    theirs = theirs[confirm(one, others)]
                if len(theirs):
                    root[np.append(theirs, mine)] = min(int(theirs.min()), mine)
    return roots(np.arange(len(points)))


def above(n: int) -> np.ndarray:
    """For the points 1 to n - 1 of a component the point that each is tied to: a tree with up to sixteen branches, so that nobody has many edges and ways are short."""
    return (np.arange(1, n) - 1) // 16


def branches(root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of points with another one of their component each, so that edges join every component (see above)."""
    order = np.argsort(root, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(root[order]) != 0))
    size = np.diff(np.append(first, len(order)))
    begin = np.repeat(first, size)
    place = np.arange(len(order)) - begin
    later = place > 0
    return order[later], order[(begin + (place - 1) // 16)[later]]


def _columns(batch: pa.RecordBatch | pa.Table, fields: list[str]) -> np.ndarray:
    return np.stack([batch.column(f).to_numpy() for f in fields], axis=1).view(np.uint64)


def fitted_tree(points: DataFrame, n: int, radius: int, leaf_points: int, sample_rows: int, overfull: int = 16, again: int = 512) -> Broadcast:
    """A tree for the n points (node, f0) with leaves of about leaf_points.

    It is fitted on at most about sample_rows points (a quarter of them at most); as a leaf needs eight of these, it has
    at most sample_rows / 8 leaves. All points are then counted by leaf; leaves of over `overfull` times leaf_points are
    parted again by about `again` points of their own, so that at most sample_rows / 8 * again points are gathered, whatever n is.
    """
    spread_key, whole = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(1 << 30)), 1 << 30
    share = min(0.25, sample_rows / max(n, 1))
    picked = points.where(spread_key < int(share * whole)).select("f0").collect()
    sample = np.sort(np.array([r[0] for r in picked], dtype=np.int64)).view(np.uint64).reshape(-1, 1)
    tree = VantageTree(sample, max(8, int(leaf_points * share)), -(-radius // 2))
    held = points.sparkSession.sparkContext.broadcast(tree)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(held.value.leaves, dtype=np.int64)
        for b in batches:
            for leaf, at in held.value.deal(_columns(b, ["f0"])):
                sums[leaf] += len(at)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums)), pa.array(sums[sums > 0])], ["leaf", "n"])

    counts = points.select("f0").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    full = {r[0]: r[1] for r in counts.where(F.col("n") > overfull * leaf_points).collect()}
    if not full:
        return held
    parts = points.sparkSession.sparkContext.broadcast({leaf: again / c for leaf, c in full.items()})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, draw = _columns(b, ["f0"]), b.column("draw").to_numpy() / whole
            for leaf, at in held.value.deal(f):
                got = at[draw[at] < parts.value.get(leaf, 0)]
                if len(got):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), leaf)), b.column("f0").take(pa.array(got))], ["leaf", "f0"])

    own: dict[int, list[int]] = {}
    for leaf, f in points.select("f0", spread_key.alias("draw")).mapInArrow(pick, "leaf long, f0 long").collect():
        own.setdefault(leaf, []).append(f)
    tree.refine({leaf: (np.sort(np.array(f, dtype=np.int64)).view(np.uint64).reshape(-1, 1), max(8, again * leaf_points // full[leaf])) for leaf, f in sorted(own.items())})
    held.unpersist()
    return points.sparkSession.sparkContext.broadcast(tree)


def near_edges(points: DataFrame, n: int, radius: int, leaf_points: int = 1024, sample_rows: int = 20_000) -> DataFrame:
    """Edges a, b that join all nodes whose codes differ in at most `radius` bits. points: node (long, unique) and f0, n rows."""
    tree = fitted_tree(points, n, radius, leaf_points, sample_rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for leaf, at in tree.value.deal(_columns(b, ["f0"])):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf)), *(c.take(pa.array(at)) for c in b.columns)], ["leaf", *b.schema.names])

    def link(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        first = np.argsort(node, kind="stable")  # the result must not depend on the order of arrival
        a, b = branches(linked(_columns(group, ["f0"])[first], radius))
        return pa.table({"a": node[first][a], "b": node[first][b]})

    return points.select("node", "f0").mapInArrow(deal, "leaf long, node long, f0 long").groupBy("leaf").applyInArrow(link, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, leaf_points: int = 1024, sample_rows: int = 20_000) -> DataFrame:
    """Each row of docs with its fingerprint (signed 64 bits) and component_id, the smallest doc_id that links reach.

    docs: doc_id (of any type that has an order) and text; other columns are ignored. Fingerprints link at `radius` or fewer
    differing bits. A null or empty text has fingerprint zero and links like any other. Rows with equal texts share a
    fingerprint, so repeated rows share a component. A null doc_id is never the smallest unless all are null. An empty
    table gives no rows.
    """
    prints = cut(fingerprints(docs, shingle).select("doc_id", F.col("f0").alias("fingerprint")))
    points = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    nodes = points.select(F.col("fingerprint").alias("node"), F.col("fingerprint").alias("f0"))
    edges = near_edges(nodes, points.count(), radius, leaf_points, sample_rows)
    joined = components(edges).join(points, F.col("node") == F.col("fingerprint"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("smallest"))
    reached = joined.select("node", "root").join(smallest, "root").select("node", "smallest")
    label = points.join(reached, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("smallest", "first").alias("component_id"))
    label = cut(label)  # so that both sides of the last join are shuffled for it alone and Spark can split a fingerprint of many copies
    return prints.join(label, "fingerprint").select("doc_id", "fingerprint", "component_id")


# ---- near copies by the similarity of their shingles ----

#: Shingles of five words; copies share 0.8 of their distinct shingles, as numerator and denominator.
SHINGLE, JACCARD = 5, (4, 5)
#: A shard is named by three smallest hashes; a text is in ten. Two copies at 0.8 share one with a probability of 1 - (1 - 0.8 ** 3) ** 10 = 0.999.
SHARDS, PER_SHARD = 10, 3
#: Within a shard pairs are proposed at 60 of 256 differing bits: at 0.8 the mean is 39 with a standard deviation of 5.7.
SIGNATURE_WORDS, PROPOSED = 4, 60
_FIELDS = [f"f{k}" for k in range(SIGNATURE_WORDS)]
_NAMES = [f"s{k}" for k in range(SHARDS)]
_TURNS = np.array([((k * 0x9E3779B97F4A7C15) ^ 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF | 1 for k in range(1, SHARDS * PER_SHARD + 1)], dtype=np.uint64)


def shard_names(h: np.ndarray) -> list[int | None]:
    """The shards of a set of shingle hashes: for each, the three smallest values under three multiplications, as one number. None for an empty set."""
    if not len(h):
        return [None] * SHARDS
    low = np.min([(h[None, k : k + 8192] * _TURNS[:, None]).min(axis=1) for k in range(0, len(h), 8192)], axis=0)
    out = np.zeros(SHARDS, dtype=np.uint64)
    for k in range(PER_SHARD):
        out = spread(out ^ low[k::PER_SHARD], k + 1)
    return out.view(np.int64).tolist()


def shingle_points(docs: DataFrame) -> DataFrame:
    """doc_id, _rk (of the text), node (64 bits of the set of shingles), f0.. (fingerprints of the set) and s0.. (its shards) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows = []
            for t in b.column(2):
                h = np.unique(shingle_hashes(t.as_py() or b"", SHINGLE))
                rows.append([xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63), *(majority(spread(h, k)) for k in range(SIGNATURE_WORDS)), *shard_names(h)])
            names = ["node", *_FIELDS, *_NAMES]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "_rk", *names])

    return _texts(docs).mapInArrow(run, f"doc_id {id_type(docs)}, _rk long, " + ", ".join(f"{x} long" for x in ["node", *_FIELDS, *_NAMES]))


def sized(members: DataFrame, most: int, broadcast_groups: int = 100_000) -> DataFrame:
    """group, node and n for members (group and node): how many rows the group has if these are over `most`, else 1.

    Only groups over `most` are looked up, and they are broadcast if there are broadcast_groups at most, so that
    the rows of a large group aren't brought together to be told its size.
    """
    large = cut(members.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > most))
    large = F.broadcast(large) if large.count() <= broadcast_groups else large
    return members.join(large, "group", "left").select("group", "node", F.coalesce("n", F.lit(1)).alias("n"))


def in_blocks(members: DataFrame, most: int, buckets: int) -> DataFrame:
    """members (group, node and further columns, n: how many rows the group has, or any number up to `most` if it has no more) as rows of bucket, block and those columns.

    A group of at most `most` rows is one block, and blocks are gathered in buckets by hash, each for one task. A larger group
    is cut into parts of about most / 2 rows, and every two parts (and each alone) are a block and a bucket of their own: all
    pairs of the group meet in one, no task holds more than `most` rows or so, and a row is repeated once per part.
    """
    parts = F.ceil(F.col("n") / F.lit(most / 2)).cast("int")
    part = F.pmod(F.xxhash64(F.lit(3), "node"), parts).cast("int")
    small = members.where(F.col("n") <= most).select(F.pmod(F.xxhash64("group"), F.lit(buckets)).alias("bucket"), F.col("group").alias("block"), *(c for c in members.columns if c not in ("group", "n")))
    large = members.where(F.col("n") > most).withColumn("_p", part).withColumn("_q", F.explode(F.sequence(F.lit(0), parts - 1)))
    key = F.xxhash64("group", F.least("_p", "_q"), F.greatest("_p", "_q"))
    return small.unionAll(large.select(key.alias("bucket"), key.alias("block"), *(c for c in members.columns if c not in ("group", "n"))))


def by_block(group: pa.Table) -> Iterator[np.ndarray]:
    """Positions of the rows of each block of a bucket that has several rows, in order of node."""
    name, node = group.column("block").to_numpy(), group.column("node").to_numpy()
    order = np.lexsort((node, name))
    borders = np.flatnonzero(np.diff(name[order])) + 1
    first, end = np.append(0, borders), np.append(borders, len(name))
    for k in np.flatnonzero(end - first > 1):
        yield order[first[k] : end[k]]


def proposals(points: DataFrame, n: int, most: int) -> DataFrame:
    """part, node, other: points (node, f0.., s0..; n rows) that are within PROPOSED bits of another in a shard, by shard and component.

    part is a number for the component's set of nodes, so components that are found in several shards come once. other is
    another node of the component that ties the node to it, null for its first.
    """
    each = points.select("node", *_FIELDS, F.explode(F.array(*(F.when(F.col(s).isNotNull(), F.xxhash64(F.lit(k), s)) for k, s in enumerate(_NAMES)))).alias("group")).where("group IS NOT NULL")
    shared = each.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    blocks = in_blocks(each.join(shared, "group"), most, max(1, n * SHARDS // 16_384))

    def search(group: pa.Table) -> pa.Table:
        import xxhash

        out: list[list] = [[], [], []]
        node, f = group.column("node").to_numpy(), _columns(group, _FIELDS)
        for at in by_block(group):
            root = linked(f[at], PROPOSED)
            order = np.argsort(root, kind="stable")
            for members in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
                if len(members) > 1:
                    nodes = node[at[members]]
                    out[0] += [xxhash.xxh3_64_intdigest(nodes.tobytes()) - (1 << 63)] * len(nodes)
                    out[1] += nodes.tolist()
                    out[2] += [None, *nodes[above(len(nodes))].tolist()]
        return pa.table([pa.array(x, pa.int64()) for x in out], ["part", "node", "other"])

    return cut(blocks.groupBy("bucket").applyInArrow(search, "part long, node long, other long").distinct())


class Sets:
    """Exact similarity of sets of hashes, given as one array after another."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        names, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = times[code] > 1  # a hash of one set only is in no intersection
        self.code = code[common]
        owner = np.repeat(np.arange(len(sets)), self.size)[common]
        self.at = np.searchsorted(owner, np.arange(len(sets) + 1))
        self.mark = np.zeros(len(names), dtype=bool)

    def alike(self, one: int, others: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
        """Which of the others have a Jaccard similarity of JACCARD or more with one."""
        part, whole = JACCARD
        own, n, size = self.code[self.at[one] : self.at[one + 1]], self.size[one], self.size[others]
        out = whole * np.minimum(n, size) >= part * np.maximum(n, size)
        self.mark[own] = True
        picked = np.flatnonzero(out)
        counts = self.at[others[picked] + 1] - self.at[others[picked]]
        ends = np.cumsum(counts)
        first = 0
        while first < len(picked):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + at_once, "right")))
            c = counts[first:last]
            begin = np.cumsum(c) - c
            index = np.arange(c.sum()) + np.repeat(self.at[others[picked[first:last]]] - begin, c)
            hit = np.concatenate([[0], np.cumsum(self.mark[self.code[index]])])
            both = hit[begin + c] - hit[begin]
            out[picked[first:last]] = (both > 0) & (whole * both >= part * (n + size[picked[first:last]] - both))
            first = last
        self.mark[own] = False
        return out


def confirmed(found: DataFrame, points: DataFrame, docs: DataFrame, n: int, most: int, repeated: bool) -> DataFrame:
    """Edges a, b that join all nodes that proposals (part, node, other) bring together and whose similarity is JACCARD or more.

    repeated: docs has rows that repeat doc_id and text. Parts that share nodes are taken together if they have at most `most` nodes in all, so each text's shingles are sent once;
    larger ones are taken part by part.
    """
    whole = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    whole = cut(sized(whole.select(F.col("root").alias("group"), "node"), most))
    apart = found.join(whole.where(F.col("n") > most).select("node"), "node", "left_semi").select(F.col("part").alias("group"), "node")
    blocks = in_blocks(whole.where(F.col("n") <= most).unionAll(sized(apart, most)), most, max(1, n // 1024))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.unique(shingle_hashes(t.as_py() or b"", SHINGLE)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.binary()), *b.columns[2:]], ["node", "h", *_FIELDS])

    def test(group: pa.Table) -> pa.Table:
        out: list[list] = [[], []]
        node, f, h = group.column("node").to_numpy(), _columns(group, _FIELDS), group.column("h").to_pylist()
        for at in by_block(group):
            known = Sets([np.frombuffer(h[k], dtype="<u8") for k in at])
            a, b = branches(linked(f[at], PROPOSED, known.alike))
            out[0] += node[at[a]].tolist()
            out[1] += node[at[b]].tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    own = points.join(whole.select("node"), "node", "left_semi").select("node", F.col("first.doc_id").alias("_id"), F.col("first._rk").alias("_own"), *_FIELDS)
    texts = _texts(docs).join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_rk") == F.col("_own")))
    texts = texts.select("node", "text", *_FIELDS)
    held = (texts.dropDuplicates(["node"]) if repeated else texts).mapInArrow(sets, "node long, h binary, " + ", ".join(f"{f} long" for f in _FIELDS))
    return blocks.join(held, "node").groupBy("bucket").applyInArrow(test, "a long, b long")


def keep_one_of_each(docs: DataFrame, most: int = 1024) -> DataFrame:
    """The rows of docs without near copies: of each group the document with the smallest doc_id stays, with all its columns.

    Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; groups are what such
    pairs reach. Texts that share a shard (see SHARDS) and differ in at most PROPOSED bits of their fingerprints are
    proposed, and every pair proposed is confirmed by its shingles, so nothing goes that has no near copy; what is lost
    of pairs at 0.8 is 0.1 % by the shards and as much by the bits. most: texts that a task compares at once; larger
    groups are compared in blocks. A null or empty text is one text like any other. Rows that repeat doc_id and text are one
    document, of which one row stays. A null doc_id comes after all others; a doc_id with several texts has
    several documents. Ids may be of any type that has an order.
    """
    prints = cut(shingle_points(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rk"))
    points = cut(prints.groupBy("node", *_FIELDS, *_NAMES).agg(first.alias("first")))
    n = points.count()
    repeated = not prints.groupBy("doc_id", "_rk").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    sure = confirmed(proposals(points, n, most), points, docs, n, most, repeated)
    root = components(sure)
    grouped = points.select("node", "first").join(root, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    i, k, ki, kk = unused(docs, "_zw_i", "_zw_k", "_zw_ki", "_zw_kk")
    kept = cut(grouped.select(F.col("first.doc_id").alias(ki), F.col("first._rk").alias(kk)))
    keyed = docs.withColumn(i, F.col("doc_id")).withColumn(k, row_key("text"))
    out = keyed.join(kept, F.col(i).eqNullSafe(F.col(ki)) & (F.col(k) == F.col(kk)), "left_semi")
    return (out.dropDuplicates([i, k]) if repeated else out).drop(i, k)
