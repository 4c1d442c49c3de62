import zlib
from collections import Counter, defaultdict

import numpy as np

from zonewright.llm import sharding

from .helpers import awkward, empty, frame, prose


def test_shards(spark):
    texts = [x for x in awkward() if x[0] != 9] + [(1000 + k, prose(k, 20 + k * 31 % 400)) for k in range(800)] + [(5000 + k, prose(7, 100)) for k in range(400)]
    got = sharding.shard_documents(frame(spark, texts), slot_rows=10).collect()
    want = Counter((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    slots, size, n = defaultdict(list), Counter(), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        n[r.shard] += 1
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, rows = sum(size.values()) / 16, sum(n.values()) / 16
    assert all(abs(v - mean) < 0.02 * mean for v in size.values()) and all(abs(v - rows) < 0.1 * rows for v in n.values())


def test_groups_stay_together(spark):
    texts = [(k, prose(k // 3, 60)) for k in range(1500)]
    got = sharding.shard_documents(frame(spark, texts)).collect()
    where = defaultdict(set)
    for r in got:
        where[r.group].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_dot_product_rule():
    # the first unit goes to shard 0; the second finds more room for its bytes in shard 1
    assert sharding.place_units(np.array([[10, 1, 1], [9, 1, 1]]), 2).tolist() == [0, 1]
    placed = sharding.place_units(np.random.default_rng(0).integers(1, 1000, (4000, 3)), 16)
    sums = np.array([np.random.default_rng(0).integers(1, 1000, (4000, 3))[placed == s].sum(0) for s in range(16)])
    assert (np.abs(sums / sums.mean(0) - 1) < 0.01).all()


def test_empty(spark):
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_hot_group_of_one_id_is_split(spark):
    texts = [(7, prose(7, 100))] * 3000 + [(10 + k, prose(k, 20 + k % 300)) for k in range(1500)] + [(9, prose(99, 3000))]
    got = sharding.shard_documents(frame(spark, texts), groups_per_task=100).collect()
    size, n, slots = Counter(), Counter(), defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        n[r.shard] += 1
        slots[r.shard].add(r.slot)
    assert len(got) == len(texts) and all(slots[s] == set(range(n[s])) for s in range(16))
    assert all(abs(v / (sum(size.values()) / 16) - 1) < 0.02 for v in size.values())
    assert all(abs(v / (len(texts) / 16) - 1) < 0.15 for v in n.values())
    where = defaultdict(set)
    for r in got:
        where[r.group].add(r.shard)
    assert sorted(map(len, where.values()))[-2] == 1 and max(map(len, where.values())) > 4


def test_places_do_not_depend_on_the_order_of_rows(spark):
    texts = [(k, prose(k // 2, 30 + k % 200)) for k in range(600)]
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(df, groups_per_task=20).collect())
    assert key(frame(spark, texts, parts=2)) == key(frame(spark, texts[::-1], parts=7))


def test_one_id_of_many_rows(spark):
    """Slots stay gapless, and no task orders more than a few times slot_rows of them."""
    from pyspark.sql import functions as F

    df = spark.range(100_000, numPartitions=6).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 5000).alias("text"))
    got = sharding.shard_documents(df, slot_rows=500)
    per = got.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("z"), F.count_distinct("slot").alias("d")).collect()
    assert len(per) == 16 and all((r.a, r.z, r.d) == (0, r.n - 1, r.n) for r in per) and sum(r.n for r in per) == 100_000
    by = got.groupBy("shard", F.floor(F.col("slot") / 500)).count()
    assert by.count() > 16 * 10
