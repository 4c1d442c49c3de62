"""Operator 9: sharding by vector bin packing over bytes, tokens and rows.

Documents with equal text form a group and groups are placed one by one: in falling order of their largest share, each
goes where the dot product of its vector with the residual capacity is highest. Groups that are large against a shard
are few; they are placed on the driver, and one that is larger still is split into pieces of its rows. All other groups are
dealt by hash to tasks. Every task places its groups by the rule into as many bins as there are shards, of which each may
hold its share of the task's groups; the tasks' bins, whose number depends on the number of groups by a factor of
thousands less, are then placed like groups, together with the large ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused

DIMENSIONS = ("size", "tokens", "rows")


def place_units(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit (rows: units, columns: dimensions). Ties: the lowest shard, the first unit."""
    total = np.maximum(vectors.sum(axis=0, dtype=float), 1)
    share = vectors / total * shards
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    for k in np.argsort(-share.max(axis=1), kind="stable"):
        out[k] = s = int((left @ share[k]).argmax())
        left[s] -= share[k]
    return out


def task_bins(groups: DataFrame, shards: int) -> DataFrame:
    """Groups (ga, gb, s, t, c) with the bin that their task placed them in: the task's number times shards, plus the bin in it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([("ga", "ascending"), ("gb", "ascending")])  # the result must not depend on the order of arrival
        bins = place_units(np.stack([table.column(c).to_numpy() for c in "stc"], axis=1), shards) + TaskContext.get().partitionId() * shards
        yield from table.append_column("bin", pa.array(bins)).to_batches(max_chunksize=10_000)

    return groups.mapInArrow(place, "ga long, gb long, s long, t long, c long, bin long")


def shard_documents(docs: DataFrame, shards: int = 16, units_per_shard: int = 256, split_above: float = 0.125, pieces_per_shard: int = 64, groups_per_task: int = 65_536, slot_rows: int = 2000) -> DataFrame:
    """Each row of docs with its place: doc_id, size, tokens, text_crc32, group (of equal texts), shard, slot.

    docs: doc_id (of any type) and text; other columns are ignored. size is the text's UTF-8 bytes plus 1, tokens its words. A null
    text counts as empty. A group with more than 1 / units_per_shard of a shard is placed by itself; one with more
    than split_above of a shard is split by its rows into pieces of about 1 / pieces_per_shard, so it is no longer together, and
    it is the only one that is not. Sizes are near equal; token and row counts follow as far as the groups allow. Slots count
    from 0 in each shard, by a hash of doc_id and the row's place in the table, so that one id of many rows is ordered by many tasks; rows that repeat get slots of their own. A null doc_id is an
    id like any other. An empty table gives no rows.
    The driver gets fewer than 3 * shards * units_per_shard large groups with their pieces, and one row per bin of a task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("ga"),
        F.xxhash64(F.lit(1), text).alias("gb"),
        F.monotonically_increasing_id().alias("at"),
    )
    rows = cut(rows)
    groups = cut(rows.groupBy("ga", "gb").agg(F.sum("size").alias("s"), F.sum("tokens").alias("t"), F.count("*").alias("c")))
    total = groups.agg(F.count("*"), F.sum("s"), F.sum("t"), F.sum("c")).first()
    n, caps = total[3] or 0, [max(x or 0, 1) / shards for x in total[1:]]
    groups = groups.withColumn("share", F.greatest(*(F.col(x) / F.lit(c) for x, c in zip("stc", caps, strict=True))))
    # shares sum to len(DIMENSIONS) * shards, so these are fewer than that times units_per_shard
    pieces = F.when(F.col("share") > split_above, F.ceil(F.col("share") * pieces_per_shard)).otherwise(1)
    large = F.broadcast(groups.where(F.col("share") > 1 / units_per_shard).select("ga", "gb", pieces.cast("long").alias("pieces")))
    tasks = max(shards, -(-total[0] // groups_per_task))
    small = cut(task_bins(groups.where(F.col("share") <= 1 / units_per_shard).drop("share").repartition(tasks, "ga", "gb"), shards))
    parted = rows.join(large, ["ga", "gb"]).withColumn("piece", F.pmod(F.xxhash64("doc_id", "at"), F.col("pieces")))
    units = [tuple(r) for r in parted.groupBy("ga", "gb", "piece").agg(F.sum("size"), F.sum("tokens"), F.count("*")).orderBy("ga", "gb", "piece").collect()]
    bins = [tuple(r) for r in small.groupBy("bin").agg(F.sum("s"), F.sum("t"), F.sum("c")).orderBy("bin").collect()]
    placed = place_units(np.array([u[-3:] for u in units + bins], dtype=np.int64).reshape(-1, 3), shards).tolist()
    spark = rows.sparkSession
    of_unit = spark.createDataFrame([(*u[:3], s) for u, s in zip(units, placed, strict=False)], "ga long, gb long, piece long, shard int")
    of_bin = spark.createDataFrame([(b[0], s) for b, s in zip(bins, placed[len(units) :], strict=True)], "bin long, shard int")
    fields = ["doc_id", "size", "tokens", "text_crc32", F.col("ga").alias("group"), "shard", "at"]
    alone = parted.join(F.broadcast(of_unit), ["ga", "gb", "piece"]).select(*fields)
    rest = rows.join(small.select("ga", "gb", "bin"), ["ga", "gb"]).join(F.broadcast(of_bin), "bin").select(*fields)
    out = alone.unionAll(rest).withColumn("_b", F.pmod(F.xxhash64("doc_id", "at"), F.lit(max(1, -(-n // (shards * slot_rows))))))
    counts = out.groupBy("shard", "_b").agg(F.count("*").alias("_c"))
    base = counts.select("shard", "_b", (F.sum("_c").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_c")).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("doc_id", "text_crc32", "size", "at"))
    return out.withColumn("_r", rank - 1).join(base, ["shard", "_b"]).select("doc_id", "size", "tokens", "text_crc32", "group", "shard", (F.col("_base") + F.col("_r")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The documents themselves as Parquet, one folder per shard, with all their columns and slot. docs needs unique ids; Spark parts large shards into files."""
    i, shard, slot = unused(docs, "_zw_id", "shard", "slot")
    where = placed.select(F.col("doc_id").alias(i), F.col("shard").alias(shard), F.col("slot").alias(slot))
    docs.join(where, docs["doc_id"].eqNullSafe(F.col(i))).drop(i).write.partitionBy(shard).parquet(path)
