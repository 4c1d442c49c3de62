"""Tables in versions behind a pointer: a reader sees the version that the pointer names, whole, whatever happened to a writer.

A version is a folder of its own. It is written first; then the pointer file is written beside the old one and takes its place by one
rename. A writer that stops at any step leaves the version before readable, and the next writer of the same version begins anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import overlay

_POINTER = "CURRENT"


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, folder: str) -> int | None:
    """The version that is in place, None before the first."""
    jvm, at, fs = _store(spark, f"{folder}/{_POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return int(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip())
    finally:
        stream.close()


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    version = current(spark, folder)
    return None if version is None else spark.read.parquet(f"{folder}/version={version}")


def publish(df: DataFrame, folder: str, version: int | None = None, keep: int = 2) -> int:
    """Put df in place as `version` (by default the next one); it may read the version before. Of older versions the last `keep` stay, for readers that have begun."""
    spark = df.sparkSession
    before = current(spark, folder)
    version = (-1 if before is None else before) + 1 if version is None else version
    df.write.mode("overwrite").parquet(f"{folder}/version={version}")
    _swap(spark, folder, version)
    _, at, fs = _store(spark, folder)
    old = sorted(n for n in (int(s.getPath().getName()[8:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("version=")) if n < version)
    for n in old[: max(0, len(old) - keep)]:
        fs.delete(_store(spark, f"{folder}/version={n}")[1], True)
    return version


def _swap(spark: SparkSession, folder: str, version: int) -> None:
    jvm, beside, fs = _store(spark, f"{folder}/.{_POINTER}-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(str(version).encode()))
    out.close()
    hadoop = jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(beside.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, hadoop.Path(f"{folder}/{_POINTER}"), overwrite)


def refresh(spark: SparkSession, folder: str, fetch: Callable[[], DataFrame | None]) -> str:
    """Publish what fetch returns: "fresh". If it fails or has no rows the last good version stays: "kept", or "none" before the first. A failure to write is an error, and keeps it too."""
    try:
        got = fetch()
        empty = got is None or got.isEmpty()
    except Exception:  # whatever a source raises, what is there is better than nothing
        empty = True
    if empty:
        return "none" if current(spark, folder) is None else "kept"
    publish(got, folder)
    return "fresh"


def revisions_sink(folder: str, key: str, revised: str, frozen_before: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that merges late revisions into the snapshot of `folder`: per key the last one by `revised` replaces what is stored; keys before frozen_before that are stored stay.

    Version k + 1 is the snapshot with batch k in it (version 0, if there is one, is what was stored before), so a batch that is run again after its version is in place changes nothing, and
    one that was stopped before is merged into the version it had begun from. Rows of the snapshot: key, revised and the other columns of the stream.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = current(spark, folder)
        if version is not None and version > number:
            return
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(revised, *(c for c in batch.columns if c not in (key, revised)))).alias("r")).select("r.*")
        stored = read(spark, folder)
        if stored is not None:
            # a revision older than what is stored is none
            known = stored.select(F.col(key).alias("_k"), F.col(revised).alias("_r"))
            last = last.join(known, F.col(key) == F.col("_k"), "left").where(F.col("_r").isNull() | (F.col(revised) >= F.col("_r"))).drop("_k", "_r")
            last = overlay(stored.select(*batch.columns), last, key, frozen_before)
        publish(last, folder, number + 1)

    return merge
