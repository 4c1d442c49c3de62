"""What the corpus operators share: reading tables, cutting lineage, row keys."""

from __future__ import annotations

import tempfile

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Spark reads it, so the folder can be in any store that Spark reaches."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Where that is unset, a temporary folder is made once and set on the context if driver and executors are one process
    (a local master, as in tests); on a cluster it is an error, since no folder of the driver's is seen by executors.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors see")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="zonewright-"))
    return spark.sparkContext.getCheckpointDir()


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it: a plain path is local, else its scheme says which."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def remove(folder: str) -> None:
    """Delete a folder that this run has written, if it is there."""
    fs, path = open_store(folder)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there: it is computed once, also if executors are lost later."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(*cols: str) -> Column:
    """64 bits that tell rows of one doc_id apart by the columns given; use it beside doc_id, never alone."""
    return F.xxhash64(*cols)


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of doc_id as text, modulo folds; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def id_type(docs: DataFrame) -> str:
    """The SQL type of doc_id: ids of any type that Spark can compare are kept as they are."""
    return docs.schema["doc_id"].dataType.simpleString()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
