"""Operator 8: token counts per document from flat token files without an index.

A token file is a run of little-endian 16- or 32-bit ids in which an end-of-document id follows each document. Files
are read in blocks of fixed size, each by a task of its own; the search for separators in a block is one vectorised
comparison. A document may begin blocks before it ends, so each block reports its number of separators and the place
of its last one, and an exclusive prefix scan over blocks (sum and maximum, over runs of blocks first) gives every
block the number of documents before it and the place where its first document began.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, id_type, open_store, remove, shared_dir
from .tokens import encoder

_RUN = 1024  # blocks per run of the prefix scan
_PER_TASK = 4  # blocks that a task reads one after another


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2) -> DataFrame:
    """Write docs as token files into a shared folder, one per task; returns doc_id, file and ordinal in the file.

    A null text has no tokens. Special tokens' strings in a text are ordinary text, so end_id only ends documents. A task
    writes under a name of its attempt and renames it, so a task that is run again or twice leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out = TaskContext.get(), None
        fs, top = open_store(folder)
        name, n = f"tokens-{context.partitionId():06d}.bin", 0
        held, end = f"{top}/.{name}.{context.taskAttemptId()}", np.array([end_id], dtype=f"<u{width}").tobytes()
        enc = encoder(tokenizer, ordinary=True, width=width)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(held)
                out.write(end.join([*enc.encode(part.column(1).to_pylist()), b""]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([name] * part.num_rows), pa.array(np.arange(n, n + part.num_rows))], ["doc_id", "file", "ordinal"])
                n += part.num_rows
        if out is not None:
            out.close()
            fs.move(held, f"{top}/{name}")

    return cut(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {id_type(docs)}, file string, ordinal long"))


def count_tokens(spark: SparkSession, folder: str, end_id: int, width: int = 2, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document of the files in folder (*.bin): file, ordinal, start (its first token's place) and n_tokens.

    Empty documents count 0. Ids after a file's last separator are a document of their own, with ended false; a file without
    ids has no document. A folder without files gives no rows. A partial id at a file's end is an error.
    """
    fs, top = open_store(folder)
    files = [(f.base_name, f.size) for f in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)) if f.base_name.endswith(".bin") and not f.base_name.startswith(".")]
    for name, size in files:
        if size % width:
            raise ValueError(f"{name}: {size} bytes are no whole number of {8 * width}-bit ids")
    span = max(1, block_bytes // width)
    listed = spark.createDataFrame([(n, s // width) for n, s in files if s], "file string, size long")
    blocks = listed.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / span))).alias("block"))
    n_blocks = sum(-(-s // (width * span)) for _, s in files)
    blocks = blocks.repartition(max(1, -(-n_blocks // _PER_TASK)), "file", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_store(folder)
        for b in batches:
            for r in b.to_pylist():
                first = r["block"] * span
                with fs.open_input_file(f"{top}/{r['file']}") as f:
                    ids = np.frombuffer(f.read_at(min(span, r["size"] - first) * width, first * width), dtype=f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + first
                last = first + len(ids) == r["size"]
                tail = bool(last and (not len(ends) or ends[-1] != r["size"] - 1))
                if tail:
                    ends = np.append(ends, r["size"])  # as if a separator followed
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]]), pa.array([r["block"]]), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else -1], pa.int64()), pa.array([tail]), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "n", "last", "tail", "ends"])

    found = cut(blocks.mapInArrow(scan, "file string, block long, n long, last long, tail boolean, ends array<long>"))
    each = found.select("file", "block", F.floor(F.col("block") / _RUN).alias("run"), "n", "last")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = each.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    w = before("file", "run")
    runs = runs.select("file", "run", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("run_n"), F.coalesce(F.max("last").over(w), F.lit(-1)).alias("run_last"))
    w = before("file", "run", "block")
    inner = each.select("file", "run", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("in_n"), F.coalesce(F.max("last").over(w), F.lit(-1)).alias("in_last"))
    carried = inner.join(runs, ["file", "run"]).select("file", "block", (F.col("run_n") + F.col("in_n")).alias("base"), F.greatest("run_last", "in_last").alias("carry"))
    joined = found.where("n > 0").join(carried, ["file", "block"])
    start = lambda i: F.when(i == 0, F.col("carry")).otherwise(F.get(F.col("ends"), i - 1)) + 1
    docs = F.transform("ends", lambda e, i: F.struct((F.col("base") + i).alias("ordinal"), start(i).alias("start"), (e - start(i)).alias("n_tokens"), (~(F.col("tail") & (i == F.size("ends") - 1))).alias("ended")))
    return joined.select("file", F.inline(docs))


def document_token_counts(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2, block_bytes: int = 8 << 20, folder: str | None = None) -> DataFrame:
    """Each row of docs with doc_id, n_tokens, and the file, ordinal and start where its tokens are.

    docs: doc_id (of any type) and text; other columns are ignored. The token files are written to `folder` and stay there; without
    one they go to the session's shared folder and are removed once counted. A null or empty text has 0 tokens; repeated
    rows and null ids are counted each for itself. An empty table gives no rows.
    """
    spark = docs.sparkSession
    there = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    order = write_token_files(docs, there, tokenizer, end_id, width)
    counts = count_tokens(spark, there, end_id, width, block_bytes)
    if folder is None:
        remove(there)
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
