"""Operator 11: token ids as binary files, each document compressed for itself with one shared zstandard dictionary.

An archive is a folder: one dictionary, trained on serialised id arrays, and files in the order of doc_id. A file is

    header   magic, bytes per id, SHA-256 of the dictionary
    frames   one zstandard frame per document, in order
    index    zstandard-compressed Arrow stream: doc_id, offset, size (of the frame), n_tokens
    footer   place and size of the index, documents, ids, magic

so a reader finds a document by the index and decompresses its frame alone; what short documents have in common is in the
dictionary. Ids are little-endian, in 2 bytes if the vocabulary allows it, else 4. A reader that has another dictionary
than the file was written with stops with an error.

Documents are encoded and compressed once and their frames kept in the shared folder, then dealt to files by ranges of doc_id; rows that share a doc_id are told apart by
their ids' number and checksum and by where they were encoded, so a doc_id of many rows fills several files. Files get their places by a sum over
files before them, over runs of files first.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, id_type, open_store, remove, shared_dir
from .tokens import encoder

_MAGIC = b"ZWIDARC1"
_HEADER, _FOOTER = "<8sI32s", "<QQQQ8s"
_HEADER_BYTES, _FOOTER_BYTES = struct.calcsize(_HEADER), struct.calcsize(_FOOTER)
_RUN = 1024  # files per run of the prefix scan
_CHUNK = 8 << 20  # bytes of frames that a reader holds at once, if no document is larger


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes per id that hold every id of the tokenizer and end_id."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4


def encoded(docs: DataFrame, tokenizer: str, end_id: int, width: int, dictionary: bytes, level: int) -> DataFrame:
    """One row per document: doc_id, frame (of its ids and end_id), n_tokens, crc (of the ids in 4 bytes each), and the task and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, task, n = encoder(tokenizer, width=width), np.array([end_id], dtype=f"<u{width}").tobytes(), TaskContext.get().partitionId(), 0
        shrink = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_checksum=True)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = [x + end for x in enc.encode(part.column(1).to_pylist())]
                columns = [
                    pa.array(map(shrink.compress, ids), pa.binary()),
                    pa.array([len(x) // width for x in ids], pa.int64()),
                    pa.array([zlib.crc32(wide(x, width)) for x in ids], pa.int64()),
                    pa.array([task] * len(ids), pa.int32()),
                    pa.array(range(n, n + len(ids)), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "frame", "n_tokens", "crc", "task", "place"])
                n += len(ids)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {id_type(docs)}, frame binary, n_tokens long, crc long, task int, place long")


def wide(ids: bytes, width: int) -> bytes:
    """Serialised ids in 4 bytes each."""
    return ids if width == 4 else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, size: int = 64 << 10, documents: int = 4096, slice_bytes: int = 4096) -> bytes:
    """A zstandard dictionary of at most `size` bytes from the serialised ids of about `documents` rows, slice_bytes of each at most.

    A row is in the sample if a hash of its place in the table is in the share that `documents` is of all rows, so tens of megabytes
    at most reach the driver, whatever the corpus. Of a longer row the slice begins where the hash says. Too few samples to train on are used as they are, as the content of the dictionary.
    """
    rows, h = docs.count(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40))
    sample = docs.select(h.alias("h"), F.col("text").cast("string").alias("text")).where(F.col("h") * max(rows, documents) < documents * (1 << 40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, width=width), np.array([end_id], dtype=f"<u{width}").tobytes()
        for b in batches:
            out = []
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.encode([text])[0] + end
                first = h % max(1, (len(ids) - slice_bytes) // width + 1) * width
                out.append(ids[first : first + slice_bytes])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["h", "ids"])

    samples = [bytes(r.ids) for r in sorted(sample.mapInArrow(run, "h long, ids binary").collect())]
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    """None for no content: frames are then plain."""
    trained = data[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT) if data else None


def _open_dictionary(fs: pafs.FileSystem, top: str, sha: bytes) -> zstandard.ZstdCompressionDict | None:
    with fs.open_input_file(f"{top}/dictionary-{sha.hex()}.zdict") as f:
        data = f.read()
    if hashlib.sha256(data).digest() != sha:
        raise ValueError(f"{top}: the dictionary is not the one that its name tells")
    return _dictionary(data)


def write_archive(docs: DataFrame, folder: str, tokenizer: str, end_id: int, level: int = 3, file_bytes: int = 256 << 20) -> DataFrame:
    """Write docs as an archive into a shared folder, in ascending doc_id order (nulls first); returns a row per file.

    docs: doc_id (of any type with an order) and text; other columns are ignored. A null text is an empty one. Rows of one
    doc_id come in the order of their number of ids and checksum. No files are written for an empty table. A task writes under a name of its attempt and renames the
    file when it is whole, so a task that is run again leaves one file. file_bytes bounds a file's ids before compression, about.
    """
    spark = docs.sparkSession
    width = id_width(tokenizer, end_id)
    data = train_dictionary(docs, tokenizer, end_id, width)
    sha = hashlib.sha256(data).digest()
    fs, top = open_store(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/dictionary-{sha.hex()}.zdict") as f:
        f.write(data)
    frames = cut(encoded(docs, tokenizer, end_id, width, data, level))
    total = width * (frames.agg(F.sum("n_tokens")).first()[0] or 0)
    n_files = max(1, -(-total // file_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 << 20))))
    keys = ["doc_id", "n_tokens", "crc", "task", "place"]
    ordered = frames.repartitionByRange(n_files, *keys).sortWithinPartitions(*keys).select("doc_id", "frame", "n_tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out = TaskContext.get(), None
        fs, top = open_store(folder)
        name = f"ids-{context.partitionId():08d}.bin"
        held = f"{top}/.{name}.{context.taskAttemptId()}"
        index, at, n_docs, n_ids = [], _HEADER_BYTES, 0, 0
        for b in batches:
            if out is None:
                out = fs.open_output_stream(held)
                out.write(struct.pack(_HEADER, _MAGIC, width, sha))
            for x in b.column(1):
                out.write(x.as_buffer())
            sizes = pc.binary_length(b.column(1)).to_numpy().astype(np.int64)
            ends = at + np.cumsum(sizes)
            index.append(pa.RecordBatch.from_arrays([b.column(0), pa.array(ends - sizes), pa.array(sizes), b.column(2)], ["doc_id", "offset", "size", "n_tokens"]))
            at, n_docs, n_ids = int(ends[-1]), n_docs + b.num_rows, n_ids + pc.sum(b.column(2)).as_py()
        if out is not None:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, index[0].schema) as w:
                for x in index:
                    w.write_batch(x)
            packed = zstandard.ZstdCompressor(level=level).compress(sink.getvalue())
            out.write(packed)
            out.write(struct.pack(_FOOTER, at, len(packed), n_docs, n_ids, _MAGIC))
            out.close()
            fs.move(held, f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n_docs]), pa.array([n_ids]), pa.array([at + len(packed) + _FOOTER_BYTES])], ["file", "n_docs", "n_tokens", "bytes"])

    return cut(ordered.mapInArrow(write, "file string, n_docs long, n_tokens long, bytes long"))


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of an archive, from their footers: file, n_docs, n_tokens, start (ids of all files before it)."""
    fs, top = open_store(folder)
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)) if f.base_name.endswith(".bin") and not f.base_name.startswith("."))
    listed = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "file string, k long").repartition(max(1, min(len(names), 1024)), "k")

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_store(folder)
        for b in batches:
            found = []
            for name in b.column(0).to_pylist():
                with fs.open_input_file(f"{top}/{name}") as f:
                    found.append(_footer(f, name)[2:4])
            n_docs, n_ids = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_docs, pa.int64()), pa.array(n_ids, pa.int64())], ["file", "k", "n_docs", "n_tokens"])

    each = cut(listed.mapInArrow(footers, "file string, k long, n_docs long, n_tokens long").withColumn("run", F.floor(F.col("k") / _RUN)))
    runs = each.groupBy("run").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row per 1,024 files
    runs = runs.select("run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("run").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return each.join(runs, "run").select("file", "n_docs", "n_tokens", (F.col("_base") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).alias("start"))


def _footer(f: pa.NativeFile, name: str) -> tuple[int, int, int, int]:
    size = f.size()
    if size < _HEADER_BYTES + _FOOTER_BYTES:
        raise ValueError(f"{name}: too short for an archive file")
    at, packed, n_docs, n_ids, magic = struct.unpack(_FOOTER, f.read_at(_FOOTER_BYTES, size - _FOOTER_BYTES))
    if magic != _MAGIC or at + packed + _FOOTER_BYTES != size:
        raise ValueError(f"{name}: not a whole archive file")
    return at, packed, n_docs, n_ids


class ArchiveFile:
    """One file of an archive, open for reading: its index, and the ids of documents by their place in it."""

    def __init__(self, fs: pafs.FileSystem, top: str, name: str, dictionaries: dict[bytes, zstandard.ZstdDecompressor]):
        self.file = fs.open_input_file(f"{top}/{name}")
        magic, self.width, sha = struct.unpack(_HEADER, self.file.read_at(_HEADER_BYTES, 0))
        if magic != _MAGIC:
            raise ValueError(f"{name}: not an archive file")
        if sha not in dictionaries:
            dictionaries[sha] = zstandard.ZstdDecompressor(dict_data=_open_dictionary(fs, top, sha))
        self._grow = dictionaries[sha]
        self._at, self._packed, *_ = _footer(self.file, name)

    def index(self) -> pa.Table:
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self.file.read_at(self._packed, self._at))).read_all()

    def ids(self, offset: int, size: int) -> bytes:
        """The serialised ids of the document whose frame is there."""
        return self._grow.decompress(self.file.read_at(size, offset))

    def stretches(self, index: pa.Table) -> Iterator[tuple[int, list[bytes]]]:
        """Serialised ids of consecutive documents of the index, in stretches of about _CHUNK bytes of frames: the first one's place, and the ids."""
        offset, size = index.column("offset").to_numpy(), index.column("size").to_numpy()
        k = 0
        while k < len(offset):
            end = max(k + 1, int(np.searchsorted(offset + size, offset[k] + _CHUNK, side="right")))
            raw = memoryview(self.file.read_at(int(offset[end - 1] + size[end - 1] - offset[k]), int(offset[k])))
            yield k, [self._grow.decompress(raw[int(o - offset[k]) : int(o - offset[k] + s)]) for o, s in zip(offset[k:end], size[k:end], strict=True)]
            k = end


def read_archive(spark: SparkSession, folder: str, id_schema: str = "bigint", with_ids: bool = False) -> DataFrame:
    """One row per document of the archive: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids in 4 bytes each), file and
    ordinal in it; with_ids adds the serialised ids. id_schema: the SQL type of doc_id. An empty archive gives no rows."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "file", "ordinal", *(["ids"] if with_ids else [])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_store(folder)
        dictionaries: dict[bytes, zstandard.ZstdDecompressor] = {}
        for b in batches:
            for r in b.to_pylist():
                f = ArchiveFile(fs, top, r["file"], dictionaries)
                index, start = f.index(), r["start"]
                for k, ids in f.stretches(index):
                    for j in range(0, len(ids), 4096):
                        part = ids[j : j + 4096]
                        counts = np.array([len(x) // f.width for x in part], dtype=np.int64)
                        if not np.array_equal(counts, index.column("n_tokens").slice(k + j, len(part)).to_numpy()):
                            raise ValueError(f"{r['file']}: a document has another number of ids than its index")
                        ends = start + np.cumsum(counts)
                        columns = [
                            index.column("doc_id").slice(k + j, len(part)).combine_chunks(),
                            pa.array(ends - counts),
                            pa.array(counts),
                            pa.array([zlib.crc32(wide(x, f.width)) for x in part], pa.int64()),
                            pa.array([r["file"]] * len(part)),
                            pa.array(range(k + j, k + j + len(part)), pa.int64()),
                        ]
                        start = int(ends[-1])
                        yield pa.RecordBatch.from_arrays([*columns, *([pa.array(part, pa.binary())] if with_ids else [])], names)
                f.file.close()

    files = archive_files(spark, folder)
    dealt = files.repartition(max(1, files.count()), "file")
    return dealt.select("file", "start").mapInArrow(read, f"doc_id {id_schema}, start long, n_tokens long, ids_crc32 long, file string, ordinal long" + ", ids binary" * with_ids)


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The ids of the wanted documents alone: doc_id, n_tokens, ids (serialised). Each file's index is read, and of the frames those asked for.

    wanted: doc_id; repeats count once, a null finds nothing. Documents that share a doc_id all come. Unknown ids give no row.
    """
    kind = id_type(wanted)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_store(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                f = ArchiveFile(fs, top, name, {})
                for x in f.index().combine_chunks().to_batches(max_chunksize=65_536):
                    yield pa.RecordBatch.from_arrays([*x.columns, pa.array([name] * x.num_rows)], ["doc_id", "offset", "size", "n_tokens", "file"])
                f.file.close()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_store(folder)
        dictionaries: dict[bytes, zstandard.ZstdDecompressor] = {}
        name, f = None, None
        for b in batches:
            for j in range(0, b.num_rows, 1024):
                part = b.slice(j, 1024)
                ids = []
                for file, offset, size in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "size")), strict=True):
                    if file != name:
                        if f is not None:
                            f.file.close()
                        name, f = file, ArchiveFile(fs, top, file, dictionaries)
                    ids.append(f.ids(offset, size))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_tokens"), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
        if f is not None:
            f.file.close()

    index = archive_files(spark, folder).select("file").mapInArrow(entries, f"doc_id {kind}, offset long, size long, n_tokens long, file string")
    hits = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return hits.sortWithinPartitions("file", "offset").select("doc_id", "offset", "size", "n_tokens", "file").mapInArrow(frames, f"doc_id {kind}, n_tokens long, ids binary")


def archived_token_counts(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write docs as an archive and read it back: the rows of read_archive. Without a folder the files go once they are read."""
    spark = docs.sparkSession
    there = folder or f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(docs, there, tokenizer, end_id)
    rows = read_archive(spark, there, id_type(docs))
    if folder is None:
        rows = cut(rows)
        remove(there)
    return rows
