"""Operator 7: language identification by prediction by partial matching (PPM) over bytes.

Per language a tree of byte contexts of up to three bytes is counted over all learned documents. A context codes the
bytes it has seen in proportion to their counts and leaves a share for escape: q of n + q, where q is the number of
different bytes seen (method C). After an escape the next shorter context codes what the longer one has not seen.
The statistics are then frozen, so the code length of a byte after a context is a constant. A text's language is the one
with the shortest code.

Bytes are those of the lower-cased text; runs of characters other than letters become one space.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, cut, id_type, open_store, remove, shared_dir

ORDER = 3
_SPACE = 32
#: Letters a-z and bytes of non-ASCII characters stay, all else is space.
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else _SPACE for b in range(256))


def symbols(text: str) -> np.ndarray:
    """The bytes to be coded: a space, then words each followed by one space. Empty if there is no word."""
    words = text.lower().encode("utf-8", "replace").translate(_FOLD).split()
    return np.frombuffer(b" ".join([b"", *words, b""]), dtype=np.uint8) if words else np.zeros(0, dtype=np.uint8)


def grams(text: str) -> np.ndarray:
    """Each coded byte with the three before it, as one 32-bit number; before the text are spaces."""
    x = symbols(text)
    if not len(x):
        return np.zeros(0, dtype=np.uint32)
    x = np.concatenate([np.full(ORDER - 1, _SPACE, dtype=np.uint8), x]).astype(np.uint32)
    return x[:-3] << np.uint32(24) | x[1:-2] << np.uint32(16) | x[2:-1] << np.uint32(8) | x[3:]


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of docs (lang, text, both not null). Each task sums its own counts before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def settle(lang: str) -> None:
            g, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            if lang in sums:
                g, where = np.unique(np.concatenate([sums[lang][0], g]), return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([sums[lang][1], n])).astype(np.int64)
            sums[lang] = g, n

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.setdefault(lang, []).append(grams(text.as_py()))
                if len(held[lang]) >= 512 or len(held[lang][-1]) > 1_000_000:
                    settle(lang)
        for lang in list(held):
            settle(lang)
        for lang, (g, n) in sums.items():
            for k in range(0, len(g), 100_000):
                part = g[k : k + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[k : k + 100_000].astype(np.int64))], ["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Sorted:
    """Numbers by 64-bit key in files of the shared folder, each a range of keys in order: all keys, then all numbers.

    A file is mapped into memory where the store is a file system, so that the workers of a machine share the pages they look at;
    from any other store it is read once per task. Only the paths travel with a task.
    """

    def __init__(self, files: list[tuple[int, str]]):
        self.files = sorted(files)
        self.first = np.array([f for f, _ in self.files], dtype=np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def __getstate__(self) -> dict:
        return {**self.__dict__, "parts": []}

    def _open(self) -> None:
        for _, path in self.files:
            fs, there = open_store(path)
            if isinstance(fs, pafs.LocalFileSystem):
                words = np.asarray(np.memmap(there, dtype="<i8", mode="r"))
            else:
                with fs.open_input_file(there) as f:
                    words = np.frombuffer(f.read(), dtype="<i8")
            half = len(words) // 2
            self.parts.append((words[:half], words[half:].view("<f8")))

    def find(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted keys are there, and the numbers of those."""
        if not self.parts:
            self._open()
        hit, value = np.zeros(len(want), dtype=bool), np.zeros(len(want))
        part = np.searchsorted(self.first, want, side="right") - 1
        for k in np.unique(part[part >= 0]):
            rows = np.flatnonzero(part == k)
            keys, numbers = self.parts[k]
            at = np.minimum(np.searchsorted(keys, want[rows]), len(keys) - 1)
            hit[rows] = keys[at] == want[rows]
            value[rows] = numbers[at]
        return hit, value[hit]


class Trees:
    """Frozen code lengths of all languages: per order a length for every seen gram and a constant for every context.

    A byte that a context has seen has a length of its own. Any other byte has the length that the next shorter context
    gives it, plus a constant of the context: the escape, less the share that the seen bytes had there.
    """

    def __init__(self, languages: list[str], bottom: float, orders: list[tuple[Sorted, Sorted]], folder: str):
        """bottom: the bits of a byte below the empty context; orders: lengths and constants, shortest contexts first; folder: where their files are."""
        self.languages, self.bottom, self.orders, self.folder = languages, bottom, orders, folder

    def remove(self) -> None:
        """Delete the files; nothing can be predicted afterwards."""
        remove(self.folder)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Length of each gram's last byte after those before it: a row per gram, a column per language."""
        out = np.empty((len(gram), len(self.languages)))
        gram = gram.astype(np.int64)
        for k in range(len(self.languages)):
            open_, cost = np.arange(len(gram)), np.zeros(len(gram))
            for order in range(ORDER, -1, -1):
                lengths, constants = self.orders[order]
                want = k << 32 | gram[open_] & ((1 << 8 * (order + 1)) - 1)
                hit, length = lengths.find(want)
                cost[open_[hit]] += length
                open_, want = open_[~hit], want[~hit] >> 8
                known, onward = constants.find(want)
                cost[open_[known]] += onward
            cost[open_] += self.bottom
            out[:, k] = cost
        return out

    def code_lengths(self, texts: list[str], at_once: int = 1 << 19) -> np.ndarray:
        """Bits of each text in each language (rows: texts). Each different gram of a run of texts is looked up once."""
        out = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if held:
                each, where = np.unique(np.concatenate([g for _, g in held]), return_inverse=True)
                bits, at = self.bits(each), 0
                for k, g in held:
                    out[k] += np.bincount(where[at : at + len(g)], minlength=len(each)) @ bits if len(g) > len(each) else bits[where[at : at + len(g)]].sum(axis=0)
                    at += len(g)
                held.clear()

        size = 0
        for k, text in enumerate(texts):
            g = grams(text)
            for j in range(0, len(g), at_once):
                held.append((k, g[j : j + at_once]))
                size += len(held[-1][1])
                if size >= at_once:
                    flush()
                    size = 0
        flush()
        return out


def code_tables(counts: DataFrame, languages: list[str], bottom: float) -> list[DataFrame]:
    """Per order, from the empty context up: key, context, length and onward, a row per language and different gram of that order.

    counts: lang, gram, n. A context has at most 256 different bytes after it, so what meets by context is bounded.
    """
    number = (F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1).cast("long")
    whole = counts.select((F.shiftleft(number, 32)).bitwiseOR(F.col("gram")).alias("whole"), "n")
    of_language, low = F.lit(-1 << 32).cast("long"), lambda bits: F.lit((1 << bits) - 1).cast("long")
    part = lambda c, bits: F.col(c).bitwiseAND(of_language.bitwiseOR(low(bits)))
    out: list[DataFrame] = []
    for order in range(ORDER + 1):
        seen = whole.groupBy(part("whole", 8 * (order + 1)).alias("key")).agg(F.sum("n").cast("double").alias("c"))
        if order:
            shorter = out[-1].select(F.col("key").alias("suffix"), F.col("p").alias("start"))
            seen = seen.withColumn("suffix", part("key", 8 * order)).join(shorter, "suffix")  # every gram's suffix has been seen as well
        else:
            seen = seen.withColumn("start", F.lit(2.0**-bottom))
        seen = seen.withColumn("context", F.shiftright("key", 8))
        w = Window.partitionBy("context")
        total, q = F.sum("c").over(w), F.count("*").over(w)
        rest = F.greatest(1 - F.sum("start").over(w), F.lit(1e-300))  # never 0: a byte never learned is in it
        seen = seen.select("key", "context", "c", total.alias("total"), (q / (total + q)).alias("escape"), rest.alias("rest"))
        p = F.col("c") / F.col("total") * (1 - F.col("escape"))
        out.append(cut(seen.select("key", "context", p.alias("p"), (-F.log2(p)).alias("length"), (F.log2("rest") - F.log2("escape")).alias("onward"))))
    return out


def write_tables(tables: list[DataFrame], folder: str, part_rows: int) -> list[Sorted]:
    """Each table (key, number) in files of about part_rows rows at most; tasks that are run again write files of their own. The driver gets a row per file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        of, key, number = (held.column(k).to_numpy() for k in range(3))
        fs, top = open_store(folder)
        fs.create_dir(top, recursive=True)
        borders = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(borders, borders[1:], strict=False):
            name = f"{of[a]}-{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(f"{top}/{name}") as f:
                f.write(key[a:b].astype("<i8").tobytes())
                f.write(number[a:b].astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([int(of[a])]), pa.array([int(key[a])]), pa.array([f"{folder}/{name}"])], ["of", "first", "path"])

    rows = reduce(DataFrame.unionAll, (t.toDF("key", "number").select(F.lit(k).cast("long").alias("of"), "key", "number") for k, t in enumerate(tables)))
    parts = max(1, -(-rows.count() // part_rows))
    dealt = rows.repartition(1) if parts == 1 else rows.repartitionByRange(parts, "of", "key")
    files = dealt.sortWithinPartitions("of", "key").mapInArrow(write, "of long, first long, path string").collect()
    return [Sorted([(f.first, f.path) for f in files if f.of == k]) for k in range(len(tables))]


def learn(docs: DataFrame, part_rows: int = 1 << 21) -> Trees | None:
    """Trees from all rows of docs (lang, text) where both are not null; None if there are none.

    Every gram of every language counts, however rare it is. The lengths are computed by joins and stay in files of the
    session's shared folder until `Trees.remove`. The driver gets the languages and a row per file of about part_rows rows.
    """
    counts = cut(gram_counts(docs.where("lang IS NOT NULL AND text IS NOT NULL")))
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not languages:
        return None
    bytes_ = F.array(F.lit(_SPACE).cast("long"), *(F.shiftright("gram", s).bitwiseAND(F.lit(255).cast("long")) for s in (24, 16, 8, 0)))
    bottom = math.log2(counts.select(F.explode(bytes_)).distinct().count() + 1)  # below the empty context all bytes are alike; those never learned are one more
    found = code_tables(counts, languages, bottom)
    folder = f"{shared_dir(docs.sparkSession)}/trees-{uuid.uuid4().hex}"
    tables = [t for f in found for t in (f.select("key", "length"), f.groupBy("context").agg(F.max("onward")))]
    got = write_tables(tables, folder, part_rows)
    return Trees(languages, bottom, list(zip(got[::2], got[1::2], strict=True)), folder)


def predict_language(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Each row's doc_id, lang_pred and score, from text alone.

    docs: doc_id (of any type) and text; other columns are ignored. A null text or one without a letter is `und` with score 0, as is
    every text if nothing was learned. score is the language's probability given the code lengths, all languages being
    equally likely before. Equal lengths go to the first language in order of name. Rows come back one for one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trees
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = part.column(1).to_pylist()
                known = [bool(t) and model is not None and any(map(str.isalpha, t)) for t in texts]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if any(known):
                    bits = model.code_lengths([t if ok else "" for t, ok in zip(texts, known, strict=True)])
                    best = bits.argmin(axis=1)
                    share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                    for j in np.flatnonzero(known):
                        lang[j], score[j] = model.languages[best[j]], float(share[j])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {id_type(docs)}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from documents whose crc32(doc_id as text) modulo folds is not 0, then predict every row: doc_id, held_out, lang_pred, score.

    A null doc_id is neither learned from nor held out.
    """
    trees = learn(docs.where(crc_fold(F.col("doc_id"), folds) != 0).select(F.col("lang").cast("string"), F.col("text").cast("string")))
    got = predict_language(docs, trees)
    if trees is not None:
        got = cut(got)
        trees.remove()
    return got.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
