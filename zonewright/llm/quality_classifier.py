"""Operator 3: quality by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics. Per class the mean and covariance are gathered over all learned
rows; a class covariance is shrunk towards the pooled one and then towards a multiple of the identity. Its Cholesky
factor is computed once and kept; a text's score is the sigmoid of the difference of the classes' log densities, that
is of Mahalanobis distances and log determinants, plus the log of the classes' shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, cut, id_type
from .quality_rules import Text

#: The statistics in order. Shares are of words, letters, bytes or lines; all are put on scales where they are roughly normal.
STATISTICS = ("words", "word_length", "symbols", "capitals", "repeated", "repeated_lines", "bare", "distinct", "exclamations", "digits", "stops", "line_length")
_BYTES = {"exclamations": b"!", "digits": b"0123456789", "stops": b".,;:?"}


def statistics(raw: bytes | None) -> list[float]:
    t = Text(raw)
    n, letters = t.n_words, t.n_upper + t.n_lower

    def share(part: float, of: float) -> float:
        """Log odds of a share, kept finite by half a count; counts above 2000 are scaled to it, so that length alone says little."""
        s = min(1.0, 2000 / of) if of else 1.0
        return float(np.log((part * s + 0.5) / (max(of - part, 0) * s + 0.5)))

    count = {k: len(t.raw) - len(t.raw.translate(None, v)) for k, v in _BYTES.items()}
    return [
        float(np.log1p(n)),
        t.word_chars / n if n else 0.0,
        share(t.n_symbols, n + t.n_symbols),
        share(t.n_upper, letters),
        share(t.n_repeat_words, n),
        share(t.n_dup_lines, len(t.lines)),
        share(t.n_bare, n),
        float(np.log((len(set(t.words)) + 1) / (n + 1))),
        share(count["exclamations"], n + count["exclamations"]),
        share(count["digits"], len(t.raw)),
        share(count["stops"], n + count["stops"]),
        float(np.log1p(n / max(len(t.lines), 1))),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of text. Nothing else of a row is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id {id_type(docs)}, x array<double>")


def _solved(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y with low @ y = b for a lower triangle, row by row."""
    y = np.empty_like(b)
    for k in range(len(low)):
        y[k] = (b[k] - low[k, :k] @ y[:k]) / low[k, k]
    return y


class Discriminant:
    """Class means, Cholesky factors and log shares. A class without rows leaves the score at the share of label 1 (0.5 if nothing was learned)."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = 0.2, ridge: float = 0.02):
        """moments: label to (rows, sum of x, sum of outer products). pool and ridge: shares of the pooled covariance and of the identity."""
        n = {k: moments[k][0] if k in moments else 0 for k in (0, 1)}
        self.share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
        self.parts = None
        if not (n[0] and n[1]):
            return
        mean = {k: moments[k][1] / n[k] for k in (0, 1)}
        cov = {k: moments[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)}
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        unit = np.sqrt(np.maximum(np.diag(pooled), 1e-6))  # statistics in units of their spread within classes
        self.unit, self.parts = unit, []
        for k in (0, 1):
            weight = min(1.0, pool + len(unit) / n[k])  # few rows: mostly pooled
            s = ((1 - weight) * cov[k] + weight * pooled) / np.outer(unit, unit)
            s = (1 - ridge) * s + ridge * (np.trace(s) / len(unit)) * np.eye(len(unit))
            low = np.linalg.cholesky(s + 1e-9 * np.eye(len(unit)))
            self.parts.append((mean[k] / unit, low, np.log(np.diag(low)).sum(), np.log(n[k] / (n[0] + n[1]))))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        if self.parts is None:
            return np.full(len(x), self.share)
        z, logs = x / self.unit, []
        for mean, low, log_det, log_share in self.parts:
            d = _solved(low, (z - mean).T)
            logs.append(log_share - log_det - 0.5 * (d * d).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def learn(rows: DataFrame) -> Discriminant:
    """From all rows of (x, quality), by one aggregation into two rows of sums."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    at = lambda i: F.get(F.col("x"), F.lit(i))
    sums = rows.groupBy("quality").agg(F.count("*").alias("n"), F.array(*(F.sum(at(i)) for i in range(d))).alias("s"), F.array(*(F.sum(at(i) * at(j)) for i, j in pairs)).alias("p"))
    moments = {}
    for r in sums.collect():
        outer = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["p"], strict=True):
            outer[i, j] = outer[j, i] = v
        moments[int(r["quality"])] = (float(r["n"]), np.array(r["s"]), outer)
    return Discriminant(moments)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """Each row of docs with doc_id, held_out, score and predicted.

    docs: doc_id (of any type), text; labels: doc_id, quality; other columns are ignored. Learned are labels 0 and 1 of documents whose
    crc32(doc_id as text) modulo folds is not 0; a label given several times counts each time. A null or empty text has the
    statistics of a text of no words and gets a score like any other. A null doc_id is neither learned from nor held
    out. Repeated rows get equal scores. An empty table gives no rows.
    """
    rows = cut(features(docs))
    fold = crc_fold(F.col("doc_id"), folds)
    marks = labels.where("quality IN (0, 1)").select(F.col("doc_id").cast(id_type(docs)).alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    model = rows.sparkSession.sparkContext.broadcast(learn(rows.where(fold != 0).join(marks.where(fold != 0), "doc_id").select("x", "quality")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.value.score(x))], ["doc_id", "score"])

    got = rows.mapInArrow(run, f"doc_id {id_type(docs)}, score double")
    return got.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
