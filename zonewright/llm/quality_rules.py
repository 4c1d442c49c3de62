"""Operator 5: quality rules as a short-circuit cascade, ordered by measured rejection per cost.

A rule is a predicate over one text's measures. Measures are computed when a rule first asks for them and then kept,
so a text rejected by an early rule never pays for what only later rules need. The order is found on a bounded
sample of rows: each rule's seconds per text and share of rejected texts; rules run by rejections per second,
highest first. The order decides the time, never the verdict.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type

SYMBOLS = b"#*$%&|<>"
_LETTERED = re.compile(rb"[A-Za-z\x80-\xff]").search


class Text:
    """Measures of one text. Words are runs of bytes other than space and tab to carriage return."""

    def __init__(self, text: bytes | None):
        self.raw = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes split at ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that have a word."""
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that occur twice or more in the text."""
        n = self.n_words
        if n < 4:
            return 0
        codes: dict[bytes, int] = {}
        a = np.fromiter((codes.setdefault(w, len(codes)) for w in self.words), dtype=np.int64, count=n)
        pair = a[:-1] * len(codes) + a[1:]
        if len(codes) > 1_000_000:  # keeps three codes within 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        _, which, times = np.unique(pair[:-1] * len(codes) + a[2:], return_inverse=True, return_counts=True)
        start = times[which] > 1
        hit = np.zeros(n, dtype=bool)
        for k in range(3):
            hit[k : k + len(start)] |= start
        return int(hit.sum())

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, bytes(range(65, 91))))

    @cached_property
    def n_lower(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, bytes(range(97, 123))))

    @cached_property
    def n_bare(self) -> int:
        """Words without any letter A-Z, a-z or non-ASCII character."""
        return sum(not _LETTERED(w) for w in self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


EMPTY = Rule("empty", lambda t: t.n_words == 0)
REPEATS = Rule("repeats", lambda t: 100 * t.n_repeat_words > 50 * t.n_words)
#: The base of the contract: too short, or mostly repeated.
BASE = (
    Rule("too_short", lambda t: t.n_words < 50),
    REPEATS,
)
#: The method's own rules. All are ratios of whole numbers, so SQL states them alike.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("capitals", lambda t: 10 * t.n_upper > 4 * (t.n_upper + t.n_lower)),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 6 * len(t.lines)),
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 12 * t.n_words),
    Rule("bare_words", lambda t: 10 * t.n_bare > 3 * t.n_words),
)


def cascade_order(rules: tuple[Rule, ...], sample: list[bytes | None], base: tuple[Rule, ...] = (), clock: Callable[[], float] = time.perf_counter) -> list[Rule]:
    """Rules by rejections per second on the sample, each given those before it; ties stay in the given order.

    A rule is measured on the texts that base and the rules chosen so far let pass, with what these have computed already
    at hand, so it is charged for what it adds and credited with what it alone rejects.
    """
    left, order = list(rules), []
    passing = [x for x in sample if not any(r.rejects(Text(x)) for r in base)]
    while left and passing:
        rate, stays = [], []
        for rule in left:
            texts = [Text(x) for x in passing]
            for t in texts:
                for r in (*base, *order):
                    r.rejects(t)
            began = clock()
            rejected = [bool(rule.rejects(t)) for t in texts]
            rate.append(sum(rejected) / max(clock() - began, 1e-9))
            stays.append([x for x, r in zip(passing, rejected, strict=True) if not r])
        best = max(range(len(left)), key=lambda k: rate[k])
        order.append(left.pop(best))
        passing = stays[best]
    return order + left


def first_rejecting(rules: list[Rule], text: Text) -> str | None:
    return next((r.name for r in rules if r.rejects(text)), None)


def sample_texts(docs: DataFrame, rows: int) -> list[bytes | None]:
    """Up to `rows` texts, from all over the table where it is large enough. They only set the order of rules."""
    texts = docs.select(F.col("text").cast("string").cast("binary"))
    got = texts.sample(False, 0.02, 7).limit(rows).collect()
    return [bytes(r[0]) if r[0] is not None else None for r in (got if len(got) >= rows // 4 else texts.limit(rows).collect())]


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, sample_rows: int = 200, measures: bool = True) -> DataFrame:
    """Each row of docs with its verdict: the columns of docs' doc_id and text's measures, base_failed, failed_rule and kept.

    docs: doc_id (of any type) and text; other columns are ignored. failed_rule is the first in the measured order that rejects, so
    of several that do, which one is named depends on the timings; base_failed and kept do not. Rows come back one for one, repeated rows and null ids too.
    A null or empty text has no words and fails the base. measures: False leaves out the base measures, so that
    base rules join the cascade and nothing is computed that no rule asked for. An empty table gives no rows.
    """
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        _judge(ordered_rules(docs, rules, base, sample_rows, measures), base if measures else (), measures),
        f"doc_id {id_type(docs)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, failed_rule string, kept boolean" if measures else f"doc_id {id_type(docs)}, failed_rule string, kept boolean",
    )


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...], base: tuple[Rule, ...], sample_rows: int, measures: bool) -> list[Rule]:
    return cascade_order(rules, sample_texts(docs, sample_rows), base) if measures else cascade_order((*base, *rules), sample_texts(docs, sample_rows))


def _judge(order: list[Rule], base: tuple[Rule, ...], measures: bool):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8 if measures else 2)]
            for raw in batch.column(1):
                t = Text(raw.as_py())
                failed = any(r.rejects(t) for r in base)
                rule = "base" if failed else first_rejecting(order, t)
                row = (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, rule, rule is None) if measures else (rule, rule is None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.bool_()] if measures else [pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", "kept"] if measures else ["doc_id", "failed_rule", "kept"]
    return judge


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, sample_rows: int = 200) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns as they are. One pass, no shuffle."""
    verdict = F.pandas_udf(_verdict(ordered_rules(docs, rules, base, sample_rows, False)), "boolean")
    return docs.where(verdict(F.col("text").cast("string").cast("binary")))


def _verdict(order: list[Rule]):
    import pandas as pd

    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([first_rejecting(order, Text(x)) is None for x in texts], dtype=bool)

    kept.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return kept
