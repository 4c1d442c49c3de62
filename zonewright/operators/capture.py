"""Capture-recapture: two lists (Chapman) and three lists, with bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import chapman, replication, three_list_total


def chapman_point(df: DataFrame, in_a: Column, in_b: Column, n: Column | None = None) -> DataFrame:
    """One row: n_a, n_b, overlap, documented, chapman (null below three in both), factor. n: how many incidents a row stands for, one by default."""
    n = F.lit(1) if n is None else n
    total_where = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    got = df.agg(total_where(in_a).alias("n_a"), total_where(in_b).alias("n_b"), total_where(in_a & in_b).alias("overlap"), total_where(F.lit(True)).alias("documented"))
    total = (F.col("n_a") + 1) * (F.col("n_b") + 1) / (F.col("overlap") + 1) - 1
    enough = F.col("overlap") >= 3
    return got.select("*", F.when(enough, total).alias("chapman"), F.when(enough, total / F.greatest("documented", F.lit(1))).otherwise(F.lit(1.0)).alias("factor"))


def pattern_table(df: DataFrame, flags: list[Column]) -> list[tuple[tuple[bool, ...], int]]:
    """Counts by pattern of flags, in order of pattern; at most 2 ** len(flags) rows reach the driver."""
    got = df.groupBy(*(f.alias(f"f{k}") for k, f in enumerate(flags))).agg(F.count("*").alias("n")).collect()
    return sorted((tuple(bool(x) for x in r[:-1]), int(r[-1])) for r in got)


def _resampled(spark, sizes: list[int], seed: int, replications: int, estimate) -> np.ndarray:
    """estimate(counts per pattern) for each replication: as many rows as there are, drawn with replacement, as one multinomial."""
    total = sum(sizes)
    share = np.array(sizes) / max(total, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rep in b["id"]:
                out.append(estimate(replication(seed, int(rep)).multinomial(total, share)))
            yield pd.DataFrame({"v": pd.Series(out, dtype="float64")})

    got = spark.range(replications).mapInPandas(run, "v double").where("v IS NOT NULL AND NOT isnan(v)").collect()
    return np.sort([r[0] for r in got])


def two_list_estimate(df: DataFrame, in_a: Column, in_b: Column, replications: int = 400) -> dict:
    """Chapman's estimate with the 5 % and 95 % quantiles of its bootstrap (a 90 % interval). Rows in both lists are in the pool twice."""
    table = {p: n for p, n in pattern_table(df.where(in_a | in_b), [in_a, in_b])}
    only_a, only_b, both = (table.get(k, 0) for k in ((True, False), (False, True), (True, True)))
    n_a, n_b = only_a + both, only_b + both
    out = {"method": "not-estimable", "n_a": n_a, "n_b": n_b, "overlap": both, "documented": n_a + n_b - both, "estimated": float(n_a + n_b - both), "low": None, "high": None}
    if both < 3:
        return out
    flags = np.array([[1, 0], [0, 1], [1, 1]])

    def one(n: np.ndarray) -> float | None:
        a, b = n @ flags
        return chapman(a, b, n[2])

    reps = _resampled(df.sparkSession, [only_a, only_b, 2 * both], n_a * 131 + n_b * 17 + both * 7 + 29, replications, one)
    at = lambda k: float(reps[k]) if len(reps) else None
    return out | {"method": "chapman-2list", "estimated": chapman(n_a, n_b, both), "low": at(int(0.05 * len(reps))), "high": at(int(np.ceil(0.95 * len(reps))) - 1)}


def three_list_estimate(df: DataFrame, flags: list[Column], replications: int = 400) -> dict:
    """Independence estimate from three lists with a 95 % bootstrap interval; below eight rows a wide interval instead."""
    table = pattern_table(df, flags)
    seen = sum(n for _, n in table)
    marks = np.array([p for p, _ in table], dtype=np.int64).reshape(-1, 3)
    sizes = [n for _, n in table]
    lists = tuple(int(x) for x in np.array(sizes, dtype=np.int64) @ marks) if sizes else (0, 0, 0)
    both = lambda i, j: int(sum(n for p, n in table if p[i] and p[j]))
    pairs = {f"pair_{i}{j}": chapman(lists[i], lists[j], both(i, j)) for i, j in ((0, 1), (0, 2), (1, 2))}
    if seen < 8:
        return {"documented": seen, "estimated": seen * 1.5, "low": float(seen), "high": seen * 3.0, "confidence": "low"} | pairs
    estimate = max(three_list_total(seen, lists), seen)
    reps = _resampled(df.sparkSession, sizes, seen * 7919 + lists[0] * 31 + 17, replications, lambda n: three_list_total(seen, tuple(n @ marks)))
    low = max(seen, reps[int(0.025 * len(reps))])
    high = max(low + 1, reps[int(np.ceil(0.975 * len(reps))) - 1])
    return {"documented": seen, "estimated": estimate, "low": float(low), "high": float(high), "confidence": "high" if seen >= 25 else "medium" if seen >= 12 else "low"} | pairs
