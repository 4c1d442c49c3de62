"""Spatial scan: circles of zones, likelihood ratios, Monte Carlo p-values, secondary clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import replication
from .entity import checkpointed
from .geo import zones_within

RADII = (40, 80, 130, 200, 280)


def circles(zones: DataFrame, radii: tuple[int, ...] = RADII, most: float = 0.5) -> DataFrame:
    """Circles around each zone: center, radius_km, members (sorted), n_members, population.

    A circle holds at most `most` of the population; of circles with equal members the first stays (lowest center, then
    smallest radius). Members are places, so an array of them is bounded by the zone dimension.
    """
    near = zones_within(zones, max(radii)).join(zones.select(F.col("zone_id").alias("b"), "population"), "b")
    sized = near.select("a", "b", "population", F.explode(F.filter(F.array(*(F.lit(r) for r in radii)), lambda r: r >= F.col("km"))).alias("radius_km"))
    grouped = sized.groupBy(F.col("a").alias("center"), "radius_km").agg(F.sort_array(F.collect_list("b")).alias("members"), F.sum("population").alias("population"))
    total = zones.agg(F.sum("population").alias("_total"))
    capped = grouped.crossJoin(F.broadcast(total)).where(F.col("population") <= F.col("_total") * most)
    first = capped.groupBy("members").agg(F.min(F.struct("center", "radius_km")).alias("f"), F.first("population").alias("population"))
    return first.select("f.center", "f.radius_km", "members", F.size("members").alias("n_members"), "population")


def llr(observed: Column, expected: Column, total: Column, kind: str = "reference") -> Column:
    """Poisson log likelihood ratio of an excess, 0 without one. kind "kulldorff" adds the term of the outside, "reference" leaves it out, as its positive part is 0 for any excess."""
    inside = observed * F.ln(observed / expected)
    if kind == "kulldorff":
        rest, rest_expected = total - observed, total - expected
        inside = inside + F.when((rest > 0) & (rest_expected > 0), rest * F.ln(rest / rest_expected)).otherwise(0.0)
    return F.when(observed <= expected, F.lit(0.0)).otherwise(inside)


def scanned(zones: DataFrame, cases: DataFrame, kind: str = "reference", by: list[str] = []) -> DataFrame:  # noqa: B006
    """Circles with observed, expected, llr and rr. cases: zone_id, cases, and the columns of `by`, for each of whose values the circles are judged."""
    ring = circles(zones)
    inside = ring.select("center", "radius_km", F.explode("members").alias("zone_id")).join(cases, "zone_id").groupBy(*by, "center", "radius_km").agg(F.sum("cases").alias("observed"))
    total = zones.agg(F.sum("population").alias("_p")).crossJoin(cases.groupBy(*by).agg(F.sum("cases").alias("_c")))
    joined = ring.join(inside, ["center", "radius_km"])
    joined = joined.join(total, by) if by else joined.crossJoin(F.broadcast(total))
    o, c = F.col("observed"), F.col("_c")
    e = F.col("population") / F.col("_p") * c
    within, outside = o / F.greatest(e, F.lit(1e-9)), (c - o) / F.greatest(c - e, F.lit(1e-9))
    rr = F.greatest(within / F.greatest(outside, F.lit(1e-9)), F.lit(1.0))
    return joined.select(*by, "center", "radius_km", "members", "n_members", o.alias("observed"), e.alias("expected"), llr(o, e, c, kind).alias("llr"), rr.alias("rr"))


def null_maxima(zones: DataFrame, ring: DataFrame, total_cases: int, replications: int = 999, seed: int = 424242, members_per_task: int = 1 << 20, numbers_at_once: int = 1 << 22) -> DataFrame:
    """rep, llr: the largest ratio of each replication, cases being dealt to zones by population.

    Circles are dealt to tasks by the number of their members. A task adds up the counts that fall into its circles, replication by
    replication, and the largest ratio of all tasks stands. Every task draws the counts of all zones anew (a multinomial, whatever the number of
    cases) from a generator of the replication's own number, so results do not depend on how circles are dealt. The driver and the tasks hold
    an id and a share for each zone, 16 bytes a place; circles stay with the tasks.
    """
    rows = zones.orderBy("zone_id").select("zone_id", F.col("population").cast("double")).toArrow()
    ids, people = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    held = zones.sparkSession.sparkContext.broadcast((ids, people / people.sum()))
    size = ring.agg(F.sum("n_members")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, share = held.value
        circles = [b.column(0) for b in batches if b.num_rows]
        if not circles:
            return
        member = np.searchsorted(ids, np.concatenate([c.flatten().to_numpy() for c in circles]))
        first = np.cumsum([0, *np.concatenate([c.value_lengths().to_numpy() for c in circles])])[:-1]
        expected = np.add.reduceat(share[member], first) * total_cases
        step = max(1, numbers_at_once // max(len(member), len(share)))
        for k in range(0, replications, step):
            reps = np.arange(k, min(k + step, replications))
            counts = np.stack([replication(seed, int(r)).multinomial(total_cases, share) for r in reps])
            o = np.add.reduceat(counts[:, member], first, axis=1)
            ratio = np.where(o > expected, o * np.log(np.maximum(o, 1) / expected), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(ratio.max(axis=1))], ["rep", "llr"])

    dealt = ring.where("n_members > 0").select("members").repartition(max(1, -(-size // members_per_task)))
    return dealt.mapInArrow(run, "rep long, llr double").groupBy("rep").agg(F.max("llr").alias("llr"))


def clusters(zones: DataFrame, cases: DataFrame, replications: int = 999, secondary: int = 2, level: float = 0.05) -> DataFrame:
    """The primary cluster and up to `secondary` more that share no zone with those before, each with its p-value; more only if p is within level.

    Each is the first of the circles that are left, so the driver gets one circle at a time.
    """
    found = checkpointed(scanned(zones, cases).where("llr > 0"))
    total = int(cases.agg(F.sum("cases")).first()[0] or 0)
    chosen, left = [], found
    while len(chosen) <= secondary and (best := left.orderBy(F.desc("llr"), "center", "radius_km").first()) is not None:
        chosen.append(best)
        left = left.where(~F.arrays_overlap("members", F.array(*map(F.lit, best.members))))
    spark = zones.sparkSession
    schema = "rank int, center int, radius_km int, members array<int>, observed long, expected double, rr double, llr double, p double"
    if not chosen:
        return spark.createDataFrame([], schema)
    null = null_maxima(zones, checkpointed(circles(zones)), total, replications)
    reached = null.agg(*(F.count_if(F.col("llr") >= c["llr"] - 1e-9).alias(str(k)) for k, c in enumerate(chosen))).first()
    out = [(k, c["center"], c["radius_km"], c["members"], c["observed"], c["expected"], c["rr"], c["llr"], (1 + reached[k]) / (replications + 1)) for k, c in enumerate(chosen)]
    return spark.createDataFrame([r for r in out if r[0] == 0 or r[-1] <= level], schema)
